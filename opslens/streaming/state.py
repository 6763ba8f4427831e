"""Suppression of repeated events: a key's newest time is all its state.

Keys are dealt to a fixed number of lots, and a lot is what Spark calls a group: a call
handles thousands of keys at once, and its state is a packed table of their newest times.
Rows of a key must not arrive in a later micro-batch than newer ones.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

# Executors get the functions below with the tasks; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LAST_SEEN_STATE = "seen binary"
#: Part of the state's layout: a job goes on from its checkpoint only with the same number.
LOTS = 512
#: What the rows carry besides their own columns.
KEY, LOT = "_key", "_lot"
NEVER = np.iinfo(np.int64).min // 2


def _packed(seen: dict[str, int]) -> bytes:
    batch = pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["key", "newest"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> dict[str, int]:
    keys, newest = pa.ipc.open_stream(held).read_all().columns
    return dict(zip(keys.to_pylist(), newest.to_pylist()))


def first_of_equals(ts: str, quiet_seconds: int):
    """Rows of a key with none of that key in the time before them; the state is the newest time of each key.

    Of a micro-batch only stretches of a key without a quiet time are held, with their first
    row, per chunk. A key's newest time is forgotten when the watermark has passed its quiet time.
    """
    quiet = quiet_seconds * 1_000_000

    def stretches(chunk: pd.DataFrame, numbers: dict[str, int]) -> pd.DataFrame:
        own, names = pd.factorize(chunk[KEY])
        key = np.array([numbers.setdefault(name, len(numbers)) for name in names], np.int64)[own]
        at = chunk[ts].to_numpy().astype("datetime64[us]").astype(np.int64)
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(key) != 0) | (np.diff(at) > quiet))))
        ends = np.append(starts[1:], len(at)) - 1
        return chunk.iloc[order[starts]].drop(columns=[KEY, LOT]).assign(_number=key[starts], _first=at[starts], _last=at[ends])

    def run(lot: tuple, chunks: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = _unpacked(state.get[0]) if state.exists else {}
        numbers: dict[str, int] = {}
        found = [stretches(chunk, numbers) for chunk in chunks if len(chunk)]
        if not found:
            return
        rows = pd.concat(found, ignore_index=True).sort_values(["_number", "_first"], kind="stable", ignore_index=True)
        key, first = rows["_number"].to_numpy(), rows["_first"].to_numpy()
        reach = rows.groupby("_number")["_last"].cummax().to_numpy()
        head = np.concatenate(([True], np.diff(key) != 0))
        known = np.array([seen.get(name, NEVER) for name in numbers], np.int64)  # in the order of their numbers, as the heads are
        before = np.concatenate(([0], reach[:-1]))
        before[head] = known
        newest = np.maximum(reach[np.append(head[1:], True)], known)
        seen.update(zip(numbers, newest.tolist()))
        now = state.getCurrentWatermarkMs()
        seen = {name: time for name, time in seen.items() if (time + quiet) // 1000 >= now}
        if seen:
            state.update((_packed(seen),))
            state.setTimeoutTimestamp(max(max(seen.values()) // 1000 + quiet // 1000, now + 1))
        elif state.exists:
            state.remove()
        yield rows[first - before > quiet].drop(columns=["_number", "_first", "_last"])

    return run
