"""Personal data by candidate gradient boosting.

Generators with high recall propose spans that may overlap: the four base rules, and
looser forms of each (an address with written-out ``at`` and ``dot``, digits in groups
with any separators). A candidate is described by its format and by the words around
it; boosted trees score it, and a threshold per kind, calibrated on examples the trees
have not seen, decides. Base spans always stay; accepted candidates are added where they
overlap neither a base span nor a better candidate.

The trees learn from two sets: what the base rules match in all documents, labelled by
the rules' own checks, and a fixed list of made-up forms of the kinds the base rules do
not cover. Equal examples are one row with a count. Only sums per node, feature and bin
reach the driver; they are whole numbers, so the order in which they are added does not
matter. Where the distinct examples are few they are kept on the driver and added up
there, else Spark adds them up, a job per level of a tree, with the same sums. All
examples of the documents together weigh at most as much as the made-up ones. Trees
travel to the tasks as small arrays.

Defined cases: a null text is empty; digits of any length are compared without being
turned into numbers; repeated rows each get their own result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opslens.llm.common import bounded_batches, written

#: The base patterns, in the order in which kinds are listed.
KINDS = ["email", "ip", "card", "phone"]
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),  # a match always starts where its digits do
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Looser forms. Only these propose more than the base rules do.
LOOSE = {
    "ip": re.compile(r"[0-9]{1,3}(?: ?[.] ?[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]{4}(?:[ .\-/]?[0-9]{2,6}){2,4}"),
    "phone": re.compile(r"(?:\+|\b00)?[ ]?\(?[0-9]{2,4}\)?(?:[ .\-/]{0,2}\(?[0-9]{2,4}\)?){2,4}"),
}
CUES = {
    "email": {"email", "mail", "e-mail", "write", "contact", "address"},
    "ip": {"ip", "host", "server", "address", "from"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "payment"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "whatsapp"},
    "other": {"version", "v", "section", "isbn", "order", "invoice", "no", "number", "page", "id", "date", "total", "figure"},
}
DIGITS = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
#: An address is found from its 'at', as it is or written out: the name before it, read backwards, and the domain behind it.
AT = re.compile(r"@| ?\(at\) ?| ?\[at\] ?| at ", re.I | re.A)
NAME_BACK = re.compile(r"[A-Z0-9_%+-]++(?:(?:\.| tod | ?\)tod\( ?| ?\]tod\[ ?)[A-Z0-9_%+-]++)*", re.I | re.A)
LOOSE_DOMAIN = re.compile(r"[A-Z0-9-]++(?:(?:\.| dot | ?\(dot\) ?| ?\[dot\] ?)[A-Z0-9-]++)+", re.I | re.A)
REACH = 64  # characters read at first; more where the name goes on
MARK = 8  # a mark between two parts and the first character of the next
GROUPS = re.compile(r"[0-9]+")
WORDS = re.compile(r"[A-Za-z-]+")
CONTEXT = 40
SPELLED_DOT = re.compile(r" dot |\(dot\)|\[dot\]")
NEXT_SENTENCE = re.compile(r"[a-z]\.[A-Z][a-z]")
DATE_FIRST = re.compile(r"(?:19|20)[0-9]{2}[-/.](?:0[1-9]|1[0-2])[-/.][0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def small_octets(groups: list[str]) -> bool:
    return all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in groups)


def base_holds(kind: str, span: str) -> bool:
    """Whether a match of a base pattern passes its check."""
    if kind == "email":
        return True
    if kind == "ip":
        return small_octets(span.split("."))
    digits = "".join(GROUPS.findall(span))
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What the base pattern of addresses finds, in time that grows with the text: from each @ back, then on."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Matches of the base patterns that pass their check, and those that fail it."""
    good, bad = [], []
    has = {"email": "@" in text, "phone": "+" in text}
    if not has["email"] and not DIGITS.search(text):
        return good, bad
    good += [("email", s, e) for s, e in emails(text)]
    for kind in KINDS[1:]:
        if has.get(kind, True):
            for m in BASE[kind].finditer(text):
                (good if base_holds(kind, m.group()) else bad).append((kind, m.start(), m.end()))
    return good, bad


def loose_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses around every 'at', whole whatever their length, in time that grows with the text."""
    for at in AT.finditer(text):
        domain = LOOSE_DOMAIN.match(text, at.end())
        reach = REACH
        while domain:
            back = text[max(0, at.start() - reach):at.start()][::-1]
            name = NAME_BACK.match(back)
            if name and name.end() + MARK > len(back) and reach < at.start():
                reach *= 2
                continue
            if name:
                yield at.start() - name.end(), domain.end()
            break


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that any looser pattern proposes."""
    found = [("email", s, e) for s, e in loose_emails(text)]
    if DIGITS.search(text):
        for kind in ("ip", "card", "phone"):
            found += [(kind, m.start() + len(m.group()) - len(m.group().lstrip()), m.end()) for m in LOOSE[kind].finditer(text)]
    return found


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span, then its context."""
    span = text[start:end]
    folded = span.lower()
    groups = GROUPS.findall(span)
    digits = "".join(groups)
    before, after = text[max(0, start - CONTEXT):start], text[end:end + 12]
    words = [w.lower() for w in WORDS.findall(before)[-4:]]
    sizes = [len(g) for g in groups] or [0]
    own = KINDS.index(kind)
    return [
        *[float(own == i) for i in range(len(KINDS))],
        len(span), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        span.count("."), span.count("-"), span.count(" "), span.count("/"), "(" in span and ")" in span,
        span.startswith("+") or span.startswith("00"), "@" in span or "(at)" in folded or "[at]" in folded,
        " at " in folded and " dot " in folded, bool(digits) and len(digits) <= 30 and luhn(digits),
        len(groups) == 4 and small_octets(groups), len(set(sizes)) == 1, int(digits[:1] or 0),
        *[any(w in CUES[k] for w in words) for k in (*KINDS, "other")],
        before[-1:].isalnum() or before[-1:] in ("-", ".", "/", "_", "+") and before[-1:] != "",
        after[:1].isalnum() or (after[:1] in ("-", "/", "_", ".") and after[1:2].isalnum()),
        any(w in CUES[kind] for w in words),
        "www." in folded, bool(SPELLED_DOT.search(folded)), bool(NEXT_SENTENCE.search(span)), bool(DATE_FIRST.match(span)),
        after[:1] in (":", ",") and after[1:2].isdigit(), sum(not g.strip("0") for g in groups),
        len(groups) > 2 and sizes[0] <= 3 and set(sizes[1:]) == {3},
    ]


#: Sums are counted in these units, so that they are whole numbers; scores are counted in steps of a grid.
UNIT, GRID = float(1 << 36), 4096
LARGEST = 255  # features are whole numbers; larger ones count as this in examples


@dataclass
class Examples:
    """Distinct examples: bytes of features, label, weight, and whether they are held out of the fit."""
    x: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    held: np.ndarray


class Boosted:
    """Boosted trees for two classes over binned features: Newton steps on the log loss, shallow greedy trees.

    The fit sees its examples only through ``added``, which applies a function from
    examples to (slot, sums) to all of them and adds up the sums per slot.
    """

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 16, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0
        self.cuts: list[np.ndarray] = []

    def values(self, rows: Examples) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight by feature and value, and by label."""
        fit = ~rows.held
        x, w, y = rows.x[fit].astype(np.int64), np.rint(rows.weight[fit] * UNIT), rows.y[fit]
        wide = x.shape[1]
        slot = (np.arange(wide) * (LARGEST + 1) + x).ravel()
        total = np.bincount(slot, np.repeat(w, wide), wide * (LARGEST + 1))
        return _filled(np.append(total, 0), np.append(np.zeros(len(total)), (w * y).sum()))

    def level(self, rows: Examples, tree: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slopes and curves by node of a level, feature and bin."""
        at = np.zeros(len(rows.y), dtype=np.int64)
        for _ in range(depth):
            at = np.where(at >= 0, self._step(tree, rows.x, np.maximum(at, 0)), -1)
        use = (at >= 0) & ~rows.held
        x, y, w, at = rows.x[use], rows.y[use], rows.weight[use], at[use] - ((1 << depth) - 1)
        p = self.score(x)
        slope, curve = np.rint(w * (p - y) * UNIT), np.rint(w * (p * (1 - p) + 1e-6) * UNIT)
        slots = (1 << depth) * self.bins
        both = [[np.bincount(at * self.bins + np.searchsorted(cuts, x[:, j], side="left"), v, slots) for v in (slope, curve)] for j, cuts in enumerate(self.cuts)]
        return _filled(*[np.concatenate([b[k] for b in both]) for k in (0, 1)])

    def grid(self, rows: Examples) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight and weight of the true ones by kind and step of the score, of the examples that are held out."""
        x, y, w = rows.x[rows.held], rows.y[rows.held], np.rint(rows.weight[rows.held] * UNIT)
        slot = x[:, :len(KINDS)].argmax(axis=1) * (GRID + 1) + np.floor(self.score(x) * GRID).astype(np.int64)
        return _filled(*[np.bincount(slot, v, len(KINDS) * (GRID + 1)) for v in (w, w * y)])

    def fit(self, added, width: int) -> "Boosted":
        total, true = added(self.values, width * (LARGEST + 1) + 1)
        total, true = total[:-1].reshape(width, -1), true[-1]
        all_ = total[0].sum()
        shares = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.searchsorted(np.cumsum(t), shares * all_)).astype(float) for t in total]
        rate = min(max(float(true / all_), 0.01), 0.99)
        self.start = float(np.log(rate / (1 - rate)))
        for _ in range(self.rounds):
            self.trees.append(self._tree(added))
        return self

    def _tree(self, added):
        size = (1 << (self.depth + 1)) - 1
        feature, cut, value = tree = np.full(size, -1), np.zeros(size), np.zeros(size)
        newton = lambda g, h: -self.rate * g / (h + self.least)
        for depth in range(self.depth):
            nodes = [n for n in range((1 << depth) - 1, (2 << depth) - 1) if not n or feature[(n - 1) // 2] >= 0]
            if not nodes:
                break
            slope, curve = added(lambda rows: self.level(rows, tree, depth), len(self.cuts) * (1 << depth) * self.bins)  # noqa: B023
            slope, curve = (v.reshape(len(self.cuts), 1 << depth, self.bins) / UNIT for v in (slope, curve))
            for node in nodes:
                own_g, own_h = slope[:, node - ((1 << depth) - 1)], curve[:, node - ((1 << depth) - 1)]
                g, h = own_g[0].sum(), own_h[0].sum()
                value[node] = newton(g, h)
                best = (1e-6, -1, 0, 0.0, 0.0)
                for j, cuts in enumerate(self.cuts):
                    if not len(cuts):
                        continue
                    left_g, left_h = own_g[j].cumsum()[:len(cuts)], own_h[j].cumsum()[:len(cuts)]
                    gain = left_g ** 2 / (left_h + self.least) + (g - left_g) ** 2 / (h - left_h + self.least) - g ** 2 / (h + self.least)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k, left_g[k], left_h[k])
                if best[1] >= 0:
                    feature[node], cut[node] = best[1], self.cuts[best[1]][best[2]]
                    value[2 * node + 1], value[2 * node + 2] = newton(best[3], best[4]), newton(g - best[3], h - best[4])
        return tree

    @staticmethod
    def _step(tree, x, at):
        """The node below, or -1 below a leaf."""
        feature, cut, _ = tree
        right = x[np.arange(len(x)), np.maximum(feature[at], 0)] > cut[at]
        return np.where(feature[at] >= 0, 2 * at + 1 + right, -1)

    @classmethod
    def _walk(cls, tree, x):
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            below = cls._step(tree, x, at)
            if not (below >= 0).any():
                return tree[2][at]
            at = np.where(below >= 0, below, at)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += self._walk(tree, x)
        return 1 / (1 + np.exp(-total))


def _filled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    slot = np.flatnonzero((a != 0) | (b != 0))
    return slot, a[slot], b[slot]


def made_up(n: int = 4000, seed: int = 11) -> list[tuple[list[float], str, int]]:
    """Forms the base rules miss, and look-alikes that are no personal data: (features, kind, label).

    A form may say, behind a zero byte, what follows it in the text.
    """
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda k: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(k))

    def card(valid: bool) -> str:
        digits = "4" + d(14)
        return digits + next(c for c in "0123456789" if luhn(digits + c) == valid)

    def grouped(digits: str, mark: str) -> str:
        return mark.join(digits[i:i + 4] for i in range(0, len(digits), 4))

    octets = lambda: ".".join(str(r.randrange(1, 256)) for _ in range(4))
    good = [
        ("email", lambda: f"{name(5)}{r.choice([' (at) ', ' [at] ', '(at)', ' at '])}{name(6)}{r.choice([' dot ', ' (dot) ', ' [dot] '])}com"),
        ("email", lambda: f"{name(5)}.{name(4)}@{name(6)}.org"),
        ("email", lambda: f"{name(5)}{r.choice([' (at) ', ' [at] ', '(at)', '[at]', ' (AT) ', '[AT]'])}{name(6)}.{r.choice(['org', 'com', 'co.uk'])}"),
        ("email", lambda: f"{name(5)}{r.choice(['.' + name(5), ' dot ' + name(4), ''])}{r.choice([' AT ', ' (AT) ', ' at '])}"
                          f"{name(7)}{r.choice([' DOT ', ' dot ', ' (DOT) '])}{r.choice(['net', name(9) + ' dot org'])}"),
        ("phone", lambda: f"({d(3)}) {d(3)}-{d(4)}"), ("phone", lambda: f"{d(3)}-{d(3)}-{d(4)}"),
        ("phone", lambda: f"0{d(3)}/{d(3)} {d(4)}"), ("phone", lambda: f"+{d(2)} {d(3)} {d(3)} {d(4)}"),
        ("card", lambda: grouped(card(True), r.choice(".-/ "))), ("card", lambda: card(True)),
        ("ip", octets), ("ip", lambda: octets().replace(".", " . ")),
    ]
    bad = [
        ("email", lambda: f"{name(4)} at {name(5)}.{name(3)}"), ("email", lambda: f"{name(4)} at the dot {name(4)}"),
        ("phone", lambda: f"20{d(2)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}"), ("phone", lambda: d(r.randrange(6, 13))),
        ("phone", lambda: f"{d(2)} {d(3)} {d(3)}"), ("phone", lambda: f"{d(3)}.{d(3)}.{d(3)}"), ("phone", lambda: card(False)), ("phone", octets),
        ("phone", lambda: f"978-{d(2)}-{d(4)}"), ("card", lambda: grouped(card(False), r.choice("-/ "))), ("card", lambda: card(False)),
        ("card", lambda: f"20{d(2)}-{d(2)}-{d(2)}"), ("card", lambda: d(12)), ("ip", lambda: f"{d(1)}.{d(1)}.{r.randrange(300, 999)}.{d(2)}"),
        ("ip", lambda: f"{r.randrange(1, 5)} . {d(1)} . {r.randrange(300, 999)} . 0"),
        # a host behind the word "at", the end of one sentence and the start of the next, names of files
        *[("email", lambda: f"{name(r.randrange(2, 9))} at www.{name(r.randrange(3, 10))}.{r.choice(['com', 'org', 'de'])}")] * 2,
        *[("email", lambda: f"{name(r.randrange(2, 9))} at {name(r.randrange(3, 9))}.{name(r.randrange(2, 9)).capitalize()}")] * 2,
        ("email", lambda: f"{name(r.randrange(2, 9))} at {name(r.randrange(3, 9))}.{r.choice(['csv', 'txt', 'com', 'html', 'pdf'])}"),
        # times of logs, and amounts in groups of three
        *[(kind, lambda: f"20{d(2)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d} {r.randrange(24):02d}\0:{r.randrange(60):02d}:{d(2)}.{d(3)}") for kind in ("phone", "card")],
        *[(kind, lambda: r.choice([d(1), d(2), d(3)]) + r.choice([" ", "."]).join([""] + [r.choice([d(3), "000"]) for _ in range(r.randrange(2, 6))])) for kind in ("phone", "card", "phone")],
        *[(kind, lambda: f"{r.randrange(1, 999)}" + " 000" * r.randrange(2, 6)) for kind in ("phone", "card")],
    ]
    cue = {kind: sorted(words) for kind, words in CUES.items()}
    found = []
    for i in range(n):
        label = i % 2
        kind, form = r.choice(good if label else bad)
        words = [name(4), r.choice(cue[kind if label else "other"]) if r.random() < 0.5 else name(3)]
        before = " ".join(words) + r.choice([" ", ": ", " "])
        span, _, rest = form().partition("\0")
        found.append((features(before + span + (rest or " " + name(4)), kind, len(before), len(before) + len(span)), kind, label))
    return found


@dataclass
class Model:
    trees: Boosted
    thresholds: dict[str, float]


EXAMPLE = "x binary, label int, held boolean"


def example(text: str, kind: str, start: int, end: int, label: int) -> tuple[bytes, int, bool]:
    """Features, label, and whether it is held out; copies of a passage are on one side."""
    around = text[max(0, start - CONTEXT):end + 12].encode("utf-8", "surrogatepass")
    return bytes(min(LARGEST, int(v)) for v in features(text, kind, start, end)), label, zlib.crc32(around) % 3 == 0


def examples(documents: DataFrame) -> DataFrame:
    """(x, label, held, n): what the base rules match in all documents and whether it passes their check; n times each."""
    chosen = documents.filter(F.col("text").contains("@") | F.col("text").rlike("[0-9]{2}")).select("text")  # others have no match

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                good, bad = base_spans(text or "")
                rows += [example(text, k, s, e, 1) for k, s, e in good]
                taken = _Taken()
                for _, s, e in sorted(good, key=lambda g: g[1]):
                    taken.add(s, e)
                rows += [example(text, k, s, e, 0) for k, s, e in bad if taken.free(s, e)]
            if rows:
                x, label, held = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(x, pa.binary()), pa.array(label, pa.int32()), pa.array(held)], names=["x", "label", "held"])

    return chosen.mapInArrow(run, EXAMPLE).groupBy("x", "label", "held").agg(F.count(F.lit(1)).alias("n"))


def fitted(documents: DataFrame, precision: float = 0.98, local: int = 50_000) -> Model:
    """The trees and their thresholds, from the matches of the base rules in all documents and the made-up forms.

    A kind's threshold is the lowest score from which held-out examples reach ``precision``,
    and never below one half: where it is one half, they are that precise down to there, as
    made-up forms and look-alikes are told apart well. ``local`` distinct examples are
    added up on the driver; if there are more, Spark does it.
    """
    table = written(examples(documents), "pii-examples")
    count, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    invented = made_up()
    width = len(invented[0][0])
    share = min(1.0, len(invented) / total) if total else 1.0

    def rows(batch: pa.Table | pa.RecordBatch) -> Examples:
        x = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(-1, width)
        return Examples(x, batch.column(1).to_numpy().astype(float), batch.column(3).to_numpy() * share,
                        np.array(batch.column(2).to_pylist(), dtype=bool))

    own = Examples(np.array([[min(LARGEST, v) for v in x] for x, _, _ in invented]).astype(np.uint8), np.array([y for _, _, y in invented], dtype=float),
                   np.ones(len(invented)), np.arange(len(invented)) % 3 == 0)
    parts = [own] + ([rows(table.toArrow())] if 0 < count <= local else [])

    def added(sums, slots: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums per slot over all examples."""
        out = np.zeros((2, slots))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot, a, b = sums(rows(batch))
                yield pa.record_batch([pa.array(slot), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["slot", "a", "b"])

        found = [sums(part) for part in parts]
        if count > local:
            whole = table.mapInArrow(run, "slot long, a long, b long").groupBy("slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
            found.append(tuple(c.to_numpy() for c in whole.columns))
        for slot, a, b in found:
            out[0, slot] += a
            out[1, slot] += b
        return out[0], out[1]

    trees = Boosted().fit(added, width)
    weight, true = (v.reshape(len(KINDS), GRID + 1)[:, ::-1].cumsum(axis=1) for v in added(trees.grid, len(KINDS) * (GRID + 1)))
    thresholds = {}
    for kind, all_, good in zip(KINDS, weight, true, strict=True):
        reached = np.flatnonzero((good >= precision * all_) & (all_ > 0))
        thresholds[kind] = max(0.5, (GRID - int(reached[-1])) / GRID) if len(reached) else 1.1
    return Model(trees, thresholds)


class _Taken:
    """Disjoint stretches of a text, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.ends, start)  # the first stretch that ends behind the start
        return i == len(self.starts) or self.starts[i] >= end

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_right(self.ends, start)
        j = bisect.bisect_left(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]


def redactions(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the candidates the model adds to them."""
    base, _ = base_spans(text)
    taken = _Taken()
    for _, s, e in sorted(base, key=lambda b: b[1]):
        taken.add(s, e)
    open_ = [c for c in candidates(text) if taken.free(c[1], c[2])]
    if not open_:
        return base, []
    score = model.trees.score(np.array([features(text, *c) for c in open_], dtype=float))
    added: list[tuple[str, int, int]] = []
    for i in sorted(range(len(open_)), key=lambda i: (-score[i], open_[i][1], KINDS.index(open_[i][0]))):
        kind, s, e = open_[i]
        if score[i] >= model.thresholds[kind] and taken.free(s, e):
            added.append(open_[i])
            taken.add(s, e)
    return base, added


def joined(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, last = [], 0
    for kind, s, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if s >= last:
            out += [text[last:s], f"[{kind.upper()}]"]
        last = max(last, e)
    return "".join(out) + text[last:]


def scan(documents: DataFrame, model: Model | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_added and, if asked for, redacted_text."""
    bounded_batches(documents.sparkSession)
    model = model or fitted(documents)
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()),
                        ("spans", pa.string()), ("n_added", pa.int64())] + ([("redacted_text", pa.string())] if with_text else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                base, added = redactions(text, model)
                row = (doc_id, *[sum(k == kind for k, _, _ in base) for kind in KINDS],
                       hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added))
                rows.append(row + ((redacted(text, base + added),) if with_text else ()))
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    types = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = narrow.mapInArrow(run, types + (", redacted_text string" if with_text else ""))
    return result.select(*names, *(["redacted_text"] if with_text else []))
