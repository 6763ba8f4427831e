"""Event XML: one parse per row into a struct, then plain field access."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NODE = "struct<_name: string, value: string, text: string>"
EVENT_COLUMNS = f"_name string, _timestamp string, data array<{_NODE}>, action array<{_NODE}>"
EVENT = f"struct<{EVENT_COLUMNS}>"
RING_TARGET = f"struct<event: array<{EVENT}>>"
SCHEDULER_RECORD = (
    "struct<_id: long, SchedulerMonitorEvent: struct<SystemHealth: "
    "struct<SystemIdle: long, ProcessUtilization: long>>>"
)
PROPERTY_BAG = "struct<Object: array<struct<Property: array<struct<_Name: string, _VALUE: string>>>>>"


def parse(c: Column, schema: str) -> Column:
    return F.from_xml(c, schema)


def event_time(event: Column) -> Column:
    return F.replace(F.replace(event["_timestamp"], F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit("")) \
        .cast("timestamp_ntz")


#: Fixed value: what stands before the time in the tag that a document begins with.
TIME_MARK = 'timestamp="'


def maybe_since(document: Column, bound: Column) -> Column:
    """False for a document whose first tag carries a time before the bound; the text is scanned, not parsed.

    Times are compared as text, to the second. A tag without the mark begins with ``<``,
    which is behind every digit, so such a document stays, for the parser to judge.
    """
    tag = F.substring_index(F.ltrim(document), ">", 1)
    at = F.translate(F.substring_index(tag, TIME_MARK, -1), " ", "T")
    return at >= F.date_format(bound, "yyyy-MM-dd'T'HH:mm:ss")


def nth(event: Column, kind: str, position: int) -> Column:
    """The n-th ``value`` or ``text`` node of all data nodes, in document order."""
    present = F.filter(event["data"], lambda node: node[kind].isNotNull())
    return F.get(present, F.lit(position - 1))[kind]


def named(event: Column, name: str, kind: str = "value", group: str = "data") -> Column:
    """``value`` or ``text`` of the first node with a given name attribute."""
    found = F.filter(event[group], lambda node: node["_name"] == name)
    return F.get(found, F.lit(0))[kind]


def named_all(event: Column, name: str) -> Column:
    """Whole text content of the first data node with a given name attribute."""
    found = F.get(F.filter(event["data"], lambda node: node["_name"] == name), F.lit(0))
    return F.when(found.isNotNull(),
                  F.concat(F.coalesce(found["value"], F.lit("")), F.coalesce(found["text"], F.lit(""))))
