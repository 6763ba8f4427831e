"""Two spellings of the few expressions Spark SQL and DuckDB write differently."""

from __future__ import annotations


class SparkSpelling:
    def idiv(self, a: str, b: str | int) -> str:
        return f"(({a}) div {b})"

    def add_seconds(self, ts: str, n: str) -> str:
        return f"timestampadd(SECOND, {n}, {ts})"

    def json_int(self, column: str, key: str) -> str:
        return f"CAST(get_json_object({column}, '$.{key}') AS BIGINT)"

    def stamp(self, text: str) -> str:
        return f"TIMESTAMP_NTZ'{text}'"

    def binary(self, hex_text: str) -> str:
        return f"unhex({hex_text})"

    def millis_text(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss.SSS')"

    def seconds_between(self, a: str, b: str) -> str:
        return f"(unix_seconds(CAST({b} AS TIMESTAMP)) - unix_seconds(CAST({a} AS TIMESTAMP)))"


class DuckSpelling:
    def idiv(self, a: str, b: str | int) -> str:
        return f"(({a}) // {b})"

    def add_seconds(self, ts: str, n: str) -> str:
        return f"({ts} + to_seconds({n}))"

    def json_int(self, column: str, key: str) -> str:
        return f"CAST(json_extract_string({column}, '$.{key}') AS BIGINT)"

    def stamp(self, text: str) -> str:
        return f"TIMESTAMP '{text}'"

    def binary(self, hex_text: str) -> str:
        return hex_text

    def millis_text(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%g')"

    def seconds_between(self, a: str, b: str) -> str:
        return f"date_diff('second', {a}, {b})"
