"""Text semantics: quoting, paths, statement slices, templates, duration bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from opslens.functions import dates

# Placeholders of printf-style message templates.
MESSAGE_PLACEHOLDERS = ["%.*ls", "%d", "%ls", "%S_MSG", "%S_PGID", "%#016I64x", "%p", "%08x",
                        "%u", "%I64d", "%s", "%ld", "%lx"]

CRLF = "\r\n"


def quote_name(c: Column) -> Column:
    """Bracketed identifier with closing brackets doubled."""
    return F.concat(F.lit("["), F.replace(c, F.lit("]"), F.lit("]]")), F.lit("]"))


def bracket(c: Column) -> Column:
    """Bracketed identifier as it stands."""
    return F.concat(F.lit("["), c, F.lit("]"))


def one_line(c: Column, by: str = " ") -> Column:
    """Carriage returns and line feeds replaced, one for one."""
    return F.regexp_replace(c, "[\\r\\n]", by)


def directory_of(path: Column) -> Column:
    """Everything before the last separator; null when there is none."""
    return F.nullif(F.regexp_extract(path, r"^(.*)[\\/]", 1), F.lit(""))


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.\\/]+)$", 1))


def fill(template: str, values: dict[str, Column]) -> Column:
    """Placeholders of a literal template replaced by columns, left to right."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(name), value.cast("string"))
    return out


def statement_slice(text: Column, start: Column, end: Column) -> Column:
    """Statement inside a batch by byte offsets of two-byte characters.

    An end of -1 means the end of the batch.
    """
    begin = F.call_function("div", start.cast("long"), F.lit(2)) + 1
    last = F.when(end == -1, F.length(text) * 2).otherwise(end)
    length = F.call_function("div", (last - start).cast("long"), F.lit(2)) + 1
    return F.substr(text, begin.cast("int"), length.cast("int"))


def running_statement(text: Column, start: Column, end: Column) -> Column:
    """Slice used by progress reports: starts one character earlier where there is one; an open end is the text's."""
    begin = F.greatest(F.call_function("div", start.cast("long"), F.lit(2)), F.lit(1))
    length = F.when(end == -1, F.length(text)).otherwise(
        F.call_function("div", (end - start).cast("long"), F.lit(2)))
    return F.substr(text, begin.cast("int"), F.greatest(length, F.lit(0)).cast("int"))


def like_pattern(template: Column) -> Column:
    """Message template to a wildcard pattern: one ``%`` per run of placeholders."""
    longest_first = sorted(MESSAGE_PLACEHOLDERS, key=len, reverse=True)
    marks = "|".join("\\Q" + p + "\\E" for p in longest_first)
    return F.regexp_replace(F.regexp_replace(template, marks, "%"), "%%+", "%")


def bar(percent: Column, mark: str = "|") -> Column:
    return F.repeat(F.lit(mark), percent.cast("int"))


def plural(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + unit), F.when(n > 1, "s").otherwise(""))


def between_prefix_and_comma(c: Column, prefix: str) -> Column:
    """Token after ``prefix`` up to the first comma; null if there is no comma."""
    return F.nullif(F.regexp_extract(c, "^" + prefix + "([^,]*),", 1), F.lit(""))


def version_token(banner: Column, version: Column) -> Column:
    """Banner up to and including the version number and the character after it."""
    at = F.position(version, banner)
    return F.when(at > 0, F.substr(banner, F.lit(1), at + F.length(version)))


def major_version(version: Column) -> Column:
    return F.regexp_extract(version, r"^(\d+)", 1).try_cast("int")


def duration_band(seconds: Column, millis: Column) -> Column:
    """``n sec``, ``n min`` or ``n hr`` with two decimals; bands are half open."""
    # Quotients of milliseconds go through exact decimals, as the reports print them.
    ms = millis.cast("decimal(19,0)")

    def shown(divisor: int, unit: str) -> Column:
        value = (ms / F.lit(divisor).cast("decimal(10,0)")).cast("decimal(19,2)")
        return F.concat(value.cast("string"), F.lit(unit))

    return (
        F.when((seconds >= 0) & (seconds < 60), shown(1000, " sec"))
        .when((seconds >= 60) & (seconds < 3600), shown(60000, " min"))
        .when(seconds >= 3600, shown(3600000, " hr"))
    )


def duration_text(start: Column, end: Column) -> Column:
    """``Duration: `` and the band of the time between two instants."""
    return F.concat(
        F.lit("Duration: "),
        duration_band(dates.boundary_diff("second", start, end),
                      dates.boundary_diff("millisecond", start, end)),
    )


def _escaped(c: Column) -> Column:
    out = c.cast("string")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def html_row(cells: list[Column], tag: str = "td") -> Column:
    """One table row; nulls give no cell, markup characters are escaped."""
    rendered = [F.coalesce(F.concat(F.lit(f"<{tag}>"), _escaped(c), F.lit(f"</{tag}>")), F.lit(""))
                for c in cells]
    return F.concat(F.lit("<tr>"), *rendered, F.lit("</tr>"))


def xml_element(tag: str, children: dict[str, Column]) -> Column:
    """Compact XML element with a child per non-null column."""
    parts = [
        F.coalesce(F.concat(F.lit(f"<{name}>"), _escaped(value), F.lit(f"</{name}>")), F.lit(""))
        for name, value in children.items()
    ]
    return F.concat(F.lit(f"<{tag}>"), *parts, F.lit(f"</{tag}>"))
