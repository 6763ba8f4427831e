"""Column functions at their edges."""

import pytest
from pyspark.sql import functions as F

from opslens.functions import binary, codes, dates, numbers, text, xmls


def one(spark, column, **values):
    """Value of a column expression over one literal row."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return df.select(column.alias("v")).first()[0]


def ts(value):
    return dates.instant(value)


@pytest.mark.parametrize("unit, a, b, n", [
    ("hour", "2024-01-01 00:59:00", "2024-01-01 01:01:00", 1),
    ("hour", "2024-01-01 00:00:00", "2024-01-01 00:59:59", 0),
    ("minute", "2024-01-01 00:00:59", "2024-01-01 00:01:00", 1),
    ("day", "2023-12-31 23:59:59", "2024-01-01 00:00:00", 1),
    ("second", "2024-01-01 00:00:00.9", "2024-01-01 00:00:01.1", 1),
    ("second", "1969-12-31 23:59:59.5", "1970-01-01 00:00:00", 1),
    ("millisecond", "2024-01-01 00:00:00.9994", "2024-01-01 00:00:01.0001", 1),
    ("hour", "2024-01-01 02:00:00", "2024-01-01 01:59:59", -1),
])
def test_boundary_diff(spark, unit, a, b, n):
    assert one(spark, dates.boundary_diff(unit, ts(a), ts(b))) == n


@pytest.mark.parametrize("packed, seconds", [(0, 0), (59, 59), (100, 60), (10000, 3600), (235959, 86399),
                                             (1000000, 86400), (12030405, 12 * 86400 + 3 * 3600 + 245)])
def test_packed_seconds(spark, packed, seconds):
    assert one(spark, dates.packed_seconds(F.lit(packed))) == seconds


def test_packed_datetime(spark):
    assert str(one(spark, dates.packed_datetime(F.lit(20240115), F.lit(305)))) == "2024-01-15 00:03:05"


def test_clocks_wrap_at_a_day(spark):
    assert one(spark, dates.clock_text(F.lit(86400 + 3661))) == "1 hours, 1 minutes, 1 seconds"
    assert one(spark, dates.millis_clock(F.lit(86400000 + 3661000))) == "01:01:01"


@pytest.mark.parametrize("seconds, shown", [(0, "0.00 sec"), (59, "59.00 sec"), (60, "1.00 min"), (90, "1.50 min"),
                                            (3599, "59.98 min"), (3600, "1.00 hr"), (90000, "25.00 hr")])
def test_duration_bands_are_half_open(spark, seconds, shown):
    band = text.duration_band(F.lit(seconds), F.lit(seconds * 1000))
    assert one(spark, band) == shown


def test_day_floor_and_since(spark):
    assert str(one(spark, dates.since("2024-01-31 10:00:00", 1, "day"))) == "2024-01-30 00:00:00"
    assert str(one(spark, dates.since("2024-01-31 10:00:00", 1, "hour"))) == "2024-01-31 09:00:00"


@pytest.mark.parametrize("start, end, shown", [(0, -1, "select 1; select 2"), (0, 14, "select 1"), (20, -1, "select 2"),
                                               (20, 34, "select 2"), (4, 2, "")])
def test_statement_slice(spark, start, end, shown):
    column = text.statement_slice(F.lit("select 1; select 2"), F.lit(start), F.lit(end))
    assert one(spark, column) == shown


def test_running_statement_keeps_a_long_open_end(spark):
    whole = "select 1 -- " + "x" * 5000
    assert one(spark, text.running_statement(F.lit(whole), F.lit(0), F.lit(-1))) == whole


@pytest.mark.parametrize("start, end, shown", [(0, 6, "abc"), (2, 8, "abc"), (4, -1, "bcdef"), (0, -1, "abcdef")])
def test_running_statement(spark, start, end, shown):
    assert one(spark, text.running_statement(F.lit("abcdef"), F.lit(start), F.lit(end))) == shown


def test_text_helpers(spark):
    assert one(spark, text.quote_name(F.lit("a]b"))) == "[a]]b]"
    assert one(spark, text.directory_of(F.lit("D:\\a\\b.mdf"))) == "D:\\a"
    assert one(spark, text.directory_of(F.lit("b.mdf"))) is None
    assert one(spark, text.extension_of(F.lit("D:\\a.b\\c.MDF"))) == "mdf"
    assert one(spark, text.extension_of(F.lit("D:\\a.b\\c"))) == ""
    assert one(spark, text.like_pattern(F.lit("a %.*ls%d b %08x %S_MSG"))) == "a % b % %"
    assert one(spark, text.between_prefix_and_comma(F.lit("Error: 12"), "Error: ")) is None
    assert one(spark, text.plural(F.lit(1), "day")) == "1 day"
    assert one(spark, text.plural(F.lit(2), "day")) == "2 days"
    assert one(spark, text.fill("x $a $b", {"$a": F.lit(1), "$b": F.lit("z")})) == "x 1 z"
    assert one(spark, text.version_token(F.lit("P 1.2.3 (x)"), F.lit("1.2.3"))) == "P 1.2.3 "
    assert one(spark, text.version_token(F.lit("P 1.2.3"), F.lit("9"))) is None
    assert one(spark, text.xml_element("T", {"a": F.lit("<x&"), "b": F.lit(None).cast("string")})) == "<T><a>&lt;x&amp;</a></T>"


def test_sid_text(spark):
    sid = bytes.fromhex("010500000000000515000000A065CF7E784B9B5FE77C8770091C0100")
    assert one(spark, binary.sid_text(F.lit(sid))) == "S-1-5-21-2127521184-1604012920-1887927527-72713"
    assert one(spark, binary.sid_text(F.lit(bytes.fromhex("010100000000000512000000")))) == "S-1-5-18"
    assert one(spark, binary.sid_text(F.lit(bytes.fromhex("0100000000000005")))) == "S-1-5"
    assert one(spark, binary.hex_text(F.lit(b"\x01\xab"))) == "0x01AB"
    assert one(spark, binary.hash_text(F.lit("ABC"))) == "0xA9993E364706816ABA3E25717850C26C9CD0D89D"


def test_guid_hex(spark):
    assert one(spark, binary.guid_hex(F.lit("00112233-4455-6677-8899-aabbccddeeff"))) == "0x33221100554477668899AABBCCDDEEFF"


@pytest.mark.parametrize("gb, reserve", [(1, 0.5), (2, 0.5), (3, 2.0), (4, 2.0), (16, 5.0), (17, 5.125), (128, 19.0)])
def test_system_reserve(spark, gb, reserve):
    assert one(spark, numbers.system_reserve_gb(F.lit(float(gb)))) == reserve


def test_numbers(spark):
    assert one(spark, numbers.int_div(F.lit(-7), 2)) == -3
    assert float(one(spark, numbers.exact_div(F.lit(2), 3, 2))) == 0.67
    assert one(spark, numbers.exact_div(F.lit(2), 0, 2)) is None
    assert float(one(spark, numbers.pages_to_mb(F.lit(129)))) == 1.01
    assert float(one(spark, numbers.next_growth_mb(F.lit(1280), F.lit(10), F.lit(True)))) == 1.0
    assert float(one(spark, numbers.next_growth_mb(F.lit(1280), F.lit(256), F.lit(False)))) == 2.0


def test_int_avg_truncates(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v long")
    assert df.agg(numbers.int_avg(F.col("v"))).first()[0] == 1


@pytest.mark.parametrize("message, comment", [
    ("Error: 825, Severity: 10", "IO transient failure. Possible corruption"),
    ("Error: 9002, Severity: 17", "No Log space available"),
    ("Error: 9001, Severity: 17", "Transaction log errors."),
    ("SQL Server has encountered 3 occurrence(s) longer than 15 seconds to", "Long IO detected: http://support.microsoft.com/kb/897284"),
    ("x cachestore flush y", "CacheStore flush"),
    ("nothing known", ""),
    ("Error: 8021, Severity: 10", ""), ("Error: 6105, Severity: 10", ""), ("Error: 610, Severity: 21", "Page header invalid. Possible corruption"),
])
def test_first_rule_wins(spark, message, comment):
    assert one(spark, codes.error_comment(F.lit(message))) == comment


def test_xml_positions_count_empty_nodes(spark):
    document = ('<event name="e" timestamp="2024-01-01T00:00:00.123Z"><data name="a"><value>1</value><text></text></data>'
                '<data name="b"><value>2</value></data><data name="c"><value> x y </value><text>T</text></data>'
                '<action name="session_id"><value>55</value></action></event>')
    event = xmls.parse(F.lit(document), xmls.EVENT)
    assert one(spark, xmls.nth(event, "value", 3)) == "x y"
    assert one(spark, xmls.nth(event, "text", 2)) == "T"
    assert one(spark, xmls.nth(event, "value", 9)) is None
    assert one(spark, xmls.named(event, "b")) == "2"
    assert one(spark, xmls.named(event, "missing")) is None
    assert one(spark, xmls.named(event, "session_id", group="action")) == "55"
    assert one(spark, xmls.named_all(event, "c")) == "x yT"
    assert str(one(spark, xmls.event_time(event))) == "2024-01-01 00:00:00.123000"
