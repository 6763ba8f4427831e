"""Quality rules: each line is judged on its own, failing lines go, and a text that loses too much is rejected.

All of it are column expressions over one row: nothing is shuffled.

Defined cases: a null text is empty, has no words and fails; a line without words is
neither judged nor counted as lost; extra columns pass through and may carry any name
but those added here; repeated rows each get their own result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opslens.llm.common import let

#: The symbols that are counted, separators of navigation bars, marks that end a sentence.
SYMBOLS = "#*$%&|<>"
BARS = "|>»•·"
SENTENCE_END = r"""[.!?:;…。！？]["'”’»)\]]*\s*$"""
BOILERPLATE = (r"(?i)\b(cookie policy|accept (all )?cookies|uses cookies|subscribe to|sign up (for|to)|log in to"
               r"|all rights reserved|privacy policy|terms of (use|service)|click here|read more|share this"
               r"|enable javascript|follow us on|back to top|lorem ipsum)\b")
WINDOW = 5
SPACE, NO_SPACE = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
WORD = f"{NO_SPACE}+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _repeated(words: Column) -> Column:
    """Words that lie in a window of five words which the text holds at least twice."""
    def places(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(pairs: Column) -> Column:
            beside = lambda p, j: F.coalesce(F.get(pairs, j)["h"] == p["h"], F.lit(False))
            return F.sort_array(F.transform(
                F.filter(pairs, lambda p, j: beside(p, j - 1) | beside(p, j + 1)), lambda p: p["i"]))
        return let(ordered, twice)

    def covered(windows: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
        step = lambda s, i: F.struct(
            i.alias("last"), (s["total"] + F.least(F.lit(WINDOW), i - s["last"])).alias("total"))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            F.aggregate(places(windows), start, step, lambda s: s["total"]))

    def hashed(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                              lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return let(windows, covered)

    each = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(each, hashed))


def _has_word(line: Column) -> Column:
    return line.rlike(NO_SPACE)


def _bad(line: Column) -> Column:
    """A line that is navigation, boilerplate, noise of symbols or marks, or a stub without a sentence end."""
    words = _count(line, WORD)
    bars = _count(line, f"[{BARS}]")
    doubled = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    return ((bars >= 3) & (bars * 4 >= words)
            | (_count(line, f"[{SYMBOLS}]") * 10 >= F.length(line))
            | (doubled >= 2) & (doubled * 4 >= words)
            | (words < 4) & ~line.rlike(SENTENCE_END)
            | line.rlike(BOILERPLATE))


def judged(documents: DataFrame, text: str = "text", max_lost: float = 0.5, min_words: int = 10,
           max_repeated: float = 20.0) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cleaned_text, lost, kept.

    ``lost`` is the share of the word characters in removed lines; a text above
    ``max_lost`` is not kept. ``cleaned_text`` is the text without its failing lines.
    """
    # one array of parts in one generator: the parts are worked out once and read by name
    whole = F.coalesce(F.col(text), F.lit(""))

    def parts(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), _has_word)
        return let(_words(t), lambda words: let(lines, lambda worded: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _count(t, f"[{SYMBOLS}]").cast("long").alias("n_symbols"),
            (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
            _repeated(words).alias("n_repeat_words"),
            F.array_join(F.filter(F.split(t, "\n", -1), lambda l: ~(_has_word(l) & _bad(l))), "\n").alias("cleaned_text"))))

    found = documents.withColumn("_parts", F.explode(F.array(let(whole, parts))))
    failed = ((F.col("_parts.n_words") < min_words)
              | (F.col("_parts.n_repeat_words") * 100 > F.col("_parts.n_words") * F.lit(max_repeated)))
    left = F.length(F.regexp_replace("_parts.cleaned_text", f"{SPACE}+", ""))
    lost = F.when(F.col("_parts.word_chars") == 0, 0.0).otherwise(1 - left / F.col("_parts.word_chars"))
    return (found.select(*[F.col(f"`{c}`") for c in documents.columns], "_parts.*", failed.alias("base_failed"),
                         lost.alias("lost"))
            .withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost)))


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w,
                 generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS p FROM d),
grams AS (SELECT r, p, w, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN
                 [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] END AS g
          FROM words WINDOW o AS (PARTITION BY r ORDER BY p)),
twice AS (SELECT r, p, w, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS again FROM grams),
inside AS (SELECT r, w, bool_or(again) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rep FROM twice),
per AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (rep) AS n_repeat_words FROM inside GROUP BY r),
lines AS (SELECT r, l, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars,
                 len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
                 length(regexp_replace(l, '[^|>»•·]', '', 'g')) AS bars,
                 length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) AS symbols,
                 (length(l) - length(replace(l, '!!', ''))) / 2 AS doubled
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
judged AS (SELECT r, l, chars,
                 (bars >= 3 AND bars * 4 >= n) OR symbols * 10 >= length(l) OR (doubled >= 2 AND doubled * 4 >= n)
                 OR (n < 4 AND NOT regexp_matches(l, '[.!?:;…。！？]["''”’»)\]]*\s*$'))
                 OR regexp_matches(l, 'BOILERPLATE') AS bad
          FROM lines WHERE n > 0),
by_line AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines, sum(chars) FILTER (bad) AS gone FROM judged GROUP BY r)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       coalesce(n_words, 0) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed,
       coalesce(n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words
                AND coalesce(gone, 0) <= 0.5 * word_chars, false) AS kept
FROM d LEFT JOIN per USING (r) LEFT JOIN by_line USING (r)
""".replace("BOILERPLATE", BOILERPLATE)
