"""Line-first cleaning with built-in functions only: rules per line, then per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that separates words, and the symbols counted in a text.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

# A line needs a sentence end, at its own end or before a space.
SENTENCE_END = r"""[.!?:;…。！？]["'”’»)\]]*(\s|$)"""
# Marks between the entries of menus, lists of links and breadcrumbs.
SEPARATOR = r"(^|\s)[|»›•·>/]+(\s|$)"
# Phrases of page furniture, in lower case.
BOILERPLATE = (
    r"lorem ipsum|all rights reserved|cookie policy|privacy policy|terms of (use|service)"
    r"|use of cookies|uses cookies|enable javascript|javascript is disabled|click here"
    r"|read more|sign in|log in|sign up|subscribe to|skip to content|page not found"
)
# Shares of a line, in percent.
MOST_SEPARATORS = 20
MOST_SYMBOLS = 10
MOST_CAPITALS = 60
# Words of a line, in percent, that may equal the word before.
MOST_STUTTER = 40
# A boilerplate phrase condemns a line of up to so many words.
FURNITURE_WORDS = 25
# Share of the text, in percent, that must survive.
LEAST_KEPT = 50


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{SPACE}]+")
    )


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words inside windows that occur twice or more in the array, the first included.

    Windows are compared by 64-bit hashes.  Texts without a repeat, the usual case, stop at
    a distinct count; else hashes are sorted with their places, and places of equal
    neighbours cover ``window`` words each, less what the next place covers too.
    """
    last = F.size(words) - window
    hashes = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, window))
    )

    def places(hashes: Column) -> Column:
        pairs = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )
        again = lambda pairs: F.filter(
            pairs,
            lambda p, k: F.coalesce(p["h"] == F.get(pairs, k - 1)["h"], F.lit(False))
            | F.coalesce(p["h"] == F.get(pairs, k + 1)["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(_let(pairs, again), lambda p: p["i"]))

    def covered(at: Column) -> Column:
        own = F.transform(
            at,
            lambda i, k: F.least(
                F.lit(window), F.coalesce(F.get(at, k + 1), i + window) - i
            ),
        )
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda a, b: a + b)

    counted = _let(
        hashes,
        lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")
        ).otherwise(_let(places(h), covered)),
    )
    return F.when(last < 1, F.lit(0).cast("bigint")).otherwise(counted)


def line_passes(line: Column) -> Column:
    """The punctuation, navigation, symbol, capitals, boilerplate and stutter rules of a line."""
    size = F.length(line)
    symbols = _count_of(line, SYMBOLS) * 100 > size * MOST_SYMBOLS
    capitals = _count_of(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 100 > size * MOST_CAPITALS

    def of_words(words: Column) -> Column:
        n = F.size(words)
        navigation = F.regexp_count(line, F.lit(SEPARATOR)) * 100 > n * MOST_SEPARATORS
        furniture = (n <= FURNITURE_WORDS) & F.lower(line).rlike(BOILERPLATE)
        again = F.filter(words, lambda w, k: F.coalesce(w == F.get(words, k - 1), F.lit(False)))
        return ~navigation & ~furniture & (F.size(again) * 100 <= n * MOST_STUTTER)

    words = F.split(F.btrim(line, F.lit(SPACE)), f"[{SPACE}]+")
    return line.rlike(SENTENCE_END) & ~symbols & ~capitals & _let(words, of_words)


def clean_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` and the measures, verdicts and cleaned text.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines (with a word), n_lines_removed, clean_text.  A line without a word is neither
    counted nor removed.  A null text counts as empty; an empty text has too few words and
    is not kept.  Clashing columns are replaced.  Nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.btrim(s, F.lit(SPACE)) != "")
    base = docs.withColumns({"_words": words_of(text), "_lines": lines})
    measured = base.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": _word_chars(text),
            "n_symbols": _count_of(text, SYMBOLS).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": repeated_words(F.col("_words")),
            "_good": F.filter("_lines", line_passes),
        }
    )
    size = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, s: a + F.length(s))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT
    )
    enough = size("_good") * 100 >= size("_lines") * LEAST_KEPT
    return measured.withColumns(
        {
            "base_failed": failed,
            "kept": ~failed & enough,
            "n_lines_removed": F.col("n_lines") - F.size("_good"),
            "clean_text": F.array_join("_good", "\n"),
        }
    ).drop("_words", "_lines", "_good")


def _word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACE, "")).cast("bigint")


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document."""
    found = clean_lines(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines_removed",
    )


def quality_sql() -> str:
    """The same report in SQL for DuckDB."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    count = lambda x, p: f"length(regexp_replace({x}, '[^{p}]', '', 'g'))"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^ \\t-\\r]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda s: trim(s, {space}) <> '') AS ls FROM d),
win AS (
  SELECT rid, i, list_slice(ws, i, i + {REPEAT_WINDOW - 1}) AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {REPEAT_WINDOW - 2})) AS i FROM w)),
again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win)
  WHERE n > 1),
rep AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest(range(i, i + {REPEAT_WINDOW})) AS p FROM again) GROUP BY rid),
line AS (SELECT rid, unnest(ls) AS l FROM w),
judged AS (
  SELECT rid, length(l) AS size,
    regexp_matches(l, {quoted(SENTENCE_END)})
    AND len(regexp_extract_all(l, {quoted(SEPARATOR)})) * 100
        <= len(lw) * {MOST_SEPARATORS}
    AND {count('l', SYMBOLS)} * 100 <= length(l) * {MOST_SYMBOLS}
    AND {count('l', 'A-Z')} * 100 <= length(l) * {MOST_CAPITALS}
    AND NOT (len(lw) <= {FURNITURE_WORDS} AND regexp_matches(lower(l), {quoted(BOILERPLATE)}))
    AND len(list_filter(range(2, len(lw) + 1), lambda k: lw[k] = lw[k - 1])) * 100
        <= len(lw) * {MOST_STUTTER} AS good
  FROM (SELECT *, regexp_extract_all(l, '[^ \\t-\\r]+') AS lw FROM line)),
kept AS (
  SELECT rid, sum(size) AS total, sum(CASE WHEN good THEN size ELSE 0 END) AS left_over,
         sum(CASE WHEN good THEN 0 ELSE 1 END) AS removed
  FROM judged GROUP BY rid),
base AS (
  SELECT w.rid, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         {count('t', SYMBOLS)} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, coalesce(total, 0) AS total,
         coalesce(left_over, 0) AS left_over, coalesce(removed, 0) AS removed
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN kept USING (rid)),
failed AS (
  SELECT *, n_words < {LEAST_WORDS}
         OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND left_over * 100 >= total * {LEAST_KEPT} AS kept,
       CAST(removed AS BIGINT) AS n_lines_removed
FROM failed"""
