"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

``THRESHOLDS`` lists (name, numerator, denominator, least, most), the two terms as SQL over the measured
counts; a document is kept when every ratio is within its bounds and the base test passes. The bounds and
the stop words are parameters. The first twenty words of a text need no stop word.

Edge cases: a null, empty or blank text has no words, fails the base test and is not kept; repeated rows
give repeated rows; a null doc_id is kept or rejected by its text; texts of any length are measured whole; an empty table
gives an empty one; extra columns of the input are ignored by ``measured`` and retained by ``kept``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Very frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in that is it was for on are as with be by this from at or an not a i he you "
    "le la les de des du et est un une dans que qui pour par sur avec pas au ce se ne en il "
    "el los las del y que en un una por con para su se no es lo al "
    "der die das und ist von den dem des ein eine mit zu auf für nicht im sich als auch es an"
).split()

#: (name, numerator, denominator, least, most); None is no bound.
THRESHOLDS: tuple[tuple[str, str, str, float | None, float | None], ...] = (
    ("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    ("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    ("exclamation_ratio", "n_exclamations", "n_words", None, 0.5),
    ("stop_word_ratio", "n_stop_words", "greatest(n_words - 20, 0)", 0.02, None),
    ("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
)

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"
WINDOW = 5


def _repeated(grams: str, ordered: str) -> Column:
    """Words within windows whose hash occurs twice or more; ``ordered`` has (h, i) by hash where there are any."""
    at = lambda j: F.get(F.col(ordered), j)["h"]
    twins = F.filter(F.col(ordered), lambda s, j: (s["h"].eqNullSafe(at(j - 1))) | (s["h"].eqNullSafe(at(j + 1))))
    places = F.array_sort(F.transform(twins, lambda s: s["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + WINDOW).alias("end"))
    return F.when(F.col(ordered).isNotNull(), F.aggregate(places, start, step, lambda a: a["n"])).otherwise(0)


def measured(docs: DataFrame, stop_words: Sequence[str] = tuple(STOP_WORDS), keep: Sequence[str] = ("doc_id",), extra: Sequence[Column] = ()) -> DataFrame:
    """The columns in ``keep``, ``extra`` and the counts of each whole text, all native expressions.

    n_repeat_words: words in windows of five that the text has twice or more, found by the windows' 64-bit
    hashes; only texts with an equal pair are sorted.
    """
    trimmed = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(WHITE))
    spoken = {w for x in stop_words for w in (x, x[:1].upper() + x[1:])}
    own = docs.select(F.struct(*keep).alias("_own"), "text")
    words = own.select("_own", "text", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+")).alias("_words"))
    window = lambda i: F.xxhash64(*(F.get(F.col("_words"), i + k) for k in range(WINDOW)))
    grams = words.select(
        "*",
        F.when(F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), window)).alias("_grams"),
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"\S")).alias("_lines"),
    )
    twice = F.size(F.array_distinct("_grams")) < F.size("_grams")
    sorted_ = grams.select("*", F.when(twice, F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_ordered"))
    long = lambda x, name: x.cast("long").alias(name)
    return sorted_.select(
        "_own.*",
        *extra,
        long(F.size("_words"), "n_words"),
        long(F.length(F.array_join("_words", "")), "word_chars"),
        long(F.coalesce(F.length("text") - F.length(F.translate("text", SYMBOLS, "")), F.lit(0)), "n_symbols"),
        long(F.coalesce(F.length("text") - F.length(F.translate("text", "!", "")), F.lit(0)), "n_exclamations"),
        long(F.size("_lines"), "n_lines"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines")), "n_dup_lines"),
        long(_repeated("_grams", "_ordered"), "n_repeat_words"),
        long(F.size(F.filter("_words", lambda w: w.isin(*sorted(spoken)))), "n_stop_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(thresholds: Sequence[tuple[str, str, str, float | None, float | None]] = THRESHOLDS) -> Column:
    """The whole table as one boolean expression."""
    passed = ~base_failed()
    for _, top, bottom, least, most in thresholds:
        if least is not None:
            passed &= F.expr(top) >= least * F.expr(bottom)
        if most is not None:
            passed &= F.expr(top) <= most * F.expr(bottom)
    return passed


def judged(docs: DataFrame, thresholds: Sequence[tuple] = THRESHOLDS, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    return measured(docs, keep=keep).withColumns({"base_failed": base_failed(), "kept": verdict(thresholds)})


def kept(docs: DataFrame, thresholds: Sequence[tuple] = THRESHOLDS) -> DataFrame:
    """The rows of docs that pass every rule, with all their columns."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    # A filter would be moved below the counts, and each use of a count would work it out anew; it isn't
    # moved below a column that numbers rows.
    counted = measured(whole, keep=("row",), extra=(F.monotonically_increasing_id().alias("number"),))
    return counted.where(verdict(thresholds) & (F.col("number") >= 0)).select("row.*")


#: The stop words as a DuckDB list, both spellings.
_LISTED = "[" + ", ".join(f"'{w}'" for w in sorted({w for x in STOP_WORDS for w in (x, x[:1].upper() + x[1:])})) + "]"

ORACLE_SQL = f"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_bang, len(list_filter(w, lambda x: list_contains({_LISTED}, x))) AS n_stop
  FROM words LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars >= 2.0 * n_words AND word_chars <= 20.0 * n_words
       AND n_symbols <= 0.1 * n_words AND n_bang <= 0.5 * n_words AND n_stop >= 0.02 * greatest(n_words - 20, 0)
       AND n_dup_lines <= 0.5 * n_lines AS kept
FROM counts
"""
