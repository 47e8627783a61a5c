"""Quality rules: a threshold table compiled into one projection, without user functions.

Defined cases: a null or blank text has no words, fails the base rule and is not kept; repeated rows
are judged row by row; very long texts are measured whole; an empty table gives an empty result; further input columns stay as they are,
those named like the operator's own (``q_*``) are replaced. Windows are equal if their 64-bit hashes are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlens.llm.common import documents

#: Frequent function words of the four languages that the rules know.
STOP_WORDS = {
    "en": "the of and to in is that it was for on are with as be this by from at an or have not",
    "de": "der die und das von zu mit den ist des für auf ein eine nicht als auch sich dem im",
    "fr": "le la les de et un une des en que pour dans est qui par sur au du avec ne",
    "es": "el la los de y en que un una del las por con para es se al lo su como",
}
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie within [low, high]; None is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The production thresholds. Base limits come first and are fixed; the others are the method's verdict.
BASE_RULES = (Rule("too_short", "n_words", low=10), Rule("repeated_words", "repeat_percent", high=20))
RULES = (
    Rule("word_length_low", "mean_word_length", low=1.5),
    Rule("word_length_high", "mean_word_length", high=20),
    Rule("symbols", "symbol_ratio", high=0.25),
    # symbols of a word less function words of a word: a text without function words, of whatever length or language, may have fewer symbols
    Rule("stop_words", "symbols_less_stops", high=0.10),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("capitals", "capital_ratio", high=0.5),
)


def _words(text: Column) -> Column:
    blank = " \t\n\x0b\f\r"
    bare = F.trim(text, F.lit(blank))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(bare, SPACE + "+"))


def measured(docs: DataFrame, text_col: str = "text", n: int = 5) -> DataFrame:
    """Adds ``q_*`` measures of each whole text. ``q_repeat``: words in n-word windows found at least twice; ``q_stop``: function words."""
    stops = sorted({v for ws in STOP_WORDS.values() for w in ws.split() for v in (w, w.capitalize())})
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumns({"q_words": _words(text), "q_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    d = d.withColumn("q_n", F.size("q_words").cast("long"))
    w = F.col("q_words")
    d = d.withColumn("q_grams", F.when(F.col("q_n") >= n, F.transform(F.sequence(F.lit(0), (F.col("q_n") - n).cast("int")), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))))
    d = d.withColumn("q_twice", F.coalesce(F.size(F.array_distinct("q_grams")) < F.size("q_grams"), F.lit(False)))
    order = F.sort_array(F.transform("q_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("q_order", F.when(F.col("q_twice"), order))
    o, last = F.col("q_order"), F.size("q_order") - 1
    twin = lambda k: F.coalesce(F.get(o, k)["h"] == F.get(o, k - 1)["h"], F.lit(False)) | F.coalesce(F.get(o, k)["h"] == F.get(o, k + 1)["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda k: F.get(o, k)["i"]))
    d = d.withColumn("q_places", F.when(F.col("q_twice"), places))
    p = F.col("q_places")
    covered = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(n), lambda acc, k: acc + F.least(F.lit(n), F.get(p, k) - F.get(p, k - 1)))
    found = {
        "q_n": F.col("q_n"),
        "q_repeat": F.when(F.col("q_twice"), covered).otherwise(0).cast("long"),
        "q_chars": F.length(F.array_join("q_words", "")).cast("long"),
        "q_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "q_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "q_line_count": F.size("q_lines").cast("long"),
        "q_stop": F.size(F.filter(w, lambda x: x.isin(stops))).cast("long"),
        "q_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
    }
    # a number of the row in each, so that filters on measures aren't pushed below this projection, where they would be evaluated again for each use
    return d.withColumns({k: F.when(F.monotonically_increasing_id() >= 0, c) for k, c in found.items()}).drop("q_words", "q_lines", "q_grams", "q_order", "q_places", "q_twice")


def _metrics() -> dict[str, Column]:
    n, chars = F.col("q_n"), F.greatest(F.col("q_chars"), F.lit(1))
    some = F.greatest(n, F.lit(1))
    return {
        "n_words": n,
        "repeat_percent": 100 * F.col("q_repeat") / some,
        "mean_word_length": F.col("q_chars") / some,
        "symbol_ratio": F.col("q_symbols") / some,
        "symbols_less_stops": (F.col("q_symbols") - F.col("q_stop")) / some,
        "dup_line_ratio": F.col("q_dup_lines") / F.greatest(F.col("q_line_count"), F.lit(1)),
        "capital_ratio": F.col("q_capitals") / chars,
    }


def compiled(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """Rule name to a column that is true where the rule is broken."""
    m = _metrics()
    out = {}
    for r in rules:
        broken = F.lit(False)
        if r.low is not None:
            broken = broken | (m[r.metric] < r.low)
        if r.high is not None:
            broken = broken | (m[r.metric] > r.high)
        out[r.name] = broken
    return out


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` with the measures, ``q_base_failed``, ``q_broken`` (names of broken rules) and ``q_kept``."""
    base = [100 * F.col("q_repeat") > 20 * F.col("q_n") if r.metric == "repeat_percent" else c for r, c in zip(BASE_RULES, compiled(BASE_RULES).values(), strict=True)]
    broken = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in compiled(rules).items()]), lambda x: x.isNotNull())
    d = measured(docs, text_col).withColumns({"q_base_failed": base[0] | base[1], "q_broken": broken})
    return d.withColumn("q_kept", ~F.col("q_base_failed") & (F.size("q_broken") == 0))


def kept(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    return judge(docs, text_col, rules).where("q_kept").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the base counts and the verdict of every document."""
    d = judge(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select(
        "doc_id", F.col("q_n").alias("n_words"), F.col("q_chars").alias("word_chars"), F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"), F.col("q_repeat").alias("n_repeat_words"),
        F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"),
    )


def oracle() -> str:
    stops = sorted({v for ws in STOP_WORDS.values() for w in ws.split() for v in (w, w.capitalize())})
    listed = ", ".join(f"'{s}'" for s in stops)
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT r, i, ws[i:i+4] AS gram FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) AS u(i) WHERE len(ws) >= 5),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS o(k) GROUP BY r),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) AS caps,
         len(list_filter(ws, lambda x: x IN ({listed}))) AS stops
  FROM w LEFT JOIN covered c ON c.r = w.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 20 AND n_symbols / n_words <= 0.25
       AND (n_symbols - stops) / n_words <= 0.10 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND caps / greatest(word_chars, 1) <= 0.5 AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
"""
