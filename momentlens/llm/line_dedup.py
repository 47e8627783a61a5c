"""Line dedup: lines that many documents share stay in one of them; the result is a keep bitmap for each document.

Lines become 128-bit hashes of their keys (stripped, A-Z in lower case). Hashes are partitioned by ranges and sorted by
document, the largest id first, and position, so that a stream over a range meets the first occurrence of
each key first; a line is dropped if another document came first and the key has documents enough. Ranges are cut by
(hash, document), so that a key of any number of documents spreads over ranges. Of such keys, at most one for each cut, the documents
are counted apart. Only dropped lines go on: they are gathered as 64-bit words of their document's bitmap, and words in which every line
stays are left out. Texts meet bitmaps only where a text is asked for.

Everything is column expressions and joins; there is no Python code on executors.

Defined cases: a null or empty text is one empty line and stays as it is; keys of fewer than ``LEAST_CHARS`` code points are never dropped;
rows that share an id are one document for counts, and each row has the bitmap of its own text; a null id is one document,
smaller than all others; all lines of a key stay in the document that keeps it, repeated ones too; an empty table gives an empty result;
further input columns stay as they are; only ``with_bitmaps`` replaces those named like the operator's own (``l_*``). Keys are equal if their 128-bit
hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentlens.llm.common import documents, written

LEAST_CHARS = 20
LEAST_DOCS = 3
_BLANK = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _key(line: Column) -> Column:
    bare = F.trim(line, F.lit(_BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _split(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")


def _row(text_col: str) -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64(text_col)


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(l_a, l_b, l_doc, l_row, l_pos) of the lines whose keys are long enough; ``l_a`` and ``l_b``: the key's hash."""
    d = docs.select(F.col(id_col).alias("l_doc"), _row(text_col).alias("l_row"), F.posexplode(_split(text_col)).alias("l_pos", "l_line"))
    d = d.withColumn("l_key", _key(F.col("l_line"))).where(F.length("l_key") >= least_chars)
    return d.select(F.xxhash64("l_key").alias("l_a"), F.xxhash64(F.lit(1), "l_key").alias("l_b"), "l_doc", "l_row", "l_pos")


def dropped_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(l_doc, l_row, l_pos) of the lines whose key at least ``least_docs`` documents have and a larger id keeps."""
    order = [F.desc("l_doc"), F.col("l_pos")]
    ranged = lines.repartitionByRange("l_a", "l_b", F.desc("l_doc")).sortWithinPartitions("l_a", "l_b", *order)
    # written, so that ranges aren't drawn anew where they are read again
    d = written(ranged.withColumn("l_range", F.spark_partition_id()), "line-ranges")
    ends = d.groupBy("l_range").agg(F.min(F.struct("l_a", "l_b")).alias("x"), F.max(F.struct("l_a", "l_b")).alias("y"))
    ends = ends.select("l_range", F.explode(F.array("x", "y")).alias("e")).groupBy("e.l_a", "e.l_b").agg(F.count_distinct("l_range").alias("n")).where("n > 1").drop("n")
    # two for each range at most
    cut = d.join(F.broadcast(ends), ["l_a", "l_b"], "left_semi").groupBy("l_a", "l_b")
    cut = written(cut.agg((F.count_distinct("l_doc") + F.max(F.col("l_doc").isNull().cast("long"))).alias("l_all"), F.max("l_doc").alias("l_most")), "lines-over-ranges")
    of_key = Window.partitionBy("l_range", "l_a", "l_b")
    stream = of_key.orderBy(*order)
    fresh = (F.row_number().over(stream) == 1) | ~F.lag("l_doc").over(stream).eqNullSafe(F.col("l_doc"))
    d = d.withColumn("l_fresh", fresh.cast("long")).withColumn("l_first", F.first("l_doc").over(stream)).withColumn("l_docs", F.sum("l_fresh").over(of_key))
    d = d.join(F.broadcast(cut), ["l_a", "l_b"], "left")
    first = F.when(F.col("l_all").isNotNull(), F.col("l_most")).otherwise(F.col("l_first"))
    return d.where((F.coalesce("l_all", "l_docs") >= least_docs) & ~F.col("l_doc").eqNullSafe(first)).select("l_doc", "l_row", "l_pos")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(l_doc, l_row, l_keep, l_dropped) of the rows that lose lines.

    ``l_keep``: in order, the words (at, bits) of the bitmap in which a line goes; bit i of word w is 1 if line 64 * w + i stays. Other words are all ones.
    """
    gone = dropped_lines(hashed_lines(docs, id_col, text_col, least_chars), least_docs)
    words = gone.groupBy("l_doc", "l_row", F.shiftright("l_pos", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, l_pos & 63)")).alias("gone"))
    word = F.struct("at", F.bitwise_not("gone").alias("bits"))
    return words.groupBy("l_doc", "l_row").agg(F.sort_array(F.collect_list(word)).alias("l_keep"), F.sum(F.bit_count("gone")).cast("long").alias("l_dropped"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``l_keep`` and ``l_dropped``; rows that lose nothing have null and 0."""
    d = docs.drop("l_doc", "l_row", "l_keep", "l_dropped").withColumn("l_at", _row(text_col))
    d = d.join(bitmaps, F.col(id_col).eqNullSafe(F.col("l_doc")) & (F.col("l_at") == F.col("l_row")), "left")
    return d.withColumn("l_dropped", F.coalesce("l_dropped", F.lit(0).cast("long"))).drop("l_doc", "l_row", "l_at")


def kept_text(text_col: str = "text") -> Column:
    """The lines that ``l_keep`` leaves of a text."""
    dense = "flatten(transform(l_keep, (w, k) -> concat(array_repeat(-1L, w.at - coalesce(get(l_keep, k - 1).at, -1) - 1), array(w.bits))))"
    lines = f"split(`{text_col}`, '\n')"
    # one array for all lines of a text: a lambda's own would be made for each line
    picked = f"transform(array(struct({lines} AS ls, {dense} AS ws)), z -> filter(z.ls, (x, i) -> coalesce(shiftright(get(z.ws, shiftright(i, 6)), i & 63) & 1, 1L) = 1))[0]"
    return F.when(F.col("l_keep").isNull(), F.col(text_col)).otherwise(F.array_join(F.expr(picked), "\n"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` without the lines that another document keeps."""
    own = docs.select(F.struct(*docs.columns).alias("own"), id_col, text_col)
    d = with_bitmaps(own, keep_bitmaps(docs, id_col, text_col, least_chars, least_docs), id_col, text_col)
    return d.select(*[kept_text(text_col).alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the lines of each document, how many of them go, and a digest of what stays."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    d = with_bitmaps(docs, keep_bitmaps(docs))
    return d.select("doc_id", F.size(_split("text")).cast("long").alias("n_lines"), F.col("l_dropped").alias("n_dropped"), F.sha2(F.coalesce(kept_text(), F.lit("")), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS k FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
s AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
m AS (SELECT r, doc_id, i, line, s.k IS NOT NULL AND doc_id <> top AS gone FROM l LEFT JOIN s ON s.k = l.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r
"""
