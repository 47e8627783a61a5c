"""Vectors, manifests, reports, texts and timelines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlens.functions import scalars as fn
from momentlens.functions.vectors import truncated
from momentlens.operators import manifest, report, timeline, vector_index, vectors
from momentlens.plans import moments as plans
from momentlens.profiles import CALLOUTS_HIGH, CALLOUTS_MIDDLE, NARRATION_HIGH, NARRATION_LOW, NARRATION_MIDDLE
from momentlens.queries import sql
from momentlens.sources import adapters as src
from momentlens.sources import files
from momentlens.sources.shared import scratch

R = lambda c, n=6: F.round(c, n).alias(c)
BACKENDS = [("qwen", "qwen"), ("gemma", "gemma")]


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The first vector of the table: one row."""
    return src.table(spark, sf, "embeddings").orderBy("vec_id").first()["embedding"]


def s02_media_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose address has a known extension, of any case."""
    d = src.table(spark, sf, "pages").select("page_id", fn.file_name(F.col("url")).alias("name"), fn.suffix(F.col("url")).alias("suffix"))
    return d.where(F.col("suffix") != "")


def s05_probes(spark: SparkSession, sf: str) -> DataFrame:
    """Duration, frame rate and size from probe texts of orders; the first stream is sound, and some rates have a zero denominator."""
    k = F.col("o_orderkey")
    text = F.format_string('{"format": {"duration": "%.4f"}, "streams": [{"r_frame_rate": "0/0"}, {"width": %d, "height": 1080, "r_frame_rate": "%d/%d"}]}', F.col("o_totalprice") / 100, 640 + k % 5 * 320, 24000 + k % 7 * 1000, k % 3 * 1001)
    d = files.probed(src.table(spark, sf, "orders").select("o_orderkey", text.alias("json")))
    return d.select("o_orderkey", R("duration", 4), R("fps"), F.col("width").cast("long").alias("width"))


def k02_list(spark: SparkSession, sf: str) -> DataFrame:
    """The list of the clips of the nations' timeline, written in order and read back."""
    d = src.table(spark, sf, "nation").select(F.col("n_nationkey").alias("rank"), F.concat(F.lit("it's "), F.lower("n_name"), F.lit(".mp4")).alias("file"))
    path = f"{scratch(spark)}/list-{uuid.uuid4().hex}"
    files.concat_list(d, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def s15_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = src.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("source"), (F.col("o_totalprice") / 1000).alias("duration"))
    return vectors.chunks(d).select("source", "start", R("end"), "chunk_id")


def j04_fresh(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines' parts that no order before 1995 had."""
    d = src.table(spark, sf, "lineitem")
    return vectors.fresh(d.select("l_partkey").distinct(), d.where("l_shipdate < '1995-01-01'"), "l_partkey")


def p05_contrast(spark: SparkSession, sf: str) -> DataFrame:
    d = src.table(spark, sf, "embeddings")
    prompts = d.select(F.when(F.col("vec_id") % 2 == 0, 1).otherwise(-1).alias("polarity"), F.expr("transform(embedding, x -> cast(x as double))").alias("vec"))
    return vectors.contrast(d, prompts, ["vec_id"]).select("vec_id", R("score"))


def p07_truncated(spark: SparkSession, sf: str) -> DataFrame:
    d = src.table(spark, sf, "embeddings").select("vec_id", truncated(F.col("embedding"), 16).alias("v"))
    return d.select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), R("x"))


def j12_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.nearest(src.chunk_index(spark, sf), _query_vector(spark, sf), 25).select("chunk_id", "source", R("similarity"))


def _indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, str]:
    """All vectors, those whose id is divisible by 50 as queries, and the path of an index of all."""
    d, path = src.table(spark, sf, "embeddings").select("vec_id", "embedding"), f"{scratch(spark)}/vectors-{uuid.uuid4().hex}"
    vector_index.build(d, path, "vec_id")
    return d, d.where("vec_id % 50 = 0"), path


def j12_search(spark: SparkSession, sf: str) -> DataFrame:
    """Searches of every vector whose id is divisible by 50, against all, by the index: similarity of at least 0.1."""
    _, q, path = _indexed(spark, sf)
    hit = vector_index.within(q, path, 0.1, "vec_id").where("_q <> _id")
    return hit.select(F.col("_q").alias("query_id"), F.col("_id").alias("vec_id"), R("similarity"))


def j12_top(spark: SparkSession, sf: str) -> DataFrame:
    """The five vectors that are most similar to each vector whose id is divisible by 50, itself included."""
    _, q, path = _indexed(spark, sf)
    d = vector_index.nearest(q, path, 5, "vec_id")
    return d.select(F.col("_q").alias("query_id"), F.col("place").cast("long").alias("place"), F.col("_id").alias("vec_id"), R("similarity"))


def t03_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The segments that a query returns."""
    index = src.chunk_index(spark, sf)
    d = plans.searched(index, src.durations(index), _query_vector(spark, sf), 10, threshold=0.1)
    return d.select("rank", "label", "source", "start", "end", R("score"))


def a10_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return report.index_stats(src.table(spark, sf, "documents"), "source")


def a15_centroids(spark: SparkSession, sf: str) -> DataFrame:
    d = vectors.centroid(src.table(spark, sf, "embeddings"), ["label"])
    return d.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), R("x"))


def a14_focal_points(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of a grid of five columns by supplier."""
    d = src.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("label"), F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_extendedprice") / 1000, "l_linenumber").alias("grid"))
    d = vectors.focal_point(d, columns=5)
    return d.select("label", R("focal_x", 3), fn.side(F.col("focal_x")).alias("side"))


def a11_cost(spark: SparkSession, sf: str) -> DataFrame:
    d = src.table(spark, sf, "orders").select((F.col("o_totalprice") / 100).alias("duration"))
    return report.sampling_cost(d).select("frames", "calls", R("cost", 4))


def a08_ratings(spark: SparkSession, sf: str) -> DataFrame:
    d = plans.smoothed(src.hourly(spark, sf), plans.THREE).groupBy("asset").agg(F.max("value").alias("top"), F.avg("value").alias("mean"))
    d = d.withColumn("rating", fn.rating_tier(F.col("top")))
    return d.groupBy("rating").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mean"), 6).alias("mean"))


def t05_top_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Each segment's best three priorities by order count."""
    d = src.table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    m = d.groupBy("o_orderstatus").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))
    return m.select("o_orderstatus", F.explode(report.top_entries(F.col("m"), 3)).alias("o_orderpriority", "n"))


def j05_selected(spark: SparkSession, sf: str) -> DataFrame:
    d = src.table(spark, sf, "orders").select("o_orderkey", fn.segment_label(F.col("o_orderkey") % 30).alias("label"))
    return manifest.selected(d, include=["a", "B", "c ", "AA", "ab"], exclude=["B"])


def j09_voiceover(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' last order as the file of their label."""
    files = src.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("label"), F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("pos"))
    return manifest.with_voiceover(src.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("label")), files)


def j08_accepted(spark: SparkSession, sf: str) -> DataFrame:
    segments = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("rank"), "o_orderdate", "o_custkey")
    files = src.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("rank")).agg(F.sum("l_quantity").cast("long").alias("length"))
    return manifest.accepted(segments, files, ["o_custkey", "o_orderdate"], 100).select("rank", "o_custkey")


def k04_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as nested lines, and flat again."""
    d = src.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("quantity"))
    n = manifest.nested(d, "l_orderkey", ["l_linenumber", "quantity"], "l_linenumber")
    return manifest.flattened(n, "segments").select("l_orderkey", F.col("pos").cast("long").alias("pos"), "item.l_linenumber", "item.quantity")


def o05_json(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of JSON texts: clean, wrapped in prose, or none."""
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done"))).otherwise("nothing here")
    d = src.table(spark, sf, "events").select("event_id", text.alias("text"))
    return d.select("event_id", manifest.tolerant_json(F.col("text"), "k int", F.struct(F.lit(0).alias("k")), "k")["k"].alias("k"))


def p14_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Durations, ids and names as text."""
    return src.table(spark, sf, "orders").select(
        "o_orderkey", fn.human_duration(F.col("o_totalprice") / 10).alias("length"), fn.chunk_id(F.col("o_orderpriority"), F.col("o_orderkey") * 25.0).alias("id"),
        fn.collection_name("moments", F.concat(F.lit("Org/Model-"), F.col("o_orderstatus"))).alias("collection"), fn.backend_of(F.concat(F.lit("Org/"), F.when(F.col("o_orderkey") % 2 == 0, "Qwen-2B").otherwise("other")), BACKENDS, "gemma").alias("backend"),
        F.right(F.col("o_orderpriority"), F.lit(5)).alias("tail"), fn.rational(F.concat(F.col("o_orderkey").cast("string"), F.lit("/8"))).alias("fps"),
    )


def p21_narration(spark: SparkSession, sf: str) -> DataFrame:
    """A line for each segment of at least two seconds, by score and letters."""
    text = fn.narration(F.col("l_discount") * 8, fn.segment_label(F.col("l_orderkey") % 702))
    return src.table(spark, sf, "lineitem").where("l_quantity >= 2").select("l_orderkey", "l_linenumber", text.alias("text"))


def p26_callouts(spark: SparkSession, sf: str) -> DataFrame:
    """A callout for intense segments, by score and the first letter."""
    text = timeline.callout(F.col("l_discount") * 8, fn.segment_label(F.col("l_orderkey") % 702), list(CALLOUTS_MIDDLE), list(CALLOUTS_HIGH))
    return src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("callout"))


def _unique(spark: SparkSession, sf: str) -> DataFrame:
    d = src.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("rank"))
    return d.agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("s")).select("source", "rank", F.lit(0.0).alias("start"), (F.col("q") / 4).alias("end"), (F.col("s") * 8).alias("score"))


def w18_timeline(spark: SparkSession, sf: str) -> DataFrame:
    d = timeline.framed(_unique(spark, sf))
    return d.select("source", "rank", F.col("frames").cast("long").alias("frames"), F.col("timeline_start").cast("long").alias("timeline_start"))


def a20_length(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.length(_unique(spark, sf))


def o11_sound_cues(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.sound_cues(_unique(spark, sf)).select("source", "rank", "cue", "at", R("volume"))


def p29_camera(spark: SparkSession, sf: str) -> DataFrame:
    """Zoom, drift, offsets and ramps at one frame of each segment."""
    frame, frames = (F.col("rank") * 13).cast("double"), F.ceil(F.col("end") * 30).cast("double")
    x, y = timeline.drift(frame, frames, F.col("score"))
    return _unique(spark, sf).select(
        "source", "rank", F.round(timeline.zoom(frame, frames, F.col("score")), 6).alias("zoom"), F.round(x, 6).alias("dx"), F.round(y, 6).alias("dy"),
        F.round(timeline.focal_offset(F.when(F.col("rank") % 2 == 0, F.col("score"))) + 0.0, 6).alias("focal"), F.round(timeline.ramp(frame, 30, timeline.CALLOUT_RAMP), 6).alias("callout"),
        F.round(timeline.progress(frame, frames), 6).alias("progress"), F.round(fn.intensity(F.col("score")), 6).alias("intensity"),
    )


QUERIES = {f.__name__: f for f in (s02_media_files, s05_probes, k02_list, s15_chunks, j04_fresh, p05_contrast, p07_truncated, j12_nearest, j12_search, j12_top, t03_segments, a10_index_stats, a15_centroids, a14_focal_points, a11_cost, a08_ratings, t05_top_entries, j05_selected, j09_voiceover, j08_accepted, k04_manifest, o05_json, p14_texts, p21_narration, p26_callouts, w18_timeline, a20_length, o11_sound_cues, p29_camera)}

_THREE = dict(plans.THREE.weights)
_SIM = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_COS = "(" + _SIM + " / (sqrt(" + _SIM.replace("{b}", "{a}") + ") * sqrt(" + _SIM.replace("{a}", "{b}") + ")))"
_Q = "q AS (SELECT embedding AS qv FROM embeddings ORDER BY vec_id LIMIT 1)"
_SEG = "seg AS (SELECT l_orderkey AS source, l_linenumber AS rank, max(l_quantity) / 4 AS e, max(l_discount) * 8 AS score FROM lineitem GROUP BY 1, 2), fr AS (SELECT *, ceil(e * 30) AS frames, least(1.0, greatest(0.0, (score - 0.3) / 0.4)) AS n FROM seg)"
_LABEL21 = sql.label("(l_orderkey % 702)")
_U = sql.UNIT
_listed = lambda texts: "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"
ORACLES = {
    "s02_media_files": "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS suffix FROM pages WHERE regexp_matches(url, '\\.[^./]+$')",
    "s05_probes": "SELECT o_orderkey, round(o_totalprice / 100, 4) AS duration, CASE WHEN o_orderkey % 3 <> 0 THEN round((24000 + o_orderkey % 7 * 1000) / (o_orderkey % 3 * 1001), 6) END AS fps, 640 + o_orderkey % 5 * 320 AS width FROM orders",
    "k02_list": "SELECT 'file ''it' || chr(39) || chr(92) || chr(39) || chr(39) || 's ' || lower(n_name) || '.mp4' || chr(39) AS line FROM nation",
    "s15_chunks": """WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS source, o_totalprice / 1000 AS d FROM orders), c AS (SELECT source, d, CAST(unnest(range(0, CAST(floor(d) AS BIGINT), 25)) AS DOUBLE) AS start FROM a WHERE floor(d) >= 1)
SELECT source, start, round(least(start + 30, d), 6) AS "end", substr(sha256(source || ':' || printf('%.1f', start)), 1, 16) AS chunk_id FROM c WHERE least(start + 30, d) - start >= 2""",
    "j04_fresh": "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01')",
    "p05_contrast": f"""WITH p AS (SELECT vec_id % 2 = 0 AS pos, embedding AS v FROM embeddings), u AS (SELECT vec_id, {_U.format(v='embedding')} AS w FROM embeddings),
x AS (SELECT vec_id, pos, {_SIM.format(a='w', b='v')} AS d FROM u, p) SELECT vec_id, round(avg(d) FILTER (WHERE pos) - avg(d) FILTER (WHERE NOT pos), 6) + 0.0 AS score FROM x GROUP BY 1""",
    "p07_truncated": f"WITH t AS (SELECT vec_id, {_U.format(v='embedding[1:16]')} AS w FROM embeddings) SELECT vec_id, unnest(range(0, 16)) AS pos, round(unnest(w), 6) AS x FROM t",
    "j12_nearest": f"WITH {sql.CHUNKS}, {_Q}, s AS (SELECT chunk_id, source, {_COS.format(a='embedding', b='qv')} AS sim FROM chk, q) SELECT chunk_id, source, round(sim, 6) AS similarity FROM s ORDER BY sim DESC, chunk_id LIMIT 25",
    "j12_search": f"WITH s AS (SELECT b.vec_id AS query_id, a.vec_id, {_COS.format(a='a.embedding', b='b.embedding')} AS sim FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, vec_id, round(sim, 6) AS similarity FROM s WHERE sim >= 0.1",
    "j12_top": f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id, {_COS.format(a='a.embedding', b='b.embedding')} AS sim FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS place, vec_id, round(sim, 6) AS similarity FROM s QUALIFY place <= 5""",
    "t03_segments": f"""WITH {sql.CHUNKS}, {_Q}, k AS (SELECT source, s, e, {_COS.format(a='embedding', b='qv')} AS sim, chunk_id FROM chk, q ORDER BY sim DESC, chunk_id LIMIT 50),
h AS (SELECT source, greatest(0.0, s - 2) AS s, least(duration, e + 2) AS e, sim AS score FROM k JOIN dur USING (source) WHERE sim >= 0.1), {sql.merged('h', 'source', 5.0, False)},
f AS (SELECT source, s, CASE WHEN e - s < 3 THEN least(duration, s + 3) WHEN e - s > 30 THEN s + 30 ELSE e END AS e, score FROM mrg JOIN dur USING (source)),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, source, s) - 1 AS rank FROM f) SELECT rank, {sql.label('rank')} AS label, source, s AS start, e AS "end", round(score, 6) AS score FROM r WHERE rank < 10""",
    "a10_index_stats": "SELECT source, count(*) AS chunks FROM documents GROUP BY 1",
    "a15_centroids": f"""WITH u AS (SELECT label, {_U.format(v='embedding')} AS w FROM embeddings), x AS (SELECT label, unnest(range(0, len(w))) AS pos, unnest(w) AS x FROM u),
m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY 1, 2) SELECT label, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""",
    "a14_focal_points": """WITH m AS (SELECT CAST(l_suppkey AS VARCHAR) AS label, avg(l_quantity) AS a, avg(l_discount * 100) AS b, avg(l_tax * 100) AS c, avg(l_extendedprice / 1000) AS d, avg(l_linenumber) AS e FROM lineitem GROUP BY 1),
f AS (SELECT label, round(greatest(0.2, least(0.8, (b * 0.25 + c * 0.5 + d * 0.75 + e) / (a + b + c + d + e))), 3) AS focal_x FROM m)
SELECT label, focal_x, CASE WHEN focal_x < 0.4 THEN 'left' WHEN focal_x > 0.6 THEN 'right' ELSE 'center' END AS side FROM f""",
    "a11_cost": "WITH f AS (SELECT CAST(sum(floor(o_totalprice / 100 / 5)) AS BIGINT) AS frames FROM orders) SELECT frames, CAST(ceil(frames / 4) AS BIGINT) AS calls, round(ceil(frames / 4) * 0.004, 4) AS cost FROM f",
    "a08_ratings": f"WITH {sql.smooth(_THREE, 4)}, r AS (SELECT asset, max(value) AS top, avg(value) AS mean FROM smo GROUP BY 1) SELECT CASE WHEN top > 0.6 THEN 'high' WHEN top > 0.4 THEN 'medium' ELSE 'low' END AS rating, count(*) AS n, round(avg(mean), 6) AS mean FROM r GROUP BY 1",
    "t05_top_entries": "SELECT o_orderstatus, o_orderpriority, n FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) <= 3",
    "j05_selected": f"WITH l AS (SELECT o_orderkey, {sql.label('(o_orderkey % 30)')} AS label FROM orders) SELECT * FROM l WHERE label IN ('A', 'C', 'AA', 'AB')",
    "j09_voiceover": "SELECT CAST(c_custkey AS VARCHAR) AS label, arg_max(o_orderpriority, o_orderkey) AS file FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "j08_accepted": "SELECT o_orderkey AS rank, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING CAST(sum(l_quantity) AS BIGINT) > 100)",
    "k04_manifest": "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS pos, l_linenumber, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "o05_json": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) ELSE 0 END AS k FROM events",
    "p14_texts": """WITH o AS (SELECT *, CAST(floor(o_totalprice / 10) AS BIGINT) AS s FROM orders)
SELECT o_orderkey, CASE WHEN s < 60 THEN printf('%ds', s) WHEN s < 3600 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%dh%02dm', s // 3600, s // 60 % 60) END AS length,
 substr(sha256(o_orderpriority || ':' || printf('%.1f', o_orderkey * 25.0::DOUBLE)), 1, 16) AS id, 'moments_org_model_' || lower(o_orderstatus) AS collection, CASE WHEN o_orderkey % 2 = 0 THEN 'qwen' ELSE 'gemma' END AS backend, right(o_orderpriority, 5) AS tail, o_orderkey / 8 AS fps FROM o""",
    "p21_narration": f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_discount * 8 AS score, list_sum(list_transform(string_split({_LABEL21}, ''), lambda c: ascii(c))) AS k FROM lineitem WHERE l_quantity >= 2)
SELECT l_orderkey, l_linenumber, CASE WHEN score > 0.55 THEN {_listed(NARRATION_HIGH)}[CAST(k % 8 AS BIGINT) + 1] WHEN score > 0.4 THEN {_listed(NARRATION_MIDDLE)}[CAST(k % 6 AS BIGINT) + 1] ELSE {_listed(NARRATION_LOW)}[CAST(k % 4 AS BIGINT) + 1] END AS text FROM t""",
    "p26_callouts": f"""WITH t AS (SELECT l_orderkey, l_linenumber, least(1.0, greatest(0.0, (l_discount * 8 - 0.3) / 0.4)) AS n, ascii({_LABEL21}) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN n < 0.4 THEN NULL WHEN n > 0.7 THEN {_listed(CALLOUTS_HIGH)}[k % 5 + 1] ELSE {_listed(CALLOUTS_MIDDLE)}[k % 4 + 1] END AS callout FROM t""",
    "w18_timeline": f"WITH {_SEG} SELECT source, rank, CAST(frames AS BIGINT) AS frames, CAST(coalesce(sum(frames) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 10 * (row_number() OVER (PARTITION BY source ORDER BY rank) - 1) AS BIGINT) AS timeline_start FROM fr",
    "a20_length": f"WITH {_SEG} SELECT source, CAST(greatest(1, sum(frames) - greatest(0, count(*) - 1) * 10) AS BIGINT) AS frames FROM fr GROUP BY 1",
    "o11_sound_cues": f"""WITH {_SEG}, v AS (SELECT *, 0.1 + 0.25 * n AS vol FROM fr WHERE n >= 0.15)
SELECT source, rank, 'whoosh' AS cue, 0::BIGINT AS at, round(vol * 0.7, 6) AS volume FROM v UNION ALL SELECT source, rank, 'impact', 3, round(vol, 6) FROM v WHERE n > 0.5
UNION ALL SELECT source, rank, 'whip', CAST(greatest(0, frames - 15) AS BIGINT), round(vol * 0.5, 6) FROM v WHERE frames > 90""",
    "p29_camera": f"""WITH {_SEG}, c AS (SELECT *, rank * 13.0::DOUBLE AS f, CASE WHEN score > 0.45 THEN 1 ELSE -1 END * 3 * greatest(0.3, n) AS amt FROM fr), z AS (SELECT *, least(1.0, f / frames) AS part, least(1.0, greatest(0.0, (f - 24) / greatest(frames - 24, 1e-9))) AS back FROM c)
SELECT source, rank, round(CASE WHEN n > 0.5 THEN 1 + least(1.0, f / 30) * 0.35 * n - back * (0.35 * n - 0.15 * n) ELSE 1 + part * 0.12 * greatest(0.3, n) END, 6) AS zoom,
 round(amt * (part - 0.5), 6) AS dx, round(amt * 0.3 * (1 - 2 * part), 6) AS dy, round((coalesce(CASE WHEN rank % 2 = 0 THEN score END, 0.5) - 0.5) * -18 + 0.0, 6) AS focal,
 round(CASE WHEN f <= 9 THEN f / 9 WHEN f <= 36 THEN 1.0 WHEN f <= 54 THEN 1 - (f - 36) / 18 ELSE 0.0 END, 6) AS callout, round(least(100.0, f / frames * 100), 6) AS progress, round(n, 6) AS intensity FROM z""",
}
