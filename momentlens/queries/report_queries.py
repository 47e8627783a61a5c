"""Transients, clips, reports, overlays, orders of labels; and plain relational queries over the star schema (an extension)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentlens.functions import scalars as fn
from momentlens.operators import intervals, manifest, report, signals, sketches, vectors
from momentlens.operators.vectors import still
from momentlens.plans import moments as plans
from momentlens.queries import sql
from momentlens.sources import adapters as src
from momentlens.sources import files
from momentlens.sources.shared import scratch

R = lambda c, n=6: fn.rounded(F.col(c), n).alias(c)


def w04_transients(spark: SparkSession, sf: str) -> DataFrame:
    """Sudden, prominent rises of the hourly mean over its running median."""
    energy = src.hourly(spark, sf).select("asset", "idx", F.col("clip").alias("value"))
    return plans.transients(energy, median=10, smooth=4, distance=6).select("asset", "idx", R("value"), R("prominence"))


def w11_audio_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Two-second windows at each half second of very short assets."""
    d = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("asset"), (F.col("o_totalprice") / 50000).alias("duration"))
    d = d.where("duration >= 0.5").withColumn("step", F.explode(F.sequence(F.lit(0), (F.floor(F.col("duration") / 0.5) - 1).cast("int"))))
    start, end = signals.window_bounds(F.col("duration"), F.col("step"))
    return d.select("asset", F.col("step").cast("long").alias("step"), F.round(start, 6).alias("start"), F.round(end, 6).alias("end"))


def w15_adaptive_clips(spark: SparkSession, sf: str) -> DataFrame:
    d = src.table(spark, sf, "events").select(F.col("user_id").alias("asset"), ((F.col("event_id") % 997) / 10).alias("t"), F.col("value").alias("strength"))
    ends = d.groupBy("asset").agg(F.max("t").alias("duration"))
    return intervals.adaptive_clips(d, ends).select("asset", R("start"), R("end"), R("score"), "n")


def j03_complete_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Users and days with all five kinds of events."""
    d = src.table(spark, sf, "events").select("user_id", F.dayofmonth("ts").cast("long").alias("day"), "event_type")
    return d.groupBy("user_id", "day").agg(F.count_distinct("event_type").alias("kinds")).where("kinds = 5")


def j10_files(spark: SparkSession, sf: str) -> DataFrame:
    """A map from labels to files of each customer, and its entries again."""
    d = src.table(spark, sf, "orders").select("o_custkey", F.struct(F.col("o_orderkey").cast("string").alias("label"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("file")).alias("e"))
    m = d.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list("e")).alias("files"))
    return m.select("o_custkey", F.explode("files").alias("label", "file"))


def j15_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The frames of each supplier's merged shipments, two a day."""
    seg = intervals.merged(src.shipments(spark, sf), "source", 2.0, span=30.0).select("source", "start", "end")
    frames = seg.groupBy("source").agg(F.ceil(F.max("end") * 2).cast("long").alias("last")).select("source", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("idx"))
    return intervals.frames_within(seg, frames, 2.0).groupBy("source", "start").agg(F.count(F.lit(1)).alias("n"), F.min("idx").cast("long").alias("first"), F.max("idx").cast("long").alias("last"))


def f05_still(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose lines' prices hardly differ."""
    d = src.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("sizes"))
    return d.select("l_orderkey", still(F.col("sizes"), 0.9).alias("still"))


def p09_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Overlay lines and output names of pages."""
    d = src.table(spark, sf, "pages")
    score = (F.col("page_id") % 100) / 100
    return d.select(
        "page_id", F.format_string("[%s] Score: %.2f", fn.segment_label(F.col("page_id") % 702), score.cast("double")).alias("line1"), F.concat(F.lit("Source: "), F.right(F.col("url"), F.lit(20))).alias("line2"),
        F.concat(F.lit("Why: "), F.left(F.col("url"), F.lit(40))).alias("line3"), F.concat(fn.stem(F.col("url")), F.lit("_moments.mp4")).alias("output"),
    )


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    d = src.table(spark, sf, "events").select(F.col("event_type").alias("asset"), F.concat(F.lit("class"), F.get_json_object("props", "$.k")).alias("name"), (F.col("value") / 500).alias("prob"))
    return plans.reported(src.hourly(spark, sf), plans.THREE, 5, d.where("name IS NOT NULL").groupBy("asset", "name").agg(F.max("prob").alias("peak")))


def k06_report(spark: SparkSession, sf: str) -> DataFrame:
    """The whole report as text: totals, the table, each asset's section."""
    return report.markdown(_reports(spark, sf)).select(F.col("part").cast("long").alias("part"), "place", "value")


def s12_report(spark: SparkSession, sf: str) -> DataFrame:
    """The reports' highlights, one row each, as a reader of the nested file sees them."""
    d = manifest.flattened(_reports(spark, sf).select("name", "duration", "frames_analyzed", "rating", "highlights"))
    return d.select("name", "duration", "frames_analyzed", "rating", F.col("pos").cast("long").alias("pos"), "item.start", "item.end", "item.peak_time", "item.hybrid_score", "item.primary_signal", F.array_join("item.reasons", "; ").alias("why"))


def k05_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as segments with the focal points of their lines' grids; a segment without frames has the middle."""
    segments = src.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("label"), (F.col("o_totalprice") / 1000).alias("start"), F.lit(0.9).alias("focal_x"))
    frames = src.table(spark, sf, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").cast("string").alias("label"), F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_extendedprice") / 1000, "l_linenumber").alias("grid"))
    return manifest.enriched(segments, vectors.focal_point(frames, columns=5)).select("label", R("start"), "focal_x", "side")


def t10_label_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Labels given before the ranking and after it."""
    d = plans.rated(src.hourly(spark, sf), plans.THREE, 5).select("asset", "idx", "value")
    first = plans.numbered(d, [F.col("asset"), F.col("idx")]).withColumnRenamed("label", "before").drop("rank")
    return plans.numbered(first, [F.desc("value"), F.col("asset"), F.col("idx")]).select("asset", "idx", "before", F.col("label").alias("after"))


def m02_spring(spark: SparkSession, sf: str) -> DataFrame:
    frame = (F.col("o_orderkey") % 60).cast("double")
    return src.table(spark, sf, "orders").select("o_orderkey", F.round(fn.spring(frame, 30, 12, 100, 0.6), 6).alias("eased"))


def o10_grid(spark: SparkSession, sf: str) -> DataFrame:
    d = src.table(spark, sf, "nation").select("n_nationkey", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: i / 4)).alias("pos", "x"))
    return d.select("n_nationkey", F.col("pos").cast("long").alias("pos"), "x")


def x01_pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    d = src.table(spark, sf, "lineitem").where("l_shipdate <= '1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    return d.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def x02_rollup(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: src.table(spark, sf, n)
    d = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.rollup("r_name", "n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count(F.lit(1)).alias("n"))


def x03_top_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's three dearest orders."""
    d = src.table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return d.withColumn("r", F.row_number().over(w).cast("long")).where("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "r")


def k08_index(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk index after two overlapping additions, of which one is repeated: chunks of each source."""
    d = src.chunk_index(spark, sf).select("source", "start", "end", "embedding")
    path = f"{scratch(spark)}/index-{uuid.uuid4().hex}"
    early, late = d.where("start < 600"), d.where("start >= 300")
    for part in (early, late, late):
        files.add_chunks(part, path, "model", buckets=8)
    return files.indexed_sources(spark, path, "model").select("source", "chunks", "first", "last")


def k07_cache(spark: SparkSession, sf: str) -> DataFrame:
    """The signal cache after two signals were added and one of them again: its series."""
    d, path = src.hourly(spark, sf), f"{scratch(spark)}/cache-{uuid.uuid4().hex}"
    signal = lambda n: d.select("asset", F.lit(n).alias("signal"), "idx", F.col(n).alias("value"))
    for names in (["clip"], ["clip", "flow"]):
        files.cache_signals(signal(names[0]) if len(names) == 1 else signal(names[0]).unionByName(signal(names[1])), path, buckets=8)
    return files.cached_signals(spark, path, ["clip", "flow"]).groupBy("asset", "signal").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def a10_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of each day's events, merged by type: exact counts, and whether the estimates are within their bounds."""
    d = src.table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "event_id", "value")
    m = sketches.merged(sketches.sketched(d, ["event_type", "day"], "event_id", "value"), ["event_type"])
    m = m.select("event_type", "n", "least", "highest", sketches.distinct_count().alias("ids"), *[sketches.quantile(p).alias(f"q{int(100 * p)}") for p in (0.25, 0.5, 0.9)])
    # the share of values up to an estimate is its rank
    ranks = d.join(m.select("event_type", "q25", "q50", "q90"), "event_type").groupBy("event_type").agg(*[F.avg((F.col("value") <= F.col(q)).cast("double")).alias(f"r{q}") for q in ("q25", "q50", "q90")])
    ok = [F.abs(F.col(f"rq{p}") - p / 100) <= sketches.RANK_ERROR + 1 / F.col("n") for p in (25, 50, 90)]
    near = F.abs(F.col("ids") / F.col("n") - 1) <= sketches.COUNT_ERROR
    return m.join(ranks, "event_type").select("event_type", "n", "least", "highest", near.alias("ids_near"), (ok[0] & ok[1] & ok[2]).alias("quantiles_near"))


def k11_render_props(spark: SparkSession, sf: str) -> DataFrame:
    """What a renderer is handed of each order: lines as segments, of which those of two and more units are spoken over; read back from its JSON."""
    d = src.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("pos"), fn.segment_label(F.col("l_linenumber") - 1).alias("label"), F.col("l_discount").alias("score"), F.col("l_quantity").alias("units"))
    nested = manifest.nested(d, "source", ["label", "score"], "pos")
    spoken = manifest.voiceover_manifests(d.where("units >= 2").withColumn("text", F.concat(F.lit("line "), "label")), "source", "narrator")
    schema = "source string, segments array<struct<label: string, score: double>>, fps int, showLabels boolean, voiceovers array<struct<label: string, file: string>>"
    props = manifest.render_props(nested, spoken, "source").select("source", F.from_json("props", schema).alias("p"))
    return props.select("source", F.col("p.fps").cast("long").alias("fps"), F.size("p.segments").cast("long").alias("segments"), F.array_join("p.voiceovers.file", ",").alias("files")).fillna("", ["files"])


QUERIES = {f.__name__: f for f in (w04_transients, w11_audio_windows, w15_adaptive_clips, j03_complete_assets, j10_files, j15_frames, f05_still, p09_overlay, k06_report, s12_report, k05_enriched, k07_cache, k08_index, k11_render_props, a10_sketches, t10_label_orders, m02_spring, o10_grid, x01_pricing_summary, x02_rollup, x03_top_orders)}

_THREE = dict(plans.THREE.weights)
_FIVE = f"{sql.peaks(_THREE, 4, 0.45, 1)}, fp AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY asset ORDER BY idx) <= 5)"
_REPORT = f"""{_FIVE}, st AS (SELECT asset, max(value) AS top, min(value) AS low, max(idx) + 1 AS frames, ((max(idx) + 1) / 2.0)::DOUBLE AS d, CASE WHEN max(value) > 0.6 THEN 'high' WHEN max(value) > 0.4 THEN 'medium' ELSE 'low' END AS rating FROM smo GROUP BY 1),
hl AS (SELECT fp.asset, fp.idx, row_number() OVER (PARTITION BY fp.asset ORDER BY fp.idx) - 1 AS pos, greatest(0.0, fp.idx / 2.0 - 7.5)::DOUBLE AS start, least(d, fp.idx / 2.0 + 7.5)::DOUBLE AS "end", value, panns, clip, flow, d, frames, rating,
  CASE WHEN panns >= clip AND panns >= flow THEN 'audio' WHEN clip >= flow THEN 'visual' ELSE 'motion' END AS best,
  CASE WHEN panns > 0.5 OR clip > 0.5 OR flow > 0.5 THEN concat_ws('; ', CASE WHEN panns > 0.5 THEN printf('audio (%.2f)', round(panns, 2)) END, CASE WHEN clip > 0.5 THEN printf('visual (%.2f)', round(clip, 2)) END, CASE WHEN flow > 0.5 THEN printf('motion (%.2f)', round(flow, 2)) END)
    ELSE 'combined signals (' || CASE WHEN panns >= clip AND panns >= flow THEN 'audio' WHEN clip >= flow THEN 'visual' ELSE 'motion' END || ' dominant)' END AS why
  FROM fp JOIN nrm ON nrm.asset = fp.asset AND nrm.idx = fp.idx JOIN st ON st.asset = fp.asset),
trg AS (SELECT asset, name, peak, row_number() OVER (PARTITION BY asset ORDER BY peak DESC, name) AS r FROM (SELECT event_type AS asset, 'class' || json_extract_string(props, '$.k') AS name, max(value / 500) AS peak FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2)),
heard AS (SELECT asset, string_agg(name, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS t3, string_agg(name, ', ' ORDER BY r) FILTER (WHERE r <= 10) AS t10 FROM trg GROUP BY 1)"""
ORACLES = {
    "k07_cache": f"""WITH {sql.SIGNALS} SELECT asset, 'clip' AS signal, count(*) AS n, round(sum(clip), 4) AS total FROM sig GROUP BY 1 UNION ALL SELECT asset, 'flow', count(*), round(sum(flow), 4) FROM sig GROUP BY 1""",
    "k08_index": f"WITH {sql.CHUNKS} SELECT source, count(*) AS chunks, min(s) AS first, max(e) AS last FROM chk GROUP BY 1",
    "k11_render_props": """WITH s AS (SELECT l_orderkey AS source, count(*) AS segments FROM lineitem GROUP BY 1),
f AS (SELECT source, string_agg('voiceover/vo_' || chr(64 + n) || '.wav', ',' ORDER BY n) AS files FROM (SELECT DISTINCT l_orderkey AS source, l_linenumber AS n FROM lineitem WHERE l_quantity >= 2) GROUP BY 1)
SELECT source, CAST(30 AS BIGINT) AS fps, segments, coalesce(files, '') AS files FROM s LEFT JOIN f USING (source)""",
    "a10_sketches": "SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS highest, true AS ids_near, true AS quantiles_near FROM events GROUP BY 1",
    "w04_transients": f"""WITH RECURSIVE {sql.SIGNALS}, ris AS (SELECT asset, idx, greatest(d, 0) AS value FROM (SELECT asset, idx, lead(clip) OVER (PARTITION BY asset ORDER BY idx) - clip AS d FROM sig) WHERE d IS NOT NULL),
{sql.taps('ris', -5, 5, 'm')}, med AS (SELECT asset, idx, list_sort(list(v))[6] AS md FROM m GROUP BY 1, 2), onset AS (SELECT asset, idx, greatest(value - md, 0) AS value FROM ris JOIN med USING (asset, idx)),
{sql.taps('onset', -2, 2, 'a')}, smo AS (SELECT asset, idx, round(avg(v), 9) AS value FROM a GROUP BY 1, 2),
{sql.kept_peaks('SELECT asset, quantile_cont(value, 0.85) AS f FROM smo WHERE value > 0 GROUP BY 1', 6)},
wall AS (SELECT p.asset, p.idx, p.value, max(s.idx) FILTER (WHERE s.value > p.value AND s.idx < p.idx) AS wl, min(s.idx) FILTER (WHERE s.value > p.value AND s.idx > p.idx) AS wr FROM pk p JOIN smo s USING (asset) GROUP BY 1, 2, 3),
low AS (SELECT w.asset, w.idx, w.value, min(s.value) FILTER (WHERE s.idx <= w.idx) AS ll, min(s.value) FILTER (WHERE s.idx >= w.idx) AS lr FROM wall w JOIN smo s ON s.asset = w.asset AND (wl IS NULL OR s.idx > wl) AND (wr IS NULL OR s.idx < wr) GROUP BY 1, 2, 3)
SELECT low.asset, low.idx, round(value, 6) AS value, round(value - greatest(ll, lr), 6) AS prominence FROM low JOIN flo USING (asset) WHERE value - greatest(ll, lr) >= f * 0.5""",
    "w11_audio_windows": """WITH o AS (SELECT o_orderkey AS asset, o_totalprice / 50000 AS d FROM orders), s AS (SELECT asset, d, unnest(range(0, CAST(floor(d / 0.5) AS BIGINT))) AS step FROM o WHERE d >= 0.5)
SELECT asset, step, round(greatest(0.0, step * 0.5 + 0.25 - 1), 6) AS start, round(least(d, greatest(0.0, step * 0.5 + 0.25 - 1) + 2), 6) AS "end" FROM s""",
    "w15_adaptive_clips": f"""WITH p AS (SELECT user_id AS asset, event_id % 997 / 10 AS t, value FROM events), m AS (SELECT asset, max(value) AS top, max(t) AS d FROM p GROUP BY 1),
c AS (SELECT asset, t, d, value / top AS score, 0.2 + value / top * (0.8 - 0.2) AS len FROM p JOIN m USING (asset)), e AS (SELECT *, least(d - 0.1, greatest(0.0, t - 0.1) + len) AS e FROM c), r AS (SELECT asset, greatest(0.0, e - len) AS s, e, score FROM e),
{sql.merged('r', 'asset', 0.0, True)} SELECT mrg.asset, round(s, 6) AS start, round(e, 6) AS "end", round(score, 6) AS score, n FROM mrg JOIN m USING (asset) WHERE s < d - 0.5""",
    "j03_complete_assets": "SELECT user_id, CAST(day(ts) AS BIGINT) AS day, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 5",
    "j10_files": "SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS label, o_orderkey || '.wav' AS file FROM orders",
    "j15_frames": f"""WITH {sql.SHIPMENTS}, {sql.merged('shp', 'source', 2.0, False)}, g AS (SELECT source, s, CAST(floor(s * 2) AS BIGINT) AS a, CAST(floor(e * 2) AS BIGINT) AS b FROM mrg)
SELECT source, s AS start, b - a AS n, a AS first, b - 1 AS last FROM g WHERE b > a""",
    "f05_still": "SELECT l_orderkey, count(*) < 2 OR min(l_quantity) / max(l_quantity) >= 0.9 AS still FROM lineitem GROUP BY 1",
    "p09_overlay": f"""SELECT page_id, '[' || {sql.label('(page_id % 702)')} || '] Score: ' || printf('%.2f', page_id % 100 / 100) AS line1, 'Source: ' || right(url, 20) AS line2, 'Why: ' || left(url, 40) AS line3, regexp_replace(url, '\\.[^./]+$', '') || '_moments.mp4' AS output FROM pages""",
    "k06_report": f"""WITH RECURSIVE {_REPORT}, lines AS (SELECT asset, count(*) AS n, string_agg(printf('%d. %.1fs - %.1fs (%.3f), %s; audio %.3f, visual %.3f, motion %.3f; %s', pos + 1, round(start, 2), round("end", 2), round(value, 3), best, round(panns, 3), round(clip, 3), round(flow, 3), why), chr(10) ORDER BY pos) AS txt FROM hl GROUP BY 1),
allof AS (SELECT st.*, coalesce(n, 0) AS n, txt, t3, t10 FROM st LEFT JOIN lines USING (asset) LEFT JOIN heard USING (asset))
SELECT 0::BIGINT AS part, 0::BIGINT AS place, printf('Assets: %d. Highlights: %d.', count(*), coalesce(sum(n), 0)::BIGINT) AS value FROM allof
UNION ALL SELECT 1, row_number() OVER w, printf('| %d | %s | %.0fs | %s | %.3f | %d | %s |', row_number() OVER w, right(asset, 15), d, rating, round(top, 3), n, coalesce(t3, 'none')) FROM allof WINDOW w AS (ORDER BY round(top, 3) DESC, asset)
UNION ALL SELECT 2, row_number() OVER (ORDER BY asset), printf('### %s' || chr(10) || '%.1fs, rated %s, scores %.3f to %.3f', asset, d, rating, round(low, 3), round(top, 3)) || coalesce(chr(10) || 'Heard: ' || t10, '') || chr(10) || coalesce(txt, 'No highlights.') FROM allof""",
    "s12_report": f"""WITH RECURSIVE {_REPORT} SELECT asset AS name, round(d, 1) AS duration, CAST(frames AS BIGINT) AS frames_analyzed, rating, pos, round(start, 2) AS start, round("end", 2) AS "end", round(idx / 2.0, 2)::DOUBLE AS peak_time, round(value, 3) AS hybrid_score, best AS primary_signal, why FROM hl""",
    "k05_enriched": """WITH m AS (SELECT CAST(l_orderkey AS VARCHAR) AS label, avg(l_quantity) AS a, avg(l_discount * 100) AS b, avg(l_tax * 100) AS c, avg(l_extendedprice / 1000) AS d, avg(l_linenumber) AS e FROM lineitem WHERE l_quantity > 10 GROUP BY 1),
f AS (SELECT label, round(greatest(0.2, least(0.8, CASE WHEN a + b + c + d + e < 1e-6 THEN 0.5 ELSE (b * 0.25 + c * 0.5 + d * 0.75 + e) / (a + b + c + d + e) END)), 3) AS x FROM m)
SELECT CAST(o_orderkey AS VARCHAR) AS label, round(o_totalprice / 1000, 6) AS start, coalesce(x, 0.5) AS focal_x, CASE WHEN coalesce(x, 0.5) < 0.4 THEN 'left' WHEN coalesce(x, 0.5) > 0.6 THEN 'right' ELSE 'center' END AS side FROM orders LEFT JOIN f ON label = CAST(o_orderkey AS VARCHAR)""",
    "t10_label_orders": f"""WITH RECURSIVE {_FIVE}, r AS (SELECT asset, idx, row_number() OVER (ORDER BY asset, idx) - 1 AS a, row_number() OVER (ORDER BY value DESC, asset, idx) - 1 AS b FROM fp)
SELECT asset, idx, {sql.label('a')} AS before, {sql.label('b')} AS after FROM r""",
    "m02_spring": """WITH t AS (SELECT o_orderkey, o_orderkey % 60 / 30 AS t, sqrt(100 / 0.6) AS o, 12 / (2 * sqrt(100 * 0.6)) AS z FROM orders), w AS (SELECT *, o * sqrt(1 - z * z) AS w FROM t)
SELECT o_orderkey, round(1 - exp(-z * o * t) * (cos(w * t) + z * o / w * sin(w * t)), 6) AS eased FROM w""",
    "o10_grid": "SELECT n_nationkey, unnest(range(0, 5)) AS pos, unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS x FROM nation",
    "x01_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "x02_rollup": "SELECT r_name, n_name, round(sum(c_acctbal), 2) AS balance, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "x03_top_orders": "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 3",
}
