"""SQL fragments for the comparison queries."""

from __future__ import annotations

from momentlens.sources.adapters import CLASSES

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
HOUR = "(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts))"
SIGNALS = f"""
hours AS (SELECT event_type AS asset, {HOUR} AS idx, avg(value) AS clip, sqrt(avg(value * value)) AS panns, CAST(count(*) AS DOUBLE) AS flow,
  coalesce(sum(CASE WHEN {_K} IN {CLASSES} THEN value END), 0) AS mae FROM events GROUP BY 1, 2),
spine AS (SELECT asset, unnest(range(0, (SELECT max(idx) + 1 FROM hours))) AS idx FROM (SELECT DISTINCT asset FROM hours)),
sig AS (SELECT asset, idx, coalesce(clip, 0) AS clip, coalesce(panns, 0) AS panns, coalesce(flow, 0) AS flow, coalesce(mae, 0) AS mae FROM spine LEFT JOIN hours USING (asset, idx))"""


def normal(columns: list[str]) -> str:
    scaled = ", ".join(f"CASE WHEN max({c}) OVER a - min({c}) OVER a < 1e-8 THEN 0 ELSE ({c} - min({c}) OVER a) / (max({c}) OVER a - min({c}) OVER a) END AS {c}" for c in columns)
    return f"nrm AS (SELECT asset, idx, {scaled} FROM sig WINDOW a AS (PARTITION BY asset))"


def fused(weights: dict[str, float]) -> str:
    total = " + ".join(f"{c} * {w!r}" for c, w in weights.items())
    return f"{SIGNALS}, {normal(list(weights))}, fus AS (SELECT asset, idx, 0.0::DOUBLE + {total} AS value FROM nrm)"


def smooth(weights: dict[str, float], size: int) -> str:
    return f"""{fused(weights)},
len AS (SELECT asset, count(*) AS n FROM fus GROUP BY 1),
tap AS (SELECT asset, idx, (((idx + k) % (2 * n)) + 2 * n) % (2 * n) AS j0, n FROM fus JOIN len USING (asset), (SELECT unnest(range({-(size // 2)}, {size - size // 2})) AS k)),
smo AS (SELECT t.asset, t.idx, round(avg(f.value), 9) AS value FROM tap t JOIN fus f ON f.asset = t.asset AND f.idx = CASE WHEN j0 < n THEN j0 ELSE 2 * n - 1 - j0 END GROUP BY 1, 2)"""


def kept_peaks(floor: str, distance: int) -> str:
    """Spaced local maxima `pk` of the series `smo`; ``floor``: SQL of each asset's least height as (asset, f)."""
    return f"""chg AS (SELECT *, sum(CASE WHEN value = pv THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY idx) AS run FROM (SELECT *, lag(value) OVER (PARTITION BY asset ORDER BY idx) AS pv FROM smo)),
rle AS (SELECT asset, run, min(idx) AS l, max(idx) AS r, first(value) AS value FROM chg GROUP BY 1, 2),
loc AS (SELECT asset, (l + r) // 2 AS idx, value FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM rle WINDOW w AS (PARTITION BY asset ORDER BY run)) WHERE a < value AND b < value),
flo AS ({floor}),
cand AS (SELECT loc.*, row_number() OVER (PARTITION BY loc.asset ORDER BY value DESC, idx DESC) AS rk FROM loc JOIN flo USING (asset) WHERE value >= f),
nms AS (
  SELECT asset, 0::BIGINT AS rk, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT asset FROM cand)
  UNION ALL
  SELECT n.asset, n.rk + 1, CASE WHEN len(list_filter(n.kept, lambda x: abs(x - c.idx) < {distance})) > 0 THEN n.kept ELSE list_append(n.kept, c.idx) END FROM nms n JOIN cand c ON c.asset = n.asset AND c.rk = n.rk + 1),
kep AS (SELECT asset, unnest(kept) AS idx FROM (SELECT asset, arg_max(kept, rk) AS kept FROM nms GROUP BY 1)),
pk AS (SELECT c.asset, c.idx, c.value FROM cand c JOIN kep USING (asset, idx))"""


def peaks(weights: dict[str, float], size: int, percentile: float, distance: int) -> str:
    return f"{smooth(weights, size)}, {kept_peaks(f'SELECT asset, quantile_cont(value, {percentile}) AS f FROM smo GROUP BY 1', distance)}"


def taps(source: str, a: int, b: int, name: str) -> str:
    """``name`` (asset, idx, v): each place of ``source`` (asset, idx, value) with the values from a to b - 1 places on, edges reflected."""
    return f"""{name}_n AS (SELECT asset, count(*) AS n FROM {source} GROUP BY 1),
{name}_t AS (SELECT asset, idx, (((idx + k) % (2 * n)) + 2 * n) % (2 * n) AS j0, n FROM {source} JOIN {name}_n USING (asset), (SELECT unnest(range({a}, {b})) AS k)),
{name} AS (SELECT t.asset, t.idx, f.value AS v FROM {name}_t t JOIN {source} f ON f.asset = t.asset AND f.idx = CASE WHEN j0 < n THEN j0 ELSE 2 * n - 1 - j0 END)"""


def merged(source: str, key: str, gap: float, strict: bool, name: str = "mrg") -> str:
    """Running maximum, flag, group. ``source``: (key, start, end, score) named s, e."""
    op = ">=" if strict else ">"
    return f"""{name} AS (SELECT {key}, min(s) AS s, max(e) AS e, max(score) AS score, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN m IS NULL OR NOT (s {op} m + {gap}) THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {source})) GROUP BY {key}, g)"""


SHIPMENTS = "shp AS (SELECT l_suppkey AS source, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS s, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) + l_quantity / 10 AS e, l_discount AS score FROM lineitem)"
CHUNKS = "chk AS (SELECT 'video' || CAST(label AS VARCHAR) AS source, 25.0 * (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS s, 25.0 * (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) + 30 AS e, vec_id AS chunk_id, embedding FROM embeddings), dur AS (SELECT source, max(e) AS duration FROM chk GROUP BY 1)"
LEVELS = "lev AS (SELECT user_id AS asset, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS DOUBLE) AS t, value FROM events)"
UNIT = "list_transform({v}, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform({v}, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))"


def label(i: str) -> str:
    return f"CASE WHEN {i} < 26 THEN chr(CAST(65 + {i} AS INTEGER)) ELSE chr(CAST(64 + {i} // 26 AS INTEGER)) || chr(CAST(65 + {i} % 26 AS INTEGER)) END"
