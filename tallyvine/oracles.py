"""What the registered queries return, as SQL for DuckDB over the same tables."""

from __future__ import annotations

from tallyvine.queries import CAMPAIGN, EVENTS_BEFORE, LAST_CLOSED, MOST_NEIGHBOURS, NEIGHBOURS, PAGE_ROWS
from tallyvine.schema import DIMENSIONS, HARVEST_SCHEMA, PREDICTION_KEY, PREDICTION_SCHEMA, PROFILE_DIMENSIONS

_FACTS = """WITH harvest AS (
  SELECT CAST(year(l_shipdate) AS INT) AS campaign, l_suppkey AS farm_id, l_linenumber AS zone,
         p_brand AS station, l_discount AS altitude, p_size AS variety, l_linestatus AS mode,
         l_returnflag AS type, p_type AS color, l_quantity AS area, l_extendedprice AS production
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
"""
_OTHERS = ", ".join(f"{name} NULLS FIRST" for name in HARVEST_SCHEMA.names if name != "production")
_SUM = "coalesce(CAST(sum(CAST(production AS DECIMAL(18,2))) AS DOUBLE), 0)"
_MEAN = "CAST(sum(CAST(production AS DECIMAL(18,2))) AS DOUBLE) / nullif(count(production), 0)"


def _report(dimension: str, value: str) -> str:
    return f"""{_FACTS}
SELECT {dimension}, campaign, {value} AS production, dense_rank() OVER (ORDER BY {dimension}) - 1 AS code
FROM harvest WHERE {dimension} IS NOT NULL AND campaign = {CAMPAIGN}
GROUP BY {dimension}, campaign"""


def _shares(dimension: str, where: str = "true") -> str:
    return f"""{_FACTS}, counted AS (
  SELECT {dimension}, count(*) AS n FROM harvest
  WHERE {dimension} IS NOT NULL AND {where} GROUP BY {dimension})
SELECT {dimension}, n,
       round_even(CAST(n AS DOUBLE) / (SELECT sum(n) FROM counted) * 100 * 100, 0) / 100 AS share
FROM counted"""


def _rows(where: str, columns: str = "*") -> str:
    return f"{_FACTS} SELECT {columns} FROM harvest WHERE {where}"


_SPLIT = f"""drawn AS (
  SELECT *, row_number() OVER (ORDER BY md5('1234:' || vec_id), vec_id)
            <= (SELECT ceil(count(*) * 20 / 100) FROM embeddings) AS tested
  FROM embeddings)"""
_KNN = f"""WITH {_SPLIT}, pairs AS (
  SELECT t.vec_id, t.label, r.vec_id AS other, r.label AS vote,
         list_sum(list_transform(range(1, len(t.embedding) + 1),
           lambda i: (CAST(t.embedding[i] AS DOUBLE) - CAST(r.embedding[i] AS DOUBLE))
                   * (CAST(t.embedding[i] AS DOUBLE) - CAST(r.embedding[i] AS DOUBLE)))) AS squared
  FROM drawn t JOIN drawn r ON t.tested AND NOT r.tested),
nearest AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY squared, other) AS place FROM pairs),
votes AS (
  SELECT vec_id, label, vote, count(*) AS n FROM nearest WHERE place <= {NEIGHBOURS} GROUP BY ALL),
classified AS (
  SELECT vec_id, label, vote AS predicted FROM votes
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, vote) = 1)
"""
_GAPS = ", ".join(
    f"CASE WHEN (zone + farm_id) % 11 <> {place} THEN {name} END AS {name}" for place, name in enumerate(HARVEST_SCHEMA.names)
)
_GROUP = "variety, mode, type, color"
_PREDICTED = f"""{_FACTS}, closed AS (
  SELECT {_GROUP}, CAST(round(area * 100) AS HUGEINT) AS x, CAST(round(production * 100) AS HUGEINT) AS y
  FROM harvest WHERE campaign <= {LAST_CLOSED} AND production IS NOT NULL),
sums AS (
  SELECT {_GROUP}, CAST(sum(y) AS DOUBLE) / 100.0::DOUBLE / count(*) AS mean, min(x) < max(x) AS spread,
         CAST(count(x) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(x * x) AS DOUBLE) AS sxx,
         CAST(sum(y) FILTER (x IS NOT NULL) AS DOUBLE) AS sy, CAST(sum(x * y) AS DOUBLE) AS sxy
  FROM closed GROUP BY {_GROUP}),
lines AS (
  SELECT *, CASE WHEN spread THEN (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) END AS slope FROM sums)
SELECT farm_id, h.variety, h.mode, h.type, h.color, area,
       coalesce((sy - slope * sx) / (100.0::DOUBLE * nullif(n, 0)) + slope * area, mean,
                (SELECT CAST(sum(y) AS DOUBLE) / 100.0::DOUBLE / count(*) FROM closed)) AS production
FROM harvest h LEFT JOIN lines l ON h.variety IS NOT DISTINCT FROM l.variety AND h.mode IS NOT DISTINCT FROM l.mode
  AND h.type IS NOT DISTINCT FROM l.type AND h.color IS NOT DISTINCT FROM l.color
WHERE campaign > {LAST_CLOSED}"""
# The leading component of a covariance: squared again and again, it tends to a multiple of v v'.
_POWERS = """{0} AS (
  SELECT 0 AS step, c AS m FROM {1} UNION ALL
  SELECT step + 1, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / norm))
  FROM (SELECT *, list_sum(list_transform(m, lambda r: list_dot_product(r, r))) AS norm FROM {0} WHERE step < 14))"""
_LEADING = """{0} AS (
  SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))
           * sign(list_extract(r, list_position(list_transform(r, lambda y: abs(y)), list_max(list_transform(r, lambda y: abs(y))))))) AS v
  FROM (SELECT m[list_position(list_transform(m, lambda r: list_dot_product(r, r)),
                                list_max(list_transform(m, lambda r: list_dot_product(r, r))))] AS r FROM {1} WHERE step = 14))"""
_PCA = f"""WITH RECURSIVE cells AS (
  SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
centred AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM cells),
vectors AS (SELECT vec_id, list(x ORDER BY i) AS x FROM centred GROUP BY vec_id),
covariances AS (
  SELECT a.i, b.i AS j, sum(a.x * b.x) / ((SELECT count(*) FROM embeddings) - 1) AS c
  FROM centred a JOIN centred b USING (vec_id) GROUP BY a.i, b.i),
first AS (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(c ORDER BY j) AS r FROM covariances GROUP BY i)),
{_POWERS.format("powers1", "first")}, {_LEADING.format("leading1", "powers1")},
found AS (SELECT c, v, list_transform(c, lambda r: list_dot_product(r, v)) AS cv FROM first, leading1),
second AS (
  SELECT list_transform(c, lambda r, i: list_transform(r, lambda x, j: x - list_dot_product(v, cv) * v[i] * v[j])) AS c
  FROM found),
{_POWERS.format("powers2", "second")}, {_LEADING.format("leading2", "powers2")}
SELECT vec_id, round(list_dot_product(x, a.v), 6) + 0.0 AS pc1, round(list_dot_product(x, b.v), 6) + 0.0 AS pc2
FROM vectors, leading1 a, leading2 b"""
_KEYS = ", ".join(PREDICTION_KEY)
_ALL = ", ".join(HARVEST_SCHEMA.names)
_OTHER = ", ".join(f"h.{name}" for name in HARVEST_SCHEMA.names[:-1])


def registry() -> dict[str, str]:
    found = {
        "campaign_totals": f"""{_FACTS}
SELECT campaign, {_SUM} AS production FROM harvest WHERE campaign <= {LAST_CLOSED} GROUP BY campaign"""
    }
    for dimension in DIMENSIONS.values():
        found[f"sum_by_{dimension}"] = _report(dimension, _SUM)
        found[f"mean_by_{dimension}"] = _report(dimension, _MEAN)
    for name, value in (("sum", _SUM), ("mean", _MEAN)):
        found[f"{name}_by_station_each_campaign"] = f"""{_FACTS}
SELECT station, campaign, {value} AS production FROM harvest
WHERE station IS NOT NULL AND campaign IS NOT NULL GROUP BY station, campaign"""
    for dimension in PROFILE_DIMENSIONS.values():
        found[f"share_by_{dimension}"] = _shares(dimension)
    found |= {
        "share_by_mode_one_campaign": _shares("mode", f"campaign = {CAMPAIGN}"),
        "frequency_by_station": f"""{_FACTS}
SELECT station, count(*) AS n FROM harvest WHERE station IS NOT NULL GROUP BY station""",
        "frequency_total": f"{_FACTS} SELECT count(station) AS n FROM harvest",
        "distinct_farms": f"""{_FACTS}
SELECT count(DISTINCT farm_id) + CAST(max(CAST(farm_id IS NULL AS INT)) AS BIGINT) AS farms FROM harvest""",
        "distinct_farms_one_campaign": f"""{_FACTS}
SELECT count(DISTINCT farm_id) + CAST(max(CAST(farm_id IS NULL AS INT)) AS BIGINT) AS farms
FROM harvest WHERE campaign = {CAMPAIGN}""",
        "distinct_campaigns": f"{_FACTS} SELECT DISTINCT campaign FROM harvest",
        "filter_eq": _rows("zone = 3"),
        "filter_ne": f"""{_FACTS}, blanked AS (SELECT * REPLACE (nullif(zone, 2) AS zone) FROM harvest)
SELECT * FROM blanked WHERE zone IS DISTINCT FROM 3""",
        "filter_gt": _rows("production > 30000"),
        "filter_ge": _rows("area >= 25"),
        "filter_lt": _rows("station < 'Brand#2'"),
        "filter_le": _rows("production <= 30000.5"),
        "filter_count": _rows("production > 30000", "count(*) AS n"),
        "explorer_sorted": _rows("production >= 30000"),
        "explorer_page": _rows("production <= 30000")
        + f" ORDER BY production DESC, {_OTHERS} LIMIT {PAGE_ROWS} OFFSET {2 * PAGE_ROWS}",
        "filter_timestamp": f"SELECT event_id, event_type, value FROM events WHERE ts < TIMESTAMP '{EVENTS_BEFORE}'",
        "campaign_split": _rows(f"campaign <= {LAST_CLOSED}"),
        "row_positions": """
SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events""",
        "row_split": """
SELECT * FROM events
QUALIFY row_number() OVER (ORDER BY ts, event_id) <= (SELECT floor(0.9 * count(*)) FROM events)""",
        "column_by_position": _rows("true", "production"),
        "positional_fill": """
WITH numbered AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events),
given AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer),
cut AS (SELECT (SELECT count(*) FROM events) - (SELECT count(*) FROM customer) AS first_open)
SELECT event_id, ts, user_id, event_type,
       CASE WHEN n.position >= first_open THEN c_acctbal ELSE value END AS value, props
FROM numbered n CROSS JOIN cut LEFT JOIN given g ON g.position = n.position - first_open""",
        "keyed_fill": f"""{_FACTS}, given AS (
  SELECT {_KEYS}, {_MEAN} AS predicted FROM harvest WHERE campaign = {LAST_CLOSED} GROUP BY {_KEYS})
SELECT {_OTHER},
       CASE WHEN h.campaign > {LAST_CLOSED} THEN coalesce(predicted, production) ELSE production END AS production
FROM harvest h LEFT JOIN given USING ({_KEYS})""",
        "delimited_scan_header": _rows("true"),
        "delimited_scan_headerless": _rows("true", ", ".join(PREDICTION_SCHEMA.names)),
        "delimited_missing": _rows("true", _GAPS),
        "delimited_bad_cells": f"""{_FACTS}, written AS (
  SELECT CAST(farm_id AS VARCHAR) AS farm_id, CASE WHEN zone = 7 THEN 'seven' ELSE CAST(zone AS VARCHAR) END AS zone,
         CASE WHEN production > 50000 THEN CAST(CAST(floor(production) AS INT) AS VARCHAR) || ' kg' ELSE 'NA' END AS production
  FROM harvest),
found AS (
  SELECT 'zone' AS column, farm_id || '|' || zone || '|' || production AS row, zone AS cell FROM written WHERE zone = 'seven'
  UNION ALL
  SELECT 'production', farm_id || '|' || zone || '|' || production, production FROM written WHERE production <> 'NA')
SELECT "column", count(*) AS bad, min(row) AS row, arg_min(cell, row) AS cell FROM found GROUP BY found."column" """,
        "file_completion": f"""{_FACTS}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY {_ALL}) - (SELECT count(*) FROM harvest WHERE campaign <= {LAST_CLOSED})
            AS place FROM harvest),
given AS (
  SELECT area * -100.25 AS predicted,
         row_number() OVER (ORDER BY {_KEYS}, area) AS place
  FROM harvest WHERE campaign > {LAST_CLOSED})
SELECT {_OTHER}, CASE WHEN place > 0 THEN predicted ELSE production END AS production
FROM numbered h LEFT JOIN given USING (place)""",
        "categorical_codes": f"""{_FACTS}, blanked AS (
  SELECT * REPLACE (nullif(station, 'Brand#7') AS station) FROM harvest)
SELECT *, CASE WHEN station IS NULL THEN -1
               ELSE dense_rank() OVER (ORDER BY station NULLS LAST) - 1 END AS code
FROM blanked""",
        "codes_with_nan": f"""{_FACTS}, blanked AS (SELECT nullif(altitude, 0.05) AS altitude FROM harvest)
SELECT code, count(*) AS n, min(coalesce(altitude, -1.0)) AS least FROM (
  SELECT altitude, CASE WHEN altitude IS NULL THEN -1
                        ELSE dense_rank() OVER (ORDER BY altitude NULLS LAST) - 1 END AS code FROM blanked)
GROUP BY code""",
        "sorted_with_nan": f"""{_FACTS}
SELECT farm_id, coalesce(nullif(altitude, 0.05), -1.0) AS altitude FROM harvest ORDER BY altitude DESC""",
        "class_counts": """SELECT count(*) AS n,
       count(DISTINCT label) + coalesce(max(CAST(label IS NULL AS BIGINT)), 0) AS classes FROM embeddings""",
        "hash_split": f"""WITH {_SPLIT}
SELECT vec_id, label, CASE WHEN tested THEN 'test' ELSE 'train' END AS part FROM drawn""",
        "knn_classify": f"{_KNN} SELECT vec_id, label, predicted FROM classified",
        "knn_accuracy": f"""{_KNN}
SELECT avg(CAST(predicted = label AS INT)) AS accuracy FROM classified""",
        "knn_accuracy_by_k": f"""{_KNN}, counted AS (
  SELECT k, vec_id, label, vote, count(*) AS n FROM nearest, range(1, {MOST_NEIGHBOURS + 1}) t(k) WHERE place <= k GROUP BY ALL),
chosen AS (
  SELECT k, label, vote FROM counted QUALIFY row_number() OVER (PARTITION BY k, vec_id ORDER BY n DESC, vote) = 1)
SELECT CAST(k AS INTEGER) AS k, avg(CAST(vote = label AS INT)) AS accuracy FROM chosen GROUP BY k""",
        "pca_2d": _PCA,
        "batch_prediction": _PREDICTED,
    }
    return found
