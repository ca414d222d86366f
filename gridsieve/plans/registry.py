"""Register of runnable queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ---- SQL building blocks over the test tables ------------------------------

PX = """px AS (
  SELECT printf('AOI_%04d', CAST(floor(event_id / 2500.0) AS INT)) AS aoi,
         CAST(floor((event_id % 2500) / 50.0) AS INT) AS row,
         CAST(event_id % 50 AS INT) AS col,
         CASE WHEN event_type <> 'error' AND value > 0 THEN value END AS dtm,
         CASE WHEN event_type <> 'error'
              THEN (4.0 * k - value) / nullif(4.0 * k + value, 0) END AS ndvi,
         ((user_id + 1.0) - 4.0 * k) / nullif((user_id + 1.0) + 4.0 * k, 0) AS ndwi,
         CASE WHEN k <> 99 AND k > 0 THEN ln(1.0 + k) END AS flow_acc,
         CASE WHEN event_id % 9 <> 8 THEN sin(radians(45.0 * (event_id % 9))) END AS flow_dir
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))"""

SC = """sc AS (
  SELECT vec_id, printf('AOI_%04d', CAST(floor(vec_id / 100.0) AS INT)) AS aoi,
         printf('AOI_%04d_p%03d', CAST(floor(vec_id / 100.0) AS INT),
                CAST(vec_id % 100 AS INT)) AS patch_id,
         CAST(floor((vec_id % 100) / 10.0) * 32 AS INT) AS row,
         CAST(vec_id % 10 * 32 AS INT) AS col,
         1 / (1 + exp(-4 * CAST(embedding[1] AS DOUBLE))) AS prob_autoencoder,
         1 / (1 + exp(-4 * CAST(embedding[2] AS DOUBLE))) AS gate_prediction,
         1 / (1 + exp(-4 * CAST(embedding[3] AS DOUBLE))) AS prob_iforest,
         1 / (1 + exp(-4 * CAST(embedding[4] AS DOUBLE))) AS prob_kmeans,
         1 / (1 + exp(-4 * CAST(embedding[5] AS DOUBLE))) AS arch_similarity,
         CASE WHEN label < 2 THEN 1 ELSE 0 END AS y, label, embedding
  FROM embeddings)"""

EXTENT = """extent AS (
  SELECT aoi, CAST(max(row) + 64 AS INT) AS height, CAST(max(col) + 64 AS INT) AS width
  FROM sc GROUP BY aoi)"""

META = """meta AS (
  SELECT aoi, -55.0 + i * 0.01 AS min_lon, -3.4 + i * 0.01 AS min_lat,
         -54.99 + i * 0.01 AS max_lon, -3.391 + i * 0.01 AS max_lat
  FROM (SELECT DISTINCT aoi, CAST(CAST(regexp_extract(aoi, 'AOI_(\\d+)', 1) AS INT) AS DOUBLE) AS i
        FROM sc) WHERE aoi <> 'AOI_0002')"""

# Pixel table with median-filled neighbourhood: slope, roughness and gradients.
AROUND = """med AS (SELECT aoi, median(dtm) AS m, count(dtm) AS n FROM px GROUP BY aoi),
fl AS (SELECT px.*, coalesce(dtm, m) AS f, n FROM px JOIN med USING (aoi)),
ud AS (SELECT *, coalesce(lag(f) OVER w, f) AS u, coalesce(lead(f) OVER w, f) AS d
       FROM fl WINDOW w AS (PARTITION BY aoi, col ORDER BY row)),
nb AS (SELECT *, coalesce(lag(u) OVER w, u) AS n00, u AS n01, coalesce(lead(u) OVER w, u) AS n02,
              coalesce(lag(f) OVER w, f) AS n10, f AS n11, coalesce(lead(f) OVER w, f) AS n12,
              coalesce(lag(d) OVER w, d) AS n20, d AS n21, coalesce(lead(d) OVER w, d) AS n22
       FROM ud WINDOW w AS (PARTITION BY aoi, row ORDER BY col)),
gr AS (SELECT *, (n02 + 2*n12 + n22) - (n00 + 2*n10 + n20) AS gx,
              (n20 + 2*n21 + n22) - (n00 + 2*n01 + n02) AS gy,
              (n00+n01+n02+n10+n11+n12+n20+n21+n22) / 9.0 AS mu FROM nb),
ter AS (SELECT aoi, row, col, dtm, ndvi, ndwi, flow_acc, flow_dir,
               CASE WHEN dtm IS NOT NULL AND n >= 10
                    THEN degrees(atan(sqrt(gx*gx + gy*gy))) END AS slope,
               CASE WHEN dtm IS NOT NULL AND n >= 10 THEN sqrt((pow(n00-mu,2) + pow(n01-mu,2)
                    + pow(n02-mu,2) + pow(n10-mu,2) + pow(n11-mu,2) + pow(n12-mu,2)
                    + pow(n20-mu,2) + pow(n21-mu,2) + pow(n22-mu,2)) / 9.0) END AS roughness
        FROM gr)"""


def unpivot_sql(source: str, channels, name: str = "lng") -> str:
    parts = [
        f"SELECT aoi, row, col, '{c}' AS channel, {c} AS value FROM {source} WHERE {c} IS NOT NULL"
        for c in channels
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


SAMPLED = """smp AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY aoi, channel
         ORDER BY md5('42|' || row || '|' || col), row, col) AS rn FROM lng) WHERE rn <= 1000)"""


def stats_sql(source: str) -> str:
    return f"""bnd AS (SELECT channel, quantile_cont(value, 0.005) AS p_low,
                   quantile_cont(value, 0.995) AS p_high FROM {source} GROUP BY channel),
st AS (SELECT channel, avg(greatest(least(value, p_high), p_low)) AS mean,
              stddev_pop(greatest(least(value, p_high), p_low)) AS std,
              max(p_low) AS p_low, max(p_high) AS p_high
       FROM {source} JOIN bnd USING (channel) GROUP BY channel)"""


def normalized_sql(source: str, channels, name: str = "nm") -> str:
    cells = [
        f"CASE WHEN {c} IS NOT NULL THEN (greatest(least({c}, s_{c}.p_high), s_{c}.p_low)"
        f" - s_{c}.mean) / s_{c}.std END AS {c}"
        for c in channels
    ]
    joins = [f"JOIN st s_{c} ON s_{c}.channel = '{c}'" for c in channels]
    return (
        f"{name} AS (SELECT p.aoi, p.row, p.col, {', '.join(cells)} FROM {source} p {' '.join(joins)})"
    )


def cut_sql(source: str, name: str = "pp") -> str:
    """Patch pixels of complete 16-pixel patches at stride 8 with enough NDVI."""
    return f"""ca AS (SELECT DISTINCT row AS r0 FROM {source} WHERE row % 8 = 0),
cb AS (SELECT DISTINCT col AS c0 FROM {source} WHERE col % 8 = 0),
cut AS (SELECT s.*, r0, c0, row - r0 AS pr, col - c0 AS pc FROM {source} s
        JOIN ca ON s.row BETWEEN r0 AND r0 + 15 JOIN cb ON s.col BETWEEN c0 AND c0 + 15),
ok AS (SELECT aoi, r0, c0, count(ndvi) AS n_valid FROM cut GROUP BY aoi, r0, c0
       HAVING count(*) = 256 AND count(ndvi) / 256.0 >= 0.8),
{name} AS (SELECT cut.*, n_valid FROM cut JOIN ok USING (aoi, r0, c0))"""


def gate_ctes(model: dict, source: str, keep: str) -> list[str]:
    """CTEs of the network's forward pass over the four scores, ending in gated(keep, gate)."""
    names = ["prob_autoencoder", "prob_iforest", "prob_kmeans", "arch_similarity"]
    cells = [f"({n} - {m}) / {s} AS l0_{j}" for j, (n, m, s) in
             enumerate(zip(names, model["mean"], model["scale"]))]
    ctes = [f"h0 AS (SELECT {keep}, {', '.join(cells)} FROM {source})"]
    depth = len(model["weights"])
    for n, (matrix, bias) in enumerate(zip(model["weights"], model["biases"])):
        outs = []
        for i, line in enumerate(matrix):
            total = f"CAST({bias[i]} AS DOUBLE)" + "".join(
                f" + ({w}) * l{n}_{j}" for j, w in enumerate(line)
            )
            last = n == depth - 1
            outs.append(f"1 / (1 + exp(-({total})))" if last else f"greatest({total}, 0)")
        cols = ", ".join(f"{o} AS l{n + 1}_{i}" for i, o in enumerate(outs))
        ctes.append(f"h{n + 1} AS (SELECT {keep}, {cols} FROM h{n})")
    return [*ctes, f"gated AS (SELECT {keep}, l{depth}_0 AS gate FROM h{depth})"]


def rnd(expr: str, n: int = 6) -> str:
    """Rounded value with a plain zero."""
    value = f"round(CAST({expr} AS DOUBLE), {n})"
    return f"CASE WHEN {value} = 0 THEN CAST(0 AS DOUBLE) ELSE {value} END"


def compose(ctes, body: str, plain: str = "", rounded: str = "", places: int = 6) -> str:
    """``WITH ctes SELECT plain, round(rounded) FROM (body)``."""
    cols = [c.strip() for c in plain.split(",") if c.strip()]
    cols += [f"{rnd(c.strip(), places)} AS {c.strip()}" for c in rounded.split(",") if c.strip()]
    head = f"WITH {', '.join(ctes)} " if ctes else ""
    return f"{head}SELECT {', '.join(cols)} FROM ({body}) q"


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL twin, if it has one."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All double columns to six places, as the SQL side does.

    A value that is an exact multiple of half a unit in the last place could go
    either way in the two engines; such queries ask for more places.
    """
    return df.select(
        *[
            F.round(c, places).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )
