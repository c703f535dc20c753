"""Queries over image geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry
from ..sources import bindings


def q21_resize_28(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    a, b = geometry.resized_28(w, h, geometry.target(w, h), hi=900_000)
    return bindings.image_sizes(spark, sf_dir).select("image_id", a.alias("rw"), b.alias("rh"))


def q22_resize_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    a, b = geometry.resized_free(w, h, geometry.target(w, h), hi=900_000)
    return bindings.image_sizes(spark, sf_dir).select("image_id", a.alias("rw"), b.alias("rh"))


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.image_sizes(spark, sf_dir).withColumn("grid", geometry.tile_grid(F.col("w"), F.col("h")))


def q23_tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(spark, sf_dir).select("image_id", "grid.cols", "grid.rows", geometry.patch_count(F.col("grid.cols") * F.col("grid.rows")).alias("patches"))


def q24_tile_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.crops(_grids(spark, sf_dir)).select("image_id", "tile", "x0", "y0", "x1", "y1")


def q29_channel_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bindings.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(geometry.normalised(F.col("embedding"))).alias("i", "v"))
    return rows.select("vec_id", "i", F.round("v", 6).alias("v"))


SIZE = "size AS (SELECT p_partkey AS image_id, p_size * 40 AS w, CAST(100 + (p_partkey * 37) % 1900 AS INTEGER) AS h FROM part)"
FIRST = "first AS (SELECT image_id, CASE WHEN greatest(w / h, h / w) >= 3.0 THEN 2048 ELSE 1024 END / greatest(w, h) AS ratio, w, h FROM size)"


def resized(lo: int, hi: int, first: str, shrink: str, grow: str, last: str) -> str:
    """CTEs up to `resized`: first, shrink and grow are patterns with {} for the value."""
    return f"""{SIZE}, {FIRST},
      one AS (SELECT image_id, {first.format("w * ratio")} AS a, {first.format("h * ratio")} AS b FROM first),
      two AS (SELECT *, a * b AS px, CASE WHEN a * b > {hi} THEN {shrink.format(f"a * sqrt({hi}.0::DOUBLE / (a * b))")} ELSE a END AS a2, CASE WHEN a * b > {hi} THEN {shrink.format(f"b * sqrt({hi}.0::DOUBLE / (a * b))")} ELSE b END AS b2 FROM one),
      resized AS (SELECT image_id, CAST({last.format(f"CASE WHEN px < {lo} THEN {grow.format(f'a2 * sqrt({lo}.0::DOUBLE / nullif(px, 0))')} ELSE a2 END")} AS BIGINT) AS rw,
        CAST({last.format(f"CASE WHEN px < {lo} THEN {grow.format(f'b2 * sqrt({lo}.0::DOUBLE / nullif(px, 0))')} ELSE b2 END")} AS BIGINT) AS rh FROM two)"""


FLOOR, CEIL = "floor(({}) / 28) * 28", "ceil(({}) / 28) * 28"
RESIZED_28 = resized(3136, 12_845_056, FLOOR.format("trunc({})"), FLOOR, CEIL, "{}")
GRID = f"""WITH {SIZE}, grid AS (SELECT i AS cols, j AS rows FROM range(1, 13) a(i), range(1, 13) b(j) WHERE i * j <= 12),
  best AS (SELECT image_id, arg_min({{'c': cols, 'r': rows}}, {{'d': abs(w / h - cols / rows), 't': CASE WHEN w * h > 0.5 * 448 * 448 * cols * rows THEN -(cols * rows) ELSE cols * rows END}}) AS g
    FROM size CROSS JOIN grid GROUP BY image_id)"""
SQL = {
    "q21_resize_28": f"WITH {resized(3136, 900_000, FLOOR.format('trunc({})'), FLOOR, CEIL, '{}')} SELECT image_id, rw, rh FROM resized",
    "q22_resize_free": f"WITH {resized(3136, 900_000, 'trunc({})', '{}', '{}', 'round_even({}, 0)')} SELECT image_id, rw, rh FROM resized",
    "q23_tile_grid": f"{GRID} SELECT image_id, CAST(g.c AS INTEGER) AS cols, CAST(g.r AS INTEGER) AS rows, CAST(g.c * g.r + CASE WHEN g.c * g.r <> 1 THEN 1 ELSE 0 END AS INTEGER) AS patches FROM best",
    "q24_tile_crops": f"""{GRID}, tile AS (SELECT image_id, g.c AS c, g.c * g.r AS n, unnest(range(g.c * g.r + CASE WHEN g.c * g.r <> 1 THEN 1 ELSE 0 END)) AS t FROM best)
      SELECT image_id, CAST(t AS INTEGER) AS tile, CAST(CASE WHEN t < n THEN t % c * 448 END AS INTEGER) AS x0, CAST(CASE WHEN t < n THEN t // c * 448 END AS INTEGER) AS y0,
        CAST(CASE WHEN t < n THEN t % c * 448 + 448 END AS INTEGER) AS x1, CAST(CASE WHEN t < n THEN t // c * 448 + 448 END AS INTEGER) AS y1 FROM tile""",
    "q29_channel_normalise": """WITH v AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
      SELECT vec_id, CAST(i AS INTEGER) AS i, round((x / 255 - [0.485::DOUBLE, 0.456::DOUBLE, 0.406::DOUBLE][i % 3 + 1]) / [0.229::DOUBLE, 0.224::DOUBLE, 0.225::DOUBLE][i % 3 + 1], 6) AS v FROM v""",
}
QUERIES = {k: globals()[k] for k in SQL}
