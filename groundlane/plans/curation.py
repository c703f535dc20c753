"""Queries over discovery, filtering, splitting and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import hash32, last_segment
from ..operators import curate, templates
from ..sources import bindings
from ..sources.shared import written

#: SQL of the bindings: items with image_key and reject_reason.
ITEMS = """
line AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, [l_discount + 0.0, l_tax + 0.0, l_discount + l_quantity / 100, l_tax + l_quantity / 100] AS box,
    CASE WHEN l_quantity < 49 THEN p_name || '.' END AS answer
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
),
per AS (
  SELECT l_orderkey, list(box ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS bbox,
    list(answer ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (answer IS NOT NULL) AS answer
  FROM line GROUP BY l_orderkey
),
item AS (
  SELECT o_orderkey AS item_id, o_custkey, 'd' || (o_orderkey % 5) AS dataset, CASE WHEN o_orderkey % 10 < 2 THEN 'val' ELSE 'train' END AS split,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus || ' ' || o_orderpriority END AS query, coalesce(answer, []) AS answer, coalesce(bbox, []) AS bbox,
    '/raw/cust_' || o_custkey || '.png' AS image_path, 'cust_' || o_custkey || '.png' AS image_key
  FROM orders LEFT JOIN per ON o_orderkey = l_orderkey
),
judged AS (
  SELECT i.*, CASE WHEN query = '' THEN 'empty_query' WHEN len(bbox) = 0 THEN 'empty_bbox' WHEN len(answer) = 0 THEN 'empty_answer'
    WHEN len(bbox) <> len(answer) THEN 'len_mismatch' WHEN c_custkey IS NULL THEN 'missing_image' END AS reject_reason
  FROM item i LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
),
kept AS (SELECT * FROM judged WHERE reject_reason IS NULL)"""
HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
PREPARED = """
has_val AS (SELECT dataset, bool_or(split = 'val') AS has_val FROM judged GROUP BY dataset),
able AS (SELECT k.*, has_val FROM kept k JOIN has_val USING (dataset)),
image AS (SELECT DISTINCT dataset, image_key, has_val FROM able WHERE split = CASE WHEN has_val THEN 'val' ELSE 'train' END),
ranked AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS n, row_number() OVER (PARTITION BY dataset ORDER BY md5('117|' || image_key), image_key) AS rank FROM image),
picked AS (SELECT dataset, image_key FROM ranked WHERE rank <= round_even(n * CASE WHEN has_val THEN 0.99::DOUBLE ELSE 0.2::DOUBLE END, 0)),
prepared AS (
  SELECT a.*, CASE WHEN has_val AND split = 'train' THEN 'train' WHEN p.image_key IS NOT NULL THEN 'val' WHEN has_val THEN 'dropped' ELSE 'train' END AS final_split
  FROM able a LEFT JOIN picked p ON a.dataset = p.dataset AND a.image_key = p.image_key AND (NOT has_val OR split = 'val')
)"""
ASSIGNED = f"""
assigned AS (
  SELECT *, ['answerBox', 'boxFromAnswer', 'box'][{HASH.format("'658|' || item_id")} % 3 + 1] AS template,
    CASE WHEN {HASH.format("'658n|' || item_id")} < {{share}} THEN 'negative' ELSE 'positive' END AS polarity
  FROM {{source}}
)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.judged(bindings.items(spark, sf_dir), bindings.images(spark, sf_dir))


def q01_discover_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.items(spark, sf_dir).where("split IN ('train', 'val')").groupBy("dataset", "split").agg(F.count("*").alias("n_items"))


def q02_explode_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents of about a hundred items, parsed with the declared schema and exploded."""
    items = bindings.items(spark, sf_dir)
    n = bindings.table(spark, sf_dir, "orders").count() // 100 + 1
    docs = items.groupBy((hash32("doc", "item_id") % n).alias("document")).agg(F.to_json(F.struct(F.collect_list(F.struct("query", "answer", "bbox", "image_path")).alias("items"))).alias("json"))
    rows = docs.select(F.from_json("json", schemas.DOCUMENT).alias("d")).select(F.inline("d.items"))
    return rows.groupBy("image_path", "query").agg(F.count("*").alias("n_items"), F.sum(F.size("bbox")).alias("n_boxes"), F.sum(F.size("answer")).alias("n_answers"))


def q03_rebase_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/data/pages/train/img/"), last_segment(F.col("url"))).alias("image_path"))


def q04_filter_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("item_id", F.coalesce("reject_reason", F.lit("kept")).alias("outcome"))


def q05_filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.filter_stats(judged(spark, sf_dir))


def q06_union_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per dataset, running totals over datasets, and the first query."""
    rows = curate.kept(bindings.items(spark, sf_dir), bindings.images(spark, sf_dir))
    per = rows.groupBy("dataset").agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"), F.left(F.min_by("query", "item_id"), F.lit(50)).alias("first_query")
    )
    per = curate.require_rows(written(per, "dataset-totals"), "the kept set")  # a row for each dataset, made once
    so_far = Window.orderBy("dataset").rowsBetween(Window.unboundedPreceding, 0)  # one row per dataset
    return per.withColumns({"total_train": F.sum("n_train").over(so_far), "total_val": F.sum("n_val").over(so_far)})


def q07_sampled_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.sampled_groups(curate.kept(bindings.items(spark, sf_dir), bindings.images(spark, sf_dir)), 0.2)


def q08_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.prepared(judged(spark, sf_dir)).select("item_id", "dataset", "final_split")


def q09_capped_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.capped(curate.prepared(judged(spark, sf_dir)).where("final_split = 'val'"), 500).select("dataset", "item_id")


def q10_val99_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curate.prepared(judged(spark, sf_dir)).where("split = 'val'")
    return rows.groupBy("dataset", "final_split").agg(F.count_distinct("image_key").alias("n_images"), F.count("*").alias("n_rows"))


def q11_negative_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = templates.assigned(curate.kept(bindings.items(spark, sf_dir), bindings.images(spark, sf_dir)), negative_share=0.2)
    swapped = curate.negatives(rows)
    image = F.when(templates.is_negative(F.col("tag")), F.coalesce("swapped", "image_key")).otherwise(F.col("image_key"))
    return swapped.select("item_id", "tag", image.alias("image_key"))


def q12_template_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = templates.assigned(curate.kept(bindings.items(spark, sf_dir), bindings.images(spark, sf_dir)))
    names = rows.select("item_id", F.split_part("tag", F.lit("|"), F.lit(1)).alias("template"), F.split_part("tag", F.lit("|"), F.lit(2)).alias("polarity"))
    return names.join(F.broadcast(templates.catalog(spark)), ["template", "polarity"]).select("item_id", "template", "polarity", F.md5("system").alias("system_md5"))


def q13_template_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = templates.assigned(curate.kept(bindings.items(spark, sf_dir), bindings.images(spark, sf_dir)))
    return rows.groupBy("template").agg(F.count("*").alias("n"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SYSTEM = "CASE template " + " ".join(f"WHEN '{r[0]}' THEN {quoted(r[2])}" for r in templates.CATALOG if r[1] == "positive") + " END"

SQL = {
    "q01_discover_splits": f"WITH {ITEMS} SELECT dataset, split, count(*) AS n_items FROM item WHERE split IN ('train', 'val') GROUP BY dataset, split",
    "q02_explode_items": f"WITH {ITEMS} SELECT image_path, query, count(*) AS n_items, CAST(sum(len(bbox)) AS BIGINT) AS n_boxes, CAST(sum(len(answer)) AS BIGINT) AS n_answers FROM item GROUP BY image_path, query",
    "q03_rebase_path": "SELECT page_id, '/data/pages/train/img/' || string_split(url, '/')[-1] AS image_path FROM pages",
    "q04_filter_items": f"WITH {ITEMS} SELECT item_id, coalesce(reject_reason, 'kept') AS outcome FROM judged",
    "q05_filter_stats": f"WITH {ITEMS} SELECT dataset, split, count(*) AS total, count(*) FILTER (reject_reason IS NULL) AS kept, "
    + ", ".join(f"count(*) FILTER (reject_reason = '{r}') AS {r}" for r in curate.REASONS)
    + " FROM judged GROUP BY dataset, split",
    "q06_union_totals": f"""WITH {ITEMS}, d AS (SELECT dataset, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
      left(arg_min(query, item_id), 50) AS first_query FROM kept GROUP BY dataset)
      SELECT *, CAST(sum(n_train) OVER (ORDER BY dataset) AS BIGINT) AS total_train, CAST(sum(n_val) OVER (ORDER BY dataset) AS BIGINT) AS total_val FROM d""",
    "q07_sampled_images": f"""WITH {ITEMS}, image AS (SELECT DISTINCT dataset, image_key FROM kept),
      ranked AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS n, row_number() OVER (PARTITION BY dataset ORDER BY md5('117|' || image_key), image_key) AS rank FROM image)
      SELECT dataset, image_key FROM ranked WHERE rank <= round_even(n * 0.2::DOUBLE, 0)""",
    "q08_group_split": f"WITH {ITEMS}, {PREPARED} SELECT item_id, dataset, final_split FROM prepared",
    "q09_capped_validation": f"""WITH {ITEMS}, {PREPARED} SELECT dataset, item_id FROM prepared WHERE final_split = 'val'
      QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5('117|' || item_id), item_id) <= 500""",
    "q10_val99_split": f"WITH {ITEMS}, {PREPARED} SELECT dataset, final_split, count(DISTINCT image_key) AS n_images, count(*) AS n_rows FROM prepared WHERE split = 'val' GROUP BY dataset, final_split",
    "q11_negative_swap": f"""WITH {ITEMS}, {ASSIGNED.format(share=int(0.2 * 2**32), source="kept")},
      place AS (SELECT dataset, split, image_key, row_number() OVER (PARTITION BY dataset, split ORDER BY md5('658|' || image_key), image_key) - 1 AS place, count(*) OVER (PARTITION BY dataset, split) AS n
        FROM (SELECT DISTINCT dataset, split, image_key FROM kept)),
      turned AS (SELECT a.*, CASE WHEN n > 1 THEN (place + 1 + {HASH.format("'658|' || item_id")} % greatest(n - 1, 1)) % n END AS swap_to FROM assigned a JOIN place USING (dataset, split, image_key))
      SELECT item_id, template || '|' || polarity AS tag, CASE WHEN polarity = 'negative' THEN coalesce(o.image_key, t.image_key) ELSE t.image_key END AS image_key
      FROM turned t LEFT JOIN place o ON t.dataset = o.dataset AND t.split = o.split AND t.swap_to = o.place""",
    "q12_template_assign": f"WITH {ITEMS}, {ASSIGNED.format(share=0, source='kept')} SELECT item_id, template, polarity, md5({SYSTEM}) AS system_md5 FROM assigned",
    "q13_template_histogram": f"WITH {ITEMS}, {ASSIGNED.format(share=0, source='kept')} SELECT template, count(*) AS n FROM assigned GROUP BY template",
}
QUERIES = {k: globals()[k] for k in SQL}
