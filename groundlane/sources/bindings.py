"""Synthetic stand-ins for the engine's inputs, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash32
from .shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per order: boxes are its lines, answers the parts' names."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
    box = F.expr("array(l_discount + 0.0D, l_tax + 0.0D, l_discount + l_quantity / 100, l_tax + l_quantity / 100)")
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", box.alias("box"), F.expr("IF(l_quantity < 49, concat(p_name, '.'), NULL)").alias("answer"))
    per = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("lines"))
    rows = table(spark, sf_dir, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("item_id"),
        F.expr("concat('d', o_orderkey % 5)").alias("dataset"),
        F.expr("IF(o_orderkey % 10 < 2, 'val', 'train')").alias("split"),
        F.expr("IF(o_orderstatus = 'P', '', concat(o_orderstatus, ' ', o_orderpriority))").alias("query"),
        F.expr("filter(transform(coalesce(lines, array()), x -> x.answer), a -> a IS NOT NULL)").alias("answer"),
        F.expr("transform(coalesce(lines, array()), x -> x.box)").alias("bbox"),
        F.expr("concat('/raw/cust_', o_custkey, '.png')").alias("image_path"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.expr("concat('/img/cust_', c_custkey, '.png')").alias("path"))


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS image_id", "p_size * 40 AS w", "CAST(100 + (p_partkey * 37) % 1900 AS INT) AS h")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which every tenth line was written again after a resume: `line` is its place in the file."""
    e = table(spark, sf_dir, "events").selectExpr("event_id AS batch_idx", "event_id + 1 AS global_step", "value AS loss", "event_id AS line")
    again = e.where("batch_idx % 10 = 0").selectExpr("batch_idx", "global_step", "loss * 2 AS loss", "line + 1000000000 AS line")
    return e.union(again)


#: Items of a document, about.
DOCUMENT_ITEMS = 2000


def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items as JSON objects: of each seven one lacks its query and one has null; boxes of third lines are whole numbers and those
    of fifth lines have three; one of fifty has no image_path."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
    box = F.expr("""concat('[', CASE l_linenumber WHEN 3 THEN '0, 0, 1, 1' WHEN 5 THEN '0.25, 0.5, 0.75'
      ELSE concat_ws(', ', l_discount + 0.0D, l_tax + 0.0D, l_discount + l_quantity / 100, l_tax + l_quantity / 100) END, ']')""")
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", box.alias("box"), F.expr("IF(l_quantity < 49, to_json(concat(p_name, '.')::variant), NULL)").alias("answer"))
    per = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("x"))
    rows = table(spark, sf_dir, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    query = F.expr("""CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '"query": null, '
      ELSE concat('"query": "', IF(o_orderstatus = 'P', '', concat(o_orderstatus, ' ', o_orderpriority)), '", ') END""")
    image = F.expr("""IF(o_orderkey % 50 = 3, '', concat(', "image_path": "/raw/cust_', o_custkey, '.png"'))""")
    listed = "concat('[', array_join(filter(transform(coalesce(x, array()), r -> r.{}), r -> r IS NOT NULL), ', '), ']')"
    text = F.concat(F.lit("{"), query, F.lit('"id": '), F.col("o_orderkey").cast("string"), F.lit(', "answer": '), F.expr(listed.format("answer")), F.lit(', "bbox": '), F.expr(listed.format("box")), image, F.lit("}"))
    return rows.select(F.col("o_orderkey").alias("item_id"), F.expr("concat('d', o_orderkey % 5)").alias("dataset"), F.expr("IF(o_orderkey % 10 < 2, 'val', 'train')").alias("split"), text.alias("item"))


def annotation_folder(spark: SparkSession, sf_dir: str) -> str:
    """Writes the items as documents of about DOCUMENT_ITEMS / 10 items, one a file, and returns their root. The second half of each
    document numbered 0 is lost, as where a writer was stopped."""
    n = table(spark, sf_dir, "orders").count() // DOCUMENT_ITEMS + 1
    rows = item_texts(spark, sf_dir).withColumn("document", hash32("file", "item_id") % n)
    per = rows.groupBy("dataset", "split", "document").agg(F.array_join(F.sort_array(F.collect_list("item")), ",\n  ").alias("items"))
    whole = F.concat(F.lit('{\n "items": [\n  '), F.col("items"), F.lit("\n ],\n \"made\": true\n}"))
    text = F.when(F.col("document") == 0, F.substring(whole, F.lit(1), (F.length(whole) / 2).cast("int"))).otherwise(whole)
    root = shared_dir(spark, "annotations")
    per.select("dataset", "split", text.alias("value")).write.partitionBy("dataset", "split").option("maxRecordsPerFile", 1).text(root)
    return root
