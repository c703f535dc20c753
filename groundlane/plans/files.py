"""Queries over written files: annotation documents, checkpoints and training shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunSettings
from ..operators import curate, training
from ..sources import annotations, bindings, checkpoints, items, shards
from ..sources.shared import shared_dir
from ..streaming import metrics
from .curation import HASH
from .training import BATCH, LOG, _joined, padded_epoch
from .training import SQL as TRAINING_SQL

ACCUMULATION, SAVE_EVERY, KEEP = 8, 10, 2
SETTINGS = RunSettings("/data", "Qwen3-VL-8B-Instruct", "/out", BATCH, ACCUMULATION, 117, 1, 1e-4, 25, SAVE_EVERY, 14_000_000, use_peft=True, restore_checkpoint=True)

#: SQL of the documents' items: which file holds them, and what is planted in them.
FILED = f"""
line AS (
  SELECT l_orderkey, l_linenumber, l_quantity < 49 AND p_name IS NOT NULL AS answered FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
),
filed AS (
  SELECT o_orderkey AS item_id, o_custkey, 'd' || (o_orderkey % 5) AS dataset, CASE WHEN o_orderkey % 10 < 2 THEN 'val' ELSE 'train' END AS split,
    CASE o_orderkey % 7 WHEN 0 THEN 'absent' WHEN 1 THEN 'null' ELSE 'string' END AS query_kind, o_orderstatus = 'P' AS blank,
    coalesce(n_boxes, 0) AS n_boxes, coalesce(n_bad_boxes, 0) AS n_bad_boxes, coalesce(n_answers, 0) AS n_answers,
    {HASH.format("'file|' || o_orderkey")} % ((SELECT count(*) FROM orders) // {bindings.DOCUMENT_ITEMS} + 1) AS document
  FROM orders LEFT JOIN (
    SELECT l_orderkey, count(*) AS n_boxes, count(*) FILTER (l_linenumber IN (3, 5)) AS n_bad_boxes, count(*) FILTER (answered) AS n_answers FROM line GROUP BY l_orderkey
  ) ON o_orderkey = l_orderkey
)"""


def q39_annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dataset and split: files, those rejected by name, and the items, boxes and answers of the others."""
    files = annotations.annotation_files(spark, bindings.annotation_folder(spark, sf_dir))
    items = annotations.typed(annotations.file_items(files, "skip"))
    per_file = files.groupBy("dataset", "split").agg(F.count("*").alias("n_files"), F.count_if(F.col("fault") == "malformed").alias("n_malformed"))
    per_item = items.groupBy("dataset", "split").agg(F.count("*").alias("n_items"), F.sum("n_bbox").alias("n_boxes"), F.sum("n_answer").alias("n_answers"))
    return per_file.join(per_item, ["dataset", "split"], "left").na.fill(0, ["n_items", "n_boxes", "n_answers"])


def q40_strict_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every item of the files in strict reading: its fault, the first rule that it fails, or kept."""
    files = annotations.annotation_files(spark, bindings.annotation_folder(spark, sf_dir))
    rows = annotations.typed(annotations.file_items(files, "skip")).withColumn("item_id", F.expr("variant_get(item, '$.id', 'bigint')"))
    judged = curate.judged(rows, bindings.images(spark, sf_dir), annotations.strict_reason)
    return judged.select("item_id", "query_kind", F.col("n_bad_boxes").cast("bigint").alias("n_bad_boxes"), F.coalesce("item_fault", "reject_reason", F.lit("kept")).alias("outcome"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.last_written(bindings.metrics(spark, sf_dir))


def q41_checkpoints_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three saves of a run that logged all events, published one after the other: the states that stay, and which one a
    resumed run takes."""
    log, folder = _log(spark, sf_dir), shared_dir(spark, "checkpoints")
    saves = training.save_steps(training.virtual_steps(log, ACCUMULATION), SAVE_EVERY).orderBy(F.desc("batch_idx")).limit(3).collect()
    losses = training.virtual_losses(log, ACCUMULATION, BATCH)
    best = losses.agg(*[F.min(F.when(F.col("block") * ACCUMULATION < r["global_step"], F.col("loss"))).alias(f"b{k}") for k, r in enumerate(saves)], F.count("*")).first()
    for k, r in reversed(list(enumerate(saves))):
        state = checkpoints.trainer_state(spark, SETTINGS, r["global_step"], r["virtual_batch_counter"], best[f"b{k}"])
        checkpoints.publish(folder, r["global_step"], state, keep=KEEP)
    found = checkpoints.resumed(spark, folder, SETTINGS)
    kept = [r["path"] for r in checkpoints.listing(spark, folder).collect()]
    states = spark.read.schema("global_step long, virtual_batch_counter long, best_val_loss double, use_peft boolean").parquet(*[f"{folder}/{n}" for n in kept])
    return states.select("global_step", "virtual_batch_counter", F.round("best_val_loss", 6).alias("best_val_loss"), (F.col("global_step") == found["global_step"]).alias("latest"))


def q42_streamed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks' losses by a stream over the log's files, in which every tenth line is written again later."""
    folder = shared_dir(spark, "stream")
    lines = bindings.metrics(spark, sf_dir).select(F.lit("batch_loss").alias("type"), "global_step", F.lit(None).cast("bigint").alias("virtual_batch_counter"), "batch_idx", "loss", "line")
    for again in (False, True):
        items.append_metrics(lines.where((F.col("line") >= 1_000_000_000) == again), f"{folder}/log")
    return metrics.block_log(spark, f"{folder}/log", f"{folder}/blocks", f"{folder}/state", ACCUMULATION, BATCH).select("block", F.round("loss", 6).alias("loss"))


def q43_virtual_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each optimizer step over all events but every thirteenth: the batch that ends it and the step's number."""
    log = _log(spark, sf_dir).where("batch_idx % 13 <> 5")
    return training.virtual_steps(log, ACCUMULATION).where("stepped").select("batch_idx", "virtual_batch_counter")


def q44_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epoch's padded batches written as shards and read back from a third of the batches on."""
    path = f"{shared_dir(spark, 'shards')}/epoch"
    rows = padded_epoch(spark, sf_dir)
    manifest = shards.write_shards(rows, path, rows_per_shard=2_000)
    done = manifest.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first()["n"] // BATCH // 3
    left = shards.read_shards(spark, path, done, BATCH)
    return left.select("row_id", F.col("rank").cast("bigint").alias("rank"), "batch_id", F.size("ids").cast("bigint").alias("n"), *[F.md5(_joined(c)).alias(f"{c}_md5") for c in ("ids", "attention", "labels")])


SQL = {
    "q39_annotation_files": f"""WITH {FILED}
      SELECT dataset, split, count(DISTINCT document) AS n_files, count(DISTINCT document) FILTER (document = 0) AS n_malformed, count(*) FILTER (document > 0) AS n_items,
        CAST(coalesce(sum(n_boxes) FILTER (document > 0), 0) AS BIGINT) AS n_boxes, CAST(coalesce(sum(n_answers) FILTER (document > 0), 0) AS BIGINT) AS n_answers FROM filed GROUP BY dataset, split""",
    "q40_strict_items": f"""WITH {FILED}
      SELECT item_id, query_kind, n_bad_boxes, CASE WHEN item_id % 50 = 3 THEN 'no_image_path' WHEN query_kind = 'absent' OR query_kind = 'string' AND blank THEN 'empty_query'
        WHEN n_boxes = 0 THEN 'empty_bbox' WHEN n_answers = 0 THEN 'empty_answer' WHEN n_boxes <> n_answers THEN 'len_mismatch' WHEN c_custkey IS NULL THEN 'missing_image' ELSE 'kept' END AS outcome
      FROM filed LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey WHERE document > 0""",
    "q41_checkpoints_kept": f"""WITH {LOG}, b AS (SELECT batch_idx // 8 AS block, sum(loss / 4) AS loss FROM log GROUP BY block HAVING count(*) = 8),
      s AS (SELECT batch_idx, (SELECT count(*) FROM log x WHERE (x.batch_idx + 1) % 8 = 0 AND x.batch_idx <= log.batch_idx) AS counter FROM log WHERE (batch_idx + 1) % 80 = 0 ORDER BY batch_idx DESC LIMIT 2)
      SELECT batch_idx + 1 AS global_step, counter AS virtual_batch_counter, round((SELECT min(loss) FROM b WHERE block * 8 <= batch_idx), 6) AS best_val_loss, batch_idx = (SELECT max(batch_idx) FROM s) AS latest FROM s""",
    "q42_streamed_blocks": f"WITH {LOG} SELECT batch_idx // 8 AS block, round(sum(loss / 4), 6) AS loss FROM log GROUP BY block HAVING count(*) = 8",
    "q44_training_shards": TRAINING_SQL["q27_pad_collate"].replace("SELECT row_id, ", "SELECT row_id, rank, batch_id, ", 1) + " WHERE rank > (SELECT count(*) FROM conversations) // 4 // 3 * 4",
    "q43_virtual_counters": f"""WITH {LOG}, s AS (SELECT batch_idx FROM log WHERE batch_idx % 13 <> 5 AND (batch_idx + 1) % 8 = 0)
      SELECT batch_idx, row_number() OVER (ORDER BY batch_idx) AS virtual_batch_counter FROM s""",
}
QUERIES = {k: globals()[k] for k in SQL}
