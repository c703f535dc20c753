"""Queries over token batches, label masks, training logs, checkpoints and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash32
from ..operators import tokens, training
from ..sources import bindings
from .curation import HASH

SEED, BATCH, MARKER = 117, 4, 1


def _turn_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in tokens: words between single spaces, numbered by hash."""
    rows = bindings.turns(spark, sf_dir).withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn"))
    ids = F.transform(F.split("text", " "), lambda w: hash32("tok", w) % 50_000 + 10)
    return rows.select("row_id", ids.alias("ids"))


def _joined(ids: str) -> F.Column:
    return F.array_join(F.col(ids).cast("array<string>"), " ")


def _order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.batches(tokens.epoch_order(_turn_ids(spark, sf_dir), SEED, "row_id"), BATCH)


def q26_shuffle_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order(spark, sf_dir).select("row_id", F.col("rank").cast("bigint").alias("rank"), "batch_id")


def padded_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked rows with ids, attention and labels of equal length within their batch."""
    rows = _order(spark, sf_dir).withColumns({"attention": F.transform("ids", lambda x: F.lit(1)), "labels": tokens.masked_prefix(F.col("ids"), F.lit(2))})
    out = tokens.padded(rows, 0)
    return out.withColumn("labels", tokens.masked_padding(F.col("labels"), F.col("attention")))


def q27_pad_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return padded_epoch(spark, sf_dir).select("row_id", F.size("ids").cast("bigint").alias("n"), *[F.md5(_joined(c)).alias(f"{c}_md5") for c in ("ids", "attention", "labels")])


def q27b_batch_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in patches: the first three tokens of each row."""
    out = tokens.batch_patches(_order(spark, sf_dir).withColumn("patches", F.slice("ids", 1, 3)))
    return out.select("batch_id", F.md5(_joined("patches")).alias("patches_md5"), F.size("image_flags").cast("bigint").alias("n_flags"))


def q28_resume_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.resumed(_order(spark, sf_dir), 10, BATCH).select("row_id", F.col("rank").cast("bigint").alias("rank"))


def q30_batch_loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.last_written(bindings.metrics(spark, sf_dir)).select("global_step", "batch_idx", "loss")


def q31_virtual_batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.virtual_losses(training.last_written(bindings.metrics(spark, sf_dir)), 8, BATCH)
    return out.select("block", F.round("loss", 6).alias("loss"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation with an assistant turn: ids of all turns, each after its role's number, and how many precede the answer."""
    turn = F.struct("turn", "role", F.concat(F.array(F.when(F.col("role") == "assistant", MARKER).when(F.col("role") == "user", 2).otherwise(3).cast("bigint")), F.transform(F.split("text", " "), lambda w: hash32("tok", w) % 50_000 + 10)).alias("ids"))
    per = bindings.turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    per = per.where(F.exists("t", lambda x: x["role"] == "assistant"))
    prompt = F.flatten(F.transform(F.filter("t", lambda x: x["role"] != "assistant"), lambda x: x["ids"]))
    return per.select("conv_id", F.flatten(F.transform("t", lambda x: x["ids"])).alias("ids"), F.size(prompt).alias("n_prompt"))


def q32a_mask_to_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = tokens.masked_to_marker(F.col("ids"), F.lit(MARKER).cast("bigint"))
    return _conversations(spark, sf_dir).select("conv_id", F.md5(F.array_join(labels.cast("array<string>"), " ")).alias("labels_md5"))


def q32b_mask_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = tokens.masked_prefix(F.col("ids"), F.col("n_prompt"))
    return _conversations(spark, sf_dir).select("conv_id", F.md5(F.array_join(labels.cast("array<string>"), " ")).alias("labels_md5"))


def q33_val_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bindings.table(spark, sf_dir, "events").selectExpr("floor(event_id / 3) AS batch_id", "value AS loss")
    return training.validation_loss(rows).select(F.round("val_loss", 6).alias("val_loss"), "n_batches")


def q34_lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bindings.table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    n_batches, n_steps = training.step_counts(F.col("n"), BATCH, 1, 8)
    total = n.select(n_batches.alias("n_batches"), n_steps.alias("n_steps")).first()
    steps = spark.range(total["n_steps"] + 1).withColumnRenamed("id", "step")
    return steps.select("step", F.lit(total["n_batches"]).alias("n_batches"), F.round(training.learning_rate(F.col("step"), 1e-4, 25, total["n_steps"]), 10).alias("lr"))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state file and an adapter folder for each event, and the state file of the latest step."""
    paths = bindings.table(spark, sf_dir, "events").selectExpr("explode(array(concat('chkp_', event_id, '.pt'), concat('peft_chkp_', event_id))) AS path")
    return paths.union(spark.range(1).select(F.lit("chkp_latest.pt").alias("path")))


def q35_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = _listing(spark, sf_dir)
    latest = training.latest_checkpoint(listing.where("path LIKE 'peft%'")).select(F.col("path").alias("latest"))
    return training.retention(listing).withColumn("latest", F.lit(latest.first()["latest"]))


def q36_param_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bindings.table(spark, sf_dir, "part").select(F.concat("p_name", "p_partkey").alias("name"), F.col("p_size").cast("bigint").alias("numel"), (F.col("p_type") == "PROMO").alias("trainable"))
    return training.parameter_totals(rows)


def q37_low_rank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank 4: of each eight vectors, which are a layer, four are A and four the transposed B; W is a pattern. Per row of the merged
    matrices, the sum of its weights and the largest."""
    vectors = bindings.table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL")
    v = vectors.select(F.floor(F.col("vec_id") / 8).alias("layer"), (F.col("vec_id") % 8).alias("part"), F.col("embedding").cast("array<double>").alias("v"))
    adapter = v.where("part < 4").select("layer", F.col("part").alias("k"), F.col("v").alias("a")).join(v.where("part >= 4").select("layer", (F.col("part") - 4).alias("k"), F.col("v").alias("b")), ["layer", "k"])
    rows = v.where("part = 0").select("layer", F.size("v").alias("n"), F.posexplode("v").alias("i", "_"))
    weights = rows.select("layer", "i", F.expr("transform(sequence(0, n - 1), j -> ((i * 31 + j * 17) % 7 - 3) / 10D)").alias("w"))
    merged = training.low_rank_merge(weights, adapter, 2.0)
    total = F.aggregate("w", F.lit(0.0), lambda x, y: x + y)
    return merged.select("layer", "i", F.round(total, 4).alias("total"), F.round(F.array_max("w"), 5).alias("largest"))


def q38_model_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of base models, by part: the family by a part of the name, and whether a merge takes them."""
    names = ("models/Qwen2.5-VL-7B-Instruct", "models/Qwen3-VL-8B-Instruct", "models/InternVL3_5-8B-Instruct", "models/Qwen2-VL-7B-Instruct", "models/QWEN2.5-other")
    part = bindings.table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int")).alias("model"))
    return part.select("p_partkey", F.coalesce(training.family(F.col("model"), strict=False), F.lit("error")).alias("family"), training.mergeable(F.col("model")).alias("mergeable"))


TURN = f"""turn AS (SELECT conv_id * 1000 + turn AS row_id, list_transform(string_split(text, ' '), lambda w: {HASH.format("'tok|' || w")} % 50000 + 10) AS ids FROM conversations),
  ranked AS (SELECT *, row_number() OVER (ORDER BY md5('117|' || row_id), row_id) AS rank FROM turn),
  batch AS (SELECT *, (rank - 1) // 4 AS batch_id FROM ranked)"""
LOG = """log AS (SELECT event_id + 1 AS global_step, event_id AS batch_idx, CASE WHEN event_id % 10 = 0 THEN value * 2 ELSE value END AS loss FROM events)"""
CONV = f"""t AS (SELECT conv_id, turn, role, [CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 ELSE 3 END::BIGINT] || list_transform(string_split(text, ' '), lambda w: {HASH.format("'tok|' || w")} % 50000 + 10) AS ids FROM conversations),
  c AS (SELECT conv_id, flatten(list(ids ORDER BY turn)) AS ids, coalesce(sum(len(ids)) FILTER (role <> 'assistant'), 0) AS n_prompt FROM t GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0)"""

SQL = {
    "q26_shuffle_batches": f"WITH {TURN} SELECT row_id, rank, batch_id FROM batch",
    "q27_pad_collate": f"""WITH {TURN}, m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS n FROM batch)
      SELECT row_id, CAST(n AS BIGINT) AS n, md5(array_to_string(ids || list_transform(range(n - len(ids)), lambda x: 0), ' ')) AS ids_md5,
        md5(array_to_string(list_transform(ids, lambda x: 1) || list_transform(range(n - len(ids)), lambda x: 0), ' ')) AS attention_md5,
        md5(array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= 2 THEN -100 ELSE x END) || list_transform(range(n - len(ids)), lambda x: -100), ' ')) AS labels_md5 FROM m""",
    "q27b_batch_patches": f"WITH {TURN} SELECT batch_id, md5(array_to_string(flatten(list(ids[1:3] ORDER BY rank)), ' ')) AS patches_md5, CAST(sum(len(ids[1:3])) AS BIGINT) AS n_flags FROM batch GROUP BY batch_id",
    "q28_resume_suffix": f"WITH {TURN} SELECT row_id, rank FROM batch WHERE rank > 40",
    "q30_batch_loss_log": f"WITH {LOG} SELECT global_step, batch_idx, loss FROM log",
    "q31_virtual_batch_loss": f"WITH {LOG} SELECT batch_idx // 8 AS block, round(sum(loss / 4), 6) AS loss FROM log GROUP BY block HAVING count(*) = 8",
    "q32a_mask_to_marker": f"WITH {CONV} SELECT conv_id, md5(array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= list_position(ids, 1) THEN -100 ELSE x END), ' ')) AS labels_md5 FROM c",
    "q32b_mask_prefix": f"WITH {CONV} SELECT conv_id, md5(array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= n_prompt THEN -100 ELSE x END), ' ')) AS labels_md5 FROM c",
    "q33_val_loss": "SELECT round(avg(l), 6) AS val_loss, count(*) AS n_batches FROM (SELECT event_id // 3 AS b, avg(value) AS l FROM events GROUP BY b)",
    "q34_lr_schedule": """WITH n AS (SELECT count(*) // 4 AS n_batches, count(*) // 4 // 8 AS n_steps FROM orders), s AS (SELECT n_batches, n_steps, unnest(range(n_steps + 1)) AS step FROM n)
      SELECT step, n_batches, round(CASE WHEN step < 25 THEN 1e-4 * step / 25 ELSE 1e-4 * greatest(0, 0.5 * (1 + cos(pi() * (step - 25) / greatest(n_steps - 25, 1)))) END, 10) AS lr FROM s""",
    "q35_checkpoints": """WITH l AS (SELECT 'peft_chkp_' || event_id AS path FROM events UNION ALL SELECT 'chkp_' || event_id || '.pt' FROM events UNION ALL SELECT 'chkp_latest.pt'),
      s AS (SELECT path, coalesce(TRY_CAST(replace(string_split(path, '_')[-1], '.pt', '') AS BIGINT), -1) AS step FROM l),
      state AS (SELECT path, step, row_number() OVER (ORDER BY step DESC, path) <= 2 AS keep FROM s WHERE path LIKE 'chkp%.pt')
      SELECT path, step, keep, (SELECT max_by(path, step) FROM s WHERE path LIKE 'peft%') AS latest FROM (SELECT * FROM state UNION ALL
        SELECT s.path, s.step, coalesce(state.keep, true) AS keep FROM s LEFT JOIN state USING (step) WHERE s.path LIKE 'peft%')""",
    "q36_param_totals": """SELECT CAST(sum(p_size) AS BIGINT) AS total, CAST(coalesce(sum(p_size) FILTER (p_type = 'PROMO'), 0) AS BIGINT) AS trainable,
      round(100.0::DOUBLE * coalesce(sum(p_size) FILTER (p_type = 'PROMO'), 0) / sum(p_size), 3) AS percent FROM part""",
    "q37_low_rank_merge": """WITH v AS (SELECT vec_id, vec_id // 8 AS layer, vec_id % 8 AS part, unnest(range(len(embedding))) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
      w AS (SELECT layer, c AS i, unnest(range(n)) AS j FROM (SELECT layer, c, max(c) OVER (PARTITION BY layer) + 1 AS n FROM v WHERE part = 0)),
      p AS (SELECT a.layer, b.c AS i, a.c AS j, sum(a.v * b.v) AS p FROM v a JOIN v b ON a.vec_id + 4 = b.vec_id WHERE a.part < 4 GROUP BY ALL),
      m AS (SELECT layer, i, j, ((i * 31 + j * 17) % 7 - 3) / 10::DOUBLE + 2.0::DOUBLE * coalesce(p, 0) AS w FROM w LEFT JOIN p USING (layer, i, j))
      SELECT layer, CAST(i AS INTEGER) AS i, round(sum(w), 4) AS total, round(max(w), 5) AS largest FROM m GROUP BY layer, i""",
    "q38_model_dispatch": """WITH p AS (SELECT p_partkey, ['models/Qwen2.5-VL-7B-Instruct', 'models/Qwen3-VL-8B-Instruct', 'models/InternVL3_5-8B-Instruct', 'models/Qwen2-VL-7B-Instruct', 'models/QWEN2.5-other'][p_partkey % 5 + 1] AS model FROM part)
      SELECT p_partkey, CASE WHEN contains(lower(model), 'qwen2.5') THEN 'qwen2.5' WHEN contains(lower(model), 'qwen3') THEN 'qwen3' ELSE 'error' END AS family,
        string_split(model, '/')[-1] IN ('Qwen2-VL-6B-Instruct', 'Qwen2.5-VL-7B-Instruct', 'Qwen3-VL-8B-Instruct', 'InternVL3_5-8B-Instruct') AS mergeable FROM p""",
}
QUERIES = {k: globals()[k] for k in SQL}
