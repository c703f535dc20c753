"""Whole runs by flags: `python -m groundlane.runs prepare --dataset_dir ...` and `... merge --base_model ...`."""

from __future__ import annotations

import json
import logging
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import logs
from .config import MergeSettings, RunSettings, parsed
from .operators import curate, templates, tokens, training
from .sources import annotations, checkpoints, items, shards
from .sources.shared import put, text_of, written

#: Validation rows of a dataset at most.
MOST_VALIDATION = 500
CONFIG = "adapter_config.json"


def folder_items(spark: SparkSession, root: str) -> DataFrame:
    """The typed items of a folder of datasets, their image paths under it and an item_id from file and place."""
    rows = annotations.typed(annotations.file_items(annotations.annotation_files(spark, root)))
    name = F.concat_ws("/", "dataset", "split", F.substring_index("file", "/", -1), F.col("place").cast("string"))
    return items.rebase(rows.where("item_fault IS NULL"), root).withColumn("item_id", name).drop("item")


def prepare(spark: SparkSession, settings: RunSettings) -> dict[str, int]:
    """From annotation folders to what a trainer reads, under output_dir: the rules' counts (filter_stats), the validation rows
    (validation), the learning rate and the saves of each optimizer step (schedule) and the epoch's batches as shards (train-{step}),
    from the latest checkpoint's step on where settings ask for it.

    Rules, splits, caps, templates and order are those of the operators; broken files end the run by name. Returns how many rows
    and batches there are."""
    training.check_family(settings.base_model_name)
    logging.info("settings %s", settings)
    out = settings.output_dir.rstrip("/")
    judged = curate.judged(folder_items(spark, settings.dataset_dir), items.image_listing(spark, settings.dataset_dir), annotations.strict_reason, segments=4)
    judged = written(judged, "judged")  # files are read once
    curate.filter_stats(judged).write.mode("overwrite").json(f"{out}/filter_stats")
    named = templates.assigned(curate.prepared(judged)).select("item_id", "dataset", "final_split", "image_path", "query", "answer", "bbox", "tag")
    named.write.mode("overwrite").parquet(f"{out}/prepared")
    rows = spark.read.schema(named.schema).parquet(f"{out}/prepared")
    train, validation = curate.checked_splits(rows.where("final_split = 'train'"), curate.capped(rows.where("final_split = 'val'"), MOST_VALIDATION))
    validation.write.mode("overwrite").parquet(f"{out}/validation")
    step = checkpoints.resumed(spark, f"{out}/checkpoints", settings)["global_step"]
    manifest = shards.write_shards(tokens.epoch(train, settings, "item_id", step), f"{out}/train-{step}")
    n_train = manifest.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first()["n"]
    n_full = F.lit(train.count())
    n_batches, n_steps = training.step_counts(n_full, settings.batch_size, settings.epochs, settings.gradient_accumulation)
    total = spark.range(1).select(n_batches.alias("n_batches"), n_steps.alias("n_steps")).first()
    rate = training.learning_rate(F.col("step"), settings.lr, settings.num_warmup_steps, total["n_steps"])
    saves = (F.col("step") % settings.num_save_steps == 0) & (F.col("step") > 0)
    spark.range(total["n_steps"] + 1).select(F.col("id").alias("step")).withColumns({"lr": rate, "saves": saves}).write.mode("overwrite").parquet(f"{out}/schedule")
    found = {"n_train": n_train, "n_validation": spark.read.parquet(f"{out}/validation").count(), "global_step": step, "n_batches": -(-n_train // settings.batch_size), "n_steps": total["n_steps"]}
    logging.info("prepared %s", found)
    return found


def merge(spark: SparkSession, settings: MergeSettings) -> None:
    """Writes base weights with an adapter folded in. Weights are Parquet rows (layer, i, w array) in `base_model`, whose last name must
    be a known one; the adapter has rows (layer, k, a array, b array) and adapter_config.json with r and lora_alpha."""
    if not spark.range(1).select(training.mergeable(F.lit(settings.base_model.rstrip("/"))).alias("x")).first()["x"]:
        raise ValueError(f"unsupported base model: {settings.base_model}")
    config = json.loads(text_of(spark, f"{settings.adapter_path}/{CONFIG}"))
    adapter = spark.read.parquet(f"{settings.adapter_path}/rows")
    merged = training.low_rank_merge(spark.read.parquet(settings.base_model), adapter, config["lora_alpha"] / config["r"])
    merged.write.parquet(settings.output_model_path)
    logging.info("merged %s", settings)


def save_adapter(adapter: DataFrame, path: str, r: int, lora_alpha: float) -> None:
    """An adapter as merge() reads it."""
    adapter.write.parquet(f"{path}/rows")
    put(adapter.sparkSession, f"{path}/{CONFIG}", json.dumps({"r": r, "lora_alpha": lora_alpha}))


def main(argv: Sequence[str]) -> None:
    if not argv or argv[0] not in ("prepare", "merge"):
        raise SystemExit("usage: python -m groundlane.runs prepare|merge --flags ...")
    spark = SparkSession.builder.getOrCreate()
    if argv[0] == "prepare":
        settings = parsed(RunSettings, argv[1:])
        logs.to_file_and_console(settings.log_file)
        prepare(spark, settings)
    else:
        merge(spark, parsed(MergeSettings, argv[1:]))


if __name__ == "__main__":
    main(sys.argv[1:])
