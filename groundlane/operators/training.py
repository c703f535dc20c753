"""Training logs, schedules, checkpoints, parameters, merges and model names."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import running_sum


def last_written(log: DataFrame, key: str = "global_step", line: str = "line") -> DataFrame:
    """One row per step: the one written last, as a resumed run writes steps again."""
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), line).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def virtual_losses(log: DataFrame, accumulation: int, batch_size: int) -> DataFrame:
    """Per block of `accumulation` batches, the sum of loss / batch_size; an unfinished block gives no row."""
    blocks = log.groupBy(F.floor(F.col("batch_idx") / accumulation).alias("block")).agg(F.sum(F.col("loss") / batch_size).alias("loss"), F.count("*").alias("n"))
    return blocks.where(F.col("n") == accumulation).select("block", "loss")


def virtual_steps(log: DataFrame, accumulation: int, start: int = 0) -> DataFrame:
    """A log with one record per batch, with `stepped` (whether the batch ends a block and the optimizer steps) and
    virtual_batch_counter, the number of steps up to and including it, from a resumed run's `start` on. Whatever batches a log lacks,
    the counter counts the steps that it has."""
    stepped = log.withColumn("stepped", (F.col("batch_idx") + 1) % accumulation == 0)
    return running_sum(stepped, "batch_idx", F.col("stepped").cast("bigint"), "_n").withColumn("virtual_batch_counter", F.col("_n") + start).drop("_n")


def save_steps(steps: DataFrame, every: int) -> DataFrame:
    """The steps after which a run validates and saves: global_step is the number of batches done."""
    return steps.where(F.col("stepped") & (F.col("virtual_batch_counter") % every == 0)).select("batch_idx", (F.col("batch_idx") + 1).alias("global_step"), "virtual_batch_counter")


def validation_loss(rows: DataFrame) -> DataFrame:
    """The mean over batches of each batch's mean loss, whatever the batches' sizes; null without rows."""
    return rows.groupBy("batch_id").agg(F.avg("loss").alias("loss")).agg(F.avg("loss").alias("val_loss"), F.count("*").alias("n_batches"))


def learning_rate(step: Column, peak: float, warmup: int, total: int) -> Column:
    """Linear to the peak over the warm-up, then half a cosine down to 0."""
    done = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, peak * step / max(1, warmup)).otherwise(peak * F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(pi * done))))


def step_counts(n_rows: Column, batch_size: int, epochs: int, accumulation: int) -> tuple[Column, Column]:
    """Batches of an epoch, and optimizer steps of the run, both rounded down."""
    n = F.floor(n_rows / batch_size)
    return n, F.floor(n * epochs / accumulation)


def checkpoint_step(path: Column) -> Column:
    """The number after the last underscore, without .pt; -1 if it is none."""
    return F.coalesce(F.replace(F.substring_index(path, "_", -1), F.lit(".pt"), F.lit("")).try_cast("bigint"), F.lit(-1).cast("bigint"))


def latest_checkpoint(listing: DataFrame) -> DataFrame:
    return listing.agg(F.max_by("path", F.struct(checkpoint_step(F.col("path")), F.col("path"))).alias("path"), F.max(checkpoint_step(F.col("path"))).alias("step"))


def retention(listing: DataFrame, keep: int = 2) -> DataFrame:
    """path, step and whether it stays: of the state files chkp_*.pt the newest `keep`, and of the adapter folders all but those that
    stand beside a state file that goes. Other paths stay."""
    named = listing.select("path", checkpoint_step(F.col("path")).alias("step"), F.substring_index("path", "/", -1).alias("_name"))
    rows = named.withColumn("_state", F.col("_name").rlike(r"^chkp_.*\.pt$"))
    newest = rows.where("_state").orderBy(F.col("step").desc(), "path").limit(keep).select("path", F.lit(True).alias("_new"))
    rows = rows.join(F.broadcast(newest), "path", "left")  # `keep` rows
    gone = rows.where("_state AND _new IS NULL AND step >= 0").select(F.concat(F.lit("peft_chkp_"), F.col("step").cast("string")).alias("_name"), F.lit(True).alias("_gone")).distinct()
    stays = F.when(F.col("_state"), F.coalesce("_new", F.lit(False))).otherwise(F.col("_gone").isNull())
    return rows.join(gone, "_name", "left").select("path", "step", stays.alias("keep"))


def parameter_totals(parameters: DataFrame) -> DataFrame:
    total, tuned = F.sum("numel"), F.coalesce(F.sum(F.when(F.col("trainable"), F.col("numel"))), F.lit(0))
    return parameters.agg(total.alias("total"), tuned.alias("trainable"), F.round(F.try_divide(100.0 * tuned, total), 3).alias("percent"))


def low_rank_merge(weights: DataFrame, adapter: DataFrame, scale: float, layer: str = "layer") -> DataFrame:
    """W + scale * B A of each layer by rows of W: weights (layer, i, w array), adapter (layer, k, a array, b array), where a is row k of A
    and b column k of B. The adapter's few rows of a layer meet each row of W as one array, so the join gives the rows of W and no
    more. Layers without an adapter stay as they are; sizes that don't fit are an error."""
    factors = adapter.groupBy(layer).agg(F.array_sort(F.collect_list(F.struct("k", "a", "b"))).alias("_f"))
    share = lambda f: scale * F.get(f["b"], F.col("i").cast("int"))
    merged = F.aggregate("_f", F.col("w"), lambda w, f: F.zip_with(w, f["a"], lambda x, y: x + share(f) * y))
    fits = F.forall("_f", lambda f: (F.size(f["a"]) == F.size("w")) & (F.size(f["b"]) > F.col("i")))
    checked = F.when(F.col("_f").isNull(), F.col("w")).when(fits, merged).otherwise(F.raise_error(F.lit("the adapter doesn't fit its layer")).cast("array<double>"))
    return weights.join(factors, layer, "left").select(layer, "i", checked.alias("w"))


#: Families by a part of the name, and the base models that can be merged.
FAMILIES = ("qwen2.5", "qwen3")
MERGEABLE = ("Qwen2-VL-6B-Instruct", "Qwen2.5-VL-7B-Instruct", "Qwen3-VL-8B-Instruct", "InternVL3_5-8B-Instruct")


def family(name: Column, strict: bool = True) -> Column:
    """The family whose name the model's holds, in any case; else an error, or null if not strict."""
    other = F.raise_error(F.concat(F.lit("unsupported base model: "), name)).cast("string") if strict else F.lit(None).cast("string")
    out = other
    for f in reversed(FAMILIES):
        out = F.when(F.contains(F.lower(name), F.lit(f)), F.lit(f)).otherwise(out)
    return out


def check_family(name: str) -> None:
    """A base model of a known family, tiled ones included, can be prepared for; any other is an error."""
    if not any(f in name.lower() for f in (*FAMILIES, "internvl")):
        raise ValueError(f"unsupported base model: {name}")


def mergeable(path: Column) -> Column:
    """Whether the last path segment is exactly one of the known base models."""
    return F.substring_index(path, "/", -1).isin(*MERGEABLE)
