"""Checkpoints of a run that survive a crash at any moment, as a trainer's folder holds them.

A checkpoint of a step is a folder chkp_{step}.pt with the trainer state and, where adapters are tuned, peft_chkp_{step} beside it. It
is published in two phases. First its tables are written under a draft name and renamed, so that a folder of a final name is whole.
Then the pointer `chkp_latest` is replaced in one step by a file that names the checkpoint. A crash before the second phase leaves the
checkpoint before in force; what it wrote is overwritten by the same step's next attempt or goes with clean(). Readers follow the
pointer alone. Where a pointer is lost, the newest whole checkpoint counts.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import RunSettings
from ..operators.training import retention
from .shared import exists, moved, names, put, removed, text_of

POINTER, DRAFT = "chkp_latest", "_draft-"
#: The state's names of the adapter settings, and the settings' own.
LORA = {
    "r": "lora_r", "lora_alpha": "lora_alpha", "lora_dropout": "lora_dropout", "bias": "lora_bias",
    "target_modules": "lora_target_modules", "modules_to_save": "lora_modules_to_save",
}


def plain(value):
    return list(value) if isinstance(value, tuple) else value


@dataclass(frozen=True)
class Checkpoint:
    step: int
    state: DataFrame
    adapter: DataFrame | None


def trainer_state(spark: SparkSession, settings: RunSettings, global_step: int, virtual_batch_counter: int, best_val_loss: float) -> DataFrame:
    """The one row of a run's state after `global_step` batches."""
    lora = {k: plain(getattr(settings, name)) for k, name in LORA.items()}
    return spark.createDataFrame([(global_step, virtual_batch_counter, float(best_val_loss), settings.use_peft, lora)], schemas.TRAINER_STATE)


def publish(folder: str, step: int, state: DataFrame, adapter: DataFrame | None = None, keep: int | None = None) -> None:
    """Makes `state` and `adapter` the folder's checkpoint of a step and the latest one; with `keep`, older ones beyond it go."""
    spark = state.sparkSession
    for table, name in ((adapter, f"peft_chkp_{step}"), (state, f"chkp_{step}.pt")):
        if table is not None:
            draft = f"{folder}/{DRAFT}{uuid.uuid4().hex}"
            table.write.parquet(draft)
            if exists(spark, f"{folder}/{name}"):  # of an attempt that ended before its pointer
                removed(spark, f"{folder}/{name}")
            moved(spark, draft, f"{folder}/{name}")
    point(spark, folder, step, adapter is not None)
    if keep is not None:
        clean(spark, folder, keep)


def point(spark: SparkSession, folder: str, step: int, adapter: bool) -> None:
    put(spark, f"{folder}/{POINTER}", json.dumps({"step": step, "adapter": adapter}))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of a checkpoint folder, as latest_checkpoint() and retention() take them: one directory's names, drafts left out."""
    return spark.createDataFrame([(n,) for n in names(spark, folder) if n != POINTER and not n.startswith(DRAFT)], "path string")


def latest(spark: SparkSession, folder: str) -> Checkpoint | None:
    """The checkpoint that a resumed run goes on from; none in a folder without a whole one."""
    there = set(names(spark, folder))
    if POINTER in there:
        named = json.loads(text_of(spark, f"{folder}/{POINTER}"))
        step, adapter = named["step"], named["adapter"]
        if f"chkp_{step}.pt" not in there:
            raise FileNotFoundError(f"{folder}: {POINTER} names step {step}, which is not there")
    else:
        steps = [int(m[1]) for n in there if (m := re.fullmatch(r"chkp_(\d+)\.pt", n))]
        if not steps:
            return None
        step = max(steps)
        adapter = f"peft_chkp_{step}" in there
    read = spark.read.schema(schemas.TRAINER_STATE).parquet(f"{folder}/chkp_{step}.pt")
    return Checkpoint(step, read, spark.read.parquet(f"{folder}/peft_chkp_{step}") if adapter else None)


def clean(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Deletes what retention() does not keep, and drafts; never what the pointer names. Returns the names that went."""
    pointed = latest(spark, folder)
    held = {f"chkp_{pointed.step}.pt", f"peft_chkp_{pointed.step}"} if pointed else set()
    rows = retention(listing(spark, folder), keep).where(~F.col("keep")).select("path")
    gone = sorted({r["path"] for r in rows.collect()} - held) + [n for n in names(spark, folder) if n.startswith(DRAFT)]
    for n in gone:
        removed(spark, f"{folder}/{n}")
    return gone


def resumed(spark: SparkSession, folder: str, settings: RunSettings) -> dict:
    """global_step, virtual_batch_counter and best_val_loss to start from: the latest checkpoint's if the settings ask to restore one
    and there is one, else zeros. A checkpoint of other adapter settings is an error."""
    found = latest(spark, folder) if settings.restore_checkpoint else None
    if found is None:
        return {"global_step": 0, "virtual_batch_counter": 0, "best_val_loss": float("inf")}
    row = found.state.first().asDict(recursive=True)
    other = [k for k, name in LORA.items() if settings.use_peft and row["lora_config"][k] != plain(getattr(settings, name))]
    if row["use_peft"] != settings.use_peft or other:
        raise ValueError(f"the checkpoint of step {found.step} was made with other settings: {', '.join(other) or 'use_peft'}")
    return {k: row[k] for k in ("global_step", "virtual_batch_counter", "best_val_loss")}
