"""The metrics log as a stream: count-based blocks with bounded state, and a sink that writes every batch once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas
from ..sources.shared import exists, moved

#: Timers and typed state need this state store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def batch_losses(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the batch_loss records that are appended under `path`; `written` is when their file was."""
    lines = spark.readStream.schema(schemas.METRIC).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return lines.where("type = 'batch_loss'").select("global_step", "batch_idx", "loss", F.col("_metadata.file_modification_time").alias("written"))


#: Consecutive blocks that share a state and a timer: calls of the state store grow with groups, not with blocks.
GROUP = 256


class BlockLosses(StatefulProcessor):
    """The steps of a group's blocks, `accumulation` at most of each, every block's until its own time to go."""

    def __init__(self, accumulation: int, batch_size: int, idle_ms: int):
        self.accumulation, self.batch_size, self.idle_ms = accumulation, batch_size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "blocks array<long>, steps array<long>, written array<long>, losses array<double>")

    def blocks(self) -> dict[int, dict[int, tuple[int, float]]]:
        """Block -> step -> when it was written, and its loss."""
        found: dict[int, dict[int, tuple[int, float]]] = {}
        for block, step, at, loss in zip(*self.held.get(), strict=True) if self.held.exists() else ():
            found.setdefault(block, {})[step] = (at, loss)
        return found

    def due(self, steps: dict[int, tuple[int, float]]) -> int:
        return max(at for at, _ in steps.values()) + 2 * self.idle_ms

    def keep(self, found: dict[int, dict[int, tuple[int, float]]]) -> None:
        """Holds these blocks, and sets the group's one timer for the first of them that goes."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not found:
            self.held.clear()
            return
        rows = [(block, step, *found[block][step]) for block in found for step in sorted(found[block])]
        self.held.update(tuple(map(list, zip(*rows, strict=True))))
        self.handle.registerTimer(min(map(self.due, found.values())))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found, before = self.blocks(), {}
        for f in rows:
            for block, step, at, loss in zip(f["block"].tolist(), f["global_step"].tolist(), f["at"].tolist(), f["loss"].tolist(), strict=True):
                held = found.setdefault(block, {})
                if block not in before:
                    before[block] = dict(held)
                if step not in held or held[step][0] <= at:
                    held[step] = (at, loss)
        self.keep(found)
        full = [b for b, old in before.items() if len(found[b]) == self.accumulation and found[b] != old]
        if full:
            yield pd.DataFrame({"block": full, "loss": [sum(found[b][s][1] / self.batch_size for s in sorted(found[b])) for b in full]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.keep({block: steps for block, steps in self.blocks().items() if self.due(steps) > now})
        yield from ()

    def close(self) -> None:
        pass


def rolling_blocks(stream: DataFrame, accumulation: int, batch_size: int, idle_seconds: int = 3600) -> DataFrame:
    """(block, loss) whenever a block is full and has changed, for update mode. Of a step that a resumed run wrote again, the record
    of the later file counts, as in the batch query. A block's state goes once the log is twice `idle_seconds` past its last record; a
    step that comes still later opens its block anew. The session needs STATE_STORE."""
    timed = stream.withWatermark("written", f"{idle_seconds} seconds").withColumn("at", F.unix_millis("written"))
    blocks = timed.withColumn("block", F.floor(F.col("batch_idx") / accumulation))
    groups = blocks.withColumn("blocks", F.floor(F.col("block") / GROUP)).groupBy("blocks")
    return groups.transformWithStateInPandas(BlockLosses(accumulation, batch_size, 1000 * idle_seconds), "block long, loss double", "Update", "EventTime")


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives every batch a folder batch={id} under `path`, whole or not at all. A batch that is run again
    after a failure finds its folder there, or finds none and writes it: each record is there once."""

    def write(batch: DataFrame, number: int) -> None:
        spark, target, draft = batch.sparkSession, f"{path}/batch={number}", f"{path}/_draft-{uuid.uuid4().hex}"
        if not exists(spark, target):
            batch.write.json(draft)
            moved(spark, draft, target)

    return write


def last_batches(rows: DataFrame, key: str) -> DataFrame:
    """Of rows that batch_writer wrote, the one of each key that the latest batch gave."""
    others = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def block_log(spark: SparkSession, log: str, out: str, state: str, accumulation: int, batch_size: int, files_per_trigger: int = 1000) -> DataFrame:
    """Runs the stream over all of the log that is there, from where `state` says it stopped, and reads each block's latest loss."""
    own = spark.newSession()
    own.conf.set(*STATE_STORE)
    blocks = rolling_blocks(batch_losses(own, log, files_per_trigger), accumulation, batch_size)
    query = blocks.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(batch_writer(out)).trigger(availableNow=True).start()
    query.awaitTermination()
    return last_batches(spark.read.schema("block long, loss double, batch long").json(out), "block")
