import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundlane.operators import curate, tokens, training
from groundlane.sources import items
from groundlane.streaming import metrics


def test_nested_files_to_items(spark, tmp_path):
    for split, names in (("train", ("a", "b")), ("val", ("c",)), ("test", ("x",))):
        folder = tmp_path / "set1" / split
        (folder / "json").mkdir(parents=True)
        (folder / "img").mkdir()
        for n in names:
            (folder / "img" / f"{n}.png").write_bytes(b"png")
            doc = {"items": [{"query": "q", "answer": ["x."], "bbox": [[0, 0, 1, 1]], "image_path": f"/old/{n}.png", "more": 1}, {"answer": [], "bbox": [], "image_path": "/old/none.png"}], "other": {}}
            (folder / "json" / f"{n}.json").write_text(json.dumps(doc, indent=1))
    rows = items.rebase(items.read_items(spark, f"file://{tmp_path}"), "/data")
    got = sorted((r["dataset"], r["split"], r["query"], r["image_path"]) for r in rows.where("query IS NOT NULL").collect())
    assert got == [("set1", "train", "q", "/data/set1/train/img/a.png"), ("set1", "train", "q", "/data/set1/train/img/b.png"), ("set1", "val", "q", "/data/set1/val/img/c.png")]
    listing = items.image_listing(spark, f"file://{tmp_path}")
    assert curate.kept(rows, listing).count() == 3
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString()


def test_metrics_log_and_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    log = spark.range(20).selectExpr("'batch_loss' AS type", "id AS global_step", "CAST(NULL AS BIGINT) AS virtual_batch_counter", "id AS batch_idx", "1.0D AS loss")
    items.append_metrics(log, path)
    items.append_metrics(log.where("global_step >= 16"), path)
    assert items.read_metrics(spark, path).count() == 24
    out, state = str(tmp_path / "blocks"), str(tmp_path / "state")

    def run():
        return sorted(map(tuple, metrics.block_log(spark, path, out, state, 8, 4).collect()))

    assert run() == [(0, 2.0), (1, 2.0)]
    items.append_metrics(log.where("global_step IN (8, 9)").withColumn("loss", F.lit(5.0)), path)  # a resumed run writes steps again
    assert run() == [(0, 2.0), (1, 4.0)]
    assert run() == [(0, 2.0), (1, 4.0)]
    batch = training.last_written(items.read_metrics(spark, path).withColumn("line", F.col("loss")))
    assert sorted(map(tuple, training.virtual_losses(batch, 8, 4).collect())) == [(0, 2.0), (1, 4.0)]


class Store:
    """A group's state and timers, and how often they are called."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {
                "getValueState": lambda *_: self, "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v),
                "clear": lambda: setattr(self, "value", None), "listTimers": lambda: list(self.timers), "deleteTimer": self.timers.discard, "registerTimer": self.timers.add,
                "getCurrentWatermarkInMs": lambda: max(self.timers, default=0), "getExpiryTimeInMs": lambda: max(self.timers, default=0),
            }[name](*args)

        return call


def test_blocks_of_a_group_share_state_and_go_one_by_one():
    """Before, each block had calls of its own: six of the state store for eight records."""
    store, blocks = Store(), metrics.BlockLosses(2, 4, idle_ms=10)
    blocks.init(store)
    frame = lambda rows: iter([pd.DataFrame(rows, columns=["block", "global_step", "at", "loss"])])
    took = lambda rows: sorted(x for f in blocks.handleInputRows((0,), frame(rows), store) for x in f.itertuples(index=False, name=None))
    before = store.calls
    rows = [(b, s, b, 2.0) for b in range(metrics.GROUP) for s in (2 * b, 2 * b + 1)]
    assert took(rows) == [(b, 1.0) for b in range(metrics.GROUP)] and store.calls - before < 9
    assert store.timers == {20} and took(rows) == []  # nothing has changed
    assert took([(0, 0, 500, 6.0), (1, 2, 0, 9.0)]) == [(0, 2.0)]  # an older record counts no more
    assert store.timers == {21}
    list(blocks.handleExpiredTimer((0,), store, store))
    assert sorted(blocks.blocks())[:2] == [0, 2] and store.timers == {22}
    store.timers = {400}
    list(blocks.handleExpiredTimer((0,), store, store))
    assert blocks.blocks() == {0: {0: (500, 6.0), 1: (0, 2.0)}} and store.timers == {520}
    list(blocks.handleExpiredTimer((0,), store, store))
    assert store.value is None and not store.timers
    assert took([(1, 2, 900, 1.0)]) == [] and store.timers == {920}


def test_a_batch_run_again_writes_its_records_once(spark, tmp_path, monkeypatch):
    out = f"file://{tmp_path}/out"
    write, rows = metrics.batch_writer(out), spark.range(5).selectExpr("id AS block", "1.0D AS loss")
    with monkeypatch.context() as m:
        m.setattr(metrics, "moved", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            write(rows, 0)
    read = lambda: spark.read.schema("block long, loss double, batch long").json(out)
    write(rows, 0)
    write(rows, 0)
    write(rows.where("block = 3").withColumn("loss", F.lit(2.0)), 1)
    assert read().count() == 6
    assert sorted(map(tuple, metrics.last_batches(read(), "block").collect())) == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 2.0), (4, 1.0)]


def test_running_sums_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 500) * (i % 3) if i % 50 else None, i, rng.randint(-3, 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "x long, t long, v long").repartition(5)
    total, want = 0, {}
    for x, t, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        want[t] = total = total + v
    out = tokens.running_sum(df, "x", F.col("v"), "total", ranges=9, ties="t")
    assert {r["t"]: r["total"] for r in out.collect()} == want and out.columns == ["x", "t", "v", "total"]
    assert tokens.running_sum(df.limit(0), "x", F.col("v"), "total").count() == 0
    steps = training.virtual_steps(spark.createDataFrame([(i,) for i in (0, 7, 8, 15, 23, 24)], "batch_idx long"), 8, start=10)
    assert [(r["batch_idx"], r["virtual_batch_counter"]) for r in steps.where("stepped").orderBy("batch_idx").collect()] == [(7, 11), (15, 12), (23, 13)]
