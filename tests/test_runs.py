"""Runs from flags to files: prepared shards, resumed from a checkpoint, and merged weights."""

import json

import pytest

from groundlane import runs
from groundlane.config import MergeSettings, RunSettings, parsed
from groundlane.operators import tokens
from groundlane.sources import checkpoints, shards

BOX = [0.1, 0.2, 0.3, 1.0]


def folder(root, datasets=("one", "two"), n=30):
    for d in datasets:
        for split, count in (("train", n), *((("val", 6),) if d == "one" else ())):
            (root / d / split / "json").mkdir(parents=True)
            (root / d / split / "img").mkdir()
            for k in range(count):
                if k % 10:
                    (root / d / split / "img" / f"{k}.png").write_bytes(b"x")
                rows = [{"query": f"{d} {split} {k} {j}", "answer": ["A."], "bbox": [BOX], "image_path": f"/old/{k}.png"} for j in range(2)] + [{"query": "", "answer": [], "bbox": [], "image_path": "x"}]
                (root / d / split / "json" / f"{k}.json").write_text(json.dumps({"items": rows}))


def flags(root, out, *more):
    return ["--dataset_dir", f"file://{root}", "--output_dir", f"file://{out}", "--base_model_name", "Qwen3-VL-8B-Instruct", "--batch_size", "4", "--gradient_accumulation", "2", "--dataloader_seed", "117",
            "--epochs", "1", "--lr", "1e-4", "--num_warmup_steps", "25", "--num_save_steps", "5", "--image_max_pixel_count", "14000000", *more]


def test_prepare_and_resume(spark, tmp_path):
    folder(tmp_path / "data")
    settings = parsed(RunSettings, flags(tmp_path / "data", tmp_path / "out", "--restore_checkpoint"))
    found = runs.prepare(spark, settings)
    out = f"file://{tmp_path}/out"
    stats = {(r["dataset"], r["split"]): r for r in spark.read.json(f"{out}/filter_stats").collect()}
    assert stats["one", "train"]["total"] == 90 and stats["one", "train"]["missing_image"] == 6 and stats["one", "train"]["kept"] == 54 and stats["one", "val"]["kept"] == 10
    # `one` keeps its train rows and has validation rows of its own; a fifth of the images of `two` goes to validation.
    rows = shards.read_shards(spark, f"{out}/train-0").collect()
    assert found == {"n_train": len(rows), "n_validation": 10 + 2 * 5, "global_step": 0, "n_batches": -(-len(rows) // 4), "n_steps": len(rows) // 4 // 2} and len(rows) == 54 + 2 * 22
    assert sorted(r["rank"] for r in rows) == [*range(1, len(rows) + 1)]
    schedule = {r["step"]: r for r in spark.read.parquet(f"{out}/schedule").collect()}
    assert len(schedule) == len(rows) // 8 + 1 and schedule[5]["lr"] == pytest.approx(5 / 25 * 1e-4) and [s for s in sorted(schedule) if schedule[s]["saves"]] == [5, 10]
    images = lambda rs: {(r["dataset"], r["image_path"]) for r in rs}
    assert not images(rows) & images(spark.read.parquet(f"{out}/validation").collect())
    checkpoints.publish(f"{out}/checkpoints", 10, checkpoints.trainer_state(spark, settings, 10, 5, 0.5))
    again = runs.prepare(spark, settings)
    assert again["global_step"] == 10 and again["n_train"] == len(rows) - 40
    left = {(r["rank"], r["item_id"]) for r in shards.read_shards(spark, f"{out}/train-10").collect()}
    assert left == {(r["rank"], r["item_id"]) for r in rows if r["rank"] > 40} == {(r["rank"], r["item_id"]) for r in shards.read_shards(spark, f"{out}/train-0", 10, 4).collect()}
    with pytest.raises(FileExistsError):
        runs.prepare(spark, settings)


def test_a_broken_file_or_an_unknown_model_ends_the_run(spark, tmp_path):
    folder(tmp_path / "data", ("two",), 12)
    with pytest.raises(ValueError, match="unsupported base model"):
        runs.prepare(spark, parsed(RunSettings, [x.replace("Qwen3-VL-8B-Instruct", "other") for x in flags(tmp_path / "data", tmp_path / "out")]))
    (tmp_path / "data" / "two" / "train" / "json" / "3.json").write_text('{"items": [')
    with pytest.raises(Exception, match="3.json: malformed"):
        runs.prepare(spark, parsed(RunSettings, flags(tmp_path / "data", tmp_path / "out")))


def test_merge_by_flags(spark, tmp_path):
    base, adapter = f"file://{tmp_path}/Qwen3-VL-8B-Instruct", f"file://{tmp_path}/adapter"
    spark.createDataFrame([("q", 0, [1.0, 0.0]), ("q", 1, [0.0, 1.0]), ("v", 0, [3.0])], "layer string, i int, w array<double>").write.parquet(base)
    runs.save_adapter(spark.createDataFrame([("q", 0, [1.0, 2.0], [1.0, -1.0])], "layer string, k int, a array<double>, b array<double>"), adapter, r=16, lora_alpha=32.0)
    runs.merge(spark, parsed(MergeSettings, ["--base_model", base, "--adapter_path", adapter, "--output_model_path", f"file://{tmp_path}/merged"]))
    got = {(r["layer"], r["i"]): r["w"] for r in spark.read.parquet(f"file://{tmp_path}/merged").collect()}
    assert got == {("q", 0): [3.0, 4.0], ("q", 1): [-2.0, -3.0], ("v", 0): [3.0]}
    with pytest.raises(ValueError, match="unsupported base model"):
        runs.merge(spark, MergeSettings(adapter, adapter, f"{adapter}-2"))


def test_shards_are_ranges_of_ranks(spark, tmp_path):
    path = f"file://{tmp_path}/epoch"
    ranked = tokens.epoch_order(spark.range(1000), 117, "id")
    files = sorted((r["first"], r["last"], r["n_rows"]) for r in shards.write_shards(ranked, path, rows_per_shard=100).collect())
    assert len(files) > 5 and files[0][0] == 1 and files[-1][1] == 1000 and all(a[1] + 1 == b[0] for a, b in zip(files[:-1], files[1:], strict=True))
    left = shards.read_shards(spark, path, 90, 10)
    assert sorted(r["rank"] for r in left.collect()) == [*range(901, 1001)] and len(left.inputFiles()) < len(files) / 2
    assert shards.read_shards(spark, path, 100, 10).count() == 0
    assert shards.write_shards(ranked.limit(0), f"{path}-none").count() == 0 and shards.read_shards(spark, f"{path}-none").count() == 0
