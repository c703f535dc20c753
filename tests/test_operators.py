import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from groundlane import logs
from groundlane.config import MergeSettings, RunSettings, check_split_size, parsed
from groundlane.functions.columns import half_even, list_repr
from groundlane.operators import boxes, curate, geometry, templates, tokens, training

ITEM = "item_id long, dataset string, split string, query string, answer array<string>, bbox array<array<double>>, image_path string"
BOX = [0.0005, 0.0015, 0.0025, 1.0]


def one(spark, column, schema="x int", row=(0,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def test_reject_reasons_name_the_first_fault_and_add_up(spark):
    rows = [
        (1, "d", "train", "q", ["a"], [BOX], "/x/a.png"), (2, "d", "train", "", ["a"], [], "/x/a.png"), (3, "d", "train", "q", ["a"], [], "/x/a.png"),
        (4, "d", "train", "q", None, [BOX], "/x/a.png"), (5, "d", "train", "q", ["a", "b"], [BOX], "/x/a.png"), (6, "d", "train", "q", ["a"], [BOX], "/x/b.png"),
        (7, "d", "train", None, ["a"], [BOX], "/x/a.png"), (8, "d", "train", " ", ["a"], [BOX], "/x/a.png"),
    ]
    listing = spark.createDataFrame([("/img/a.png",), ("/other/a.png",)], "path string")
    judged = curate.judged(spark.createDataFrame(rows, ITEM), listing)
    assert {r["item_id"]: r["reject_reason"] for r in judged.collect()} == {
        1: None, 2: "empty_query", 3: "empty_bbox", 4: "empty_answer", 5: "len_mismatch", 6: "missing_image", 7: "empty_query", 8: None,
    }
    stats = curate.filter_stats(judged).first()
    assert stats["total"] == stats["kept"] + sum(stats[r] for r in curate.REASONS) == 8


def test_split_keeps_images_apart_and_sizes_exact(spark):
    rows = spark.range(300).selectExpr("id AS item_id", "concat('d', id % 3) AS dataset", "concat('i', id % 31) AS image_key")
    out = curate.group_split(rows, 0.5).groupBy("dataset", "image_key").agg(F.count_distinct("chosen").alias("sides"), F.max("chosen").alias("chosen")).collect()
    assert all(r["sides"] == 1 for r in out)
    for d in ("d0", "d1", "d2"):
        mine = [r["chosen"] for r in out if r["dataset"] == d]
        assert sum(mine) == round(len(mine) * 0.5)
    assert curate.capped(rows, 7).groupBy("dataset").count().where("count <> 7").isEmpty()
    assert curate.sampled_groups(rows, 4).count() == 12
    for bad in (1.5, 0.0, -1, True):
        with pytest.raises(ValueError):
            check_split_size(bad)


def test_negatives_take_another_image_and_survive_one_image(spark):
    rows = spark.createDataFrame([(i, "d", "train", f"i{i % 4}") for i in range(40)] + [(99, "e", "train", "only")], "item_id long, dataset string, split string, image_key string")
    out = {r["item_id"]: r for r in curate.negatives(rows).collect()}
    assert len(out) == 41 and out[99]["swapped"] is None
    assert all(r["swapped"] and r["swapped"] != r["image_key"] for k, r in out.items() if k != 99)


def test_boxes(spark):
    assert one(spark, boxes.scaled(F.col("x"), 1000, 1000), "x array<double>", (BOX,)) == [round(c * 1000) for c in BOX]
    assert one(spark, boxes.scaled(F.col("x"), 10, 20), "x array<double>", ([0.5, 0.5, 1.0, 1.0],)) == [5, 10, 10, 20]
    assert one(spark, boxes.scaled(F.col("x"), 10, 20), "x array<double>", ([0.1, 0.2, 0.3],)) is None
    assert one(spark, boxes.text(F.array(*map(F.lit, (1, 2, 3, 4))))) == "<box> 1 2 3 4 </box>"
    joined = boxes.interleaved(F.array(F.lit("It's A."), F.lit("B")), F.array(F.lit("<box> 1 </box>"), F.lit("<box> 2 </box>")))
    assert one(spark, joined) == "It's A <box> 1 </box> .B <box> 2 </box>"
    assert one(spark, half_even(F.lit(0.5))) == 0 and one(spark, half_even(F.lit(2.5))) == 2 and one(spark, half_even(F.lit(1.5))) == 2


@pytest.mark.parametrize("items", [["It's", "B"], ["a\nb\\c", 'say "x"'], ["'\""], [], ["é"], ["\x00\x1b\x7f \x85\xa0\xad", "\\x00'\u200b\u2028", "\u3000\ue000 😀 \U000e0001ß"]])
def test_list_repr_is_pythons(spark, items):
    assert one(spark, list_repr(F.col("x")), "x array<string>", (items,)) == repr(items)


def test_templates_leave_braces_and_later_images_alone(spark):
    assert one(spark, templates.fill("Q: {query}\nA: {answer}", {"query": F.lit("what is {answer}?"), "answer": F.lit("{query}")})) == "Q: what is {answer}?\nA: {query}"
    assert one(spark, templates.with_image_tokens(F.lit("a <image> b <image>"), F.lit(2), 2)) == "a <img>" + "<IMG_CONTEXT>" * 4 + "</img> b <image>"
    assert one(spark, templates.with_image_tokens(F.lit("q"), F.lit(1), 1)) == "<img><IMG_CONTEXT></img>\nq"
    assert templates.catalog(spark).count() == 6
    shares = templates.assigned(spark.range(3000).withColumnRenamed("id", "item_id"), negative_share=0.2).groupBy("polarity").count().collect()
    assert abs({r["polarity"]: r["count"] for r in shares}["negative"] / 3000 - 0.2) < 0.04
    assert one(spark, templates.is_negative(F.lit("box|negative"))) and not one(spark, templates.is_negative(F.lit("neg|positive")))


#: Worked out with pencil: sides after scaling to 1024, cut to 28s, and what the pixel limits make of them.
RESIZED = [
    (640, 480, 3136, 10**7, [1008, 756]), (100, 3000, 3136, 10**7, [28, 1008]), (2000, 1900, 3136, 500_000, [700, 672]),
    (900, 30, 40_000, 10**7, [1204, 56]), (10_000, 100, 3136, 10**7, [None, None]),
]


@pytest.mark.parametrize(("w", "h", "lo", "hi", "want"), RESIZED)
def test_resize(spark, w, h, lo, hi, want):
    a, b = geometry.resized_28(F.col("w"), F.col("h"), F.lit(1024), lo, hi)
    got = spark.createDataFrame([(w, h)], "w int, h int").select(a.alias("a"), b.alias("b")).first()
    assert [got["a"], got["b"]] == want


def nearest_grid(w, h):
    """Of the grids whose exact ratio is nearest, the largest that the image fills by more than half, else the smallest."""
    ratio = lambda g: abs(Fraction(w, h) - Fraction(*g))
    least = min(map(ratio, geometry.grids()))
    near = sorted((g for g in geometry.grids() if ratio(g) == least), key=math.prod)
    return max((g for g in near if 2 * w * h > 448 * 448 * math.prod(g)), key=math.prod, default=near[0])


def test_grid_and_crops(spark):
    sizes = [(w, h) for w in (50, 300, 448, 633, 634, 896, 1500, 4000) for h in (50, 300, 448, 633, 634, 896, 1500, 4000)]
    rows = spark.createDataFrame(sizes, "w int, h int").withColumn("grid", geometry.tile_grid(F.col("w"), F.col("h")))
    assert all((r["grid"]["cols"], r["grid"]["rows"]) == nearest_grid(r["w"], r["h"]) for r in rows.collect())
    for (w, h), tiles in geometry.crops(rows).groupBy("w", "h").agg(F.collect_list(F.struct("tile", "x0", "y0", "x1", "y1")).alias("t")).rdd.map(lambda r: ((r["w"], r["h"]), r["t"])).collect():
        i, j = nearest_grid(w, h)
        placed = [t for t in tiles if t["x0"] is not None]
        assert len(placed) == i * j and len(tiles) == i * j + (i * j > 1)
        assert {(t["x0"], t["y0"]) for t in placed} == {(x * 448, y * 448) for x in range(i) for y in range(j)}


def test_tokens(spark):
    rows = tokens.batches(tokens.epoch_order(spark.range(1000).withColumnRenamed("id", "k"), 5, "k"), 10)
    assert sorted(r["rank"] for r in rows.collect()) == list(range(1, 1001))
    assert tokens.resumed(rows, 3, 10).count() == 970
    ids = F.array(*[F.lit(x).cast("bigint") for x in (5, 9, 7, 9)])
    assert one(spark, tokens.masked_to_marker(ids, F.lit(9).cast("bigint"))) == [-100, -100, 7, 9]
    with pytest.raises(Exception, match="no assistant marker"):
        one(spark, tokens.masked_to_marker(ids, F.lit(1).cast("bigint")))
    assert one(spark, tokens.masked_prefix(ids, F.lit(9))) == [-100] * 4
    batch = spark.createDataFrame([(0, [1, 2], [1, 1], [1, 2]), (0, [3], [1], [3])], "batch_id long, ids array<long>, attention array<int>, labels array<long>")
    out = sorted(tokens.padded(batch, 0).select("ids", "attention", "labels").collect())
    assert [tuple(map(list, r)) for r in out] == [([1, 2], [1, 1], [1, 2]), ([3, 0], [1, 0], [3, -100])]


def test_training(spark):
    log = spark.createDataFrame([(i, i, 1.0, i) for i in range(11)] + [(3, 3, 9.0, 99)], "global_step long, batch_idx long, loss double, line long")
    last = training.last_written(log)
    assert last.count() == 11 and last.where("global_step = 3").first()["loss"] == 9.0
    assert [tuple(r) for r in training.virtual_losses(last, 8, 4).collect()] == [(0, 4.0)]
    rows = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 10.0)], "batch_id long, loss double")
    assert training.validation_loss(rows).first()["val_loss"] == 6.0
    assert training.validation_loss(rows.limit(0)).first()["val_loss"] is None
    listing = spark.createDataFrame([("p_5",), ("p_40",), ("chkp_latest.pt",)], "path string")
    assert training.latest_checkpoint(listing).first()["path"] == "p_40"
    folder = [f"run/{x}" for n in (5, 40, 300) for x in (f"chkp_{n}.pt", f"peft_chkp_{n}")] + ["run/chkp_latest.pt", "run/peft_chkp_7", "run/notes.txt"]
    kept = {r["path"] for r in training.retention(spark.createDataFrame([(x,) for x in folder], "path string")).where("keep").collect()}
    assert kept == {"run/chkp_300.pt", "run/peft_chkp_300", "run/chkp_40.pt", "run/peft_chkp_40", "run/peft_chkp_7", "run/notes.txt"}
    half = one(spark, training.learning_rate(F.lit(55), 1.0, 10, 100))
    assert half == pytest.approx(0.5) and one(spark, training.learning_rate(F.lit(100), 1.0, 10, 100)) == pytest.approx(0.0)
    w = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [0.0, 0.0]), (1, 0, [5.0])], "layer int, i int, w array<double>")
    adapter = "layer int, k int, a array<double>, b array<double>"
    got = training.low_rank_merge(w, spark.createDataFrame([(0, 1, [0.0, 7.0], [1.0, 0.0]), (0, 0, [0.0, 10.0], [3.0, 2.0])], adapter), 0.5).collect()
    assert {(r["layer"], r["i"], *r["w"]) for r in got} == {(0, 0, 1.0, 2.0 + 0.5 * 37), (0, 1, 0.0, 10.0), (1, 0, 5.0)}
    for bad in (([0.0], [1.0, 0.0]), ([0.0, 7.0], [1.0])):
        with pytest.raises(Exception, match="doesn't fit"):
            training.low_rank_merge(w, spark.createDataFrame([(0, 0, *bad)], adapter), 0.5).collect()
    assert one(spark, training.family(F.lit("x/QWEN3-VL"))) == "qwen3"
    with pytest.raises(Exception, match="unsupported base model"):
        one(spark, training.family(F.lit("other")))
    assert not one(spark, training.mergeable(F.lit("a/Qwen2-VL-7B-Instruct")))
    assert one(spark, training.learning_rate(F.lit(0), 1.0, 10, 100)) == 0.0 and one(spark, training.learning_rate(F.lit(10), 1.0, 10, 100)) == 1.0


def test_settings(spark):
    good = dict(dataset_dir="d", base_model_name="m", output_dir="o", batch_size=4, gradient_accumulation=8, dataloader_seed=117, epochs=1, lr=1e-4, num_warmup_steps=25, num_save_steps=50, image_max_pixel_count=14_000_000)
    assert RunSettings(**good, inert={"max_tokens": 4500}).lora_r == 16
    for bad in ({"batch_size": 0}, {"lora_bias": "some"}, {"inert": {"other": 1}}):
        with pytest.raises(ValueError):
            RunSettings(**(good | bad))
    line = [x for k, v in good.items() for x in (f"--{k}", str(v))]
    run = parsed(RunSettings, [*line, "--use_peft", "--max_tokens", "4500", "--lora_target_modules", "q_proj", "v_proj"])
    assert run == RunSettings(**good, use_peft=True, lora_target_modules=("q_proj", "v_proj"), inert={"max_tokens": "4500"})
    assert parsed(MergeSettings, ["--base_model", "b", "--adapter_path", "a", "--output_model_path", "o"]) == MergeSettings("b", "a", "o")
    for bad in (line[2:], [*line, "--other", "1"]):
        with pytest.raises(SystemExit):
            parsed(RunSettings, bad)
    rows = spark.range(50).withColumnRenamed("id", "k")
    assert sorted(r["rank"] for r in tokens.epoch(rows, run, "k", global_step=3).collect()) == list(range(13, 51))


def test_log_goes_to_file_and_console(tmp_path, capsys):
    import logging

    before = logging.getLogger().handlers[:], logging.getLogger().level
    try:
        log = logs.to_file_and_console(str(tmp_path / "a" / "run.log"), "warning")
        log.info("unseen")
        log.warning("seen")
        assert "WARNING - seen" in (tmp_path / "a" / "run.log").read_text() and "unseen" not in (tmp_path / "a" / "run.log").read_text()
        assert logs.to_file_and_console(str(tmp_path / "a" / "run.log"), "odd").level == logging.INFO
    finally:
        logging.getLogger().handlers[:], logging.getLogger().level = before


def test_split_guards(spark):
    some, none = spark.range(1), spark.range(0)
    with pytest.raises(ValueError):
        curate.checked_splits(none, some)
    with pytest.warns(UserWarning):
        curate.checked_splits(some, none)
    assert boxes.with_box_text(spark.sql("SELECT array(1, 2, 3, 4) AS box")).first()["box_str"] == "<box> 1 2 3 4 </box>"


def test_the_first_by_hash_are_the_first_of_a_full_ranking(spark):
    rows = spark.range(700).selectExpr("concat('d', id % 5) AS dataset", "concat('i', id % 311) AS image_key").union(spark.sql("SELECT 'one', 'i'")).distinct()
    order = lambda: F.md5(F.concat(F.lit("7|"), "image_key"))
    ranked = tokens.rank_within(rows, ["dataset"], order(), "image_key", size="n").collect()
    for wanted, count in ((lambda n: F.lit(0), lambda n: 0), (lambda n: F.lit(1), lambda n: 1), (lambda n: n, lambda n: n), (lambda n: F.floor(n / 3), lambda n: n // 3)):
        got = tokens.first_by_hash(rows, ["dataset"], order(), "image_key", wanted, digits=2)
        assert sorted(map(tuple, got.collect())) == sorted((r["dataset"], r["image_key"]) for r in ranked if r["rank"] <= count(r["n"]))
