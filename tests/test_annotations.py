"""Strict reading of annotation files: what is wrong with files and items, and that absent, null and empty stay apart."""

import json

import pytest
from pyspark.sql import functions as F

from groundlane.operators import curate
from groundlane.sources import annotations, items

BOX = [0.1, 0.2, 0.3, 1.0]
GOOD = {"query": "q", "answer": ["A."], "bbox": [BOX], "image_path": "/old/a.png"}


def write(root, dataset, split, name, text):
    folder = root / dataset / split / "json"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text(text if isinstance(text, str) else json.dumps(text, indent=2))


def strict(spark, root, has_image=True):
    rows = annotations.typed(annotations.file_items(annotations.annotation_files(spark, f"file://{root}")))
    return {r["place"]: r for r in rows.withColumn("reason", annotations.strict_reason(F.lit(has_image))).collect()}


CASES = [
    (GOOD, None, None, 0),
    ({k: v for k, v in GOOD.items() if k != "query"}, "absent", "empty_query", 0),
    (GOOD | {"query": None}, "null", None, 0),
    (GOOD | {"query": ""}, "string", "empty_query", 0),
    (GOOD | {"query": " "}, "string", None, 0),
    (GOOD | {"query": 7}, "bigint", None, 0),
    (GOOD | {"query": "", "bbox": []}, "string", "empty_query", 0),
    (GOOD | {"bbox": None}, "string", "empty_bbox", 0),
    (GOOD | {"bbox": 0}, "string", "empty_bbox", 0),
    (GOOD | {"answer": []}, "string", "empty_answer", 0),
    (GOOD | {"answer": ""}, "string", "empty_answer", 0),
    (GOOD | {"answer": {}}, "string", "empty_answer", 0),
    (GOOD | {"answer": False}, "string", "empty_answer", 0),
    (GOOD | {"answer": ["a", "b"]}, "string", "len_mismatch", 0),
    (GOOD | {"answer": "x"}, "string", None, 0),  # one character for one box
    (GOOD | {"answer": "xyz"}, "string", "len_mismatch", 0),
    (GOOD | {"bbox": [[0, 0, 1, 1]]}, "string", None, 1),
    (GOOD | {"bbox": [[0.1, 0.2, 0.3]]}, "string", None, 1),
    (GOOD | {"bbox": [["a"] * 4, None, BOX], "answer": ["a", "b", "c"]}, "string", None, 2),
    (GOOD | {"bbox": [[1.0, 0.0, 1e-7, 2.5e300]]}, "string", None, 0),
]


def test_rules_of_strict_items(spark, tmp_path):
    write(tmp_path, "set", "train", "all", {"items": [c[0] for c in CASES], "more": {"x": 1}})
    got = strict(spark, tmp_path)
    for k, (item, kind, reason, bad) in enumerate(CASES):
        assert (got[k]["query_kind"], got[k]["reason"], got[k]["n_bad_boxes"]) == (kind or "string", reason, bad), item
        assert got[k]["item_fault"] is None
    assert {r["reason"] for r in strict(spark, tmp_path, has_image=False).values() if r["reason"] == "missing_image"}


def test_faults_of_items(spark, tmp_path):
    rows = [GOOD | {"bbox": 3}, GOOD | {"answer": True}, {k: v for k, v in GOOD.items() if k != "image_path"}, GOOD | {"image_path": None}, GOOD | {"image_path": 4}, "text", None, [GOOD], GOOD]
    write(tmp_path, "set", "val", "a", {"items": rows})
    got = strict(spark, tmp_path)
    assert [got[k]["item_fault"] for k in range(len(rows))] == ["no_length", "no_length", *["no_image_path"] * 3, *["no_object"] * 3, None]


def test_faulty_files_are_named_or_end_the_job(spark, tmp_path):
    for name, text in {"good": {"items": [GOOD]}, "half": '{"items": [', "blank": "", "other": {"rows": []}, "null": {"items": None}, "text": {"items": "x"}, "twice": '{"items": [], "items": []}', "none": {"items": []}}.items():
        write(tmp_path, "set a+b", "train", name, text)
    files = annotations.annotation_files(spark, f"file://{tmp_path}")
    got = {r["file"].rpartition("/")[2]: r["fault"] for r in annotations.rejected_files(files).collect()}
    assert got == {"half.json": "malformed", "blank.json": "malformed", "twice.json": "malformed", "other.json": "no_items", "null.json": "no_items", "text.json": "no_items"}
    assert [r["dataset"] for r in annotations.file_items(files, "skip").collect()] == ["set a+b"]
    with pytest.raises(Exception, match=r"annotation file .*\.json: (malformed|no_items)"):
        annotations.file_items(files).collect()
    with pytest.raises(Exception, match="annotation file"):
        items.read_items(spark, f"file://{tmp_path}").collect()
    assert items.read_items(spark, f"file://{tmp_path}", on_fault="skip").count() == 1
    with pytest.raises(ValueError):
        annotations.file_items(files, "pass")
    with pytest.raises(FileNotFoundError):
        annotations.annotation_files(spark, f"file://{tmp_path}", ("test",))


def test_loose_and_strict_reading_differ_where_they_should(spark, tmp_path):
    write(tmp_path, "set", "train", "a", {"items": [GOOD | {"query": None}, GOOD]})
    listing = spark.createDataFrame([("/img/a.png",)], "path string")
    rows = annotations.typed(annotations.file_items(annotations.annotation_files(spark, f"file://{tmp_path}")))
    assert curate.judged(rows, listing, annotations.strict_reason).where("reject_reason IS NULL").count() == 2
    assert curate.kept(items.read_items(spark, f"file://{tmp_path}"), listing).count() == 1


def test_files_are_listed_by_folders(spark, tmp_path):
    """Before, Spark listed each file by a task of its own, and the driver asked for the length of each."""
    for k in range(40):
        write(tmp_path, "a{b}[c]", "train", f"f{k}", {"items": [GOOD]} if k else "")
        write(tmp_path, "other", "val", f"f{k}", {"items": [GOOD]})
    write(tmp_path, "other", "val/json/below", "no", {"items": [GOOD]})
    (tmp_path / "other" / "val" / "json" / "no.txt").write_text("{")
    part = tmp_path / "dataset=p" / "split=val"
    part.mkdir(parents=True)
    (part / "x.txt").write_text(json.dumps({"items": [GOOD, GOOD]}))
    (part / "none.txt").write_text("")
    tracker, jobs = spark.sparkContext.statusTracker(), []
    spark.sparkContext.setJobGroup("listing", "listing")
    files = annotations.annotation_files(spark, f"file://{tmp_path}")
    jobs = tracker.getJobIdsForGroup("listing")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs
    got = {(r["dataset"], r["split"], r["fault"]): r["n"] for r in files.groupBy("dataset", "split", "fault").agg(F.count("*").alias("n")).collect()}
    assert got == {("a{b}[c]", "train", None): 39, ("a{b}[c]", "train", "malformed"): 1, ("other", "val", None): 40, ("p", "val", None): 1, ("p", "val", "malformed"): 1}
    assert annotations.file_items(files, "skip").count() == 81
