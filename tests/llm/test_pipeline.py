"""The pipeline, stage by stage and as a whole, against plain versions on a small corpus with every edge case."""

import random

import pytest

from groundlane.llm import quality, toxicity

from .test_edges import alnum, shingle_set
from .test_methods import classes

pipeline = pytest.importorskip("corpus_pipeline")
ITEM = " ".join(f"item{i}" for i in range(20))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, node long, _bad long, text_hash long"


def corpus():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ala", "ero", "ino", "ous", "ule")]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    first = prose(120)
    texts = [prose(rng.randint(30, 90)) for _ in range(30)]
    texts += [first, first, first.upper(), first.replace(first.split()[60], "changed", 1), f"{prose(40)} {ITEM} {prose(10)}", None, "", " \n", "few words only", "same line again and more\n" * 40]
    texts += [f"{prose(40)} vileword{'xyz'[i % 3]} {prose(20)}" for i in range(24)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, i, 1, 2, 3) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[30], (None, first, None, None, None, None, None, None, None), (3, prose(50), None, "s", 1, 1, 1, 1, 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out, rows = str(tmp_path_factory.mktemp("corpus")), corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    toxic = [(r[0], 1, int("vileword" in (r[1] or ""))) for r in rows[:64] if r[0] is not None and r[0] % 5]
    spark.createDataFrame([*toxic, (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (None, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def kept(rows, step, labels=None):
    """What a plain version of a stage keeps of rows (doc_id, text)."""
    if step == "quality":
        def bad(t):
            n, chars, symbols, lines, same, repeated = quality.measure_text(t)
            return n < 20 or 100 * repeated > 30 * n or symbols > 2 * n or (2 * same > lines and same >= 10) or (n and chars > 100 * n)

        return [r for r in rows if not bad(r[1])]
    if step == "toxicity":
        return [r for r in rows if "vileword" not in (r[1] or "")]
    if step == "decontamination":
        item = alnum(ITEM)
        windows = {tuple(item[i : i + 13]) for i in range(8)}

        def bad(t):
            w = alnum(t)
            hit = {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for j in range(i, i + 13)}
            return hit and 20 * len(hit) >= len(w)

        return [r for r in rows if not bad(r[1])]
    named = sorted({r for r in rows if r[0] is not None})
    sets = [shingle_set(t) for _, t in named]
    links = [(i, k) for k in range(len(named)) for i in range(k) if sets[i] and sets[k] and 100 * len(sets[i] & sets[k]) >= 80 * len(sets[i] | sets[k])]
    group = classes(links, range(len(named)))
    return [r for i, r in enumerate(named) if group[i] == i] + [r for r in rows if r[0] is None]


def test_stages_are_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
        rows = kept(rows, name)
        assert docs.columns == columns
        assert sorted(map(str, [(r["doc_id"], r["text"]) for r in docs.collect()])) == sorted(map(str, rows)), name
    pieces = pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    assert len(rows) > 25 and set(pieces.doc_id.dropna()) == {d for d, _ in rows if d is not None}
    whole = pipeline.run(spark, folder).toPandas()
    assert len(whole) and whole.length.sum() == pieces.length.sum() and set(whole.doc_id.dropna()) == set(pieces.doc_id.dropna())


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_without_labels_and_benchmark_clean_documents_stay(spark, folder, tmp_path):
    for name, schema in (("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert stages["toxicity"](spark, docs, str(tmp_path)).count() == stages["decontamination"](spark, docs, str(tmp_path)).count() == docs.count()


def test_graded_labels_give_as_many_thresholds(spark):
    rows = [(i, " ".join(["plain", "words", "here", f"u{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}", *["mildly"] * (i % 3 == 1), *["grossly"] * (i % 3 == 2)])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 3) for i, _ in rows], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["severity"] for r in toxicity.graded(docs, model).collect()}
    assert len(model.thresholds) == 2 and max(got[i] for i in got if i % 3 == 0) < min(got[i] for i in got if i % 3 == 1) <= max(got[i] for i in got if i % 3 == 1) < min(got[i] for i in got if i % 3 == 2)
