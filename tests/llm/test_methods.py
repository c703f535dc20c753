"""The operators' methods against plain versions: gradients, whole predictions, dictionaries, spans, crowded families."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from groundlane.llm import decontam, files, langid, neardup, quality, tokenbin, toxicity, warc
from groundlane.llm.base import shared_dir
from groundlane.llm.queries import tokenizer

from .test_edges import SCHEMA, TEXTS, alnum, docs, shingle_set  # noqa: F401


def classes(pairs, nodes):
    root = {d: d for d in nodes}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {d: find(d) for d in nodes}


@pytest.mark.parametrize("percent", [85, 80])
def test_a_crowded_family_loses_no_link(spark, percent):
    """Texts of 60 words with two edits each and no common original: most are nearly similar, few are similar."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(60), 2):
            words[at] = f"e{rng.randrange(12)}x{at}"
        texts.append(" ".join(words))
    sets = [shingle_set(t) for t in texts]
    links = [(i, k) for k in range(300) for i in range(k) if 100 * len(sets[i] & sets[k]) >= percent * len(sets[i] | sets[k])]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent).collect()
    assert links and {r["doc_id"]: r["component_id"] for r in got} == classes(links, range(300))


def test_near_duplicates_keep_rows_of_repeated_ids_and_clashing_names(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    rows = [(1, a, 9), (1, b, 9), (1, b, 9), (2, b.upper(), 9), (3, a, 9), (None, a, 9), (4, "", 9), (4, " ", 9), (4, "", 9), (5, None, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node long").selectExpr("*", "node AS row", "node AS text_hash", "node AS gone", "node AS component")
    left = neardup.filtered(frame)
    assert left.columns == frame.columns
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in left.collect()])) == sorted(map(str, [(1, a), (1, b), (None, a), (4, ""), (4, " "), (5, None)]))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame).collect()} == {(1, 4, 1), (1, 5, 1), (2, 5, 1), (3, 4, 1), (None, 4, None), (4, 0, 4), (5, 0, 5)}


def test_band_keys_are_the_definition():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 60, 400):
        hashes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        least = {}
        for h in sorted(hashes.tolist(), reverse=True):
            least[h >> 57] = h
        values = []
        for k in range(neardup.BINS):
            if k in least:
                values.append(least[k])
                continue
            reached = [p for p in neardup.PROBES[k] if p in least]
            source = reached[0] if reached else sorted(least)[k % len(least)]
            values.append(int(neardup.mixed(np.array([least[source]], np.uint64))[0]))
        want = []
        for band in range(neardup.BANDS):
            key = np.array([band], np.uint64)
            for v in values[4 * band : 4 * band + 4]:
                key = neardup.mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(v))
            want.append(int(key[0]))
        assert neardup.band_keys(hashes).tolist() == want


def test_spans_are_cut_out(spark, docs):  # noqa: F811
    item = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(1, item), (2, "short item here")], "item_id long, text string")
    more = spark.createDataFrame([(50, f"Before, it! {item}; AND (then) {item.upper()} the Rest.", "en", "s", 1, 2, 3), (51, "Short, item\nhere", "en", "s", 1, 2, 3)], SCHEMA)
    whole = docs.union(more).withColumnRenamed("hash", "_hash").withColumnRenamed("node", "_t").withColumnRenamed("n_words", "row")
    out = decontam.without_spans(whole, bench)
    assert out.columns == whole.columns and out.count() == whole.count()
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[50] == "Before, it; AND (then the Rest." and got[51] == "" and got[0] is None and got[5] == TEXTS[5]
    assert decontam.contamination(out, bench).where("n_hit > 0").isEmpty()
    assert decontam.filtered(whole, bench).columns == whole.columns


def test_runs_of_hits_are_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(60)]
    items = {i: " ".join(rng.choices("abc", k=rng.choice([2, 3, 5, 14]))) for i in range(8)}
    sizes = {i: min(13, len(t.split())) for i, t in items.items()}
    windows = {i: {tuple(t.split()[k : k + sizes[i]]) for k in range(len(t.split()) - sizes[i] + 1)} for i, t in items.items()}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    for d, t in enumerate(texts):
        w = t.split()
        hit = {j for i, ws in windows.items() for k in range(len(w) - sizes[i] + 1) if tuple(w[k : k + sizes[i]]) in ws for j in range(k, k + sizes[i])}
        spans = [(s["first_word"], s["n_words"]) for s in got[d]["spans"]]
        assert got[d]["n_hit"] == len(hit) and {j for a, n in spans for j in range(a, a + n)} == hit and spans == sorted(spans)


@pytest.mark.parametrize("n_grades", [2, 3, 4])
def test_ordinal_fit_is_the_maximum_of_the_likelihood(n_grades):
    """The penalised log-likelihood, written out anew, falls in every direction from the fit."""
    rng = np.random.default_rng(n_grades)
    dense = rng.poisson(1.0, (300, 4)).astype(float)
    grades = np.clip((dense @ [1.0, -0.5, 0.8, 0.0] + rng.logistic(size=300)).astype(int), 0, n_grades - 1)
    rows = [[(j, v) for j, v in enumerate(x) if v] for x in dense.tolist()]
    w, theta = toxicity.fit_ordinal(rows, grades, 4, n_grades, steps=4000, l2=0.01)
    assert len(theta) == n_grades - 1 and (np.diff(theta) > 0).all()

    def loss(w, theta):
        total = 0.005 * sum(x * x for x in w)
        for x, g in zip(dense, grades, strict=True):
            above = [1.0, *(1 / (1 + math.exp(t - x @ w)) for t in theta), 0.0]
            total -= math.log(above[g] - above[g + 1]) / len(grades)
        return total

    best = loss(w, theta)
    for k in range(4 + len(theta)):
        for step in (-0.05, 0.05):
            p = np.concatenate([w, theta])
            p[k] += step
            assert loss(p[:4], p[4:]) > best


def test_expected_severity_is_the_sum_over_thresholds():
    model = toxicity.Model({"bad": 1.5, "awfu*": 0.7}, [0.2, 1.0])
    text = "Bad bad awful day"
    z = 1.5 * math.log1p(2) + 0.7 * math.log1p(1)
    assert model.scorer()(text) == pytest.approx(sum(1 / (1 + math.exp(t - z)) for t in (0.2, 1.0)))
    assert model.scorer()(None) == 0 and model.scorer()("") == 0


def test_words_are_letters_and_marks():
    assert langid.words_of("Été 12 ½ ② ² Ⅷ _x_ हिन्दी ไทย don't") == ["été", "x", "हिन्दी", "ไทย", "don", "t"]
    assert langid.words_of("Straße ²³ ½ naïve ª") == ["straße", "naïve", "ª"]


def test_language_prediction_is_brute_force(spark):
    train = {"en": "the house and the tree are here in town", "de": "das haus und der baum sind hier im dorf", "ru": "дом и дерево стоят здесь", "hi": "यह घर और पेड़ यहाँ है"}
    frame = spark.createDataFrame([(i, t, lang, "s", 1, 2, 3) for i in range(40) for lang, t in train.items()], SCHEMA)
    model = langid.fit(frame)
    assert model.langs == sorted(train)
    n = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))  # documents that teach
    counts = {lang: {w: c * n for w, c in Counter(langid.words_of(t)).items()} for lang, t in train.items()}
    for k, lang in enumerate(model.langs):
        assert {w: model.counts[i, k] for w, i in model.words.items() if model.counts[i, k]} == counts[lang]
    three, two = {lang: Counter() for lang in train}, {lang: Counter() for lang in train}
    for lang, known in counts.items():
        for w, c in known.items():
            x = f"^^{w}$"
            for i in range(len(x) - 2):
                three[lang][x[i : i + 3]] += c
                two[lang][x[i : i + 2]] += c
    alphabet = {"en": "latin", "de": "latin", "ru": "cyrillic", "hi": "devanagari"}

    def plain_score(word):
        own = langid.NAMES[langid.script([word])[0]]
        out = []
        for lang in model.langs:
            x = f"^^{word}$"
            spelt = math.prod((three[lang][x[i : i + 3]] + 0.1) / (two[lang][x[i : i + 2]] + 4) for i in range(len(x) - 2))
            out.append(math.log((counts[lang].get(word, 0) + 20 * spelt) / (sum(counts[lang].values()) + 20)))
        able = [alphabet[lang] == own for lang in model.langs]
        if any(able):
            out = [v if ok else max(out) - 30 for v, ok in zip(out, able, strict=True)]
        total = math.log(sum(math.exp(v - max(out)) for v in out)) + max(out)
        return [max(v - total, -8.0) for v in out]

    tests = ["the haus and der tree", "дом house", "यह tree है और", "½ ② ²", None, "xyz qqq", "the " * 70 + "дом " * 80]
    got = langid.identified(spark.createDataFrame([(1000 + i, t, None, None, 1, 2, 3) for i, t in enumerate(tests)], SCHEMA), model).collect()
    for r, t in zip(sorted(got), tests, strict=True):
        words = langid.words_of(t or "")
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        scores = np.array([plain_score(w) for w in words])
        assert model.scores(words) == pytest.approx(scores, abs=1e-6)
        best, back = scores[0].copy(), []
        for s in scores[1:]:
            back.append([j if best[j] >= best.max() - langid.PENALTY else int(best.argmax()) for j in range(len(model.langs))])
            best = np.maximum(best, best.max() - langid.PENALTY) + s
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(b[path[-1]])
        letters = Counter()
        for w, k in zip(words, path[::-1], strict=True):
            letters[k] += len(w)
        top = max(letters.values())
        assert model.langs.index(r["lang_pred"]) in {k for k, v in letters.items() if v == top} and r["score"] == pytest.approx(top / sum(letters.values()))


def test_every_language_keeps_words(spark):
    rows = [(i, " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(i % 400)), "big", "s", 1, 2, 3) for i in range(300)] + [(1000 + i, "rara avis", "rare", "s", 1, 2, 3) for i in range(4)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA), max_words=20)
    assert model.langs == ["big", "rare"] and {"rara", "avis"} <= set(model.words) and len(model.words) == 12


def test_shards_share_a_trained_dictionary(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("un", "re", "over", "out", "in") for b in ("done", "made", "seen", "taken", "known", "given")]
    texts = [" ".join(rng.choices(words, k=rng.randint(20, 120))) for _ in range(400)]
    frame = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    path = tokenizer("byte_bpe_50k.json")
    manifest = tokenbin.write(frame, shared_dir(spark, "test-shards"), path, 2)
    whole, seen, hashes = Tokenizer.from_file(path), 0, set()
    for r in manifest.collect():
        shard = tokenbin.Shard(r["file"])
        assert struct.unpack("<I", files.read(r["file"], 40, 4))[0] > 1000
        hashes.add(shard.dictionary_hash)
        whole_shard = list(shard.all_ids(3000))
        for k in rng.sample(range(len(shard.index)), 20):  # one document at a time, in any order
            want = [*whole.encode(texts[1000 - int(shard.index[k]["doc_id"])], add_special_tokens=False).ids, 2]
            assert shard.ids(k).tolist() == want == whole_shard[k].tolist()
        seen += len(shard.index)
        size = shard.index["size"].sum()
        assert size < 0.5 * 2 * shard.index["n_tokens"].sum()
    assert seen == 400 and len(hashes) == 1


def test_ids_beyond_16_bits_are_kept(spark):
    frame = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    got = tokenbin.write(frame, shared_dir(spark, "test-shards"), tokenizer("byte_bpe_50k.json"), 70_000).collect()
    assert [shard.ids(k)[-1] for r in got for shard in [tokenbin.Shard(r["file"])] for k in range(len(shard.index))] == [70_000] * 2


def test_revisits_name_their_response(spark):
    page = "<p>" + "y" * 300
    pages = spark.createDataFrame([(3, "http://a/ x\ty", page), (5, "http://b/", page)], "page_id long, url string, html string")
    found = {}
    for r in warc.write(pages, shared_dir(spark, "test-warc")).collect():
        for data in warc.records(files.read(r["file"])):
            fields, _ = warc.parsed(data)
            found[fields["X-Page-Id"]] = fields
    assert found["3"]["WARC-Target-URI"] == found["5"]["WARC-Refers-To-Target-URI"] == "http://a/%20x%09y"
    assert found["5"]["WARC-Refers-To"] == found["3"]["WARC-Record-ID"] and found["5"]["Content-Length"] == "0"


def test_filter_applies_the_ledger(spark, docs):  # noqa: F811
    odd = docs.withColumnRenamed("node", "row").withColumnRenamed("hash", "fail_bits")
    for policy in (quality.BASE, quality.STRICT):
        kept = quality.ledger(docs).where(quality.passes(policy)).select("doc_id").collect()
        got = quality.filtered(odd, policy)
        assert got.columns == odd.columns and sorted(map(str, got.select("doc_id").collect())) == sorted(map(str, kept))


def test_words_of_the_contract_agree():
    for t in TEXTS:
        assert len(alnum(t)) == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower() if (t or "").isascii() else " ".join(alnum(t))))
