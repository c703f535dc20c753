"""Every operator on nulls, empty texts, ties, repeated rows, extra columns with clashing names, and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from groundlane.llm import decontam, langid, licences, neardup, packing, quality, tokenbin, tokencount, toxicity, warc
from groundlane.llm.base import shared_dir
from groundlane.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, node long, hash long"
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
ITEM = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"
TEXTS = [
    None, "", " \n\t", "!!!", "one", "Hello world again", ITEM, f"pre {ITEM.upper()} post", f"{ITEM} {LONG}", LONG, LONG + " tail", LONG,
    "Licensed under the Apache License, Version 2.0.\nMIT license, mit LICENSE", "a b c d e f g h i\n" * 30, "Ünïcödé İstanbul ΣΑΣ 中文 \x1c\x85 text", "short item here",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s" if i % 3 else None, 1, 2, 3) for i, t in enumerate(TEXTS)] + [(6, ITEM, None, "s", 1, 2, 3), (6, ITEM, None, "s", 1, 2, 3), (None, ITEM, "en", "s", 1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(df.collect(), key=lambda r: str(tuple(r)))


def alnum(t):
    t = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


@pytest.mark.parametrize("most", [decontam.MAX_SET, 0])
def test_decontamination_is_brute_force_both_ways(spark, docs, monkeypatch, most):
    monkeypatch.setattr(decontam, "MAX_SET", most)
    monkeypatch.setattr(decontam, "MAX_BYTES", most)
    items = {1: ITEM, 2: "short item here", 3: "", 4: "hello world", 5: ITEM}
    bench = spark.createDataFrame([*items.items(), (None, ITEM), (6, None), (1, ITEM)], "item_id long, text string")
    windows = defaultdict(set)
    for k, t in items.items():
        w = alnum(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(k))
    want = []
    for r in docs.collect():
        w, hit, ids = alnum(r["text"]), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    ids |= found
        want.append((r["doc_id"], len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in decontam.contamination(docs, bench).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert decontam.contamination(empty(spark), bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").isEmpty()
    assert decontam.filtered(docs, bench).columns == docs.columns
    assert decontam.filtered(docs, bench).count() == sum(not x[4] for x in want)


def test_licence_places_are_brute_force(spark, docs):
    phrases = {t.label: t.words.split() for t in licences.BASE}
    got = {}
    for r in licences.scan(docs).collect():
        got.setdefault(r["doc_id"], r)
    for r in docs.where("doc_id IS NOT NULL").collect():
        w = alnum(r["text"])
        places = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["base_labels"]) == (len(w), len(places), sorted({k for _, k in places}))
        assert (g["first_word"], g["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
    assert "apache-2.0" in got[12]["labels"] and 0 <= got[12]["score"] <= 1
    assert licences.scan(docs).count() == docs.count() and licences.scan(empty(spark)).count() == 0


def test_licence_words_of_each_file(spark):
    notice = next(t.words for t in licences.NOTICES if t.label == "bsd")
    texts = [
        (1, f"x {notice} y"),
        (2, f"y {notice.replace(' provided ', ' xx ').replace(' met', ' yy')} z"),  # two of its words are not in the file
        (3, notice.split(" with ")[0].replace("binary", "bit")),  # no key phrase
        (4, " ".join(reversed(notice.split()))),  # all words, no place
        (5, None), (6, ""), (7, f"{notice} {notice}"),
    ]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if "bsd" in r["labels"]} == {1, 2, 7}
    assert got[1]["score"] == got[7]["score"] == 1.0 and 0 < got[2]["score"] <= 1.0
    assert all(got[i]["score"] == 0 and got[i]["labels"] == [] for i in (3, 4, 5, 6))


def test_quality_is_brute_force(spark, docs):
    for r, x in zip(docs.collect(), quality.ledger(docs).collect(), strict=True):
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        at = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [s for s in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
        assert (x["n_words"], x["word_chars"], x["n_repeat_words"], x["n_dup_lines"]) == (len(w), sum(map(len, w)), len(at), len(lines) - len(set(lines)))
    assert quality.filtered(docs).columns == docs.columns
    assert quality.filtered(docs).count() == quality.ledger(docs).where(quality.passes(quality.STRICT)).count()
    table = {r["rule"]: r for r in quality.ablation(quality.ledger(docs), quality.STRICT).collect()}
    assert table["few_words"]["n_fail"] == quality.ledger(docs).where("n_words < 20").count()
    assert {r["n_fail"] for r in quality.ablation(quality.ledger(empty(spark)), quality.STRICT).collect()} == {0}


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_are_brute_force(spark, docs):
    base = [f"v{i}" for i in range(300)]
    family = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(5, 295, 10)]  # each one word from the base, two from each other
    more = spark.createDataFrame([(100 + i, t, "en", "s", 1, 2, 3) for i, t in enumerate([*family, " ".join(base), " ".join(base).upper()])], SCHEMA)
    whole = docs.union(more)
    plain = [(r["doc_id"], shingle_set(r["text"])) for r in whole.collect() if r["doc_id"] is not None]
    root = {d: d for d, _ in plain}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(plain):
        for b, y in plain[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = neardup.near_duplicates(whole, 85).collect()
    assert len(got) == whole.count()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {d: find(d) for d, _ in plain}
    left = neardup.filtered(whole, 85)
    assert left.columns == docs.columns and left.where("doc_id = 6").count() == 1 and left.where("doc_id >= 100").count() == 1
    assert neardup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [neardup.BLOCK, 50])
def test_near_duplicates_within_a_template(spark, monkeypatch, block):
    """300 texts of one template, none similar to another, crowd every bucket that the one planted pair shares."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    template = " ".join(f"t{i}" for i in range(404))
    texts = [f"{template} {' '.join(f'o{i}x{j}' for j in range(33 if i in (150, 151) else 48))}" for i in range(302)]
    sets = [shingle_set(t) for t in texts]
    assert [(i, k) for k in range(302) for i in range(k) if 100 * len(sets[i] & sets[k]) >= 85 * len(sets[i] | sets[k])] == [(150, 151)]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 150 if i == 151 else i for i in range(302)}


@pytest.mark.parametrize("most", [warc.REVISITS, 0])
def test_warc_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "REVISITS", most)
    page = "<p>" + "x" * 200
    data = [(1, "http://a/ b", page), (2, None, page), (3, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "u", "é" * 60), (6, "u", "é" * 60), (None, "u", page), (0, "http://z", page)]
    pages = spark.createDataFrame([(*r, 1) for r in data], "page_id long, url string, html string, digest int")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(data)
    for r in got:
        html = {x[2] for x in data if x[0] == r["page_id"]}.pop() or ""
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
    assert {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got if r["page_id"] is not None} == {
        0: ("response", None), 1: ("revisit", 0), 2: ("revisit", 0), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None),
    }
    assert warc.round_trip(pages.limit(0)).count() == 0
    one = warc.leading_frame(b"d" * 2000)
    assert int.from_bytes(one[:4], "little") == 0x184D2A5D


def test_language(spark, docs):
    train = [(i, t, lang, "s", 1, 2, 3) for i in range(60) for lang, t in (("en", "the house and the tree are here"), ("de", "das haus und der baum sind hier"))]
    model = langid.fit(spark.createDataFrame(train, SCHEMA))
    got = langid.identified(docs, model).collect()
    assert len(got) == docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (0, 1, 2, 3))
    mixed = spark.createDataFrame([(1, "the house and the tree are here " * 40 + "das haus und der baum sind hier " * 60, None, None, 1, 2, 3)], SCHEMA)
    r = langid.identified(mixed, model).first()
    assert r["lang_pred"] == "de" and [s["lang"] for s in r["spans"]] == ["en", "de"] and r["spans"][0]["n_words"] == 280
    assert langid.identified(docs, langid.fit(empty(spark))).where("lang_pred <> 'und'").isEmpty()


def test_viterbi_is_plain_viterbi():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 64, 0, 65, 200])
    scores = rng.normal(size=(sizes.sum(), 3)) * 3
    got, at = langid.viterbi(scores, sizes), 0
    for n in sizes:
        if n:
            s = scores[at : at + n]
            v, back = s[0].copy(), []
            for x in s[1:]:
                back.append([j if v[j] >= v.max() - langid.PENALTY else int(v.argmax()) for j in range(3)])
                v = np.maximum(v, v.max() - langid.PENALTY) + x
            path = [int(v.argmax())]
            for b in reversed(back):
                path.append(b[path[-1]])
            assert got[at : at + n].tolist() == path[::-1]
        at += n


def test_toxicity(spark, docs):
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    text = lambda bad: " ".join([*rng.choice(words, 40), *([f"nasty{'abcdef'[rng.integers(6)]}"] * bad)])
    made = [(i, text(0 if i % 4 else 1 + i % 3), "en", "s", 1, 2, 3) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(0, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(made, SCHEMA)
    model = toxicity.fit(frame, labels)
    got = {r["doc_id"]: r for r in toxicity.graded(frame, model).collect()}
    assert all(got[i]["toxic"] == (i % 4 == 0) for i in range(400)) and len(model.thresholds) == 1
    assert toxicity.graded(docs, model).where("toxic").isEmpty() and toxicity.filtered(docs, model).columns == docs.columns
    assert toxicity.graded(docs, toxicity.fit(docs, labels.limit(0))).where("severity <> 0").isEmpty()


@pytest.mark.parametrize("most", ["10m", "-1"])
def test_packing(spark, docs, request, most):
    from tokenizers import Tokenizer

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    out = packing.packed(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), tokenizer("word_bpe_49k.json")).toPandas()
    for i, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = out[out.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(mine.start, mine.length, mine.ids_crc32, strict=True))
    out = out.sort_values(["sequence_id", "offset"])
    totals = out.groupby("sequence_id").length.sum()
    assert ((out.groupby("sequence_id").length.cumsum() - out.length) == out.offset).all() and (totals.iloc[:-1] == 2048).all()
    assert packing.packed(docs, tokenizer("word_bpe_49k.json")).where("doc_id IS NULL OR doc_id = 6").select("doc_id").count() >= 4
    assert packing.packed(empty(spark), tokenizer("word_bpe_49k.json")).count() == 0


def placed(phases, totals, step=777):
    """sequence -> [(offset, length, source)], after checking that every token of every source has one place, in order."""
    cells = defaultdict(list)
    for s, n in totals.items():
        at = 0
        for a in range(0, n, step * 3):
            starts = np.arange(a, min(n, a + step * 3), step)
            _, x, size, w, offset = packing.cut(phases, s, starts, min(n, a + step * 3))
            assert x[0] == at and (size > 0).all() and (x[1:] == x[:-1] + size[:-1]).all()
            at = int(x[-1] + size[-1])
            for o, z, k in zip(offset.tolist(), size.tolist(), w.tolist(), strict=True):
                cells[k].append((o, z, s))
        assert at == n
    total = sum(totals.values())
    for w, found in cells.items():
        found.sort()
        assert [o for o, _, _ in found] == [sum(z for _, z, _ in found[:i]) for i in range(len(found))]
        assert sum(z for _, z, _ in found) == min(2048, total - 2048 * w)
    return cells


@pytest.mark.parametrize("targets", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.7, "b": 0.2995, "c": 0.0005}])
def test_targets_hold_until_a_source_runs_out(targets):
    totals = {"a": 70_001, "b": 9_000, "c": 23_456}
    phases = packing.planned(totals, targets)
    cells, taken = placed(phases, totals), Counter()
    for w in range(phases[0].count):
        for _, size, s in cells[w]:
            taken[s] += size
        assert all(abs(taken[s] - v * 2048 * (w + 1)) < 3 for s, v in targets.items())
    assert any(totals[s] - taken[s] < 2048 for s in totals)


def test_a_source_without_a_target_is_an_error(spark, docs):
    with pytest.raises(ValueError):
        packing.planned({"a": 70_000, "b": 9_000}, {"a": 1.0})
    with pytest.raises(ValueError):
        packing.packed(docs, tokenizer("word_bpe_49k.json"), targets={"s": 1.0})


@pytest.mark.parametrize("totals", [
    {"a": 70_001, "b": 9_000, "c": 23_456, **{f"s{i}": i for i in range(1, 40)}}, {f"s{i:02}": 20_480 for i in range(65)},
    {"hot": 512_000, **{f"s{i:02}": 20_480 for i in range(50)}}, {"hot": 10**6, **{f"s{i:03}": i for i in range(1, 300)}},
])
def test_every_source_keeps_its_share_of_every_sequence(totals):
    cells, taken, total = placed(packing.planned(totals), totals), Counter(), sum(totals.values())
    for w in range(max(cells)):
        for _, size, s in cells[w]:
            taken[s] += size
        assert all(abs(taken[s] - n * 2048 * (w + 1) / total) < 5 for s, n in totals.items())


def test_tables_are_exact_beyond_64_bits():
    totals = {f"s{i}": n for i, n in enumerate((2**44 + 12_345, 2**43 + 1, 999_999_999_989, 3))}
    phase = packing.planned(totals)[0]
    for w in (0, 10**9 + 7, phase.count - 40):
        for s in totals:
            n, _ = phase.table(w, 40, s)
            assert n.tolist() == [phase.given(w + k, s) for k in range(41)]


def test_many_sources_share_queues(spark):
    rows = spark.range(300).selectExpr("id AS doc_id", "repeat('some words here ', cast(id % 7 as int) * 40) AS text", "concat('s', id % 60) AS source")
    out = packing.packed(rows, tokenizer("word_bpe_49k.json"), own=8).toPandas().sort_values(["sequence_id", "offset"])
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all() and out.doc_id.nunique() == 300
    assert ((out.groupby("sequence_id").length.cumsum() - out.length) == out.offset).all() and (out.groupby("sequence_id").length.sum().iloc[:-1] == 2048).all()


def test_token_shards(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted(tokenbin.round_trip(docs, path, 2).collect(), key=lambda r: r["start"])
    want = sorted(docs.collect(), key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["text"] or ""))
    at = 0
    for g, r in zip(got, want, strict=True):
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(g) == (r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenbin.round_trip(empty(spark), path, 2).count() == 0


def test_token_counts_use_the_cache(spark, docs):
    import sentencepiece

    path, cache = tokenizer("piece_bpe_32k.model"), shared_dir(spark, "test-cache")
    s = sentencepiece.SentencePieceProcessor(model_file=path)
    for _ in range(2):
        got = tokencount.token_counts(docs, path, cache).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(s.encode(r["text"] or ""))) for r in docs.collect())
        assert tokencount.read_cache(spark, cache).count() == len({t or "" for t in TEXTS})  # nothing is encoded twice
    assert tokencount.token_counts(empty(spark), path, shared_dir(spark, "test-cache")).count() == 0


def test_encoders_equal_the_library():
    import random

    from tokenizers import Tokenizer

    from groundlane.llm.tok import JsonEncoder

    random.seed(3)
    letters = [*"\x01\x02", *"aAbé É'sStT .,!\n\t\r\x85\xa0\x1c²½ºßΣσİK①中한😀%&#-_12µÿ", "<|endoftext|>", "'ll", " ' s", "the ", "\r\n", "  ", "é"]
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(random.choices(["ab", "Cé", "7", " ", " ", "\n", ". ", ", ", ".", ",\n"], k=random.randint(0, 40))) for _ in range(3000)]
    for name, kind in (("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")):
        ours, theirs = JsonEncoder(tokenizer(name), kind), Tokenizer.from_file(tokenizer(name))
        ours.known.limit = 500
        want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
        assert [list(ours.encode(t)) for t in texts] == want
        assert [np.frombuffer(x, ours.type).tolist() for x in ours.encode_column(pa.array([*texts, None]), 5_000)] == [*want, []]


def test_token_files_encode_blocks_of_16_mb(monkeypatch):
    """Before, blocks of 8 MB looked the same pieces up twice as often."""
    paths = pytest.importorskip("public_tokenizers")
    from groundlane.llm import tok

    sizes, block = [], tok.JsonEncoder.block
    monkeypatch.setattr(tok.JsonEncoder, "block", lambda self, texts: sizes.append(len(texts)) or block(self, texts))
    encode, width = tokenbin.serialiser(paths.path("byte_bpe_50k.json"), 2)
    out = encode(pa.array(["some words " * 100_000] * 16))
    assert sizes == [14, 2] and len(set(out)) == 1 and out[0][-width:] == (2).to_bytes(width, "little")
