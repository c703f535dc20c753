"""Chat text, tokens, labels and padding against the library called row by row."""

import time
from collections import defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from groundlane.operators import collate, templates, tokens
from groundlane.plans import prompts

from .compare import SF

PATHS = pytest.importorskip("public_tokenizers")
PATH = PATHS.path("byte_bpe_50k.json")


def plain(r, family):
    """ids and labels of one rendered row."""
    from tokenizers import Tokenizer

    encode = lambda t: Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    if family == "internvl":
        user = "<img>" + "<IMG_CONTEXT>" * (4 * (r["item_id"] % 3 + 1)) + "</img>\n" + r["user_text"]
        prompt = turn("system", r["system_text"]) + turn("user", user)
        ids = encode(prompt + turn("assistant", r["assistant_text"]))
        n = len(encode(prompt + "<|im_start|>assistant\n"))
        return ids, [-100] * min(n, len(ids)) + ids[n:]
    ids = encode(turn("system", r["system_text"]) + turn("user", "<|vision_start|><|image_pad|><|vision_end|>" + r["user_text"]) + turn("assistant", r["assistant_text"]))
    at = ids.index(encode("assistant")[0]) + 1
    return ids, [-100] * at + ids[at:]


def test_batches_are_those_of_the_library(spark):
    got = defaultdict(dict)
    for r in prompts.q46_chat_batches(spark, SF).collect():
        got[r["family"], r["batch_id"]][r["item_id"]] = r
    rows = {r["item_id"]: r for r in prompts._rendered(spark, SF).collect()}
    assert sum(len(b) for b in got.values()) == 2 * len(rows)
    text = lambda xs: md5(" ".join(map(str, xs)).encode()).hexdigest()
    for (family, _), batch in sorted(got.items(), key=str)[::40]:
        want = {i: plain(rows[i], family) for i in batch}
        n = max(len(ids) for ids, _ in want.values())
        for i, (ids, labels) in want.items():
            more = n - len(ids)
            assert batch[i]["n_tokens"] == n and batch[i]["ids_md5"] == text(ids + [50_256] * more)
            assert batch[i]["attention_md5"] == text([1] * len(ids) + [0] * more) and batch[i]["labels_md5"] == text(labels + [-100] * more)


def test_chat_text_of_typed_parts(spark):
    row = spark.createDataFrame([("/a.png", "s", "u {x} <image>", "a")], "image_path string, system_text string, user_text string, assistant_text string")
    out = row.select(collate.chatml(collate.flattened(templates.messages(F.lit("Image Size: (1, 2)\n")))).alias("t"), collate.chatml(F.expr("cast(array() as array<struct<role: string, content: string>>)"), True).alias("e")).first()
    assert out["t"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\n<|vision_start|><|image_pad|><|vision_end|>Image Size: (1, 2)\nu {x} <image><|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert out["e"] == "<|im_start|>assistant\n"


def test_null_and_long_texts_and_a_missing_marker(spark):
    df = spark.createDataFrame([(None,), ("",), ("word " * 5000,)], "t string").select(F.size(collate.token_ids(F.col("t"), PATH)).alias("n"))
    assert [r["n"] for r in df.collect()][:2] == [0, 0] and df.agg(F.max("n")).first()[0] > 4999


def test_labels_of_a_long_row_take_time_in_proportion(spark):
    """Before, the marker was looked for again at each id: 100,000 ids took 10 billion steps."""
    rows = spark.range(1).select(F.concat(F.sequence(F.lit(1), F.lit(100_000)), F.array(F.lit(0), F.lit(7))).cast("array<bigint>").alias("ids"))
    began = time.time()
    out = rows.select(tokens.masked_to_marker(F.col("ids"), F.lit(0).cast("bigint")).alias("m"), tokens.masked_prefix(F.col("ids"), F.lit(100_001)).alias("p")).first()
    assert out["m"] == out["p"] == [-100] * 100_001 + [7] and time.time() - began < 20
    cases = spark.createDataFrame([([5, 6], 9), ([5, 6], 0), ([], 3), (None, 1)], "ids array<bigint>, n int").select(tokens.masked_prefix(F.col("ids"), F.col("n")).alias("p"))
    assert [r["p"] for r in cases.collect()] == [[-100, -100], [5, 6], [], None]


def test_ids_turn_by_turn_are_those_of_the_whole(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    odd = ["", " ", "\n", "\n\n", "a\n ", "  b", "<|im_end|>\n<|im_start|>", "<|im_end|>\n\n<|im_start|>", " <|im_end|>\n <|im_start|>", "<|endoftext|>", "<|im_end|>\n<|endoftext|>", "x<|im_end|>", " <|im_start|>　"]
    texts = [turn("system", a) + turn("user", b) + end for a in odd for b in odd for end in ("", "<|im_start|>assistant\n", turn("assistant", a))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", collate.token_ids(F.col("t"), PATH).alias("ids"), collate.n_tokens(F.col("t"), PATH).alias("n"))
    for r in df.collect():
        assert r["ids"] == whole.encode(texts[r["i"]], add_special_tokens=False).ids and r["n"] == len(r["ids"])
    parts = list(collate.encoded([turn("system", "s") + turn("user", "u")] * 2, PATH))
    assert len(parts[0]) == 2 and parts[0][0] is parts[1][0]  # each distinct turn once
    assert collate.cuttable(PATH) and not collate.cuttable(PATHS.path("word_bpe_49k.json"))
