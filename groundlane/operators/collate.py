"""From rendered items to padded batches of token ids: chat text, tokens by a tokenizer file, labels, padding.

Chat text is ChatML, which both families' public models use: each turn between <|im_start|>role and <|im_end|>. The one family marks an
image by its vision tokens and learns from the first token of `assistant` on; the other writes its image's tokens into the user's text
and learns from where the prompt, which ends in an opened assistant turn, stops.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import templates, tokens

#: Fixed values of the chat format.
TURN, END, IMAGE = "<|im_start|>", "<|im_end|>\n", "<|vision_start|><|image_pad|><|vision_end|>"


def chatml(turns: Column, open_assistant: bool = False) -> Column:
    """Text of array<struct<role, content>>; `open_assistant` ends it with an assistant turn that is still to be written."""
    whole = F.array_join(F.transform(turns, lambda m: F.concat(F.lit(TURN), m["role"], F.lit("\n"), m["content"], F.lit(END))), "")
    return F.concat(whole, F.lit(f"{TURN}assistant\n")) if open_assistant else whole


def flattened(turns: Column) -> Column:
    """Turns of typed parts (templates.messages) as turns of text: an image becomes its vision tokens."""
    part = lambda p: F.when(p["type"] == "image", F.lit(IMAGE)).otherwise(p["text"])
    return F.transform(turns, lambda m: F.struct(m["role"].alias("role"), F.array_join(F.transform(m["content"], part), "").alias("content")))


def tiled_turns(patches: Column, tokens_per_patch: int) -> Column:
    """Turns of a rendered row for the family that writes `patches` tiles of image tokens in front of the user's text."""
    user = templates.with_image_tokens(F.concat(F.lit("<image>\n"), F.col("user_text")), patches, tokens_per_patch)
    texts = (("system", F.col("system_text")), ("user", user), ("assistant", F.col("assistant_text")))
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in texts])


@lru_cache(maxsize=4)
def encoder(path: str):
    """One tokenizer per worker process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Between the turns of a chat text.
BETWEEN = re.compile(r"(?<=<\|im_end\|>\n)(?=<\|im_start\|>)")


@lru_cache(maxsize=4)
def cuttable(path: str) -> bool:
    """Whether a chat text may be encoded turn by turn with the ids of the whole: no normalizer or post-processor looks across the cut,
    no added token holds a line end, and a byte-level pattern parts "\\n" and "<" wherever they meet (the one "\\n" after ">" is a piece
    of its own at a text's end too)."""
    made = json.loads(encoder(path).to_str())
    split = made["pre_tokenizer"] or {}
    plain = not made["normalizer"] and not made["post_processor"] and not made["truncation"] and not made["padding"]
    level = split.get("type") == "ByteLevel" and split.get("use_regex") is True and split.get("add_prefix_space") is False
    return plain and level and not any("\n" in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in made["added_tokens"])


def encoded(texts: list[str], path: str) -> Iterator[list[np.ndarray]]:
    """For each text the ids of its turns; each distinct turn is encoded once."""
    turns = [BETWEEN.split(t) if cuttable(path) else [t] for t in texts]
    known = list(dict.fromkeys(t for ts in turns for t in ts))
    ids = dict(zip(known, (np.array(e.ids, np.int64) for e in encoder(path).encode_batch_fast(known, add_special_tokens=False)), strict=True))
    return ([ids[t] for t in ts] for ts in turns)


def token_ids(text: Column, path: str) -> Column:
    """Ids by a tokenizers file, without added special tokens, never truncated; null texts are empty. Arrow batches, one library call each."""

    @F.pandas_udf("array<bigint>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([np.concatenate(x) for x in encoded(batch.fillna("").tolist(), path)], dtype=object)

    return ids(text)


def n_tokens(text: Column, path: str) -> Column:
    """How many ids token_ids gives."""

    @F.pandas_udf("int")
    def n(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([sum(map(len, x)) for x in encoded(batch.fillna("").tolist(), path)], dtype="int32")

    return n(text)


def first_id(word: str, path: str) -> int:
    return encoder(path).encode(word, add_special_tokens=False).ids[0]


def labelled(rows: DataFrame, family: str, path: str, patches: Column | None = None, tokens_per_patch: int = 256) -> DataFrame:
    """Rendered rows with ids, attention and labels. `family` is one of training.FAMILIES, or `internvl`, which needs `patches`."""
    if family == "internvl":
        turns = tiled_turns(patches, tokens_per_patch)
        out = rows.withColumns({"ids": token_ids(chatml(turns), path), "_prompt": n_tokens(chatml(templates.prompt_only(turns), True), path)})
        out = out.withColumn("labels", tokens.masked_prefix(F.col("ids"), F.col("_prompt"))).drop("_prompt")
    else:
        out = rows.withColumn("ids", token_ids(chatml(flattened(templates.messages())), path))
        out = out.withColumn("labels", tokens.masked_to_marker(F.col("ids"), F.lit(first_id("assistant", path)).cast("bigint")))
    return out.withColumn("attention", F.array_repeat(F.lit(1), F.size("ids")))


def collated(rows: DataFrame, pad_id: int, by: str = "batch_id") -> DataFrame:
    """Labelled rows padded within their batches; what is padding is never learnt from."""
    out = tokens.padded(rows, pad_id, by)
    return out.withColumn("labels", tokens.masked_padding(F.col("labels"), F.col("attention")))
