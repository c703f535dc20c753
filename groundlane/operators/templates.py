"""Prompt templates: catalog, assignment and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash32, list_repr
from . import boxes

NAMES = ("answerBox", "boxFromAnswer", "box")

#: Prompt texts.
_ANSWER_BOX = """You are an agent excellent at identifying evidence in a document page.
Your job is to answer the user's query based on the provided image and the context.
When you answer, provide evidence bounding boxes in the format <box> x1 y1 x2 y2 </box>.
Add an evidence bounding box at the end of each generated sentence.

If you cannot find the answer, respond with "I don't know"."""
_BOX_FROM_ANSWER = """You are an agent excellent at identifying evidence in a document page.
Your job is to identify the answer contained in the user's input based on the provided image and the context.
Respond by providing the evidence bounding boxes in the format <box> x1 y1 x2 y2 </box>.
The input is constituted by the user query and the answer to that query.

If you cannot find the answer, respond with the empty box <box> </box>."""
_BOX = """You are an agent excellent at identifying evidence in a document page.
Your job is to locate the answer to the user's query based on the provided image and the context.
Respond by providing the evidence bounding boxes in the format <box> x1 y1 x2 y2 </box>.

If you cannot find the answer, respond with the empty box <box> </box>."""
CATALOG = (
    ("answerBox", "positive", _ANSWER_BOX, "{query}", "{answer}"),
    ("answerBox", "negative", _ANSWER_BOX, "{query}", "I don't know."),
    ("boxFromAnswer", "positive", _BOX_FROM_ANSWER, "Query:\n{query}\n\nAnswer:\n{answer}", "{box_str}"),
    ("boxFromAnswer", "negative", _BOX_FROM_ANSWER, "Query:\n{query}\n\nAnswer:\n{answer}", "<box> </box>"),
    ("box", "positive", _BOX, "{query}", "{box_str}"),
    ("box", "negative", _BOX, "{query}", "<box> </box>"),
)


def catalog(spark: SparkSession) -> DataFrame:
    """Six rows: template, polarity, system, user, assistant."""
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("template", "polarity", "system", "user", "assistant"), r, strict=True)]) for r in CATALOG]
    return spark.range(1).select(F.inline(F.array(*rows)))


def assigned(rows: DataFrame, seed: int = 658, negative_share: float = 0.0, key: str = "item_id") -> DataFrame:
    """template, polarity and tag from hashes of the key; without a negative share all are positive."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), (hash32(seed, key) % 3 + 1).cast("int"))
    negative = hash32(f"{seed}n", key) < F.lit(int(negative_share * 2**32))
    out = rows.withColumn("template", name).withColumn("polarity", F.when(negative, "negative").otherwise("positive"))
    return out.withColumn("tag", F.concat("template", F.lit("|"), "polarity"))


def is_negative(tag: Column) -> Column:
    return F.contains(F.element_at(F.split(tag, r"\|"), -1), F.lit("neg"))


def fill(pattern: str, values: dict[str, Column]) -> Column:
    """A pattern with its placeholders filled. The pattern alone is searched for placeholders: braces in a value stay as they are."""
    parts, rest = [], pattern
    while rest:
        at = min((rest.find(f"{{{k}}}") for k in values if f"{{{k}}}" in rest), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = next(k for k in values if rest.startswith(f"{{{k}}}", at))
        parts += [F.lit(rest[:at])] * bool(at) + [values[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def rendered(rows: DataFrame, box_texts: Column) -> DataFrame:
    """system_text, user_text and assistant_text of rows with template, polarity, query and answer; `box_texts` are their box strings."""
    interleaved = boxes.interleaved(F.col("answer"), box_texts)
    texts: dict[str, Column] = {}
    for part, place in (("system", 2), ("user", 3), ("assistant", 4)):
        out = F.lit(None).cast("string")
        for row in CATALOG:
            answer = interleaved if row[0] == "answerBox" else list_repr(F.col("answer"))
            text = fill(row[place], {"query": F.col("query"), "answer": answer, "box_str": boxes.joined(box_texts)})
            out = F.when((F.col("template") == row[0]) & (F.col("polarity") == row[1]), text).otherwise(out)
        texts[f"{part}_text"] = out
    return rows.withColumns(texts)


def messages(size_text: Column | None = None) -> Column:
    """array<struct<role, content>> of rendered rows; content is an array of typed parts. `size_text`: the line on the image's size
    that one model family gets."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    user = [part("image", F.col("image_path"))] + ([part("text", size_text)] if size_text is not None else []) + [part("text", F.col("user_text"))]
    turn = lambda role, *content: F.struct(F.lit(role).alias("role"), F.array(*content).alias("content"))
    return F.array(turn("system", part("text", F.col("system_text"))), turn("user", *user), turn("assistant", part("text", F.col("assistant_text"))))


def prompt_only(turns: Column) -> Column:
    """A conversation without its assistant turns."""
    return F.filter(turns, lambda m: m["role"] != "assistant")


def size_line(w: Column, h: Column) -> Column:
    return F.format_string("Image Size: (%d, %d)\n", w.cast("bigint"), h.cast("bigint"))


def chat_text(turns: Column) -> Column:
    """Stand-in for a chat template: <|role|> before each content."""
    return F.array_join(F.transform(turns, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), m["content"])), "\n")


def with_image_tokens(prompt: Column, patches: Column, tokens_per_patch: int = 256) -> Column:
    """The first <image> becomes <img>, the context tokens and </img>; a prompt without <image> gets one in front. Later ones stay."""
    whole = F.when(F.contains(prompt, F.lit("<image>")), prompt).otherwise(F.concat(F.lit("<image>\n"), prompt))
    at = F.instr(whole, "<image>")
    return F.concat(F.substring(whole, F.lit(1), at - 1), F.lit("<img>"), F.repeat(F.lit("<IMG_CONTEXT>"), (patches * tokens_per_patch).cast("int")), F.lit("</img>"), F.substring(whole, at + 7, F.length(whole)))
