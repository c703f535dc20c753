"""Queries over boxes, rendered prompts and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes, collate, curate, geometry, templates, tokens
from ..sources import bindings
from ..sources.shared import written
from .curation import ASSIGNED, ITEMS, SYSTEM
from .geometry import RESIZED_28


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.kept(bindings.items(spark, sf_dir), bindings.images(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).select("item_id", F.posexplode("bbox").alias("k", "box"))


def _corners(rows: DataFrame) -> DataFrame:
    return rows.select("item_id", "k", *[F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def q14_box_scale_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corners(_lines(spark, sf_dir).withColumn("b", boxes.scaled(F.col("box"), 1000, 1000)))


def _sized(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """rw and rh: an item's image has the resized size of the part whose number the item's modulo gives."""
    size = bindings.image_sizes(spark, sf_dir)
    w, h = geometry.resized_28(F.col("w"), F.col("h"), geometry.target(F.col("w"), F.col("h")))
    size = size.select("image_id", w.alias("rw"), h.alias("rh"))
    n = size.agg(F.max("image_id").alias("n"))  # one row
    return rows.join(F.broadcast(n)).withColumn("image_id", F.col("item_id") % F.col("n") + 1).join(size, "image_id")


def q15_box_scale_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in pixels of the resized image."""
    rows = _sized(spark, sf_dir, _lines(spark, sf_dir))
    return _corners(rows.withColumn("b", boxes.scaled(F.col("box"), boxes.target_side(F.lit("qwen2.5"), F.col("rw")), boxes.target_side(F.lit("qwen2.5"), F.col("rh")))))


def q16_box_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("item_id", "k", boxes.text(boxes.scaled(F.col("box"), 1000, 1000)).alias("box_str"))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.rendered(templates.assigned(kept(spark, sf_dir)), boxes.texts(F.col("bbox")))


def q17_render_answerbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).where("template = 'answerBox'").select("item_id", "assistant_text")


def q18_render_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).where("template <> 'answerBox'").select("item_id", "user_text", "assistant_text")


def q19_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sized(spark, sf_dir, _rendered(spark, sf_dir)).withColumn("m", templates.messages(templates.size_line(F.col("rw"), F.col("rh"))))
    flat = F.transform("m", lambda m: F.concat(m["role"], F.lit(":"), F.array_join(F.transform(m["content"], lambda p: F.concat(p["type"], F.lit("="), p["text"])), "+")))
    return rows.select("item_id", F.md5(F.array_join(flat, "\n")).alias("messages_md5"), F.size("m").cast("bigint").alias("n_messages"))


def q20_prompt_vs_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = bindings.turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", F.md5(templates.chat_text(templates.prompt_only(F.col("m")))).alias("prompt_md5"), F.md5(templates.chat_text(F.col("m"))).alias("full_md5"))


def q25_image_token_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bindings.turns(spark, sf_dir).where("role = 'user'").withColumn("prompt", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<image>"), "text", F.lit("<image>"))).otherwise(F.col("text")))
    out = templates.with_image_tokens(F.col("prompt"), F.col("conv_id") % 3 + 1, 4)
    return rows.select("conv_id", "turn", F.length(out).cast("bigint").alias("n_chars"), F.md5(out).alias("prompt_md5"))


def q45_chat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two chat texts of each item for the family with image tokens in the text: the prompt up to an opened assistant turn, and all."""
    turns = collate.tiled_turns(F.col("item_id") % 3 + 1, 4)
    texts = _rendered(spark, sf_dir).select("item_id", collate.chatml(templates.prompt_only(turns), True).alias("prompt"), collate.chatml(turns).alias("full"))
    return texts.select("item_id", F.md5("prompt").alias("prompt_md5"), F.md5("full").alias("full_md5"), F.length("full").cast("bigint").alias("n_chars"))


def q46_chat_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded batches of four items in epoch order, in tokens of a public vocabulary, for both families."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = written(_rendered(spark, sf_dir).select("item_id", "image_path", "system_text", "user_text", "assistant_text"), "chat-texts")  # read by the order's counts too
    rows = written(tokens.batches(tokens.epoch_order(texts, 117, "item_id"), 4), "chat-batches")  # read by both families
    digest = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), " ")).alias(f"{c}_md5")
    found = []
    for family in ("qwen3", "internvl"):
        out = collate.collated(collate.labelled(rows, family, path, F.col("item_id") % 3 + 1, 4), pad_id=50_256)
        found.append(out.select("item_id", F.lit(family).alias("family"), "batch_id", F.size("ids").cast("bigint").alias("n_tokens"), digest("ids"), digest("attention"), digest("labels")))
    return found[0].unionAll(found[1])


#: SQL pieces: scaled corners and box texts of one box or a list of them.
BOX = "list_transform({box}, lambda c: CAST(round_even(c * 1000, 0) AS BIGINT))"
BOX_STR = f"'<box> ' || array_to_string({BOX}, ' ') || ' </box>'"
BOX_STRS = f"list_transform(bbox, lambda b: {BOX_STR.format(box='b')})"
LINES = "line_box AS (SELECT item_id, unnest(range(len(bbox))) AS k, unnest(bbox) AS box FROM kept)"
CORNERS = "CAST(k AS INTEGER) AS k, b[1] AS x0, b[2] AS y0, b[3] AS x1, b[4] AS y1"
INTERLEAVED = f"array_to_string(list_transform(list_zip(answer, {BOX_STRS}), lambda z: trim(z[1], '.') || ' ' || z[2]), ' .')"
LIST_REPR = """'[' || array_to_string(list_transform(answer, lambda s: CASE WHEN contains(s, '''') AND NOT contains(s, '"') THEN '"' || s || '"' ELSE '''' || replace(s, '''', '\\''') || '''' END), ', ') || ']'"""
RENDERED = f"""rendered AS (SELECT *, {SYSTEM} AS system_text,
  CASE template WHEN 'boxFromAnswer' THEN 'Query:' || chr(10) || query || chr(10) || chr(10) || 'Answer:' || chr(10) || {LIST_REPR} ELSE query END AS user_text,
  CASE template WHEN 'answerBox' THEN {INTERLEAVED} ELSE array_to_string({BOX_STRS}, ' ') END AS assistant_text FROM assigned)"""
ALL = f"WITH {ITEMS}, {ASSIGNED.format(share=0, source='kept')}, {RENDERED}"

SQL = {
    "q14_box_scale_1000": f"WITH {ITEMS}, {LINES} SELECT item_id, {CORNERS} FROM (SELECT item_id, k, {BOX.format(box='box')} AS b FROM line_box)",
    "q15_box_scale_px": f"""WITH {ITEMS}, {LINES}, {RESIZED_28}, n AS (SELECT max(image_id) AS n FROM size)
      SELECT item_id, {CORNERS} FROM (SELECT item_id, k, list_transform(box, lambda c, i: CAST(round_even(c * CASE WHEN i % 2 = 1 THEN rw ELSE rh END, 0) AS BIGINT)) AS b
        FROM line_box CROSS JOIN n JOIN resized ON image_id = item_id % n.n + 1)""",
    "q16_box_strings": f"WITH {ITEMS}, {LINES} SELECT item_id, CAST(k AS INTEGER) AS k, {BOX_STR.format(box='box')} AS box_str FROM line_box",
    "q17_render_answerbox": f"{ALL} SELECT item_id, assistant_text FROM rendered WHERE template = 'answerBox'",
    "q18_render_box": f"{ALL} SELECT item_id, user_text, assistant_text FROM rendered WHERE template <> 'answerBox'",
    "q19_messages": f"""{ALL}, {RESIZED_28}, n AS (SELECT max(image_id) AS n FROM size) SELECT item_id, md5('system:text=' || system_text || chr(10) || 'user:image=' || image_path || '+text=Image Size: (' || rw || ', ' || rh || ')' || chr(10) || '+text=' || user_text
      || chr(10) || 'assistant:text=' || assistant_text) AS messages_md5, CAST(3 AS BIGINT) AS n_messages FROM rendered CROSS JOIN n JOIN resized ON image_id = item_id % n.n + 1""",
    "q45_chat_text": f"""{ALL}, p AS (SELECT item_id, '<|im_start|>system' || chr(10) || system_text || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '<img>' || repeat('<IMG_CONTEXT>', CAST((item_id % 3 + 1) * 4 AS INTEGER)) || '</img>'
        || chr(10) || user_text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt, assistant_text || '<|im_end|>' || chr(10) AS rest FROM rendered)
      SELECT item_id, md5(prompt) AS prompt_md5, md5(prompt || rest) AS full_md5, CAST(length(prompt || rest) AS BIGINT) AS n_chars FROM p""",
    "q20_prompt_vs_full": """SELECT conv_id, md5(coalesce(string_agg('<|' || role || '|>' || text, chr(10) ORDER BY turn) FILTER (role <> 'assistant'), '')) AS prompt_md5,
      md5(string_agg('<|' || role || '|>' || text, chr(10) ORDER BY turn)) AS full_md5 FROM conversations GROUP BY conv_id""",
    "q25_image_token_prompt": """WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '<image>' || text || '<image>' ELSE text END AS prompt FROM conversations WHERE role = 'user'),
      w AS (SELECT *, CASE WHEN contains(prompt, '<image>') THEN prompt ELSE '<image>' || chr(10) || prompt END AS whole FROM p),
      o AS (SELECT conv_id, turn, substr(whole, 1, instr(whole, '<image>') - 1) || '<img>' || repeat('<IMG_CONTEXT>', CAST((conv_id % 3 + 1) * 4 AS INTEGER)) || '</img>' || substr(whole, instr(whole, '<image>') + 7) AS t FROM w)
      SELECT conv_id, turn, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS prompt_md5 FROM o""",
}
#: Tokens of a library are no SQL: tests hold q46 against it.
QUERIES = {k: globals()[k] for k in [*SQL, "q46_chat_batches"]}
