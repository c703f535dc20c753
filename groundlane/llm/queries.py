"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, conversations, decontam, divergence, langid, licences, neardup, packing, quality, tokenbin, tokencount, toxicity, warc
from .base import shared_dir, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.graded(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({x: F.array_join(x, ",") for x in ("base_labels", "labels")})


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.fit(docs)).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.stored(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"), quality.passes(quality.STRICT).alias("kept"), "fail_bits",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule does in both policies, from one stored ledger."""
    rows = quality.stored(table(spark, sf_dir, "documents"))
    return quality.ablation(rows, quality.BASE).unionByName(quality.ablation(rows, quality.STRICT))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), shared_dir(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(rows, conversations.damaged(rows))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_decontamination, op3_licences, op4_warc, op5_language,
        op6_packing, op7_quality, op8_near_duplicates, op9_token_ids, op10_token_counts,
        quality_ablation, op11_best_fit, op12_source_divergence, op13_conversation_repair,
    )
}
#: Pieces of the SQL.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = r"[^\x20\x09-\x0D]+"

OP2_SQL = f"""
WITH item AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 13) AS size, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i : i + 12], ' '))) AS window_text
  FROM item WHERE len(w) > 0
),
doc AS MATERIALIZED (SELECT doc_id, {ALNUM} AS w FROM documents),
size AS (SELECT DISTINCT size FROM win),
place AS (
  SELECT doc_id, size, i AS start, array_to_string(w[i : i + size - 1], ' ') AS window_text
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc CROSS JOIN size WHERE len(w) >= size)
),
hit AS (SELECT DISTINCT doc_id, start, p.size, item_id FROM place p JOIN win USING (window_text)),
word AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + size)) AS pos FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7_SQL = rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM doc WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
repeat_words AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM doc) WHERE regexp_matches(x, '{SPACED}')),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM line GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM doc LEFT JOIN lines USING (doc_id) LEFT JOIN repeat_words r USING (doc_id)
),
b AS (
  SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_symbols > 2 * n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines AND n_dup_lines >= 10 THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 100 * n_words AND n_words > 0 THEN 16 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

RULES = ", ".join(f"('{p.version}', '{r.name}', {1 << k}, {p.mask})" for p in (quality.BASE, quality.STRICT) for k, r in enumerate(quality.RULES) if r.name in p.rules)
ABLATION_SQL = f"""
WITH ledger AS ({OP7_SQL})
SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS n_fail, count(*) FILTER (fail_bits & mask = bit) AS n_fail_alone, count(*) FILTER (fail_bits & (mask - bit) = 0) AS n_kept_without
FROM (VALUES {RULES}) r(policy, rule, bit, mask) LEFT JOIN ledger ON true GROUP BY policy, rule
"""

OP8_SQL = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{SPACED}') AS w FROM documents),
shingle AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS x FROM doc WHERE len(w) > 0)
),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common FROM shingle p JOIN shingle q USING (x) WHERE p.doc_id <> q.doc_id GROUP BY 1, 2) c
  JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * common >= 85 * (s.n + t.n - common)
),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM reach r JOIN link l ON r.seen = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT node, min(seen) AS m FROM reach GROUP BY node) r ON r.node = d.doc_id
"""

OP4_SQL = """
WITH page AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
first AS (SELECT digest, min(page_id) AS first FROM page WHERE strlen(html) >= 100 GROUP BY digest)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM page LEFT JOIN first USING (digest)
"""

OP12_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
),
word AS MATERIALIZED (SELECT lang, source, term, row, count(*) AS n FROM (SELECT lang, source, row, unnest(w) AS term FROM doc) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM word GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
held AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, sum(w.n) AS n FROM word w JOIN kept USING (lang, term) GROUP BY ALL),
team AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(total, 0) AS lang_n, coalesce((SELECT sum(n) FROM own o WHERE o.lang = g.lang AND o.source = g.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN held USING (lang)
),
p AS MATERIALIZED (
  SELECT t.lang, t.source, k.term, coalesce(o.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 1) // (t.n + t.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (t.lang_n + t.v) AS q
  FROM team t JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = t.lang AND o.source = t.source AND o.term = k.term
),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM team a JOIN team b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
EDGES = ", ".join(map(str, conversations.edges()))
ENDINGS = ", ".join(map(str, conversations.endings()))
OP13_SQL = rf"""
WITH RECURSIVE bits AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c FROM range(256) r(n))),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 20 AS hit
  FROM conversations, bits
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) r(n) WHERE hit <> 0 AND (n = 0 OR hit = 3)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) - 1 AS pos FROM damaged
),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial
  FROM placed
),
judged AS (
  SELECT *, CASE WHEN shown = '' THEN 2 WHEN again THEN 3 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
    lead(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS follower
  FROM seen
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate,
    count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (initial || follower NOT IN ('su', 'ua', 'au')) AS illegal,
    string_agg(chr(CAST(65 + 4 * fault + strpos('suax', initial) - 1 AS INTEGER)), '' ORDER BY pos) AS codes
  FROM judged GROUP BY conv_id
),
walk AS (
  SELECT conv_id, codes, 0 AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, '' AS made FROM counted
  UNION ALL
  SELECT conv_id, codes, i, state, b.cost, b.audit, b.made FROM (
    SELECT conv_id, codes, i + 1 AS i, dst AS state, min({{'cost': cost + e.c, 'audit': audit || e.edits, 'made': made || e.makes}}) AS b
    FROM walk JOIN (VALUES {EDGES}) e(code, src, dst, c, edits, makes) ON code = substr(codes, i + 1, 1) AND src = state
    WHERE i < length(codes) GROUP BY conv_id, codes, i, dst)
),
best AS (
  SELECT conv_id, min({{'cost': cost + c, 'audit': audit || edits, 'made': made || makes}}) AS b
  FROM walk JOIN (VALUES {ENDINGS}) e(s, c, edits, makes) ON s = state WHERE i = length(codes) GROUP BY conv_id
),
sign AS (SELECT conv_id, unnest(regexp_extract_all(b.made, '[UA]*[ua=-]|[UA]+$')) AS way, generate_subscripts(regexp_extract_all(b.made, '[UA]*[ua=-]|[UA]+$'), 1) - 1 AS pos FROM best),
each AS (SELECT conv_id, pos, unnest(string_split(way, '')) AS s, generate_subscripts(string_split(way, ''), 1) AS k FROM sign),
text_of AS (
  SELECT e.conv_id, string_agg(CASE WHEN lower(s) = 'u' THEN 'user' WHEN lower(s) = 'a' THEN 'assistant' ELSE role END || ':' || CASE WHEN s IN ('U', 'A') THEN '' ELSE text END, chr(10) ORDER BY e.pos, k) AS whole
  FROM each e LEFT JOIN placed p ON p.conv_id IS NOT DISTINCT FROM e.conv_id AND p.pos = e.pos WHERE s <> '-' GROUP BY e.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN text_of t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""

SQL: dict[str, str] = {"op2_decontamination": OP2_SQL, "op4_warc": OP4_SQL, "op7_quality": OP7_SQL, "quality_ablation": ABLATION_SQL, "op8_near_duplicates": OP8_SQL, "op12_source_divergence": OP12_SQL, "op13_conversation_repair": OP13_SQL}
