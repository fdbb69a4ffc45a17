"""Registered queries of the operators and their SQL.

Each query runs its operator over the whole intended table with production
parameters and derives the contract's digest columns from its real output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from pinprice.llm import (
    arrow_tokens,
    bpe_queue,
    chat_format,
    dart_minhash,
    hard_negatives,
    html_template,
    lexical_search,
    line_dedup,
    pitman_yor,
    quality_rules,
    source_mixing,
    topk_search,
    toxicity,
)
from pinprice.llm.common import crc32_mod, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def op1_chat_formatting(spark, sf_dir):
    """Turn rows -> variant records -> fingerprint -> mapping -> template; digests of what is read back."""
    rows = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    own = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                 F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
        for i, role in enumerate(("user", "assistant"))])))
    records = rows.unionByName(own).select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("rec"))
    turns = chat_format.canonical_turns(records, "conv_id", "rec").where("layout is not null").select("id", "turn.*")
    out = chat_format.read_back(chat_format.format_conversations(turns))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("learned", "")
    return out.select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op2_exact_topk(spark, sf_dir):
    """The 5 best rows by integer inner product for every vector whose id is divisible by 50."""
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk_search.top_k(vectors, F.expr("id % 50 = 0"), "vec_id", "embedding", k=5, scale=256)


def op3_line_dedup(spark, sf_dir):
    """Every document's text without the lines and passages that an earlier place holds, and what was removed."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    out = line_dedup.remove_repeats(docs)
    return out.select("doc_id", "text", "removed", F.size("removed").cast("long").alias("n_removed"))


def op4_dart_minhash(spark, sf_dir):
    """Every document's near-duplicate class (its least doc_id) and whether the document is the one that stays."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    out = dart_minhash.near_duplicates(docs)
    return out.select(F.col("doc").alias("doc_id"), "class_id", F.col("doc").eqNullSafe(F.col("class_id")).alias("kept"))


def op5_source_mixing(spark, sf_dir):
    """Words that a mix of all sources at weights 1, 2, 3 takes from every document."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "text")
    sized = source_mixing.store(docs.select("doc_id", "source", source_mixing.word_count(F.col("text")).alias("size")),
                                "mix-sizes")
    mixed = source_mixing.mix(sized, size_col="size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_arrow_tokens(spark, sf_dir):
    """Every text as token ids in Arrow files, and what reading the files back gives."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    folder = shared_dir(spark, "llm", "tokens")
    files = arrow_tokens.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return arrow_tokens.read_checksums(files, folder)


def op7_byte_bpe(spark, sf_dir):
    """Every text's byte-level BPE ids and the bytes they decode to, as digests."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe_queue.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                            ids=False, digests=True)


def op8_toxicity(spark, sf_dir):
    """Every text's toxicity score; one quarter of the ids is held out of learning."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = _table(spark, sf_dir, "labels", "doc_id", "toxic")
    held = crc32_mod(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs.where(~held), labels.where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_pitman_yor(spark, sf_dir):
    """Every text's log10 probability under the model learned from four fifths of the ids."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    out = pitman_yor.perplexity(docs, crc32_mod(F.col("doc_id"), 5) != 1, stored=False)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
                      "score")


def op10_quality_rules(spark, sf_dir):
    """The ledger of every document: measurements, failure bits and the production policy's verdict."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    rows = quality_rules.ledger(docs)
    policy, base = quality_rules.POLICIES[quality_rules.PRODUCTION], quality_rules.BASE
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality_rules.passes(base)).alias("base_failed"), quality_rules.passes(policy).alias("kept"),
                       "n_lines", "fail_bits")


def op11_hard_negatives(spark, sf_dir):
    """The first 3 rows of other labels in the score window of each of an anchor's 5 positives."""
    rows = _table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0, positives=5, negatives=3, scale=256)


def op12_html_template(spark, sf_dir):
    """The main text of every page, by the template of its host."""
    pages = _table(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_template.extract(pages).select("page_id", "url", "text", "n_chars")


def op13_lexical_nra(spark, sf_dir):
    """The 10 best documents for every benchmark item."""
    docs, items = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text")
    return lexical_search.search(docs, items, k=10)


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_exact_topk, op3_line_dedup, op4_dart_minhash, op5_source_mixing, op6_arrow_tokens,
    op7_byte_bpe, op8_toxicity, op9_pitman_yor, op10_quality_rules, op11_hard_negatives, op12_html_template,
    op13_lexical_nra)}


# --------------------------------------------------------------------------
# SQL of the same rows (DuckDB)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = (f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
          "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
_W = "[^\\x20\\x09-\\x0D]+"


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\b')"
    for c in chat_format.CONTROL:
        code = "\\" + {"[": "(", "<": "{"}[c[0]] + c[1:]
        out = f"replace({out}, '{c}', '{code}')"
    return out


ORACLE: dict[str, str] = {
    "op1_chat_formatting": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS LAST, role, text), '')
      AS learned,
    sum(length('[TURN]' || replace({_sql_escape('role')}, chr(10), '\\n') || chr(10) || {_sql_escape('text')}
               || '[/TURN]')) AS body
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
  sha256(learned) AS loss_sha256, CAST(body + length('<s></s>') AS BIGINT) AS formatted_chars FROM g""",
    "op2_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q),
    lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
  FROM a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, min(struct_pack(l := label, q := q)) AS a FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT a.vec_id AS anchor_id, a.a.l = b.label AS same, b.vec_id, CAST(coalesce(list_sum(list_transform(
    list_zip(a.a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
  FROM a JOIN v b ON a.vec_id <> b.vec_id),
p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
    s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND p.place <= 5
    AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3""",
    "op13_lexical_nra": f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents),
p AS (
  SELECT rid, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(ts) AS t FROM d) u GROUP BY rid, t),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(ts)) AS BIGINT) AS nt FROM d WHERE len(ts) > 0),
w AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * s.nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM p, s GROUP BY t, s.nd),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE item_id IS NOT NULL),
c AS (
  SELECT i.item_id, d.rid, d.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf
    + 8 * (100 - 90 + (90 * CAST(len(d.ts) AS BIGINT) * s.nd) // s.nt)))) AS BIGINT) AS score
  FROM i JOIN w USING (t) JOIN p USING (t) JOIN d USING (rid), s GROUP BY i.item_id, d.rid, d.doc_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op5_source_mixing": f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_W}')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 64 AS salt FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
b AS (
  SELECT *, sum(source_size) OVER () AS t, sum(weight) OVER () AS wt,
    coalesce(sum(source_size) OVER x, 0) AS t0, coalesce(sum(weight) OVER x, 0) AS w0
  FROM w WINDOW x AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), encode(source) NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(CAST(t - 3 * t0 AS DOUBLE) / CAST(wt - w0 AS DOUBLE)) AS level FROM b),
g AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * CAST(weight AS DOUBLE)) AS target,
    CAST(CAST('0x' || substr(md5('17:' || coalesce('s' || source, 'null')), 1, 8) AS BIGINT) AS DOUBLE)
      / 4294967296.0::DOUBLE AS shift FROM b, l),
k AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.shift,
    CASE WHEN d.size > 0 THEN g.target / CAST(g.source_size AS DOUBLE) ELSE 0::DOUBLE END AS rate,
    CAST(row_number() OVER (PARTITION BY d.source, d.size > 0 ORDER BY d.size, d.salt, d.doc_id) - 1 AS DOUBLE) AS j
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN size * (floor(rate)
  + floor((j + 1) * (rate - floor(rate)) + shift) - floor(j * (rate - floor(rate)) + shift)) ELSE 0 END AS BIGINT)
  AS taken FROM k""",
    "op10_quality_rules": f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_W}') AS ws, string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
x AS (
  SELECT rid, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM d WHERE len(ws) > 2),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM x),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM win) t WHERE n > 1),
pos AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) t GROUP BY rid),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(ls, lambda y: regexp_matches(y, '{_W}')))
      - len(list_distinct(list_filter(ls, lambda y: regexp_matches(y, '{_W}')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(pos.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(ls, lambda y: regexp_matches(y, '{_W}'))) AS BIGINT) AS n_lines
  FROM d LEFT JOIN pos USING (rid)),
f AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
    + 4 * (n_words > 0 AND 100 * n_symbols > 20 * n_words)::INT
    + 8 * (n_lines > 0 AND 100 * n_dup_lines > 50 * n_lines)::INT
    + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words))::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits % 4 <> 0 AS base_failed,
  fail_bits = 0 AS kept, n_lines, fail_bits FROM f""",
}
