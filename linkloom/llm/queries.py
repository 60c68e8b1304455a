"""One query per operator of this subpackage, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import bpe, chat_format, compression_quality, fill_middle, html_text, periodic_runs, piece_counts, simhash, soft_mixing, token_files, warc
from linkloom.llm import quality_rules as rules
from linkloom.llm import top_k as search

#: Places of the vocabulary files; any others of the same kinds do.
WORD_BPE, BYTE_RANKS, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
END_ID = 1
#: Domains of the mixture and their shares of tokens.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def labelled_domains(docs: DataFrame) -> DataFrame:
    """(text, domain): the table that the domain classifier learns from, a fifth of the documents by id with their languages; those of the others are never read."""
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).select("text", F.col("lang").alias("domain"))


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    mixed = soft_mixing.mix(docs.select("doc_id", "text"), labelled_domains(docs), TARGETS, carry_text=False)
    shares = [F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(TARGETS)]
    return mixed.select("doc_id", "n_tokens", *shares, "rate", "copies")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, _read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(_read(spark, sf_dir, "documents"), carry_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(_read(spark, sf_dir, "documents"), WORD_BPE, END_ID).withColumnRenamed("id", "doc_id")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = compression_quality.fit(docs, _read(spark, sf_dir, "labels"))
    scored = compression_quality.with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", compression_quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(_read(spark, sf_dir, "pages"))


def op10_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.piece_counts(_read(spark, sf_dir, "documents"), PIECES).withColumnRenamed("id", "doc_id")


def _planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts, in every tenth of which by CRC-32 the words from some place on repeat with some period."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all("text", F.lit(rules.WORD), F.lit(0))
    marked = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, words).alias("_w")).withColumn("_n", F.size("_w"))
    placed = marked.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))).withColumn("_p", F.lit(1) + F.floor((F.col("_n") - F.col("_a")) / (F.lit(3) + F.col("_g") % 8)))
    changed = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get(F.col("_w"), (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return placed.select("doc_id", F.when(F.col("_n") > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_planted(_read(spark, sf_dir, "documents")), texts=False).withColumn("best", periodic_runs.strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    tricky = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    return chat_format.read_back(chat_format.format_chats(rows))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return fill_middle.restored(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_soft_mixing": op1_soft_mixing,
    "op2_simhash": op2_simhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_files": op4_token_files,
    "op5_html_text": op5_html_text,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_compression_quality": op7_compression_quality,
    "op8_top_k": op8_top_k,
    "op9_warc": op9_warc,
    "op10_piece_counts": op10_piece_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_chat_format": op12_chat_format,
    "op13_fill_middle": op13_fill_middle,
}

_OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), r AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c >= 2
  ) GROUP BY rid
), c AS (
  SELECT w.rid, doc_id, lang, source, len(ws) AS n_words, length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN r ON w.rid = r.rid
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
), x AS (
  SELECT rid, lang, source, base_failed, unnest([
    {'ratio': 'word_chars', 'v': CAST(floor(1000 * word_chars / greatest(n_words, 1)) AS BIGINT)},
    {'ratio': 'symbols', 'v': CAST(floor(1000 * n_symbols / greatest(n_words, 1)) AS BIGINT)},
    {'ratio': 'dup_lines', 'v': CAST(floor(1000 * n_dup_lines / greatest(n_lines, 1)) AS BIGINT)},
    {'ratio': 'repeats', 'v': CAST(floor(1000 * n_repeat_words / greatest(n_words, 1)) AS BIGINT)}], recursive := true) FROM b
), k AS (
  SELECT lang, source, ratio, (v >> greatest(len(bin(v)) - 5, 0)) << greatest(len(bin(v)) - 5, 0) AS k FROM x WHERE NOT base_failed
), s AS (
  SELECT lang, source, ratio, k, count(*) AS n FROM k GROUP BY ALL
), whole AS (
  SELECT ratio, k, sum(sum(n)) OVER (PARTITION BY ratio ORDER BY k) AS a_c, sum(sum(n)) OVER (PARTITION BY ratio) AS a_n FROM s GROUP BY ratio, k
), lng AS (
  SELECT lang, ratio, k, sum(n) AS n FROM s GROUP BY ALL
), grid AS (
  SELECT g.lang, g.source, g.ratio, w.k, a_c, a_n, coalesce(s.n, 0) AS g_x, coalesce(lng.n, 0) AS l_x
  FROM (SELECT DISTINCT lang, source, ratio FROM s) g JOIN whole w ON g.ratio = w.ratio
  LEFT JOIN s ON s.ratio = g.ratio AND s.k = w.k AND s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source
  LEFT JOIN lng ON lng.ratio = g.ratio AND lng.k = w.k AND lng.lang IS NOT DISTINCT FROM g.lang
), c2 AS (
  SELECT *, sum(g_x) OVER u AS g_c, sum(l_x) OVER u AS l_c, sum(g_x) OVER t AS g_n, sum(l_x) OVER t AS l_n FROM grid
  WINDOW t AS (PARTITION BY lang, source, ratio), u AS (PARTITION BY lang, source, ratio ORDER BY k)
), f AS (
  SELECT lang, source, ratio, k, (g_c + 200 * ((l_c + 200 * (CAST(a_c AS DOUBLE) / a_n)) / (l_n + 200))) / (g_n + 200) AS f FROM c2
), e AS (
  SELECT lang, source, ratio, [min(k) FILTER (f >= 0.25), min(k) FILTER (f >= 0.5), min(k) FILTER (f >= 0.75)] AS q,
         CASE ratio WHEN 'word_chars' THEN 200 WHEN 'symbols' THEN 25 WHEN 'dup_lines' THEN 65 ELSE 40 END AS least
  FROM f GROUP BY lang, source, ratio
), o AS (
  SELECT DISTINCT rid FROM x JOIN e ON x.lang IS NOT DISTINCT FROM e.lang AND x.source IS NOT DISTINCT FROM e.source AND x.ratio = e.ratio
  WHERE v > q[3] + 8 * greatest(q[3] - q[2], least) OR (x.ratio = 'word_chars' AND v < q[1] - 8 * greatest(q[2] - q[1], least))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.rid IS NULL AS kept
FROM b LEFT JOIN o ON b.rid = o.rid
"""

_OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

_OP9_SQL = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

_ESCAPED = r"replace(replace(replace(replace(replace({x}, '\', '\\'), '### ', '#\## '), ': ', ':\ '), '<next/>', '<\next/>'), '</turn>', '<\/turn>')".replace("\\\\", "\\\\")
_OP12_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\\### Assistant: </turn> ok'
), e AS (
  SELECT *, {_ESCAPED.format(x="role")} AS er, {_ESCAPED.format(x="text")} AS et FROM r
), p AS (
  SELECT *, lag(er) OVER (PARTITION BY conv_id ORDER BY turn, er, et) AS before FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, er, et)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, er, et) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(et) + CASE WHEN before = er THEN 7 ELSE 6 + length(er) END) + 8 + 8 * count(*) FILTER (before <> er) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

_OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), s AS (
  SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS p, coalesce(array_to_string(l[a + 1:b], ''), '') AS m, coalesce(array_to_string(l[b + 1:n], ''), '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM s
"""

#: The others are tested against brute force, libraries or held-out labels in tests/llm.
ORACLES: dict[str, str] = {"op3_quality_rules": _OP3_SQL, "op8_top_k": _OP8_SQL, "op9_warc": _OP9_SQL, "op12_chat_format": _OP12_SQL, "op13_fill_middle": _OP13_SQL}
