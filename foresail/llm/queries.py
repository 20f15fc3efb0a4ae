"""Registered queries of the operators in this package, over the whole given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from foresail.llm import bpe, chat, hamming, lines, mixing, quality, runs, secrets, simhash, suffix_dedup, token_store, toxicity, vector_codes
from foresail.llm.common import settle_table, table
from foresail.session import scratch_path


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return chat.read_chat(chat.format_chat(turns, path), path, in_order=True)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_table(docs, quality.fit_rules(docs, table(spark, sf_dir, "labels")))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-shards")
    token_store.write_shards(token_store.token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), path)
    return token_store.document_checksums(token_store.read_shards(spark, path))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_passages(table(spark, sf_dir, "documents"))
    n_bytes = F.octet_length("text").cast("long")
    return found.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"),
                        F.shiftright(F.size("ranges"), 1).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = settle_table(hamming.sign_codes(table(spark, sf_dir, "embeddings")), "sign-codes")
    return hamming.top_k(codes, codes.where("id % 100 = 0"), k=10)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.removed_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_model(docs, labels.where(~toxicity.is_held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.made_periodic().alias("text"))
    found = runs.find_runs(docs).withColumn("best", runs.longest_run(F.col("runs")))
    lines_of = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                        F.sha2(F.array_join(lines_of, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.book_digest(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_chat_format, op3_simhash, op4_quality_rules, op5_token_store, op6_mixing, op7_suffix_dedup, op8_hamming_search, op9_bpe, op10_line_dedup,
                                     op11_toxicity, op12_periodic_runs, op13_vector_codes)}

SQL: dict[str, str] = {
    "op8_hamming_search": """
WITH c AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INTEGER) ELSE 0 END)) AS code FROM embeddings),
p AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id, CAST(bit_count(xor(CAST(q.code AS UBIGINT), CAST(n.code AS UBIGINT))) AS INTEGER) AS distance
      FROM c q JOIN c n ON q.vec_id <> n.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM p) WHERE rank <= 10
""",
    # Words ordered by how many distinct lines have them; pairs that share a word of their prefixes are verified whole.
    "op10_line_dedup": r"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, k - 1 AS line, list_sort(list_distinct(list_filter(regexp_split_to_array(ls[k], '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS ws
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM raw)),
s AS (SELECT row_number() OVER (ORDER BY min((doc_id, line))) AS s, ws, len(ws) AS n FROM l WHERE len(ws) > 0 GROUP BY ws),
w AS (SELECT s, n, unnest(ws) AS w FROM s),
f AS (SELECT w, count(*) AS f FROM w GROUP BY w),
p AS (SELECT * FROM (SELECT s, n, w.w, row_number() OVER (PARTITION BY s ORDER BY f, w.w) AS place FROM w JOIN f ON w.w = f.w) WHERE place <= n - ceil(n * 4 / 5) + 1),
c AS (SELECT DISTINCT a.s AS s, b.s AS o FROM p a JOIN p b ON a.w = b.w AND b.s < a.s AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
gone AS (SELECT DISTINCT c.s FROM c JOIN s a ON a.s = c.s JOIN s b ON b.s = c.o
         WHERE 5 * len(list_intersect(a.ws, b.ws)) >= 4 * (a.n + b.n - len(list_intersect(a.ws, b.ws)))),
r AS (SELECT doc_id, line FROM (SELECT l.doc_id, l.line, s.s, row_number() OVER (PARTITION BY s.s ORDER BY l.doc_id, l.line) AS k FROM l JOIN s ON l.ws = s.ws)
      WHERE k > 1 OR s IN (SELECT s FROM gone))
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, count(r.line) AS n_removed, coalesce(string_agg(CAST(r.line AS VARCHAR), ',' ORDER BY r.line), '') AS removed
FROM raw d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, len(d.ls)
""",
}
