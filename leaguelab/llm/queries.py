"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit_packing import packed_documents
from .bond_mining import hard_negatives
from .cover_tree_search import top_k
from .decontamination import contaminated
from .host_rules import judged_documents
from .language_id import detect_languages, train
from .line_dedup import dedup_lines
from .periodic_runs import periodic_runs
from .shared import in_train, shared_path, table
from .simhash_bktree import simhash_components
from .suffix_dedup import repeated_spans
from .toxicity import toxicity_scores
from .url_filter import Rule, judge_urls
from .token_orc import token_digests, write_token_orc

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
PIECES = public_tokenizers.path("piece_bpe_32k.model")


URL_RULES = [
    Rule.parse("allow", "org/"),
    Rule.parse("block", "example.org/es/"),
    Rule.parse("block", "example.org/en/1"),
    Rule.parse("allow", "com/fr/"),
    Rule.parse("block", "com/de/"),
]


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The URLs that a rule decides are the labelled ones the trees learn from."""
    return judge_urls(table(spark, folder, "pages"), None, URL_RULES)


def op2_cover_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256)


def op3_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "token-orc")
    write_token_orc(table(spark, folder, "documents"), path, WORD_TOKENIZER, END_ID)
    return token_digests(spark, path)


def op4_simhash_bktree(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_components(table(spark, folder, "documents"), width=3, radius=2)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.col("spans")
    removed = F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    return repeated_spans(table(spark, folder, "documents"), length=400).select(
        "doc_id", "n_bytes", removed.alias("n_removed"),
        (F.size(spans) / 2).cast("long").alias("n_spans"), "kept_sha256",
    )


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(table(spark, folder, "documents"), BYTE_TOKENIZER, END_ID)


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(docs.where(in_train(F.col("doc_id"), 4, 2)).select("text", "lang"), PIECES)
    return detect_languages(docs, model).select(
        "doc_id", (~in_train(F.col("doc_id"), 4, 2)).alias("held_out"), "lang_pred", "score"
    )


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").where(in_train(F.col("doc_id"), 5, 0))
    scores = toxicity_scores(table(spark, folder, "documents"), labels)
    return scores.select(
        "doc_id", (~in_train(F.col("doc_id"), 5, 0)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, the text that is left, and the number of removed lines."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_words=8)


def op11_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The host of a document is its source."""
    return judged_documents(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "host", "host_rejected",
    )


def op12_bond_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings"), "vec_id % 100 = 0", label)


def repeating_documents(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents the words from one on repeat (fixed rule)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    some = docs.select(
        "doc_id", "text", (F.floor(h / 10)).alias("g"),
        F.when(h % 10 == 0, words).alias("words"),
    ).withColumn("n", F.size("words"))
    some = some.withColumn("a", F.pmod(F.col("g"), F.greatest("n", F.lit(1))).cast("int"))
    some = some.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    repeated = F.concat(
        F.slice("words", F.lit(1), F.col("a")), F.slice(cycle, F.lit(1), F.col("n") - F.col("a"))
    )
    return some.select(
        "doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text")
    )


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = repeating_documents(table(spark, folder, "documents"))
    line = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    best = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    found = periodic_runs(docs, min_exponent=4, min_length=6).withColumn("best", best)
    length, period = -F.col("best.col1"), F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_cover_tree_search": op2_cover_tree_search,
    "op3_token_orc": op3_token_orc,
    "op4_simhash_bktree": op4_simhash_bktree,
    "op5_decontamination": op5_decontamination,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_host_rules": op11_host_rules,
    "op12_bond_negatives": op12_bond_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}
SQL: dict[str, str] = {
    "op2_cover_tree_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id
  WHERE q.vec_id % 50 = 0
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_host_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, source AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
windows AS (
  SELECT row_no, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT row_no, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)
),
often AS (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, w) AS n FROM windows),
covered AS (
  SELECT row_no, count(DISTINCT i + s) AS n FROM often, (VALUES (0), (1), (2)) shifts(s) WHERE n >= 2 GROUP BY row_no
),
counts AS (
  SELECT d.doc_id, d.host, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered c USING (row_no)
),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
),
hosts AS (
  SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(base_failed AS INTEGER)) AS DOUBLE) AS f
  FROM judged GROUP BY host
),
sums AS (
  SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS mean, sum(n * n) AS n2, sum(f * f / n) AS spread FROM hosts
),
moments AS (
  SELECT mean, mean * (1 - mean) * (n - n2 / n - (k - 1)) AS room,
    spread - n * mean * mean - mean * (1 - mean) * (k - 1) AS extra
  FROM sums
),
prior AS (
  SELECT mean, CASE WHEN room <= 0 OR extra <= 0 THEN 10000.0
    ELSE least(greatest((1 - extra / room) / (extra / room), 2.0), 10000.0) END AS strength
  FROM moments
),
verdicts AS (
  SELECT host, (f + mean * strength) / (n + strength) > 0.5 AS host_rejected FROM hosts, prior
)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT host_rejected AS kept, j.host, host_rejected
FROM judged j JOIN verdicts v ON j.host IS NOT DISTINCT FROM v.host""",
    "op12_bond_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v d ON a.vec_id <> d.vec_id
  WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM scores WHERE same
),
ranked AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, place ORDER BY score DESC, vec_id) AS rank
  FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
  WHERE place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5""",
}
