"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhire.llm import bpe, collocations, exact_topk, hard_negatives, packing, parity_join, quality_fm, repetition, secret_scan, sharding, token_counts, toxicity_crf, url_filter
from tallyhire.llm.common import held_out, read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality_fm.train(docs, read(spark, sf_dir, "labels"), metadata=("n_chars",))
    scored = quality_fm.score(docs, machine, metadata=("n_chars",))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(read(spark, sf_dir, "documents"), BYTE_BPE)


#: Given rules for hosts and paths.
HOST_RULES = [
    url_filter.HostRule("net", "/", url_filter.BLOCK), url_filter.HostRule("example.net", "/en/", url_filter.ALLOW),
    url_filter.HostRule("example.com", "/de/", url_filter.BLOCK), url_filter.HostRule("org", "/fr/", url_filter.ALLOW),
]  # fmt: skip


def op3_association_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), HOST_RULES)


def op4_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), BYTE_BPE)


def op5_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return exact_topk.top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""


def op6_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.repetition_coverage(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "dup_line_chars",
        *(F.col("dup_ngram_chars")[k].alias(f"dup_{n}gram_chars") for k, n in enumerate(repetition.NGRAM_LIMITS)), "base_failed", "kept",
    )  # fmt: skip


def op6_sql() -> str:
    limits = repetition.NGRAM_LIMITS
    grams = ", ".join(f"CASE WHEN i <= n - {k - 1} THEN " + " || ' ' || ".join(["w", *(f"lead(w, {j}) OVER o" for j in range(1, k))]) + f" END AS g{k}" for k in limits)
    twice = ", ".join(f"CASE WHEN g{k} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{k}) > 1 THEN 1 ELSE 0 END AS d{k}" for k in limits)
    cover = ", ".join(f"max(d{k}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS c{k}" for k in limits)
    sums = ", ".join(f"sum(c{k} * length(w))::BIGINT AS s{k}" for k in limits)
    kept = " AND ".join(f"100 * coalesce(s{k}, 0) <= {round(100 * x)} * word_chars" for k, x in limits.items())
    return rf"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM base),
grams AS (SELECT r, w, i, {grams} FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, w, i, {twice} FROM grams),
cover AS (SELECT r, w, {cover} FROM twice),
sums AS (SELECT r, sum(c5)::BIGINT AS repeat_words, {sums} FROM cover GROUP BY r),
split AS (SELECT r, string_split(t, chr(10)) AS ls FROM base),
lines AS (SELECT r, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM split),
ranked AS (SELECT r, l, row_number() OVER (PARTITION BY r, l ORDER BY i) AS k FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, sum(length(l))::BIGINT AS line_chars, count(*) FILTER (k > 1) AS dup_lines, coalesce(sum(length(l)) FILTER (k > 1), 0)::BIGINT AS dup_chars FROM ranked GROUP BY r),
one AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(dup_chars, 0)::BIGINT AS dup_line_chars, {", ".join(f"coalesce(s{k}, 0)::BIGINT AS s{k}" for k in limits)}
  FROM base LEFT JOIN sums USING (r) LEFT JOIN dups USING (r)),
judged AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM one)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_chars, dup_line_chars, {", ".join(f"s{k} AS dup_{k}gram_chars" for k in limits)}, base_failed,
  NOT base_failed AND 100 * dup_line_chars <= {round(100 * repetition.LINE_LIMIT)} * line_chars AND {kept} AS kept
FROM judged"""


def op7_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op8_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), PIECES)


def op9_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    field = toxicity_crf.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity_crf.score(docs, field, spans="spans")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op10_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY 1) USING (doc_id)"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')), '[^ 	]+') AS ws FROM documents),
grams AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m))),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30 OR m = 1),
c AS MATERIALIZED (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 30),
cut AS (SELECT c.*, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m),
scored AS (SELECT cut.lang, cut.m, cut.phrase, cut.a, k, fl.a AS l, fr.a AS r, (2000000::HUGEINT * cut.a // (fl.a + fr.a))::BIGINT AS score FROM cut JOIN f fl ON fl.lang = cut.lang AND fl.phrase = x JOIN f fr ON fr.lang = cut.lang AND fr.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS by_longer FROM (SELECT c.*, s, unnest(range(1, m - s + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS s) WHERE s < m) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE by_longer IS NULL OR 100::HUGEINT * by_longer < 80::HUGEINT * a),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
r AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.nth ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.nth <= 5 AND p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10"""


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_factorisation_machine, op2_forced_boundary_bpe, op3_association_url_filter, op4_cutting_stock_packing,
        op5_histogram_topk, op6_repetition_coverage, op7_label_propagation_shards, op8_trie_token_counts, op9_toxicity_crf,
        op10_parity_sketch_join, op11_collocations, op12_hard_negatives, op13_secret_scan,
    )
}  # fmt: skip

ORACLE_SQL: dict[str, str] = {"op5_histogram_topk": OP5_SQL, "op6_repetition_coverage": op6_sql(), "op10_parity_sketch_join": OP10_SQL, "op11_collocations": OP11_SQL, "op12_hard_negatives": OP12_SQL}
