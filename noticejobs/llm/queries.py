"""The registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticejobs.llm import byte_bpe, common, decision_list, infill, langid, licenses, minhash, nbsvm, packing, pii, runs, token_counts, topk, trie_join

SQL: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    stats = common.stored(decision_list.described(docs).drop("text"))
    rules = decision_list.learn(decision_list.labelled(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    failed = decision_list.base_failed()
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rules.rejects()).alias("kept"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = nbsvm.learn(docs, labels.filter(langid.fold(5) != 0))
    scored = nbsvm.score(docs, model)
    return scored.select("doc_id", (langid.fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_decode(documents(spark, sf_dir), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.detect(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), keep=("doc_id",))
    counts = [pii.count_kind(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    return rows.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("all_spans")).alias("spans"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


SQL["op8_exact_top_k"] = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.jaccard_groups(documents(spark, sf_dir), n=3, num=90, den=100)


#: All pairs; the columns of the contract for ids without nulls.
SQL["op9_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) END AS g FROM d),
h AS (SELECT doc_id, [hash(x) for x in g] AS g, len(g) AS n FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.g, y.g)) AS common, x.n + y.n AS n FROM h x JOIN h y ON x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) AND x.n > 0),
e AS (SELECT a, b FROM p WHERE 100 * common >= 90 * (n - common) UNION ALL SELECT b, a FROM p WHERE 100 * common >= 90 * (n - common)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM h UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, n AS n_shingles, component_id FROM h JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse(runs.find_runs(runs.with_planted_repeats(documents(spark, sf_dir))))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"))
    length = -F.col("top.size")
    return rows.select("doc_id", "n_runs", "top.start", length.alias("length"), "top.period", F.floor(1000 * length / F.col("top.period")).cast("long").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "class_id")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL["op13_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256(concat('1:', doc_id)) AS s FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
      least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y FROM h),
p AS (SELECT *, array_to_string(u[:x], '') AS a, array_to_string(u[x + 1:y], '') AS m, array_to_string(u[y + 1:], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', a, '<S>', z, '<M>', m) ELSE concat('<S>', z, '<P>', a, '<M>', m) END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_retrieval_packing, op4_quality_rules, op5_quality_classifier, op6_byte_bpe, op7_pii, op8_exact_top_k, op9_jaccard_join, op10_license_scan, op11_periodic_runs, op12_minhash_fingerprints, op13_fill_in_middle)}
