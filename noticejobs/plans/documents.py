"""Queries over documents, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticejobs.functions import scalars as S
from noticejobs.operators import chat as C
from noticejobs.operators import nearest as V
from noticejobs.operators import rag as G
from noticejobs.operators import recommend as R
from noticejobs.operators import search as H
from noticejobs.operators import similar as N
from noticejobs.plans.registry import query
from noticejobs.sources import adapters as A

WORDS = "[w for w in regexp_split_to_array(lower({0}), '[^a-z0-9]+') if w <> '']"
KEYWORDS = {"exams": ("exam", "then"), "tenders": ("tender", "ing"), "policy": ("policy", "que"), "vacancies": ("vacan", "der")}


@query("SELECT id, title FROM rag_documents WHERE (contains(lower(title), 'thing') OR contains(lower(category), 'thing')) AND category = 'src3'", "rag_documents")
def p12_search_documents(spark, d):
    return G.search_documents(A.rag_documents(spark, d), "Thing", "src3").select("id", "title")


@query("SELECT id FROM rag_documents WHERE embedded", "rag_documents")
def p13_askable(spark, d):
    return G.askable_documents(A.rag_documents(spark, d)).select("id")


@query("SELECT count(*) FILTER (embedded) AS embedded, CAST(sum(chunk_count) FILTER (embedded) AS BIGINT) AS chunks, count(*) FILTER (NOT embedded) AS not_indexed FROM rag_documents", "rag_documents")
def a10_rag_stats(spark, d):
    return G.rag_stats(A.rag_documents(spark, d))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN NOT embedded ELSE embedded END AS embedded, CASE WHEN CASE WHEN id % 4 = 0 THEN NOT embedded ELSE embedded END THEN chunk_count ELSE 0 END AS chunk_count FROM rag_documents", "rag_documents")
def f28_toggle_embed(spark, d):
    docs = A.rag_documents(spark, d)
    return G.toggle_embed(docs, docs.filter("id % 4 = 0").select("id")).select("id", "embedded", "chunk_count")


@query("SELECT id, title FROM rag_documents ORDER BY title ASC, id", "rag_documents")
def t3_sort_documents(spark, d):
    return G.sort_documents(A.rag_documents(spark, d), "title").select("id", "title")


@query("""WITH n AS (SELECT id, content, greatest(1, CAST(ceil((length(content) - 50) / 450.0) AS BIGINT)) AS k FROM rag_documents WHERE length(content) > 0), c AS (SELECT id, content, unnest(generate_series(0, k - 1)) AS chunk_no FROM n)
    SELECT id AS doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, substr(content, chunk_no * 450 + 1, 500) AS text FROM c""", "rag_documents")
def f27_chunks(spark, d):
    return G.chunk_documents(A.rag_documents(spark, d)).select("doc_id", F.col("chunk_no").cast("long"), "text")


@query(f"""WITH w AS (SELECT id, {WORDS.format('content')} AS words FROM rag_documents), l AS (SELECT id, len(words) AS length, unnest(words) AS term FROM w), m AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w),
    q AS (SELECT id AS query_id, title AS query FROM rag_documents WHERE id % 20 = 0), qt AS (SELECT DISTINCT query_id, unnest({WORDS.format('query')}) AS term FROM q),
    p AS (SELECT term, id, length, count(*) AS tf FROM l WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    s AS (SELECT query_id, id AS chunk_id, round(sum(ln(1 + (m.n - f.df + 0.5) / (f.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m.mean))), 6) AS score FROM p JOIN f USING (term) JOIN qt USING (term), m GROUP BY 1, 2)
    SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""", "rag_documents")
def t8_keyword_retrieve(spark, d):
    docs = A.rag_documents(spark, d)
    queries = docs.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("title").alias("query"))
    return H.keyword_retrieve(docs, queries, 10).select("query_id", F.col("rank").cast("long"), "chunk_id", "score")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.v, c.v) AS score FROM e q JOIN e c ON true WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def t9_vector_topk(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return V.vector_topk(e.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), e, 10).select("query_id", F.col("rank").cast("long"), "chunk_id", "score")


@query("SELECT count(*) FILTER (vec_id % 20 = 0) AS queries, true AS reached FROM embeddings")
def t9_vector_cells(spark, d):
    """Whether the probed cells hold at least nine tenths of the best ten of the whole table."""
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"))
    queries = e.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = V.vector_topk(queries, e, 10).select("query_id", "chunk_id")
    near = V.probe_cells(V.build_cells(e, 32), queries, 10, 20).select("query_id", "chunk_id", F.lit(1).alias("found"))
    both = exact.join(near, ["query_id", "chunk_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.count("found") >= 0.9 * F.count("*")).alias("reached"))


@query("""WITH p AS (SELECT x.id AS a, y.id AS b, coalesce(CAST(x.organization = y.organization AS INT), 0) AS o, coalesce(CAST(x.category = y.category AS INT), 0) AS c, coalesce(len(list_intersect(x.tags, y.tags)), 0) AS t FROM rag_documents x JOIN rag_documents y ON x.id <> y.id WHERE x.id % 20 = 0),
    s AS (SELECT a, b, 2 * o + c + t AS score FROM p WHERE o > 0 OR t > 0)
    SELECT a AS id, CAST(rank AS BIGINT) AS rank, b AS related_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s) WHERE rank <= 3""", "rag_documents")
def j11_related_notices(spark, d):
    docs = A.rag_documents(spark, d)
    return R.related_notices(docs, 3, docs.filter("id % 20 = 0")).select("id", F.col("rank").cast("long"), "related_id", F.col("score").cast("long"))


@query(f"""WITH m AS (SELECT id, list_distinct({WORDS.format('content')}) AS words FROM chat_messages WHERE role = 'user' AND content IS NOT NULL),
    p AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.words, y.words)) AS c, len(x.words) + len(y.words) AS n FROM m x JOIN m y ON x.id <> y.id), s AS (SELECT a, b, round(c / (n - c), 6) AS jaccard FROM p WHERE c > 0)
    SELECT a AS id, CAST(rank AS BIGINT) AS rank, b AS related_id, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY jaccard DESC, b) AS rank FROM s) WHERE rank <= 3""", "chat_messages")
def j21_related_questions(spark, d):
    """Every question asks: ids are conversation * 1000 + turn, so those divisible by 20 would leave out all questions but a conversation's first."""
    return R.related_questions(A.chat_messages(spark, d), 3).select("id", F.col("rank").cast("long"), "related_id", "jaccard")


NEAR = r"""WITH w AS (SELECT id, [x for x in regexp_split_to_array(lower(content), '\s+') if x <> ''] AS w FROM rag_documents), h AS (SELECT id, list_sort(list_distinct([hash(array_to_string(w[i:i+4], ' ')) for i in range(1, len(w) - 3)])) AS s FROM w WHERE len(w) >= 5),
    c AS (SELECT s, min(id) AS a FROM h GROUP BY s), m AS (SELECT c.a, h.id AS b, 1.0 AS jaccard FROM h JOIN c ON h.s = c.s WHERE h.id <> c.a),
    q AS (SELECT x.a, y.a AS b FROM c x JOIN c y ON x.a < y.a AND least(len(x.s), len(y.s)) >= 0.8 * greatest(len(x.s), len(y.s))),
    z AS (SELECT q.a, q.b, len(list_intersect(x.s, y.s)) AS common, len(x.s) + len(y.s) AS total FROM q JOIN c x ON x.a = q.a JOIN c y ON y.a = q.b)
    SELECT a, b, round(common / (total - common), 6) AS jaccard FROM z WHERE round(common / (total - common), 6) >= 0.8 UNION ALL SELECT * FROM m"""


@query(NEAR, "rag_documents")
def j22_compare_documents(spark, d):
    return N.compare_documents(A.rag_documents(spark, d), 0.8)


@query(NEAR, "rag_documents")
def j22_near_documents(spark, d):
    """By banded MinHash."""
    return N.near_documents(A.rag_documents(spark, d), 0.8)


VOTES = {c: " + ".join(f"CAST(contains(lower(content), '{w}') AS INT)" for w in words) for c, words in KEYWORDS.items()}


@query(f"""WITH v AS (SELECT id, {', '.join(f'{v} AS {c}' for c, v in VOTES.items())} FROM rag_documents), t AS (SELECT *, {' + '.join(VOTES)} AS total, greatest({', '.join(VOTES)}) AS most FROM v)
    SELECT id, CASE WHEN total = 0 THEN NULL {' '.join(f"WHEN {c} = most THEN '{c}'" for c in VOTES)} END AS auto_category, CASE WHEN total > 0 THEN round(most / total, 6) ELSE 0.0 END AS confidence, CASE WHEN total > 0 THEN round(most / total, 6) ELSE 0.0 END < 0.5 AS to_moderation FROM t""", "rag_documents")
def f26_auto_categorize(spark, d):
    return G.auto_categorize(A.rag_documents(spark, d), KEYWORDS).select("id", "auto_category", "confidence", "to_moderation")


@query("SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, content AS question, lead(role) OVER w AS next_role, lead(content) OVER w AS answer FROM chat_messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'", "chat_messages")
def w9_pair_questions(spark, d):
    return C.pair_questions(A.chat_messages(spark, d))


@query("SELECT id, coalesce(array_to_string(list(content) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' | '), '') AS context FROM chat_messages", "chat_messages")
def w10_context_window(spark, d):
    return C.context_window(A.chat_messages(spark, d), 3).select("id", F.array_join("context", " | ").alias("context"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS questions, arg_min(content, turn) FILTER (role = 'user') AS first_question, arg_max(content, turn) FILTER (role = 'assistant') AS last_answer, max(turn) - min(turn) AS span FROM chat_messages GROUP BY 1", "chat_messages")
def a27_conversation_summary(spark, d):
    return C.conversation_summary(A.chat_messages(spark, d))


@query("SELECT concat('src', id % 7) AS source, count(*) AS citations FROM chat_messages WHERE role = 'assistant' GROUP BY 1", "chat_messages")
def a26_citation_counts(spark, d):
    rows = A.chat_messages(spark, d).filter("role = 'assistant'").withColumn("sources", F.array(F.concat(F.lit("src"), (F.col("id") % 7).cast("string"))))
    return C.citation_counts(rows)


ROUTE = " ".join("WHEN " + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + f" THEN '{name}'" for name, words in S.ROUTERS["notice"])


@query(f"SELECT CASE {ROUTE} ELSE 'fact' END AS kind, count(*) AS n FROM chat_messages WHERE role = 'user' GROUP BY 1", "chat_messages")
def f19_classify_questions(spark, d):
    return A.chat_messages(spark, d).filter("role = 'user'").groupBy(S.classify_question("content", S.ROUTERS["notice"], "fact").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT conv_id FROM chat_messages WHERE contains(lower(content), 'the')", "chat_messages")
def p19_search_conversations(spark, d):
    return C.search_conversations(A.chat_messages(spark, d), "The")
