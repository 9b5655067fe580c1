"""Retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from .derive import CHUNKS_SQL, table, vector_chunks
from .stored import documents_index, saying_enough, vector_index

QUERY_ID, K, QUERY, EVERY = 3, 10, "the of", 100
TOKENS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
DENSE_SQL = "length(regexp_replace(text, '\\s', '', 'g')) >= 24"


def _query_vector(chunks: DataFrame, chunk_id: int = QUERY_ID) -> list[float]:
    """The vector of one chunk: a request's parameter."""
    return [float(x) for x in chunks.where(F.col("chunk_id") == chunk_id).select("embedding").first()[0]]


def _cos(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = vector_chunks(spark, sf_dir)
    return S.vector_arm(chunks, _query_vector(chunks), K).select("chunk_id", F.round("sim", 6).alias("sim"), F.col("r").cast("long").alias("r"))


VECTOR_TOPK = f"""WITH {CHUNKS_SQL}, q AS (SELECT embedding AS qv FROM chunks WHERE chunk_id = {QUERY_ID}),
s AS (SELECT chunk_id, {_cos("embedding", "qv")} AS sim FROM chunks, q)
SELECT chunk_id, round(sim, 6) AS sim, row_number() OVER (ORDER BY sim DESC, chunk_id) AS r FROM s ORDER BY sim DESC, chunk_id LIMIT {K}"""


def _governed(chunks: DataFrame, tiers: list[str]) -> DataFrame:
    return chunks.where((F.col("status") == "published") & (F.col("node_id") != 7) & F.coalesce(F.nullif("visibility", F.lit("")), F.lit("public")).isin(tiers))


def vector_topk_governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = vector_chunks(spark, sf_dir)
    top = S.vector_arm(_governed(chunks, ["public", "internal"]), _query_vector(chunks), K)
    return top.select("chunk_id", F.round("sim", 6).alias("sim"), F.col("r").cast("long").alias("r"))


GOVERNED = "status = 'published' AND node_id <> 7 AND coalesce(nullif(visibility, ''), 'public') IN ('public', 'internal')"
VECTOR_TOPK_GOVERNED = VECTOR_TOPK.replace("FROM chunks, q)", f"FROM chunks, q WHERE {GOVERNED})")


def _asked(chunks: DataFrame) -> DataFrame:
    """Every hundredth chunk as a question."""
    return chunks.where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"))


def vector_top1_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth chunk as a question the best similarity to another chunk that may be served."""
    chunks = vector_chunks(spark, sf_dir)
    best = S.search_many(_governed(chunks, ["public", "internal"]), _asked(chunks), 1, leave_out=True)
    return best.select("qid", F.round("sim", 6).alias("top1"))


VECTOR_TOP1_BATCH = f"""WITH {CHUNKS_SQL}, q AS (SELECT chunk_id AS qid, embedding AS qv FROM chunks WHERE chunk_id % {EVERY} = 0)
SELECT qid, round(max({_cos("embedding", "qv")}), 6) AS top1 FROM chunks, q WHERE {GOVERNED} AND chunk_id <> qid GROUP BY qid"""


def keyword_match_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir, "simple").hits(QUERY).select(F.col("chunk_id").alias("doc_id"))


KEYWORD_MATCH = f"SELECT doc_id FROM documents WHERE list_contains({TOKENS_SQL}, 'the') AND list_contains({TOKENS_SQL}, 'of')"


def websearch_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase, an exclusion and an alternative."""
    return documents_index(spark, sf_dir, "simple").hits('"of the" -is or el').select(F.col("chunk_id").alias("doc_id"))


WEBSEARCH_MATCH = f"""SELECT doc_id FROM (SELECT doc_id, {TOKENS_SQL} AS w FROM documents)
WHERE (contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AND NOT list_contains(w, 'is')) OR list_contains(w, 'el')"""


def keyword_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents by cover density."""
    top = documents_index(spark, sf_dir, "simple").arm(QUERY, k=20)
    return top.select("chunk_id", F.round("rank", 6).alias("rank"), F.col("r").cast("long").alias("r"))


def _hits_sql(of: str) -> str:
    """Covers of two words are their neighbouring uses: places of either, where the one before is the other."""
    return f"""SELECT chunk_id, round(sum(0.1::DOUBLE / (i - before)), 9) AS rank FROM (
  SELECT chunk_id, t, i, lag(t) OVER (PARTITION BY chunk_id ORDER BY i) AS other, lag(i) OVER (PARTITION BY chunk_id ORDER BY i) AS before
  FROM (SELECT chunk_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT chunk_id, {TOKENS_SQL} AS w FROM {of})) WHERE t IN ('the', 'of')) WHERE other <> t GROUP BY chunk_id"""


KEYWORD_RANK = f"WITH h AS ({_hits_sql('(SELECT doc_id AS chunk_id, text FROM documents)')}) SELECT chunk_id, round(rank, 6) AS rank, row_number() OVER (ORDER BY rank DESC, chunk_id) AS r FROM h ORDER BY rank DESC, chunk_id LIMIT 20"


def _servable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the arms may return: published, visible and undenied chunks with enough text."""
    return _governed(saying_enough(spark, sf_dir), ["public", "internal"])


def keyword_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems and their uses in all documents, as the English configuration stores them: of plain plurals and participles."""
    stored_ = documents_index(spark, sf_dir, "english")
    found = stored_.rows(list(ENGLISH)).groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("places")).alias("uses"))
    return found.select("term", "documents", "uses")


#: Stems and the words of each; the words below are stemmed by hand.
ENGLISH = {"hous": ("house", "houses", "housed", "housing"), "work": ("work", "works", "worked", "working"), "time": ("time", "times", "timed", "timing"), "water": ("water", "waters", "watered", "watering"), "peopl": ("people", "peoples", "peopled", "peopling")}
_WORDS = "[" + ", ".join(f"{{'term': '{stem}', 'word': '{w}'}}" for stem, words in ENGLISH.items() for w in words) + "]"
KEYWORD_ENGLISH = f"""SELECT s.term, count(DISTINCT doc_id) AS documents, count(*) AS uses FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS word FROM documents) JOIN (SELECT unnest({_WORDS}, recursive := true)) s USING (word) GROUP BY s.term"""


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _servable(spark, sf_dir)
    fused = S.fuse([S.vector_arm(rows, _query_vector(vector_chunks(spark, sf_dir))), documents_index(spark, sf_dir, "simple").arm(QUERY, rows)])
    return fused.select("chunk_id", F.round("score", 9).alias("score"))


_ARMS = f"""{CHUNKS_SQL}, rows_ AS (SELECT c.*, d.text FROM chunks c JOIN documents d ON d.doc_id = c.chunk_id WHERE {GOVERNED} AND {DENSE_SQL}),
q AS (SELECT embedding AS qv FROM chunks WHERE chunk_id = {QUERY_ID}),
vs AS (SELECT chunk_id, {_cos("embedding", "qv")} AS sim FROM rows_, q),
v AS (SELECT chunk_id, sim, row_number() OVER (ORDER BY sim DESC, chunk_id) AS r FROM vs QUALIFY r <= 30),
ks AS ({_hits_sql("rows_")}),
k AS (SELECT chunk_id, row_number() OVER (ORDER BY rank DESC, chunk_id) AS r FROM ks QUALIFY r <= 30),
f AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT chunk_id, r FROM v UNION ALL SELECT chunk_id, r FROM k) GROUP BY chunk_id)"""
RRF = f"WITH {_ARMS} SELECT chunk_id, round(score, 9) AS score FROM f"


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms over what may be served, fused; the ten best with their nodes."""
    best = S.hybrid(_servable(spark, sf_dir), _query_vector(vector_chunks(spark, sf_dir)), QUERY, K, index=documents_index(spark, sf_dir, "simple"))
    names = vector_chunks(spark, sf_dir).select("chunk_id", "node_id")
    return names.join(F.broadcast(best), "chunk_id").select("chunk_id", "node_id", F.round("score", 9).alias("score"), F.round("top_vec_sim", 6).alias("top_vec_sim"))  # best: K rows


HYBRID = f"""WITH {_ARMS} SELECT f.chunk_id, c.node_id, round(f.score, 9) AS score, (SELECT round(max(sim), 6) FROM v) AS top_vec_sim
FROM (SELECT * FROM f ORDER BY score DESC, chunk_id LIMIT {K}) f JOIN chunks c USING (chunk_id)"""


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth chunk as a question the ten nearest others that may be served, by the index: what the scan finds."""
    chunks = vector_chunks(spark, sf_dir)
    allowed = _governed(chunks, ["public", "internal"]).select("chunk_id")
    best, _ = vector_index(spark, sf_dir).search_many(_asked(chunks), K, allowed, leave_out=True)
    return best.select("qid", "chunk_id", F.round("sim", 6).alias("sim"), F.col("r").cast("long").alias("r"))


VECTOR_INDEX = f"""WITH {CHUNKS_SQL}, q AS (SELECT chunk_id AS qid, embedding AS qv FROM chunks WHERE chunk_id % {EVERY} = 0),
s AS (SELECT qid, chunk_id, round({_cos("embedding", "qv")}, 12) AS sim FROM chunks, q WHERE {GOVERNED} AND chunk_id <> qid)
SELECT qid, chunk_id, round(sim, 6) AS sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, chunk_id) AS r FROM s QUALIFY r <= {K}"""


def abstention_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = vector_top1_batch(spark, sf_dir)
    return top.select("qid", "top1", S.abstains(F.col("top1"), 0.5).alias("abstained"), S.abstains(F.col("top1"), None).alias("abstained_without_floor"), S.keyword_abstains(F.col("top1"), 0.6).alias("keyword_abstained"))


ABSTENTION = f"SELECT qid, top1, (top1 IS NULL OR top1 < 0.5) AS abstained, false AS abstained_without_floor, (top1 IS NULL OR top1 < 0.6) AS keyword_abstained FROM ({VECTOR_TOP1_BATCH})"


def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 hits of each question, in 20,000 characters of their texts."""
    chunks = vector_chunks(spark, sf_dir)
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.length("text").cast("long").alias("chars"))
    hits = S.search_many(_governed(chunks, ["public", "internal"]), _asked(chunks), leave_out=True).join(sizes, "chunk_id")
    out = S.packed(hits.select("qid", "r", "chars", "chunk_id"), 20_000)
    return out.select("qid", F.col("r").cast("long").alias("r"), "chars", "chunk_id")


BUDGET = f"""WITH RECURSIVE {CHUNKS_SQL}, s AS (SELECT q.chunk_id AS qid, c.chunk_id, row_number() OVER (PARTITION BY q.chunk_id ORDER BY round({_cos("c.embedding", "q.embedding")}, 12) DESC, c.chunk_id) AS r
  FROM chunks q, (SELECT * FROM chunks WHERE {GOVERNED}) c WHERE q.chunk_id % {EVERY} = 0 AND c.chunk_id <> q.chunk_id QUALIFY r <= 30),
h AS (SELECT qid, r, chunk_id, length(text)::BIGINT AS chars, row_number() OVER (PARTITION BY qid ORDER BY r) AS n FROM s JOIN documents ON doc_id = chunk_id),
p AS (SELECT qid, n, r, chars, chunk_id, chars AS used, true AS ships FROM h WHERE n = 1
  UNION ALL SELECT h.qid, h.n, h.r, h.chars, h.chunk_id, p.used + CASE WHEN p.used + h.chars <= 20000 THEN h.chars ELSE 0 END, p.used + h.chars <= 20000 FROM p JOIN h ON h.qid = p.qid AND h.n = p.n + 1)
SELECT qid, r, chars, chunk_id FROM p WHERE ships"""

QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_governed, vector_top1_batch, keyword_match_all_terms, websearch_match, keyword_rank_topk, keyword_english, rrf_fusion, hybrid_search, vector_index_topk, abstention_gate, budget_pack)}
ORACLE_SQL = {
    "vector_topk": VECTOR_TOPK,
    "vector_topk_governed": VECTOR_TOPK_GOVERNED,
    "vector_top1_batch": VECTOR_TOP1_BATCH,
    "keyword_match_all_terms": KEYWORD_MATCH,
    "websearch_match": WEBSEARCH_MATCH,
    "keyword_rank_topk": KEYWORD_RANK,
    "keyword_english": KEYWORD_ENGLISH,
    "rrf_fusion": RRF,
    "hybrid_search": HYBRID,
    "vector_index_topk": VECTOR_INDEX,
    "abstention_gate": ABSTENTION,
    "budget_pack": BUDGET,
}
