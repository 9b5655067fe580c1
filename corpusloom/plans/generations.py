"""Generation, calibration and quality queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHUNK_POLICY, HARD_MAX_CHARS, MIN_CONTENT_CHARS
from ..durable import Scratch
from ..functions import text as X
from ..operators import calibration as E
from ..operators import digests
from ..operators import generations as V
from ..operators import quality as Q
from ..operators import search as S
from ..operators.vectors import VectorStore
from .derive import CHUNKS_SQL, NODES_SQL, generation, generation_sql, table, tree_nodes, vector_chunks
from .stored import stored

MODEL = "fake"
GOVERNED = ("visibility", "doc_status", "owner", "provenance", "superseded_by")


def _chunks(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    rows = generation(spark, sf_dir, number).withColumn("_c", F.explode(X.ceiling_slices(F.col("content"), HARD_MAX_CHARS)))
    return rows.select("generation", F.concat("stable_id", F.lit(":prose")).alias("source_id"), F.col("_c.ordinal").alias("ordinal"), F.sha2("_c.content", 256).alias("chunk_hash"), F.lit("").alias("heading_path_text"), "title", "position", "old_status")


def _chunks_sql(n: int) -> str:
    return f"""chunks{n} AS (SELECT generation, stable_id || ':prose' AS source_id, o AS ordinal, sha256(substr(content, o * {HARD_MAX_CHARS} + 1, {HARD_MAX_CHARS})) AS chunk_hash, '' AS heading_path_text, title, position, old_status
  FROM (SELECT *, unnest(range(greatest(ceil(length(content) / {HARD_MAX_CHARS})::BIGINT, 1))) AS o FROM gen{n}))"""


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _chunks(spark, sf_dir, 1)
    vector = F.when(F.col("old_status") == "embedded", F.array(F.col("position").cast("double")))
    return old.select(*V.MATCH, vector.alias("embedding"), F.lit(MODEL).alias("embedding_model"), "generation", F.lit(0).alias("priority"))


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.carried(_chunks(spark, sf_dir, 2), _old(spark, sf_dir), MODEL)
    return out.select("source_id", F.col("ordinal").cast("long").alias("ordinal"), F.when(F.col("embedding").isNull(), "pending").otherwise("embedded").alias("embedding_status"), "carried_from")


CARRY = f"""WITH {generation_sql(1)}, {generation_sql(2)}, {_chunks_sql(1)}, {_chunks_sql(2)},
old AS (SELECT DISTINCT source_id, chunk_hash, heading_path_text, title, generation FROM chunks1 WHERE old_status = 'embedded')
SELECT n.source_id, n.ordinal, CASE WHEN o.generation IS NULL THEN 'pending' ELSE 'embedded' END AS embedding_status, o.generation AS carried_from
FROM chunks2 n LEFT JOIN old o ON n.source_id IS NOT DISTINCT FROM o.source_id AND n.chunk_hash IS NOT DISTINCT FROM o.chunk_hash AND n.heading_path_text IS NOT DISTINCT FROM o.heading_path_text AND n.title IS NOT DISTINCT FROM o.title"""


def carry_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two old generations: the active one (without every fifth document) before an older one."""
    old = _old(spark, sf_dir)
    active = old.where(F.get("embedding", F.lit(0)) % 5 != 0)
    older = old.withColumn("generation", F.lit(0).cast("long")).withColumn("priority", F.lit(1))
    return V.carried(_chunks(spark, sf_dir, 2), active.unionByName(older), MODEL).groupBy("carried_from").agg(F.count(F.lit(1)).alias("chunks"))


CARRY_PRIORITY = f"""WITH {generation_sql(1)}, {generation_sql(2)}, {_chunks_sql(1)}, {_chunks_sql(2)},
old AS (SELECT source_id, chunk_hash, title, CASE WHEN position % 5 <> 0 THEN 1 ELSE 0 END::BIGINT AS generation FROM chunks1 WHERE old_status = 'embedded'),
best AS (SELECT source_id, chunk_hash, title, max(generation) AS generation FROM old GROUP BY ALL)
SELECT b.generation AS carried_from, count(*) AS chunks FROM chunks2 n LEFT JOIN best b ON n.source_id = b.source_id AND n.chunk_hash = b.chunk_hash AND n.title = b.title GROUP BY b.generation"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("generation") == 1, F.col("old_status")).when(F.col("position") % 13 == 0, F.lit("pending")).otherwise(F.lit("embedded"))
    return _chunks(spark, sf_dir, 1).unionByName(_chunks(spark, sf_dir, 2)).withColumn("embedding_status", status)


def generation_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.health(_statuses(spark, sf_dir))


HEALTH = f"""WITH {generation_sql(1)}, {generation_sql(2)}, {_chunks_sql(1)}, {_chunks_sql(2)},
s AS (SELECT generation, old_status AS st FROM chunks1 UNION ALL SELECT generation, CASE WHEN position % 13 = 0 THEN 'pending' ELSE 'embedded' END FROM chunks2)
SELECT generation, count(*) AS total, count(*) FILTER (st = 'pending') AS pending, count(*) FILTER (st = 'embedded') AS embedded, count(*) FILTER (st = 'failed') AS failed FROM s GROUP BY generation"""


def ready_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation_health(spark, sf_dir).select("generation", V.ready(F.col("pending"), F.col("embedded"), F.col("failed")).alias("ready"))


READY = f"SELECT generation, pending = 0 AND embedded > 0 AND failed / nullif(embedded + failed, 0) <= 0.02 AS ready FROM ({HEALTH})"


def _sources(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    g = generation(spark, sf_dir, n)
    return g.select("stable_id", X.content_hash(F.col("content")).alias("content_hash"), "title", "position", X.node_slug(F.col("title")).alias("slug"), F.lit("document").alias("kind"), F.col("folder").alias("parent_id"), *GOVERNED, F.lit(CHUNK_POLICY).alias("chunk_policy"), F.lit(MODEL).alias("embedding_model"))


def same_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the two generations: contents, places and governance, null-safe."""
    return V.difference(_sources(spark, sf_dir, 2), _sources(spark, sf_dir, 1)).groupBy("side").agg(F.count(F.lit(1)).alias("rows"), F.min("stable_id").alias("first_id"))


_SRC = "SELECT stable_id, sha256(content) AS h, title, position, folder, visibility, doc_status, owner, array_to_string(provenance, '|') AS provenance, superseded_by FROM gen{}"
SAME = f"""WITH {generation_sql(1)}, {generation_sql(2)}, d AS (SELECT 'only_new' AS side, * FROM ({_SRC.format(2)} EXCEPT ALL {_SRC.format(1)}) UNION ALL SELECT 'only_old', * FROM ({_SRC.format(1)} EXCEPT ALL {_SRC.format(2)}))
SELECT side, count(*) AS rows, min(stable_id) AS first_id FROM d GROUP BY side"""


def governance_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents with the same text, title and place in both generations, those whose governance changed."""
    same = ("stable_id", "content_hash", "title", "position", "slug", "kind", "parent_id", "chunk_policy", "embedding_model")
    new, old = _sources(spark, sf_dir, 2), _sources(spark, sf_dir, 1)
    rows = V.difference(new, old).where("side = 'only_new'").join(old.select(*same), list(same), "left_semi")
    return rows.select("stable_id", "visibility", "owner")


DRIFT = f"""WITH {generation_sql(1)}, {generation_sql(2)} SELECT n.stable_id, n.visibility, n.owner FROM gen2 n JOIN gen1 o ON n.stable_id = o.stable_id AND n.content = o.content AND n.title = o.title AND n.position = o.position AND n.folder = o.folder
WHERE n.visibility IS DISTINCT FROM o.visibility OR n.doc_status IS DISTINCT FROM o.doc_status OR n.owner IS DISTINCT FROM o.owner OR n.provenance IS DISTINCT FROM o.provenance OR n.superseded_by IS DISTINCT FROM o.superseded_by"""


def digest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the generations, found by their trees of digests."""

    def tree(number: int) -> digests.Tree:
        def build() -> digests.Tree:
            folder = Scratch.of(spark).folder()
            digests.write(_sources(spark, sf_dir, number), folder, bits=digests.LEVEL_BITS)  # few rows: 16 leaves
            return digests.Tree(spark, folder)

        return stored(spark, sf_dir, f"digests-{number}", build)

    return digests.compared(tree(2), tree(1))[0].select("stable_id", "side")


_COMPARED = "stable_id, title, content, folder, position, visibility, doc_status, owner, provenance, superseded_by"
DIGEST_DIFFERENCE = f"""WITH {generation_sql(1)}, {generation_sql(2)} SELECT stable_id, 'only_new' AS side FROM (SELECT {_COMPARED} FROM gen2 EXCEPT ALL SELECT {_COMPARED} FROM gen1)
UNION ALL SELECT stable_id, 'only_old' FROM (SELECT {_COMPARED} FROM gen1 EXCEPT ALL SELECT {_COMPARED} FROM gen2)"""


def flip_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.flip_delta(generation(spark, sf_dir, 2), generation(spark, sf_dir, 1))


FLIP = f"""WITH {generation_sql(1)}, {generation_sql(2)} SELECT stable_id, 'added' AS change FROM (SELECT stable_id FROM gen2 EXCEPT SELECT stable_id FROM gen1)
UNION ALL SELECT stable_id, 'removed' FROM (SELECT stable_id FROM gen1 EXCEPT SELECT stable_id FROM gen2)"""


def shrink_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = generation(spark, sf_dir, 1)
    return V.shrink(generation(spark, sf_dir, 2).where("position % 4 <> 1"), g)


SHRINK = f"""WITH {generation_sql(1)}, {generation_sql(2)}, n AS (SELECT (SELECT count(DISTINCT stable_id) FROM gen2 WHERE position % 4 <> 1) AS new, (SELECT count(DISTINCT stable_id) FROM gen1) AS old)
SELECT new, old, greatest(old - new, 0) / old AS lost_share, greatest(old - new, 0) / old > 0.15 AS refused FROM n"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from events: a user is a tenant, each event a generation."""
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "click", "retired").when(F.col("event_type") == "view", "ready").when(F.col("event_type") == "error", "building").when(F.col("event_type") == "signup", "abandoned").otherwise("retired")
    return e.select(F.col("user_id").alias("tenant"), F.col("event_id").alias("generation"), state.alias("state"), F.col("ts").alias("finished_at"), F.col("ts").alias("heartbeat_at"), (F.col("event_id") % 17 == 0).alias("pointed"))


NOW = "2030-01-01 00:00:00"


def gc_collectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.collectable(_runs(spark, sf_dir), F.lit(NOW).cast("timestamp"))


GC = f"""WITH runs AS (SELECT user_id AS tenant, event_id AS generation, CASE event_type WHEN 'click' THEN 'retired' WHEN 'view' THEN 'ready' WHEN 'error' THEN 'building' WHEN 'signup' THEN 'abandoned' ELSE 'retired' END AS state, ts, event_id % 17 = 0 AS pointed FROM events),
c AS (SELECT *, count(*) FILTER (state IN ('ready', 'active', 'retired')) OVER (PARTITION BY tenant) AS complete FROM runs),
o AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY generation) AS n FROM c WHERE NOT pointed AND state IN ('ready', 'retired', 'abandoned') AND ts <= TIMESTAMP '{NOW}' - INTERVAL 40 MINUTE)
SELECT tenant, generation FROM c WHERE state = 'building' AND ts < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR UNION ALL SELECT tenant, generation FROM o WHERE n <= complete - 2"""


def node_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.centroids(vector_chunks(spark, sf_dir).withColumn("node_id", F.col("node_id").cast("long")))
    return c.select("node_id", "chunk_count", F.posexplode("centroid").alias("i", "x")).select("node_id", "chunk_count", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


CENTROIDS = """WITH e AS (SELECT label::BIGINT AS node_id, i - 1 AS i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) AS r(i)), n AS (SELECT label::BIGINT AS node_id, count(*) AS chunk_count FROM embeddings GROUP BY 1)
SELECT node_id, chunk_count, i, round(avg(x), 6) AS x FROM e JOIN n USING (node_id) GROUP BY ALL"""


def unsearchable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per folder the documents with too little text to be found."""
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), "lang").alias("source_id"), "text")
    return V.unsearchable(d, X.dense_length(F.col("text")) >= MIN_CONTENT_CHARS)


UNSEARCHABLE = "SELECT source_id, count(*) AS chunks, count(*) FILTER (n >= 24) AS servable, count(*) FILTER (n >= 24) = 0 AS invisible FROM (SELECT source || '-' || lang AS source_id, length(regexp_replace(text, '[\\s]', '', 'g')) AS n FROM documents) GROUP BY source_id"


def vector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second generation finds in the store that the first one filled, by text and title alone, and what is embedded anew."""
    key = F.concat("title", F.lit("\n\n"), "chunk_hash").alias("input")
    store = VectorStore(spark, Scratch.of(spark).folder(), "t", "c", MODEL, 2)

    def embed(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.array(F.lit(1.0), F.length("input").cast("double")).alias("embedding"), F.lit("embedded").alias("embedding_status"), F.lit(None).cast("string").alias("embed_error"))

    with Scratch(spark) as scratch:
        first = _chunks(spark, sf_dir, 1).where("old_status = 'embedded'").select(key)
        store.embedded(first, embed, 1, scratch=scratch)
    rows = store.embedded(_chunks(spark, sf_dir, 2).select("source_id", F.col("ordinal").cast("long").alias("ordinal"), key), embed, 2)
    return rows.select("source_id", "ordinal", "carried_from", F.get("embedding", F.lit(1)).cast("long").alias("n"))


VECTOR_LOOKUP = f"""WITH {generation_sql(1)}, {generation_sql(2)}, {_chunks_sql(1)}, {_chunks_sql(2)},
old AS (SELECT DISTINCT coalesce(title || chr(10) || chr(10) || chunk_hash, '') AS input FROM chunks1 WHERE old_status = 'embedded'), new AS (SELECT *, coalesce(title || chr(10) || chr(10) || chunk_hash, '') AS input FROM chunks2)
SELECT n.source_id, n.ordinal, CASE WHEN o.input IS NOT NULL THEN 1 END::BIGINT AS carried_from, length(n.input) AS n FROM new n LEFT JOIN old o USING (input)"""


def passage_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passages of each source and language that may be asked about; what is not embedded, drafts, lists of links and denied nodes are left out."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        i.alias("chunk_id"), F.concat("source", F.lit("-"), "lang").alias("node_id"), F.col("text").alias("content"),
        F.when(i % 7 == 0, "pending").otherwise("embedded").alias("embedding_status"), F.when(i % 5 == 0, "nav").otherwise("prose").alias("source_type"), F.when(i % 11 == 0, "draft").otherwise("published").alias("status"),
    )
    denied = d.where(F.col("node_id").endswith("-de")).select("node_id")
    return E.passages(d, denied, 3).select("node_id", "chunk_id", F.col("n").cast("long").alias("n"))


PASSAGES = """SELECT source || '-' || lang AS node_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY source || '-' || lang ORDER BY md5(text), doc_id) AS n FROM documents
WHERE length(regexp_replace(text, '\\s', '', 'g')) >= 200 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 11 <> 0 AND lang <> 'de' QUALIFY n <= 3"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each labelled document; good ones are in the corpus."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("in_corpus"))
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(d, "doc_id").select("doc_id", "in_corpus", ((F.col("n_chars") % 97 + F.col("in_corpus").cast("int") * 60) / 200.0).cast("double").alias("score"))


POINTS_SQL = "points AS (SELECT doc_id, quality = 1 AS in_corpus, ((n_chars % 97 + (quality = 1)::INT * 60) / 200.0::DOUBLE)::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
CURVE_SQL = f"""{POINTS_SQL}, f AS (SELECT DISTINCT score AS floor FROM points), n AS (SELECT count(*) AS all_, count(*) FILTER (in_corpus) AS all_in FROM points),
t AS (SELECT floor, count(*) AS served, count(*) FILTER (in_corpus) AS tp FROM f JOIN points ON score >= floor GROUP BY floor),
curve AS (SELECT floor, served, served / all_ AS coverage, (served - tp) / served AS risk, (all_in - tp) / all_in AS false_abstention, tp / served AS precision FROM t, n)"""


def risk_coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, 9).alias(c) for c in ("coverage", "risk", "false_abstention", "precision")]
    return E.curve(_points(spark, sf_dir)).select("floor", "served", *rounded)


RISK = f"WITH {CURVE_SQL} SELECT floor, served, round(coverage, 9) AS coverage, round(risk, 9) AS risk, round(false_abstention, 9) AS false_abstention, round(precision, 9) AS precision FROM curve"


def aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.aurc(E.curve(_points(spark, sf_dir))).select(F.round("aurc", 9).alias("aurc"))


AURC = f"WITH {CURVE_SQL}, s AS (SELECT coverage, risk, lag(coverage, 1, 0) OVER (ORDER BY coverage) AS c0, lag(risk, 1, 0) OVER (ORDER BY coverage) AS r0 FROM curve) SELECT round(sum((coverage - c0) * (risk + r0) / 2), 9) AS aurc FROM s"


def floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.floors(_points(spark, sf_dir))


FLOORS = f"WITH {CURVE_SQL} SELECT (SELECT min(score) FROM points WHERE in_corpus) AS zero_false_abstention, (SELECT floor FROM curve WHERE precision >= 0.95 ORDER BY coverage DESC, floor DESC LIMIT 1) AS target_floor"


def paste_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor to declare for the labelled documents."""
    m = E.margin(_points(spark, sf_dir)).first()
    value, apart = E.paste_value(m["lowest_in"], m["highest_out"])
    return spark.createDataFrame([(value, apart)], "paste_value double, separable boolean")


PASTE = f"WITH {POINTS_SQL}, m AS (SELECT min(score) FILTER (in_corpus) AS lo, max(score) FILTER (NOT in_corpus) AS hi FROM points) SELECT CASE WHEN hi < lo THEN round((hi + lo) / 2, 3) ELSE lo END AS paste_value, hi < lo AS separable FROM m"


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.overlapping(_points(spark, sf_dir)).select("doc_id", "score")


OVERLAP = f"WITH {POINTS_SQL} SELECT doc_id, score FROM points WHERE NOT in_corpus AND score >= (SELECT min(score) FROM points WHERE in_corpus)"


def success_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as a question for its own label, among the 30 nearest of the others."""
    chunks = vector_chunks(spark, sf_dir)
    asked = chunks.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"), F.col("node_id").alias("expected"))
    near = S.search_many(chunks, asked, leave_out=True)
    hits = near.join(asked.select("qid", "expected"), "qid").join(chunks.select("chunk_id", "node_id"), "chunk_id")
    out = E.success_at(hits, "expected")
    return out.select("queries", *[F.round(c, 6).alias(c) for c in out.columns if c != "queries"])


_cos = "list_dot_product(c.embedding, q.embedding) / (sqrt(list_dot_product(c.embedding, c.embedding)) * sqrt(list_dot_product(q.embedding, q.embedding)))"
SUCCESS = f"""WITH {CHUNKS_SQL}, s AS (SELECT q.chunk_id AS qid, q.node_id AS expected, c.node_id, row_number() OVER (PARTITION BY q.chunk_id ORDER BY round({_cos}, 12) DESC, c.chunk_id) AS r FROM chunks q, chunks c WHERE q.chunk_id % 100 = 0 AND c.chunk_id <> q.chunk_id QUALIFY r <= 30),
d AS (SELECT qid, expected, node_id, min(r) AS r FROM s GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r) AS place FROM d), b AS (SELECT qid, min(place) FILTER (node_id = expected) AS place FROM p GROUP BY qid)
SELECT count(*) AS queries, round(count(*) FILTER (place <= 1) / count(*), 6) AS success_at_1, round(count(*) FILTER (place <= 3) / count(*), 6) AS success_at_3, round(count(*) FILTER (place <= 5) / count(*), 6) AS success_at_5 FROM b"""


def _questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector as a question, of two kinds, and what is nearest to each."""
    chunks = vector_chunks(spark, sf_dir)
    asked = chunks.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"), F.col("node_id").alias("expected"), F.when(F.col("chunk_id") % 200 == 0, "short").otherwise("long").alias("kind"))
    near = S.search_many(chunks, asked.select("qid", "vector"), leave_out=True)
    return asked.drop("vector"), near.join(chunks.select("chunk_id", "node_id"), "chunk_id")


_QUESTIONS_SQL = f"""{CHUNKS_SQL}, asked AS (SELECT chunk_id AS qid, node_id AS expected, CASE WHEN chunk_id % 200 = 0 THEN 'short' ELSE 'long' END AS kind, embedding FROM chunks WHERE chunk_id % 100 = 0),
hits AS (SELECT q.qid, c.node_id, c.chunk_id, round({_cos}, 12) AS sim, row_number() OVER (PARTITION BY q.qid ORDER BY round({_cos}, 12) DESC, c.chunk_id) AS r FROM asked q, chunks c WHERE c.chunk_id <> q.qid QUALIFY r <= 30)"""


def success_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.success_by_kind(*_questions(spark, sf_dir))


SUCCESS_BY_KIND = f"""WITH {_QUESTIONS_SQL}, d AS (SELECT qid, node_id, min(r) AS r FROM hits GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r) AS place FROM d),
b AS (SELECT a.qid, a.kind, (SELECT place FROM p WHERE p.qid = a.qid AND p.node_id = a.expected) AS place FROM asked a)
SELECT kind, count(*) AS queries, count(*) FILTER (place <= 1) AS at_1, count(*) FILTER (place <= 3) AS at_3, count(*) FILTER (place <= 5) AS at_5 FROM b GROUP BY kind"""


def retrieval_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions got the node of links (label 0), and how many of the long ones, taken as from outside, were answered above the floor."""
    asked, hits = _questions(spark, sf_dir)
    leaked = E.leaks(asked, hits.where("r <= 10"), spark.range(1).select(F.lit(0).alias("node_id")))
    outside = asked.where("kind = 'long'")
    top = hits.groupBy("qid").agg(F.max("sim").alias("top"))
    abstained = top.where(S.abstains(F.round("top", 6), 0.4)).select("qid")
    return leaked.crossJoin(F.broadcast(E.answered_outside(outside, hits, abstained)))  # one row each


RETRIEVAL_CONTROLS = f"""WITH {_QUESTIONS_SQL} SELECT (SELECT count(*) FROM asked) AS queries, (SELECT count(DISTINCT qid) FROM hits WHERE r <= 10 AND node_id = 0) AS leaked,
(SELECT count(*) FROM asked WHERE kind = 'long') AS probes, (SELECT count(*) FROM (SELECT qid, max(sim) AS top FROM hits JOIN asked USING (qid) WHERE kind = 'long' GROUP BY qid) WHERE round(top, 6) >= 0.4) AS answered"""


def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("stable_id"))
    return Q.duplicates(d, "stable_id")


DUPS = "SELECT sha256(text) AS stable_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, some outside the root, some of one name, some without a key."""
    i = F.col("doc_id")
    path = F.concat(F.lit("docs/"), F.when(i % 7 == 0, "../x/").when(i % 7 == 1, "a/../b/").otherwise(F.concat("lang", F.lit("/"))), (F.floor(i / 2)).cast("string"), F.when(i % 11 == 0, "/..").otherwise(".md"))
    path = F.when(i % 13 == 0, F.concat(F.lit("docs-old/"), i.cast("string"))).otherwise(path)
    front = F.map_from_arrays(F.filter(F.array(F.lit("title"), F.when(i % 2 == 0, "status"), F.when(i % 3 == 0, "order")), lambda k: k.isNotNull()), F.filter(F.array(F.lit("x"), F.when(i % 2 == 0, "x"), F.when(i % 3 == 0, "x")), lambda k: k.isNotNull()))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), front.alias("meta"))


MANIFEST_SQL = """m AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'docs-old/' || doc_id ELSE 'docs/' || CASE doc_id % 7 WHEN 0 THEN '../x/' WHEN 1 THEN 'a/../b/' ELSE lang || '/' END || (doc_id // 2) || CASE WHEN doc_id % 11 = 0 THEN '/..' ELSE '.md' END END AS path FROM documents)"""


def dup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicates(_manifest(spark, sf_dir), "path")


DUP_PATHS = f"WITH {MANIFEST_SQL} SELECT path, count(*) AS n FROM m GROUP BY path HAVING count(*) > 1"


def path_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir).where(Q.outside(F.col("path"), "docs")).select("doc_id")


ESCAPE = "SELECT doc_id FROM documents WHERE doc_id % 13 = 0 OR doc_id % 7 IN (0, 1) OR doc_id % 11 = 0"


def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _manifest(spark, sf_dir).select("doc_id", F.array_join(Q.missing_keys(F.col("meta"), ["title", "status", "order"]), ",").alias("missing"))
    return rows.where("missing <> ''")


MISSING = "SELECT * FROM (SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 2 <> 0 THEN 'status' END, CASE WHEN doc_id % 3 <> 0 THEN 'order' END) AS missing FROM documents) WHERE missing <> ''"


def profile_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose front matter breaks the profile of knowledge: some have none, some no status, some one of their own making."""
    i = F.col("doc_id")
    pairs = (("title", F.lit("x"), i % 2 == 0), ("status", F.element_at(F.array(*map(F.lit, ("draft", "approved", "", "done", "superseded"))), (i % 5 + 1).cast("int")), i % 3 != 0), ("owner", F.lit("team"), i % 4 != 0), ("provenance", F.lit("y"), F.lit(True)), ("id", F.lit("z"), i % 7 == 0), ("name", F.lit("z"), i % 6 == 0))
    meta = F.map_from_entries(F.filter(F.array(*[F.struct(F.when(there, F.lit(k)).alias("k"), v.alias("v")) for k, v, there in pairs]), lambda p: p["k"].isNotNull()))
    docs = table(spark, sf_dir, "documents").select(i.cast("string").alias("path"), F.when(i % 9 != 0, meta).alias("meta"))
    return Q.profile_problems(docs).select("path", "problem", "about")


PROFILE_PROBLEMS = """WITH d AS (SELECT doc_id, doc_id::VARCHAR AS path, ['draft', 'approved', '', 'done', 'superseded'][doc_id % 5 + 1] AS state FROM documents), f AS (SELECT * FROM d WHERE doc_id % 9 <> 0)
SELECT path, 'no_frontmatter' AS problem, NULL::VARCHAR AS about FROM d WHERE doc_id % 9 = 0 UNION ALL SELECT path, 'missing', 'title' FROM f WHERE doc_id % 2 <> 0 UNION ALL SELECT path, 'missing', 'status' FROM f WHERE doc_id % 3 = 0
UNION ALL SELECT path, 'missing', 'owner' FROM f WHERE doc_id % 4 = 0 UNION ALL SELECT path, 'forbidden', 'id' FROM f WHERE doc_id % 7 = 0 UNION ALL SELECT path, 'forbidden', 'name' FROM f WHERE doc_id % 6 = 0
UNION ALL SELECT path, CASE WHEN state = '' THEN 'no_state' ELSE 'unknown_state' END, nullif(state, '') FROM f WHERE doc_id % 3 <> 0 AND state IN ('', 'done')"""


def dead_relative_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of documents, as files in the folder of their language, to the file seven numbers on, to folders, headings, the web, in code and out of the tree."""
    i = F.col("doc_id")
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n[next](../en/"), (i + 7).cast("string"), F.lit('.md#top "Next") [folder](../fr) [up](../../x.md) [web](https://a.b/c) [here](#top) `[code](gone.md)`\n'))
    docs = table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), i.cast("string"), F.lit(".md")).alias("path"), body.alias("body"))
    return Q.dead_relative(docs, docs.select("path"))


DEAD_RELATIVE = """WITH d AS (SELECT doc_id, lang || '/' || doc_id || '.md' AS path FROM documents)
SELECT path, '../en/' || (doc_id + 7) || '.md#top' AS target FROM d WHERE 'en/' || (doc_id + 7) || '.md' NOT IN (SELECT path FROM d) UNION ALL SELECT path, '../../x.md' FROM d"""


def model_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user as a generation whether one model made all embedded chunks."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("generation"), F.when(F.col("event_type") == "error", "failed").otherwise("embedded").alias("embedding_status"), F.when((F.col("event_id") % 97 == 0) | (F.col("event_type") == "error"), "other").otherwise(MODEL).alias("embedding_model"))
    return V.models_consistent(e, MODEL, "generation")


CONSISTENT = "SELECT user_id AS generation, bool_and(event_id % 97 <> 0) AS consistent FROM events WHERE event_type <> 'error' GROUP BY 1"


def unknown_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return Q.unknown(nodes.where("node_id not in ('n:4', 'n:9')"), "parent_id", "node_id").select("node_id", "parent_id")


UNKNOWN = f"WITH {NODES_SQL}, n AS (SELECT * FROM nodes WHERE node_id NOT IN ('n:4', 'n:9')) SELECT node_id, parent_id FROM n WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT node_id FROM n)"


def sibling_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.when(F.col("c_nationkey") != 5, F.col("c_nationkey")).cast("long").alias("parent_id"), F.concat(F.lower("c_mktsegment"), F.lit("-"), (F.col("c_custkey") % 20).cast("string")).alias("slug"))
    return Q.collisions(rows)


COLLISION = "SELECT CASE WHEN c_nationkey <> 5 THEN c_nationkey END::BIGINT AS parent_id, lower(c_mktsegment) || '-' || (c_custkey % 20) AS slug, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1"


def dead_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages to pages of a site that isn't there: hrefs against the pages' paths."""
    p = table(spark, sf_dir, "pages")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1)).alias("target"))
    known = p.select(F.regexp_extract("url", "://[^/]+(/[^?#]*)", 1).alias("target")).unionByName(spark.createDataFrame([("/the",), ("/de",)], "target string"))
    return Q.dead(links, known).groupBy("page_id").agg(F.count(F.lit(1)).alias("dead"))


DEAD = """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS target FROM pages), k AS (SELECT regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS target FROM pages UNION ALL VALUES ('/the'), ('/de'))
SELECT page_id, count(*) AS dead FROM l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.target = l.target) GROUP BY page_id"""


def ledger_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.ledger import recent

    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("action"), F.col("props").alias("detail"))
    return recent(e, 50).select("id", "actor", "action", "detail")


LEDGER_RECENT = "SELECT event_id AS id, user_id::VARCHAR AS actor, event_type AS action, props AS detail FROM events ORDER BY ts DESC, event_id DESC LIMIT 50"


def ledger_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("action"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("actors"))


LEDGER_ACTION = "SELECT event_type AS action, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS actors FROM events GROUP BY ALL"

QUERIES = {f.__name__: f for f in (vector_lookup, success_by_kind, retrieval_controls, profile_problems, dead_relative_links, carry_forward, carry_priority, generation_health, ready_gate, same_corpus, governance_drift, digest_difference, flip_delta, shrink_guard, gc_collectable, node_centroids, unsearchable_sources, passage_sample, risk_coverage_curve, aurc, floors, paste_value, overlap, success_at_k, dup_paths, path_escape, missing_keys, model_consistency, dup_ids, unknown_parent, sibling_collision, dead_links, ledger_recent, ledger_by_action)}
ORACLE_SQL = {
    "carry_forward": CARRY,
    "carry_priority": CARRY_PRIORITY,
    "generation_health": HEALTH,
    "ready_gate": READY,
    "same_corpus": SAME,
    "governance_drift": DRIFT,
    "digest_difference": DIGEST_DIFFERENCE,
    "flip_delta": FLIP,
    "shrink_guard": SHRINK,
    "gc_collectable": GC,
    "node_centroids": CENTROIDS,
    "unsearchable_sources": UNSEARCHABLE,
    "passage_sample": PASSAGES,
    "vector_lookup": VECTOR_LOOKUP,
    "success_by_kind": SUCCESS_BY_KIND,
    "retrieval_controls": RETRIEVAL_CONTROLS,
    "profile_problems": PROFILE_PROBLEMS,
    "dead_relative_links": DEAD_RELATIVE,
    "risk_coverage_curve": RISK,
    "aurc": AURC,
    "floors": FLOORS,
    "paste_value": PASTE,
    "overlap": OVERLAP,
    "success_at_k": SUCCESS,
    "dup_ids": DUPS,
    "dup_paths": DUP_PATHS,
    "path_escape": ESCAPE,
    "missing_keys": MISSING,
    "model_consistency": CONSISTENT,
    "unknown_parent": UNKNOWN,
    "sibling_collision": COLLISION,
    "dead_links": DEAD,
    "ledger_recent": LEDGER_RECENT,
    "ledger_by_action": LEDGER_ACTION,
}
