"""A generation from a tree of Markdown files: built, embedded, flipped, rolled back and reaped, each as one commit.

Tables of the catalog: corpora (pointers) and runs, whole; nodes, sources, chunks and lexemes, a part
for each tenant, corpus and generation; denylist, whole. Readers of a served generation see all of its
tables or none, as they come with one version of the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK_POLICY, EngineConfig
from ..durable import Scratch
from ..functions import chunking, embedding, providers
from ..functions import text as X
from ..sources import markdown
from . import generations as V
from . import governance as G
from . import index, labels, quality
from . import lifecycle as L
from .catalog import WHOLE, Catalog, Change, Snapshot, Written
from .vectors import VectorStore

DENYLIST = "tenant_id string, corpus_id string, stable_id string, scope string, reason string, created_at timestamp"
OF_GENERATION = ("nodes", "sources", "chunks", "lexemes")


def part(tenant: str, corpus: str, generation: int) -> str:
    return f"{tenant}/{corpus}/{generation}"


def _pointers(now: Snapshot) -> tuple[DataFrame, DataFrame]:
    return now.table("corpora", schema=L.POINTERS), now.table("runs", schema=L.RUNS)


def allocate(catalog: Catalog, tenant: str, corpus: str, commit: str | None = None, at: Column | None = None) -> int:
    """Reserves the next generation's number; two at once get two numbers."""
    got = []

    def act(now: Snapshot) -> Change:
        number, pointers, runs = L.allocated(*_pointers(now), tenant, corpus, commit, F.current_timestamp() if at is None else at)
        got[:] = [number]
        return Change.of({"tenant": tenant, "corpus": corpus, "generation": number}, corpora=pointers, runs=runs)

    catalog.commit("allocate", act)
    return got[0]


def refused(docs: DataFrame, nodes: DataFrame) -> None:
    """Raises where no generation may be built: no document, two index files of a folder, an id twice, unreadable governance."""
    if docs.isEmpty():
        raise L.Refused("the tree has no document")
    for problem, rows in (
        ("folders with more than one index file", markdown.index_conflicts(docs).select("folder")),
        ("ids that stand more than once", quality.duplicates(nodes, "stable_id").select("stable_id")),
        ("files whose governance can't be read", docs.where("governance.problem is not null").select("path")),
        ("siblings of one slug", quality.collisions(nodes).select("slug")),
    ):
        some = [r[0] for r in rows.limit(5).collect()]
        if some:
            raise L.Refused(f"{problem}: {', '.join(map(str, some))}")


def build(catalog: Catalog, tree: DataFrame, config: EngineConfig, corpus: str, generation: int, embed: Callable[[Column], Column] | providers.Provider | None = None, store: VectorStore | None = None) -> Snapshot:
    """Writes an allocated generation from files (path, text) and commits its four tables together.

    Vectors are carried from earlier generations of the same corpus, and looked up in its store by what
    they are made of, if there is one; the rest are embedded (by a column, or by a provider that may
    fail), or stay pending without an embedder. The run is ready if what failed is little and nothing is pending.
    """
    spark, tenant = catalog.spark, config.tenant
    begin = catalog.snapshot()
    with Scratch(spark) as scratch:
        docs = scratch.keep(markdown.documents(tree))
        named = scratch.keep(markdown.nodes(docs))
        refused(docs, named)
        governed = docs.select("stable_id", "governance.*")
        own = (F.lit(tenant).alias("tenant_id"), F.lit(corpus).alias("corpus_id"), F.lit(generation).cast("long").alias("generation"))
        nodes = named.join(governed.drop("problem"), "stable_id", "left").select(*own, F.col("stable_id").alias("node_id"), "parent_id", "stable_id", "slug", "title", "kind", "ord", "name", F.lit("published").alias("status"), "visibility", "doc_status", "owner", "provenance", "superseded_by", F.lit(None).cast("string").alias("permalink"))
        nodes = scratch.keep(labels.labelled(nodes, scratch))
        lost = named.join(nodes.select("stable_id"), "stable_id", "left_anti").limit(1).collect()
        if lost:
            raise L.Refused(f"no way leads from a root to {lost[0]['stable_id']}")
        sources = docs.select(*own, "source_id", F.col("stable_id").alias("node_id"), F.lit("prose").alias("modality"), F.col("path").alias("origin_path"), "content_hash")
        chunks = _chunks(docs, scratch, own)
        chunks = scratch.keep(_embedded(begin, chunks, config, corpus, generation, embed, scratch, store))
        lexemes = index.postings(chunks.where("source_type = 'prose'").withColumn("content", X.without_diagrams(F.col("content"))), config.text_search_config)
        health = V.health(chunks).first()
        is_ready = health is not None and health["pending"] == 0 and bool(chunks.limit(1).select(V.ready(*(F.lit(health[s]) for s in ("pending", "embedded", "failed")))).first()[0])
        key = part(tenant, corpus, generation)
        written = {("nodes", key): nodes.orderBy("pre"), ("sources", key): sources, ("chunks", key): chunks, ("lexemes", key): Written(lexemes.schema, lambda folder: index.write(lexemes, folder, config.text_search_config))}

        def act(now: Snapshot) -> Change:
            runs = now.table("runs", schema=L.RUNS)
            mine = L._is(tenant, corpus) & (F.col("generation") == generation)
            run = runs.where(mine).first()
            if run is None or run["state"] != "building":
                raise L.Refused(f"generation {generation} isn't being built: {run['state'] if run else 'never allocated'}")
            state = F.when(mine, F.lit("ready" if is_ready else "building")).otherwise(F.col("state"))
            finished = F.when(mine & F.lit(is_ready), F.current_timestamp()).otherwise(F.col("finished_at"))
            runs = runs.withColumn("state", state).withColumn("finished_at", finished)
            return Change({**written, ("runs", WHOLE): runs}, [], {"tenant": tenant, "corpus": corpus, "generation": generation, "ready": is_ready, "chunks": health["total"] if health else 0})

        return catalog.commit("build", act)


def _chunks(docs: DataFrame, scratch: Scratch, own: tuple[Column, ...]) -> DataFrame:
    rows = chunking.chunked(docs.select("source_id", "title", "body"))
    content = X.heading_path_text(F.col("heading_path"))
    rows = rows.select(*own, F.xxhash64("source_id", "ordinal").alias("chunk_id"), "source_id", "title", "ordinal", "content", "chunk_hash", F.nullif(content, F.lit("")).alias("heading_path_text"), "source_type")
    return scratch.keep(rows.withColumn("dense_length", X.dense_length(F.col("content")).cast("long")))


def _embedded(now: Snapshot, chunks: DataFrame, config: EngineConfig, corpus: str, generation: int, embed, scratch: Scratch, store: VectorStore | None) -> DataFrame:
    """chunks with embedding, embedding_model, embedding_status and embed_error: carried, looked up, embedded, failed or pending."""
    vectors = "embedding array<double>, embedding_model string"
    empty = now.catalog.spark.createDataFrame([], f"source_id string, chunk_hash string, heading_path_text string, title string, {vectors}, generation long, priority int")
    carried = empty
    sources = L.carry_sources(now.table("chunks"), now.table("runs"), corpus, generation).where(F.col("tenant_id") == config.tenant).collect() if "chunks" in now else []  # a row a generation
    if sources:
        old = now.table("chunks", *[part(config.tenant, corpus, r["generation"]) for r in sources]).where("embedding_status = 'embedded'")
        order = now.catalog.spark.createDataFrame([(r["generation"], r["priority"]) for r in sources], "generation long, priority int")
        carried = old.join(F.broadcast(order), "generation").select(*empty.columns)
    rows = scratch.keep(V.carried(chunks, carried, config.embedding_model))
    have = rows.where("embedding is not null").withColumns({"embedding_model": F.lit(config.embedding_model), "embedding_status": F.lit("embedded"), "embed_error": F.lit(None).cast("string")})
    lack = rows.where("embedding is null").drop("embedding")
    lack = lack.withColumn("input", X.embed_input(F.col("title"), F.coalesce("heading_path_text", F.lit("")), F.col("content")))

    def fill(rows: DataFrame) -> DataFrame:
        if embed is None:
            return rows.select("*", F.lit(None).cast("array<double>").alias("embedding"), F.lit("pending").alias("embedding_status"), F.lit(None).cast("string").alias("embed_error"))
        drained = providers.drained if hasattr(embed, "retryable") else embedding.drained
        return drained(rows, embed, config.embedding_dim)

    if store is None:
        lack = fill(lack)
    else:
        if (store.model, store.dim) != (config.embedding_model, config.embedding_dim):
            raise L.Refused(f"the store is of {store.model}/d{store.dim}, the corpus declares {config.embedding_model}/d{config.embedding_dim}")
        runs = now.table("runs", schema=L.RUNS).where(L._is(config.tenant, corpus) & (F.col("state") == "abandoned"))
        lack = store.embedded(lack, fill, generation, [r["generation"] for r in runs.select("generation").collect()], scratch=scratch)
    lack = lack.drop("input")
    lack = lack.withColumn("embedding_model", F.lit(config.embedding_model))
    return have.unionByName(lack.select(*have.columns)).withColumn("chunk_policy", F.lit(CHUNK_POLICY))


def flip(catalog: Catalog, tenant: str, corpus: str, to: int, most_lost: float = V.SHRINK_SHARE, force: bool = False) -> Snapshot:
    """Serves a ready generation. Refused: one that isn't ready, a step back, and one that loses too many documents."""

    def act(now: Snapshot) -> Change:
        pointers, runs = _pointers(now)
        run = runs.where(L._is(tenant, corpus) & (F.col("generation") == to)).first()
        if run is None or run["state"] != "ready":
            raise L.Refused(f"generation {to} is {run['state'] if run else 'unknown'}, not ready")
        after = L.flipped(pointers, runs, tenant, corpus, to, F.current_timestamp())
        active, _ = L.pointer(pointers, tenant, corpus)
        nodes = lambda g: now.table("nodes", part(tenant, corpus, g)).where("kind = 'document'").select("stable_id")
        lost = V.shrink(nodes(to), nodes(active), most_lost).first() if active else None
        if lost is not None and lost["refused"] and not force:
            raise L.Refused(f"generation {to} loses {lost['lost_share']:.0%} of the documents")
        return Change.of({"tenant": tenant, "corpus": corpus, "from": active, "to": to}, corpora=after[0], runs=after[1])

    return catalog.commit("flip", act)


def roll_back(catalog: Catalog, tenant: str, corpus: str) -> int:
    """Serves the generation that was served before."""

    def act(now: Snapshot) -> Change:
        back, pointers, runs = L.rolled_back(*_pointers(now), tenant, corpus, F.current_timestamp())
        return Change.of({"tenant": tenant, "corpus": corpus, "to": back}, corpora=pointers, runs=runs)

    return L.pointer(catalog.commit("rollback", act).table("corpora"), tenant, corpus)[0]


def reap(catalog: Catalog, tenant: str, corpus: str, generation: int) -> Snapshot:
    """Drops a generation's tables. What is served, or would be after a rollback, is refused."""

    def act(now: Snapshot) -> Change:
        pointers, runs = _pointers(now)
        if generation in L.pointer(pointers, tenant, corpus):
            raise L.Refused(f"generation {generation} is served")
        mine = L._is(tenant, corpus) & (F.col("generation") == generation)
        runs = runs.withColumn("state", F.when(mine, "reaped").otherwise(F.col("state")))
        return Change({("runs", WHOLE): runs}, [(t, part(tenant, corpus, generation)) for t in OF_GENERATION], {"tenant": tenant, "corpus": corpus, "generation": generation})

    return catalog.commit("reap", act)


def take_down(catalog: Catalog, tenant: str, corpus: str, entries: DataFrame, actor: str = "system") -> Snapshot:
    """Adds entries (stable_id, scope, reason) to the denylist; in force with the commit, whatever is served."""

    def act(now: Snapshot) -> Change:
        old = now.table("denylist", schema=DENYLIST)
        mine = old.where(L._is(tenant, corpus))
        nodes = now.table("nodes", schema="stable_id string").select("stable_id")
        after, _ = G.taken_down(mine.drop("tenant_id", "corpus_id"), entries, nodes, F.current_timestamp())
        after = after.select(F.lit(tenant).alias("tenant_id"), F.lit(corpus).alias("corpus_id"), "*")
        return Change.of({"tenant": tenant, "corpus": corpus}, denylist=old.where(~L._is(tenant, corpus)).unionByName(after))

    return catalog.commit("takedown", act, actor)


def revoke(catalog: Catalog, tenant: str, corpus: str, ids: DataFrame, actor: str = "system") -> Snapshot:
    """Takes ids (stable_id) off the denylist; the last one leaves an empty list."""

    def act(now: Snapshot) -> Change:
        old = now.table("denylist", schema=DENYLIST)
        after, _ = G.revoked(old.where(L._is(tenant, corpus)), ids)
        return Change.of({"tenant": tenant, "corpus": corpus}, denylist=old.where(~L._is(tenant, corpus)).unionByName(after.select(*old.columns)))

    return catalog.commit("revoke", act, actor)


def serving(now: Snapshot, tenant: str, corpus: str, ledger: str | None = None):
    """The engine's tables as of a snapshot: the folders of what is served, nothing else."""
    from ..engine import Tables

    pointers = now.table("corpora", schema=L.POINTERS)
    served = L.servable(pointers, tenant, corpus)
    parts = [part(tenant, corpus, g) for g in served] or ["none"]
    tables = {name: now.table(name, *parts) for name in ("nodes", "sources", "chunks")}
    return Tables(pointers, **tables, denylist=now.table("denylist", schema=DENYLIST), ledger=ledger, lexemes={g: f for g in served for f in now.folders("lexemes", part(tenant, corpus, g))})
