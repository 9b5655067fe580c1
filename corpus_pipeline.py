"""A training corpus from documents: toxic texts go, one of each near-duplicate group stays, personal
data is redacted, sources are mixed to target weights, and texts become piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what one returns is written as
Parquet and read again as the next one's docs.

Defined cases, of every stage: further columns are dropped, whatever their names; no documents give
none. A null doc_id is a document like any other. Null texts count as empty ones for scores, sizes and
likeness and stay null, without n_chars once personal data is redacted, and with null ids. Rows that
repeat a doc_id and its text are one group of near-duplicates; before that stage each counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common, mixing, pieces, pii, simhash
from corpusloom.llm import toxicity as toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under their language's threshold."""
    docs = docs.select(*COLUMNS)
    model = toxic.learned(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxic.scored(common.spread(docs), model).where(~F.col("toxic_flag")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each component of SimHash fingerprints that differ in 3 bits or fewer."""
    return simhash.deduplicated(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind, as [EMAIL]."""
    rows = pii.found(common.spread(docs.select(*COLUMNS)), redact=True)
    return rows.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times."""
    docs = docs.select(*COLUMNS)
    rows = mixing.mixed(docs)
    return mixing.repeated(docs, rows).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document instead of its text."""
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Learned models, fingerprints and piece tables are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"stage-{name}")
    return docs
