"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``. Null texts are rejected by the first stage, empty ones too, since
no language can be told; a stage on an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm import common, decontaminate, language, order_minhash, packing, secrets

#: Prefix of columns that a stage works with and drops again.
OWN = "_stage_"


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns languages from the labelled documents and keeps the documents that are in one of them."""
    marked = language.identify(docs, language.train(docs), prefix=OWN)
    return marked.where(~F.col(f"{OWN}rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near-duplicates the document of the smallest id."""
    return order_minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    marked = decontaminate.mark_contamination(docs, common.table(spark, sf_dir, "benchmark"), prefix=OWN)
    return marked.where(F.size(f"{OWN}hit_spans") == 0).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts, and brings n_chars up to date where a text has changed."""
    marked = secrets.scan(docs, prefix=OWN)
    hit = F.size(f"{OWN}spans") > 0
    text = secrets.redacted(F.coalesce("text", F.lit("")), F.col(f"{OWN}spans"))
    out = marked.withColumn("text", F.when(hit, text).otherwise(F.col("text"))).withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their places in training sequences."""
    import public_tokenizers

    # Workers serve other stages too, so they keep fewer encoded parts than packing alone does, and none after a task.
    return packing.pack_documents(docs, vocabulary=public_tokenizers.path("word_bpe_49k.json"), keep=60_000, stay=False)


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Several stages cannot be put in SQL (trained models, tokenisers); tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
