"""A corpus pipeline of five of the training-data operators, for queries named ``pipeline``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagelore.llm import bpe, line_dedup, mixing, similar, toxicity
from pagelore.runtime import shared_dir, ship, table

#: Documents at or above this score go.
TOXIC_FROM = 0.5
#: Lines of 20 characters or more stay in the first of the documents that share them, and only there.
LINES = {"min_docs": 2, "min_chars": 20, "keep_first": True}
#: Near duplicates: five-word shingles, a Jaccard similarity of 0.8 or more by the exact check.
NEAR = {"words": 5, "least": 0.8}


def drop_toxic(spark, docs, sf_dir):
    """Documents that score below TOXIC_FROM; the model learns from the labels of the documents given."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < TOXIC_FROM).select(*docs.columns)


def drop_repeated_lines(spark, docs, sf_dir):
    """All documents, without lines that an earlier one has; n_chars follows the text."""
    ship(spark)
    out = line_dedup.dedup_lines(docs, **LINES)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each class of near duplicates, that of the smallest id."""
    ship(spark)
    return similar.one_of_each(docs, **NEAR)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as their source's target weight asks for."""
    ship(spark)
    return mixing.mixed(docs)


def encode_documents(spark, docs, sf_dir):
    """(doc_id, source, n_tokens, ids, round_trip): token ids of each text, little-endian unsigned 32-bit,
    and whether they decode to the text."""
    ship(spark)
    out = bpe.encode_checked(docs.select("doc_id", "source", "text"), bpe.default_path())
    return out.select("doc_id", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe_encoding", encode_documents),
]

#: Hashes, models and tokens have no DuckDB form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in turn; what each keeps is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
