"""A corpus pipeline of five stages; each works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.llm import langid, secrets
from taktwerk.llm.bpe import bpe_encode
from taktwerk.llm.common import forget, read, written
from taktwerk.llm.decontaminate import decontaminate
from taktwerk.llm.queries import vocabulary_path
from taktwerk.llm.simhash import simhash_components

LEAST_SCORE = 0.5  # of language ID: below it, no language has most of the likelihood


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which language ID finds a language; those that are und or undecided go.

    The model learns from the stage's documents that have a language and are not held out.
    """
    found = langid.identify(docs, docs.columns, langid.fit_on_documents(docs))
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    Rows repeated under one id are one document: they stay or go together. A document without id stays
    unless its group has a document with one.
    """
    parts = simhash_components(docs)
    kept = parts.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the benchmark contaminates; the others stay as they are."""
    found = decontaminate(docs, read(spark, sf_dir, "benchmark"), docs.columns)
    return found.filter(~F.col("contaminated")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark and counts n_chars anew where a text changed; all documents stay."""
    found = secrets.scan(docs, docs.columns, secrets.fit(docs))
    text = secrets.redacted("text", "spans")
    n_chars = F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    new = {"text": text, "n_chars": n_chars}
    return found.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The BPE tokens of every document, n_tokens, ids and what they decode to, beside its other columns but the text."""
    keep = [c for c in docs.columns if c != "text"]
    return bpe_encode(docs, keep, vocabulary_path(), outputs=("n_tokens", "ids", "decoded"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", encode),
]

#: No SQL has SimHash, the language model or the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is a table in the shared folder that the next one reads."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        after = written(stage(spark, docs, sf_dir))
        if k:
            forget(docs)
        docs = after
    return docs
