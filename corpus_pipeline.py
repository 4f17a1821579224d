"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Quality rules drop rejected documents and the failing lines of kept ones; near duplicates
(five-word shingles of a Jaccard similarity of 0.8 or more, by a positional index like the SimHash
operator's; see seqloom/llm/jaccard.py) leave the smallest id of each group; secrets are replaced in
place; mixing takes each document as often as its rate says (a clean document at least once); the last
stage encodes and decodes.

Every stage stands tables without rows, null columns and repeated rows; what an operator defines for
them holds here. Rows of one id with equal texts are one document to the near-duplicate stage; different
texts under one id are different documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, jaccard, mixing, quality, secretscan
from seqloom.llm.common import cut, shared_dir, table
from seqloom.plans.lineage import remove
from seqloom.plans.sequence import bounded

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; kept ones lose their failing lines."""
    judged = quality.judge(docs.select(*COLUMNS), text_out="_clean")
    return _documents(judged.where("kept").withColumn("text", F.col("_clean")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id, null ids last.

    Copies are texts whose five-word shingles have a Jaccard similarity of 0.8 or more. Only ids and
    digests of documents that go travel; texts are not shuffled unless those, counted, are too many to
    broadcast.
    """
    marked = docs.select(*COLUMNS, jaccard.digest().alias("digest"))
    found = jaccard.near_copies(marked)
    same = lambda other: marked.doc_id.eqNullSafe(other.id) & (marked.digest == other.of)
    gone = cut(found.where("not stays").select(F.col("doc_id").alias("id"), F.col("digest").alias("of")).distinct())
    gone = bounded(gone, gone.count())
    rest = marked.join(gone, same(gone), "left_anti")
    # what is left twice has one id and one text
    twice = found.where("stays").groupBy("doc_id", "digest").count().where("count > 1").select(F.col("doc_id").alias("id"), F.col("digest").alias("of"))
    if twice.isEmpty():
        return rest.select(*COLUMNS)
    again = rest.join(twice, same(twice), "left_semi").groupBy("doc_id", "digest").agg(F.min(F.struct(*COLUMNS[1:])).alias("x")).select("doc_id", "x.*")
    return rest.join(twice, same(twice), "left_anti").select(*COLUMNS).unionByName(again.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark of their kind."""
    return _documents(secretscan.redact(docs.select(*COLUMNS)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate, rounded by a hash of its id (of its text, for null ids), says.

    Documents are known by id and text, so null ids and different texts under one id keep their own copies.
    Totals asked for, aimed at and reached are logged for each domain.
    """
    marked = docs.select(*COLUMNS, jaccard.digest().alias("digest"))
    mixed = mixing.mix(marked, mixing.label_domains(table(spark, sf_dir, "labels")), keep=("digest",))
    taken = mixed.where("copies > 0").groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("of")).agg(F.min("copies").alias("copies"))
    rows = marked.join(taken, marked.doc_id.eqNullSafe(taken.id) & (marked.digest == taken.of))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("byte-level BPE", byte_bpe),
]

#: Fingerprints, automata and the fitted mix have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; stage results lie in the shared folder, each until the next one is whole."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
