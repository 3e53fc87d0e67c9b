"""From raw documents to packed training sequences.

Each stage works on all that the one before kept: toxic documents go, documents in no known language go, one
document of each near-duplicate group stays, byte strings that repeat across the rest are cut out, and what is
left is packed into windows of ids. All stages but the last return the columns of documents.

Null and empty texts pass the first stage like any text with their score, and fall at the second, which
rejects texts without letters. An empty table passes all stages and gives no pieces. Extra columns are carried
as they are up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import langid, packing, repeats, similar, simhash, toxicity
from chatlake.llm.common import fold, read_table
from chatlake.session import cut_lineage, prepare


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; the scorer learns from labelled rows of four folds of five."""
    labels = read_table(prepare(spark), sf_dir, "labels")
    return toxicity.kept(docs, toxicity.train(docs.where(fold("doc_id", 5) != 0), labels))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is predicted with a probability of 0.3 at least: short clean texts stay."""
    prepare(spark)
    return langid.kept(docs, langid.train(docs.where(fold("doc_id", 5) != 0)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose five-word shingles agree to 0.8 or more, that with the smallest doc_id.

    Candidates come from fingerprints that differ in few bits and, for copies with more changes, from MinHash keys.
    """
    prepare(spark)
    return simhash.keep_one(docs, similar.near_duplicates(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that occur more than once."""
    prepare(spark)
    return repeats.shortened(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of ids, with their ids and a checksum of them."""
    prepare(spark)
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack),
]

#: No SQL: models are trained, and links are followed to components; tests hold each stage against loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces made of all documents; every stage is written and read again."""
    docs = read_table(prepare(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
CHECKS = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
