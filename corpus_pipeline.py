"""A training corpus from ``documents``: five stages, each on all that its predecessor kept.

Stages return the columns of ``documents``; the last returns packed pieces.  No stage drops a row
for anything but its own decision:

1. language: rejects texts without a letter and those of which no language has half the words;
2. near-duplicates: keeps one document of each group, the one with the smallest id; links are SimHash
   fingerprints (5-word shingles) within 2 bits and 5-word shingle sets of similarity 0.8 or more;
3. decontamination: drops documents that hold a copy of a benchmark item;
4. secrets: keeps every document, its secrets replaced by a mark (``n_chars`` follows the text);
5. packing: every piece of every document gets its place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import decontaminate, language, packing, resemblance, secrets
from wordloom.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.train(docs.select("doc_id", "text", "lang")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resemblance.firsts(docs, resemblance.groups(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None  #: learned language labels, fingerprints, alignment and BPE ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
