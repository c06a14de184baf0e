"""A corpus through five operators: toxic documents go, one of each near-duplicate group stays,
repeated passages are cut, personal data is pseudonymised, and what remains is packed.

Every stage takes whole tables.  Null and empty texts pass all stages (they are not toxic, near
nothing, repeat nothing) and end as sequences without words; rows without an id are kept and judged
by their own text; rows that repeat an id and its text share each decision; an empty table gives an
empty one; columns beyond those of documents are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattiq import scratch
from lattiq.llm import base, neardup, packing, pii, queries, substrings, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7; with labels of one class or none, a share of toxic ones of
    0.7 or more rejects all.  Equal texts stay or go together."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.kept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five words, the least id; of equal ids with
    equal texts all rows."""
    return neardup.deduplicated(docs, k=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 20 words that start earlier in the corpus are cut; no row goes, a text may end
    empty.  Ties of an id with itself are ordered by a hash of the text."""
    return substrings.remove(docs, window=20)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Valid personal values are permuted within their formats, equal ones alike; no row goes."""
    return pii.pseudonymise(docs, queries.pseudonym_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 words with their documents; no document is lost (see
    :func:`lattiq.llm.packing.sequences`)."""
    return packing.sequences(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("pii", pseudonymise),
    ("best_fit_packing", pack),
]
#: Boosted trees and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
        scratch.released(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
