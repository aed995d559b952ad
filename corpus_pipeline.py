"""A training corpus from documents: five stages, each on what the one before has kept."""

from __future__ import annotations

import functools
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact, jaccard, language, packing, substrings
from tidemark.session import shared_folder, written
from tidemark.sources.paths import drop_folder

#: A stage's result names, in the metadata of its doc_id, the written tables that it reads.
TABLES = "tidemark.tables"


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def _free(docs: DataFrame) -> None:
    """Deletes the tables of the stage that ``docs`` came from, once they came from its copy.

    The metadata is written with the rows, so the tables named are those of this chain's last
    stage and of no other. Documents that still read them, never having been written, keep them.
    """
    named = set(docs.schema["doc_id"].metadata.get(TABLES, []))
    if named and not named & (own := _folders(docs)):
        for folder in sorted(named - own):
            drop_folder(docs.sparkSession, folder)


def _naming(df: DataFrame, folders: list[str]) -> DataFrame:
    doc_id = F.col("doc_id").alias("doc_id", metadata={TABLES: folders} if folders else {})
    return df.select(*[doc_id if c == "doc_id" else F.col(c) for c in df.columns])


def frees(work):
    """A stage that deletes the tables of the one before and names its own for the next."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _free(docs)
        out = work(spark, docs, sf_dir)
        base = urlparse(shared_folder(spark, "x").rsplit("/", 1)[0]).path + "/"
        made = {f for f in _folders(out) - _folders(docs) if urlparse(f).path.startswith(base)}
        return _naming(out, sorted(made))

    return run_stage


@frees
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, of which no language can be told."""
    return language.drop_unknown(docs)


@frees
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal texts, the one with the largest doc_id."""
    return exact.drop_exact_duplicates(docs)


@frees
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of documents linked by shingle similarity, the one with the least doc_id."""
    return jaccard.drop_near_duplicates(docs)


@frees
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages that an earlier document has; documents left without words go."""
    return substrings.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents, packed into sequences."""
    _free(docs)
    return packing.packed_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: SQL has neither the language model nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = written(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
