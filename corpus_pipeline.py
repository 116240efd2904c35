"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  What a stage returns is to be written
and read again before the next one is called: that one drops the scratch tables
that the stage before it read from.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from snapgraph.llm import decontaminate, mixing, ngram_join, token_output, toxicity
from snapgraph.llm.common import collected, drop, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model fit on the labelled ones rejects go."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (shingles of five words, similarity 0.8)."""
    return ngram_join.one_of_each(docs, words=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the test set go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources come near their target shares."""
    return mixing.repeated(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix in wavelet shards, described per document as read back."""
    return token_output.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


#: Scratch folders of the stage that was called last.
_left: list[str] = []


def _stage(function):
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            drop(spark, _left.pop())
        with collected() as made:
            out = function(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("ngram_join", _stage(drop_near_copies)),
    ("decontamination", _stage(drop_benchmark)),
    ("mixing", _stage(mix_sources)),
    ("token_output", _stage(write_tokens)),
]

#: The fitted model and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if before:
            drop(spark, before)
        before = path
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads its own files from here on
    if before:
        drop(spark, before)
    return out


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
