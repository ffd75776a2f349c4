"""From raw documents to a training mix: toxic documents go, repeated lines go, one of each group of near-duplicates
stays, documents with benchmark passages go, and what is left is mixed to the sources' target weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm._common import Saved, Scope, table
from chronoloom.llm.decontamination import drop_contaminated
from chronoloom.llm.linededup import dedup_lines
from chronoloom.llm.mixing import mixed_documents
from chronoloom.llm.neardup import one_of_each_group
from chronoloom.llm.toxicity import drop_toxic, fit_lexicon


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The lexicon is learned from the labels of the documents at hand. Null and empty
    texts stay, repeated rows fare alike, extra columns pass through, an empty table stays empty."""
    return drop_toxic(docs, fit_lexicon(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that stand elsewhere; documents that keep no line go. Null and empty texts and rows with a
    null id stay as they are, repeated rows keep the same lines, extra columns pass through, an empty table stays empty."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays. The lines that near copies share are gone by now but for one
    of each; so documents are near by their texts as they are, or as they were before lines went. Texts without words
    and rows with a null id stay, rows with one id go or stay together, extra columns pass through, an empty table stays
    empty."""
    return one_of_each_group(docs, before=table(spark, sf_dir, "documents"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Null and empty texts stay, repeated rows fare alike, extra
    columns pass through, an empty table stays empty."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: the documents' columns, then mix_size, mix_target and mix_taken. Null and empty texts have no
    words and aren't taken, null sources are one source, repeated rows count together, an empty table stays empty."""
    return mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Learned scores and SimHashes of words have no counterpart in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written and read again; a stage's tables go once it is written, and its result once the
    next stage's is. Empty documents give an empty result."""
    kept: Saved | None = None
    for name, stage in STAGES:
        with Scope() as scope:
            docs = kept.df if kept else table(spark, sf_dir, "documents")
            scope.result(stage(spark, docs, sf_dir), f"pipeline-{name}")
            before, kept = kept, scope.kept[0]
        if before:
            before.drop()
    return kept.df
