"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

``python -c "import corpus_pipeline; ..."`` or the registered query ``pipeline``. All stages but the last return the
columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from texlake.functions.shipping import ship
from texlake.llm.common import drop, text_batches, written
from texlake.llm.decontaminate import without_benchmark
from texlake.llm.jaccard_join import one_of_each_group
from texlake.llm.packing import pack_documents
from texlake.llm.queries import table, vocabulary
from texlake.llm.suffix_dedup import without_repeats
from texlake.llm.toxicity import without_toxic


#: Pieces that a worker of the last stage remembers: after four stages an executor has less memory to spare than in a job of its own.
KNOWN = 200_000


def _ready(spark: SparkSession) -> None:
    ship(spark)
    text_batches(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Null and empty texts score alike; repeated rows go or stay together; an empty table stays empty."""
    _ready(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, the smallest doc_id stays.

    Texts without words have no group: they stay, repeated rows of them as one; null ids come last; an empty table stays empty.
    """
    _ready(spark)
    return one_of_each_group(docs, width=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or of at least 400 bytes, that stand elsewhere, too, go from the texts.

    No row goes; null texts stay null; repeated rows lose all that they share; an empty table stays empty.
    """
    _ready(spark)
    return without_repeats(docs, length=400, words=51)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Null and empty texts contain none; repeated rows go or stay together; an empty table stays empty."""
    _ready(spark)
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row for each piece. Null and empty texts are the end token alone; repeated rows are packed each; an empty table has no pieces."""
    _ready(spark)
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024, known=KNOWN)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("packing", packing)]

#: SQL cannot express the learnt scores of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; the result is what the last one, ``packing``, returns.

    Nulls, empty and long texts, ties and repeated rows are as the stages' operators define them; an empty table gives an
    empty result; further columns of ``documents`` pass through all stages but the last.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
