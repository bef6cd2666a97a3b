"""The corpus pipeline: each stage applies one operator of ``clientele.llm`` to all rows
that the stage before it kept.

``run`` writes each stage's result as Parquet into the shared checkpoint folder and gives
it to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clientele.llm import exact_dedup, minhash, mixing, quality, sentence_pieces
from clientele.llm.common import saved, table
from clientele.llm.queries import PIECES


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents.

    Null and empty texts are scored like any other, whole long texts are read, repeated rows
    and null ids stay or go alike, extra columns are kept, an empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays.

    A null text equals an empty one; ties go to the smallest doc_id (nulls last), and of
    wholly repeated rows one stays. Extra columns are kept, an empty table stays empty."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (shingles of five words, similarity 0.8).

    Texts without words (null, empty, blank) all stay; ties go to the smallest doc_id (nulls
    last), and of wholly repeated rows one stays. Whole long texts are compared, extra
    columns are kept, an empty table stays empty."""
    return minhash.drop_near_copies(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: not at all, once or twice.

    A null text has no words, null sources are a source of their own; rows of equal id and
    text are taken together. Extra columns are kept, an empty table stays empty."""
    return mixing.mixed_rows(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as pieces of the public vocabulary.

    Null and empty texts have no pieces, repeated rows get equal ids, null ids stay null,
    whole long texts are encoded, other columns are dropped, an empty table stays empty."""
    return sentence_pieces.encode(docs, sentence_pieces.load(PIECES))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("SentencePiece", encode_texts),
]

#: SQL cannot express the trained classifier, nor the lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
