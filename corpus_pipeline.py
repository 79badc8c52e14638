"""Training-corpus pipeline: five stages, each a DataFrame of documents to the next.

quality classifier -> line dedup -> n-gram Jaccard join -> mixing sources -> packing. Each stage works on all that
the one before has kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import common, jaccard, linededup, mixing, packing, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; what it rejects goes.

    Null and empty texts have the weight of unknown text and stay. Rows of one id and text are kept or rejected
    together. An empty table gives an empty one. Columns of any name are kept.
    """
    common.ship(spark)
    return quality.keep(docs, quality.training_labels(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; n_chars follows. A document that had words and has none left goes.

    Null texts, and ones without words, stay as they are. Rows of one id and text are one document and keep the
    same lines. Of equal runs the one under the smallest id stays. An empty table gives an empty one. Columns of
    any name are kept; only text and n_chars change.
    """
    common.ship(spark)
    marks = [next(n for k in range(len(docs.columns) + 1) if (n := name + "_" * k) not in docs.columns) for name in ("lines_in", "lines_out")]
    d = linededup.dedup(docs, counts=tuple(marks)).where((F.col(marks[0]) == F.col(marks[1])) | (common.words(F.col("text")) > 0))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Null texts and ones without words link with nothing and stay. Rows of one id and text become one; different
    texts under one id are documents of their own; rows without an id all stay. An empty table gives an empty one.
    Columns of any name are kept.
    """
    common.ship(spark)
    return jaccard.keep_first(docs)


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; one that it would cut is taken if more than half of it is.

    Null texts and ones without words have no size and are never taken; a null source is one of its own. Repeated
    rows share what is taken of them. An empty table gives an empty one. Columns of any name are kept.
    """
    common.ship(spark)
    return mixing.apply(docs)


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens: doc_id, doc_tokens, start, ids, sequence_id, offset.

    Null and empty texts are their end id. Repeated rows are packed as often as they stand there. An empty table
    gives no pieces. Other columns are left out.
    """
    common.ship(spark)
    return packing.pieces(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", weighted_mix),
    ("packing", retrieval_packing),
]

#: The stages tokenise, sample and compare shingles in ways that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = common.save(docs, f"stage{number}")
            common.drop(last)  # a stage's own result; the input isn't one
    return docs
