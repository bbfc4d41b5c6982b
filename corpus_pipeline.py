"""The corpus pipeline: documents -> good, distinct, mixed documents -> packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result to the shared folder and reads it again as the next one's
input, and then deletes what the stage itself wrote on the way. All stages but
the last return the columns of ``documents``, extra ones too, untouched.

In every stage null and empty texts are texts like others (empty ones), texts of
any length are read whole, and an empty table gives an empty one; repeated rows,
ties and null ids are settled as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradewell.llm import exact_dedup, minhash, mixing, packing, quality
from gradewell.llm.shared import Scratch, clear, mark
from gradewell.session import ship_package, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the compression classifier rejects go; equal texts are judged alike, with or without an id."""
    ship_package(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts the row with the largest doc_id stays (one of rows that repeat it; a null id only where no copy has one)."""
    ship_package(spark)
    return exact_dedup.keep_rows(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 on five-word shingles at a similarity of 0.8: one document of each group stays, that of the least id.

    Rows without an id, and different texts that share one, can't be named by a
    link and stay; empty texts link with nothing and stay.
    """
    ship_package(spark)
    return minhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: clean text is repeated and toxic text is thinned as the fitted rates say; rows that repeat id and text alike.

    A document that is likelier clean than toxic keeps one copy at least.
    """
    ship_package(spark)
    return mixing.draw(docs, table(spark, sf_dir, "labels"), spare=True)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the pieces of all documents in sequences of at most 4096 tokens; each row is packed, repeated ones once each."""
    import public_tokenizers

    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_deduplication),
    ("minhash_near_dedup", near_deduplication),
    ("source_mixing", source_mixing),
    ("packing", sequence_packing),
]

#: SQL can express neither the compression classifier nor the tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole of ``documents``."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        begun = mark()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, f"{k}-{name}")
            clear(spark, begun)
    return docs
