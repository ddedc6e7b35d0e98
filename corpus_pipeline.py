"""The corpus pipeline: documents through five operators, each stage written as Parquet and reread.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
``documents`` as they came, whatever their names and nulls in them. A table without rows
gives none at every stage. Documents without an id go on like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.bpe import encode_decode
from lorespark.llm.common import read_table, vocabulary, written
from lorespark.llm.decontaminate import clean
from lorespark.llm.jaccard_join import keep_one
from lorespark.llm.pii import pseudonymised, session_key
from lorespark.llm.toxicity import without_toxic
from lorespark.session import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; labels outside the held-out fold are learned from.

    Null and empty texts get the score of texts without words; rows that repeat an id are
    judged each; a very long text is read whole; without labels of both kinds all have one score.
    """
    ship(spark)
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays.

    Null and word-less texts are nobody's copies; rows that repeat an id stay or go together; a
    similarity of exactly the threshold links; a very long text is compared as a whole.
    """
    ship(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null texts hold none; rows that repeat an id are judged each; a very long text is scanned whole.
    """
    ship(spark)
    return clean(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities become surrogates under the session's key; n_chars follows the new text.

    Null stays null, empty stays empty; equal rows become equal rows; a very long text is read whole.
    """
    ship(spark)
    out = pseudonymised(docs, session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: number of tokens and the digests of ids and decoded text.

    Null counts as empty; rows that repeat an id are encoded each; a very long text is encoded whole.
    """
    ship(spark)
    return encode_decode(docs, vocabulary("word_bpe_49k.json"), most=30_000_000, block=700_000)  # the stages before leave less memory


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("encoding", encoding),
]

#: Model scoring, tree search and tokenization can't be said in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
