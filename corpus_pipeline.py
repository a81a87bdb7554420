"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents, whatever these are called, with their values.
An empty table gives an empty result at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from circlet.llm import decontam, line_dedup, packing, simhash, toxicity
from circlet.llm.common import aside, stage, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    The model learns from the stage's own input. Null and empty texts stay; rows
    of one text go or stay together.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that many documents share stay in one of them, that of the largest doc_id; the text is reassembled.

    Null and empty texts stay as they are, and so do rows without doc_id. Rows
    that repeat lose the same lines; a text of which every line goes is empty.
    """
    own, back = aside(docs, "n_lines", "n_dropped")
    return line_dedup.dedup_lines(own).drop("n_lines", "n_dropped").withColumnsRenamed(back).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: a similarity of 0.8 or more in shingles of five words.

    It is that of the smallest doc_id. Null and empty texts are copies of each
    other; of rows that repeat one stays; of rows without doc_id one of each text.
    """
    return simhash.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go.

    Null and empty texts hold none. Rows that repeat go or stay together, those
    without doc_id by their own text.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 4,096 tokens.

    Each row is a document; null and empty texts are one end token. Which of
    pieces of equal length comes first is open.
    """
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: The toxicity model and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
