"""A corpus pipeline of five stages over documents; each is one call of an operator in streamwatch.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamwatch.llm import chosen_path, mixing, packing, pii, toxicity
from streamwatch.llm.common import delete, read, shared_folder
from streamwatch.llm.queries import PACK_MODEL, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, as they are.

    A null text counts as empty; repeated rows stay or go together; a column named like the score keeps its values.
    """
    name = "_toxicity"
    while name in docs.columns:
        name = "_" + name
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, name).filter(F.col(name) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: the one of the smallest doc_id; one row of it, if it has several.

    Unlike texts of one doc_id are groups of their own. Rows of a null id and texts without words all stay.
    """
    return chosen_path.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the names of their kinds; a null text stays null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole; texts without words are never taken; equal rows count each."""
    return mixing.mixed_corpus(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null text is one piece, its closing id."""
    return packing.pack(docs, tokenizer_path(PACK_MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Classifiers, chosen paths and tokenizers aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, with a Parquet table in the shared folder after each but the last.

    A stage's table is deleted when the next one's is written; the last one stays, for the result reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                delete(spark, f"{folder}/{k - 1}")
    return docs
