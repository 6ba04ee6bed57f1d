"""A filtering pipeline over `documents`: toxicity, repeated lines, near duplicates, benchmark items, tokens.

Each stage takes documents with the columns doc_id (a whole number, may be null or repeated), text (may be
null or empty) and any others, under whatever names: inside a stage they are numbered.  Rows are judged one
by one; an empty table stays empty.  All stages but the last return the columns that they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import bpe, decontamination, lines, neardups, toxicity
from undula.llm.common import Tables
from undula.session import ship_package

#: Documents with this toxicity score or more are rejected.
TOXIC = 0.3
#: What stages' results read until they are written.
_READ: list[Tables] = []


class Numbered:
    """Documents with numbered columns, which clash with no operator's, and the way back."""

    def __init__(self, docs: DataFrame) -> None:
        self.names = docs.columns
        self.numbers = tuple(f"column_{i}" for i in range(len(self.names)))
        self.docs = docs.toDF(*self.numbers)

    def __getitem__(self, name: str) -> str:
        return self.numbers[self.names.index(name)]

    def back(self, rows: DataFrame, **changed: Column) -> DataFrame:
        """The documents' columns, some of them from other expressions."""
        return rows.select(*[changed.get(n, F.col(c)).alias(n) for n, c in zip(self.names, self.numbers, strict=True)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that aren't scored toxic; learns from labelled documents of the learnable folds.

    A null or empty text has the score of a text without words, so it stays unless nothing but toxic
    texts was seen; so does every text where there are no labels.
    """
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = Numbered(docs)
    machine = toxicity.fit(docs, toxicity.learnable(labels))
    scored = toxicity.score(own.docs, machine, own["text"], own.numbers)
    return own.back(scored.where(F.col("score") < TOXIC))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that three or more documents hold; n_chars, where there is one, follows.

    A document all of whose lines go stays with an empty text, a null text stays null.  Rows that repeat
    an id are one document; those with a null id lose frequent lines and make none frequent.
    """
    ship_package(spark)
    own = Numbered(docs)
    done = lines.dedup_lines(own.docs, own["doc_id"], own["text"], keep=tuple(c for c in own.numbers if c != own["doc_id"]))
    changed = {"text": F.col("kept")}
    if "n_chars" in own.names:
        changed["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return own.back(done, **changed)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates: one with the least doc_id, null only if all are.

    Of rows that repeat that id and text one stays.  Null and empty texts are one class, other texts
    without words are in one with their equals.
    """
    ship_package(spark)
    own = Numbered(docs)
    _READ.append(Tables(spark))
    classed = neardups.near_duplicates(own.docs, own["doc_id"], own["text"], keep=tuple(c for c in own.numbers if c != own["doc_id"]), tables=_READ[-1])
    return own.back(classed.where("is_first"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.  Ids play no part; null and empty texts hold none."""
    ship_package(spark)
    own = Numbered(docs)
    flagged = decontamination.flag_items(own.docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), own["text"], keep=own.numbers)
    return own.back(flagged.where("not holds_item"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the bytes that they decode to; null is empty."""
    ship_package(spark)
    return bpe.encode_texts(docs).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: Scores of a trained machine can't be had in SQL; tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`, each result written as Parquet in the shared folder and read again.

    A stage's table is deleted when the next one's is written; the last stays, as the result reads it.
    """
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        name = f"stage-{uuid.uuid4().hex}"
        docs = tables.write(stage(spark, docs, sf_dir), name)
        tables.keep(name)
        while _READ:
            _READ.pop().keep()
    return docs
