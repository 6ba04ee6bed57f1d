"""Line deduplication over a whole corpus.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased.  Keys that
are long enough and found in enough documents lose their lines in all documents but one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import Kept, id_column, named, slices

#: Code points that a key needs at least, and documents that hold it.
MIN_CHARS, MIN_DOCS = 20, 3
_BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key; None if the key is too short to count."""
    key = line.strip(_BLANK).lower()  # bytes.lower() changes A-Z alone
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _keys(min_chars: int):
    """One row for each key of a text, with the positions of its lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids, marks, keys, places = [], [], [], []
            for doc, mark, text in zip(*(part.column(c).to_pylist() for c in ("id", "mark", "text")), strict=True):
                own: dict[bytes, list[int]] = {}
                for at, line in enumerate((text or "").encode().split(b"\n")):
                    if key := line_key(line, min_chars):
                        own.setdefault(key, []).append(at)
                ids += [doc] * len(own)
                marks += [mark] * len(own)
                keys += own
                places += own.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(keys, pa.binary()), pa.array(places, pa.list_(pa.int32()))], ["id", "mark", "key", "places"])

    return run


def _kept(extra: list[str]):
    """The lines of each text that aren't in lost places, in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            total, dropped, texts = [], [], []
            for text, lost in zip(part.column("text").to_pylist(), part.column("lost").to_pylist(), strict=True):
                lines, gone = (text or "").split("\n"), set(lost or ())
                total.append(len(lines))
                dropped.append(len(gone))
                texts.append("\n".join(x for at, x in enumerate(lines) if at not in gone) if gone else text)
            made = [pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in extra), *made], [*extra, "n_lines", "n_dropped", "kept"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop repeated lines; returns id_col, the columns named in `keep`, n_lines, n_dropped and kept.

    A key of at least `min_chars` code points, found in at least `min_docs` distinct ids, loses all its
    lines except in the largest id that holds it.  n_lines counts lines before, n_dropped those lost,
    kept is the rest joined by newlines, null only if the text was null (one empty line).

    Rows that repeat an id count as one document: a key stays or goes in all of them.  Rows with a null
    id hold no key, but lose the lines whose key is frequent.  Ids are whole numbers.  A kept column that
    has the name of a result gets _kept behind it.  An empty table gives an empty result.

    Lines are exploded as a key and its places in a text, and a text is reassembled by the places that it
    loses.  Rows are told apart by id and text, so those with a null id don't share one list of places.
    """
    carried = Kept((id_col, *keep), ("n_lines", "n_dropped", "kept"))
    rows = docs.select(id_column(docs, id_col).alias("id"), F.xxhash64(id_column(docs, id_col), named(text_col)).alias("mark"), named(text_col).alias("text"), *carried.inside())
    pairs = rows.select("id", "mark", "text").mapInArrow(_keys(min_chars), "id bigint, mark bigint, key binary, places array<int>").distinct()
    # counted by key and document first, so that a key in a third of all documents is spread over all tasks
    held = pairs.select("id", "key").distinct().groupBy("key").agg(F.count("id").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs).drop("n")
    lost = pairs.join(held, "key").where("id is null or id < last").groupBy("mark").agg(F.flatten(F.collect_list("places")).alias("lost"))
    done = rows.join(lost, "mark", "left").mapInArrow(_kept(carried.names), carried.schema(rows, "n_lines bigint, n_dropped bigint, kept string"))
    return done.select(*carried.outside(), "n_lines", "n_dropped", "kept")
