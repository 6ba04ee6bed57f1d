"""Byte-level BPE by monoid tree reduction.

Encoded pieces of a text form a monoid: neighbours are joined by encoding a window around their border
anew, grown on either side up to the next place where a cut provably changes nothing.  Such a place lies
before white space that follows other characters: none of the pattern's alternatives goes on from a
character that isn't white space to one that is, none looks back, and the one that looks ahead does so
only from white space; so a match ends there whatever stands to its right, and the next starts there
whatever stands to its left.  Merges never cross a match, hence tokens outside the window are final.

Leaves are so short that any text of more than a few words is put together by the tree.  Text without
white space has no such places: its windows grow to its whole length, at each level of the tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import Kept, named, slices

#: Characters of a leaf of the tree, at most; ids of a leaf in decoding.
LEAF = 64
#: White space after another character; the four separators that the pattern doesn't take for it are left out.
_STABLE = re.compile(r"(?<=\S)[^\S\x1c-\x1f]")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """Encodes and decodes by a tree; `ranks` maps byte strings to ids.

    Texts are split by public_tokenizers.PATTERN: what places are stable was shown for it alone.
    """

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF):
        self.base = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = {i: len(t) for t, i in ranks.items()}  # bytes of each token
        self.leaf = max(1, leaf)

    @staticmethod
    def stable(text: str) -> list[int]:
        """The places, ascending, where a cut leaves all tokens on both sides as they are; both ends are among them."""
        return [0, *(m.start() for m in _STABLE.finditer(text)), len(text)]

    def encode(self, text: str) -> list[int]:
        """The ids of the text, equal to those of encoding it in one go."""
        return [t for _, _, ids in self._tree(text, self.stable(text), 0, len(text)) for t in ids]

    def _tree(self, text: str, places: list[int], start: int, end: int) -> list[tuple[int, int, list[int]]]:
        """Runs (start, end, ids) that follow one another from start to end; inner borders are stable."""
        if end - start <= self.leaf:
            return [(start, end, self.base.encode_ordinary(text[start:end]))] if end > start else []
        middle = (start + end) // 2
        return self._join(text, places, self._tree(text, places, start, middle), self._tree(text, places, middle, end))

    def _join(self, text: str, places: list[int], left: list, right: list) -> list[tuple[int, int, list[int]]]:
        """The monoid's product of two neighbouring lists of runs: the window around their border encoded anew."""
        if not left or not right:
            return left + right
        border = right[0][0]
        k = bisect_left(places, border)
        if places[k] == border:
            return left + right
        lo, hi = max(places[k - 1], left[0][0]), min(places[k], right[-1][1])
        return [*self._head(text, left, lo), (lo, hi, self.base.encode_ordinary(text[lo:hi])), *self._tail(text, right, hi)]

    def _head(self, text: str, runs: list, at: int) -> list[tuple[int, int, list[int]]]:
        """The runs before `at`; tokens of the run that it cuts are counted off from the end, by bytes."""
        k = len(runs)
        while k and runs[k - 1][0] >= at:
            k -= 1
        if not k or runs[k - 1][1] <= at:
            return runs[:k]
        start, end, ids = runs[k - 1]
        room, n = len(text[at:end].encode()), len(ids)
        while room > 0:
            n -= 1
            room -= self.size[ids[n]]
        if room:
            raise AssertionError("a token crosses a stable place")
        return [*runs[: k - 1], (start, at, ids[:n])]

    def _tail(self, text: str, runs: list, at: int) -> list[tuple[int, int, list[int]]]:
        """The runs from `at` on; tokens of the run that it cuts are counted off from the start, by bytes."""
        k = 0
        while k < len(runs) and runs[k][1] <= at:
            k += 1
        if k == len(runs) or runs[k][0] >= at:
            return runs[k:]
        start, end, ids = runs[k]
        room, n = len(text[start:at].encode()), 0
        while room > 0:
            room -= self.size[ids[n]]
            n += 1
        if room:
            raise AssertionError("a token crosses a stable place")
        return [(at, end, ids[n:]), *runs[k + 1 :]]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, concatenated up a tree of halves."""
        if len(ids) <= self.leaf:
            return self.base.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_CODERS: dict[tuple, Coder] = {}


def _coder(ranks, leaf: int) -> Coder:
    """One coder for each worker process and vocabulary."""
    key = (ranks.id if hasattr(ranks, "id") else id(ranks), leaf)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(ranks.value, leaf)
    return _CODERS[key]


def encode_texts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, leaf: int = LEAF, with_ids: bool = True) -> DataFrame:
    """Encode every text; returns `keep`, n_tokens, ids, ids_sha256 and decoded_sha256.

    ids_sha256 is that of the decimal ids joined by commas, decoded_sha256 that of the bytes which the
    ids decode to.  A null text counts as empty: no ids.  Special tokens' strings are ordinary text.
    Repeated rows each give a row; an empty table gives an empty result; a kept column that has the name
    of a result gets _kept behind it.  `path` names the vocabulary file on the driver; its ranks (about
    1 MB, whatever the input) are broadcast.  with_ids=False leaves out the column ids.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(path or public_tokenizers.path(VOCABULARY)))
    kinds = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    names = [n for n in kinds if with_ids or n != "ids"]
    kept = Kept(keep, names)
    rows = docs.select(named(text_col).alias("text"), *kept.inside())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, leaf)
        for part in slices(batches, "text"):
            count, every, digest, back = [], [], [], []
            for text in part.column("text").to_pylist():
                ids = coder.encode(text or "")
                count.append(len(ids))
                digest.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                if with_ids:
                    every.append(ids)
            made = {"n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(digest, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if with_ids:
                made["ids"] = pa.array(every, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept.names), *(made[n] for n in names)], [*kept.names, *names])

    done = rows.mapInArrow(run, kept.schema(rows, ", ".join(f"{n} {kinds[n]}" for n in names)))
    return done.select(*kept.outside(), *names)


def decode_ids(rows: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """Decode arrays of ids; returns `keep` and text.  Null and empty arrays give an empty text.

    Bytes that are no valid UTF-8 become the replacement character.  A kept column named text comes out
    as text_kept.
    """
    spark = rows.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(path or public_tokenizers.path(VOCABULARY)))
    kept = Kept(keep, ("text",))

    @F.pandas_udf("string")
    def decoded(ids):  # noqa: ANN001, ANN202
        coder = _coder(ranks, LEAF)
        return ids.map(lambda x: coder.decode([int(t) for t in x] if x is not None else []).decode("utf-8", "replace"))

    return rows.select(named(ids_col).alias("ids"), *kept.inside()).select(*kept.outside(), decoded(F.col("ids")).alias("text"))
