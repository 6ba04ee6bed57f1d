"""Benchmark decontamination: size-partitioned MinHash containment search.

A document falls into the partition 2**(p-1) < n <= 2**p of its number n of distinct shingles.  Its
signature has 2**(p+e) coordinates, equal parts of the hash range, and keeps the least hash of each.

Items are partitioned by what they need.  An item of n shingles is sought if a document holds c of them
(the threshold's share); so of any n - c + m shingles, the document holds m.  Those that fewest items hold
are sought, with m a quarter of c: what many items have in common, such as a prompt, makes no candidates
unless it is most of an item.  e is the least at which all of those m get lost from the signature with a
probability of at most MISS: long items need few coordinates, short ones nearly all of a document's
hashes.  Pairs that share a coordinate's hash are then verified by exact shingle containment.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import Kept, id_column, named, slices, text_array
from undula.llm.shingles import distinct, mix, shingles

THRESHOLD = 0.8
#: Probability that an item at the threshold is overlooked, at most.
MISS = 1e-6
#: One of so many contained shingles is to be among the rare ones that are sought.
RARE = 4
#: Coordinates of a partition are never fewer than 2**(p+LEAST).
LEAST = -3
#: Characters of items that are broadcast at once; a larger benchmark is searched in several blocks.
BLOCK_CHARS = 16_000_000
#: Shingles of candidate items that are verified at once.
_CHECKED = 1 << 20


def loss(e: int) -> float:
    """The probability that one shingle is lost where there is at most one for each 2**e coordinates."""
    load = 2.0**-e
    return 1 - (1 - math.exp(-load)) / load


def extra_bits(m: int, miss: float = MISS) -> int:
    """The least e at which m shingles are all lost with probability `miss` at most."""
    e = LEAST
    while m * math.log(loss(e)) > math.log(miss):
        e += 1
    return e


def size_class(n: np.ndarray) -> np.ndarray:
    """p with 2**(p-1) < n <= 2**p."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def coordinates(values: np.ndarray, owner: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Mask of the least value of each coordinate; values ascend within an owner, bits is by owner."""
    bits = np.clip(bits, 0, 64)
    low = (64 - bits).astype(np.uint64)[owner]
    place = np.where(bits[owner] > 0, values >> np.minimum(low, np.uint64(63)), 0)
    first = np.ones(len(values), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
    return first


class ItemIndex:
    """The items' shingles, and the sought ones of each partition of items, sorted by value."""

    def __init__(self, texts: list[str], threshold: float = THRESHOLD, miss: float = MISS):
        values, _, self.at = distinct(*shingles(text_array(pa.array(texts, pa.large_string()))))
        self.values, self.size, self.threshold = values, np.diff(self.at), threshold
        owner = np.repeat(np.arange(len(texts)), self.size)
        _, back, items = np.unique(values, return_inverse=True, return_counts=True)
        order = np.lexsort((values, items[back], owner)) if len(values) else np.zeros(0, np.int64)
        rank = np.arange(len(values)) - self.at[owner]  # of each item's shingles, the rarest first
        contained = np.maximum(1, np.ceil(threshold * self.size - 1e-9)).astype(np.int64)
        some = -(-contained // RARE)
        sought = rank < (self.size - contained + some)[owner]
        need = np.array([extra_bits(int(m), miss) for m in some], np.int64)
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for e in np.unique(need[self.size > 0]):
            mine = order[sought & (need[owner] == e)]
            mine = mine[np.argsort(values[mine], kind="stable")]
            self.parts[int(e)] = values[mine], owner[mine]

    def search(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, items and containments of all pairs at or over the threshold."""
        values, _, at = distinct(*shingles(texts))
        n = np.diff(at)
        owner, p = np.repeat(np.arange(len(n)), n), size_class(n)
        pairs = [np.zeros(0, np.int64)]
        for e, (sought, item) in self.parts.items():
            kept = np.flatnonzero(coordinates(values, owner, p + e))
            have = values[kept]
            lo = np.searchsorted(sought, have, "left")
            hit = np.flatnonzero(sought[np.minimum(lo, len(sought) - 1)] == have)
            lo, count = lo[hit], np.searchsorted(sought, have[hit], "right") - lo[hit]
            met = item[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
            pairs.append(np.unique(np.repeat(owner[kept[hit]], count) * len(self.size) + met))
        pairs = np.concatenate(pairs)
        rows, items = pairs // max(1, len(self.size)), pairs % max(1, len(self.size))
        share = self._containment(values, owner, rows, items)
        good = share >= self.threshold - 1e-12
        return rows[good], items[good], share[good]

    def _containment(self, values: np.ndarray, owner: np.ndarray, rows: np.ndarray, items: np.ndarray) -> np.ndarray:
        """The exact containment of each pair, as many pairs at a time as _CHECKED allows."""
        out = np.zeros(len(rows))
        wanted = np.isin(owner, rows)
        known = np.sort(_in_row(values[wanted], owner[wanted]))
        total = np.cumsum(self.size[items])
        first = 0
        while first < len(rows):
            base = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, base + _CHECKED, "right")))
            n = self.size[items[first:last]]
            of = np.repeat(np.arange(len(n)), n)
            place = np.repeat(self.at[items[first:last]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            sought = _in_row(self.values[place], rows[first:last][of])
            met = known[np.minimum(np.searchsorted(known, sought), len(known) - 1)] == sought
            out[first:last] = np.bincount(of[met], minlength=len(n)) / n
            first = last
        return out


def _in_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One 64-bit key for a shingle in a row."""
    return mix(values ^ mix(rows.astype(np.uint64) + np.uint64(1)))


def _indices(benchmark: DataFrame, item_col: str, text_col: str, threshold: float, block_chars: int) -> Iterator[tuple[ItemIndex, list[int | None]]]:
    """Indices of all items, each of about `block_chars` characters, with the items' ids."""
    items = benchmark.select(id_column(benchmark, item_col).alias("item"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        yield ItemIndex([r.text for r in some], threshold), [r.item for r in some]


def search_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id_col, item_col, n_shingles, containment): all items of which a document holds `threshold` or more.

    n_shingles is the item's number of distinct shingles of five words.  Items without words match
    nothing, texts without words hold nothing; repeated rows and items each give their pairs; null ids
    are carried along.  Ids are whole numbers.  An empty table on either side gives an empty result.

    Items are broadcast, at most about `block_chars` characters at once: a larger benchmark is cut into
    so many blocks by a hash of its items, and the documents are searched for one block after another.
    """
    rows = docs.select(id_column(docs, id_col).alias("id"), named(text_col).alias("text"))
    found = None
    for index in _indices(benchmark, item_col, item_text_col, threshold, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search, ids = sent.value
            for part in slices(batches, "text"):
                row, item, share = search.search(text_array(part.column("text")))
                own = part.column("id").take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([own, pa.array([ids[i] for i in item], pa.int64()), pa.array(search.size[item], pa.int64()), pa.array(share, pa.float64())], ["id", "item", "n_shingles", "containment"])

        one = rows.mapInArrow(run, "id bigint, item bigint, n_shingles bigint, containment double")
        found = one if found is None else found.unionByName(one)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_shingles", "containment")


def flag_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`keep` and holds_item for each row: whether search_items would find an item in its text.

    Rows are judged one by one, whatever their ids; a kept column named holds_item comes out as
    holds_item_kept.  Otherwise as search_items.
    """
    kept = Kept(keep, ("holds_item",))
    rows = docs.select(named(text_col).alias("text"), *kept.inside()).withColumn("holds_item", F.lit(False))
    for index in _indices(benchmark, item_col, item_text_col, threshold, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search, _ = sent.value
            for part in slices(batches, "text"):
                held = np.array(part.column("holds_item").to_pylist(), bool)
                held[search.search(text_array(part.column("text")))[0]] = True
                yield pa.RecordBatch.from_arrays([part.column("text"), *(part.column(n) for n in kept.names), pa.array(held)], ["text", *kept.names, "holds_item"])

        rows = rows.mapInArrow(run, "text string, " + kept.schema(rows, "holds_item boolean"))
    return rows.select(*kept.outside(), "holds_item")
