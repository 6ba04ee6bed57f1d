"""Near-duplicate classes by DartMinHash.

Each shingle of a text is a region of weight one, however often it occurs there, as links are defined on
sets.  Darts hit it at the times of a Poisson process seeded by the shingle, so texts that share a shingle
share its darts.  A dart has a coordinate of the signature, and each coordinate keeps its earliest dart: two
texts agree in one with the probability of the Jaccard similarity of their sets.  A text throws only darts
up to a time that is expected to fill all coordinates, and doubles it while some are empty.

Coordinates are joined in bands.  A bucket of few texts is looked through in one task.  In a larger one
all members are compared with the bucket's head, the text that shares most buckets; then all that are not
in the head's component lead in turn, a block of them at a time, against all members of other components.
Of two like texts in different components one at least is not in the head's, so it leads and finds the
other: no link between components is lost, and comparisons are members times leaders.  Comparisons are of
the exact Jaccard similarity of the sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.llm.common import Kept, Tables, id_column, named, slices, text_array
from undula.llm.components import components
from undula.llm.shingles import distinct, mix, shingles

SIMILARITY = 0.8
#: At 0.8, a pair is in no common bucket with probability (1 - 0.8**ROWS)**BANDS = 3.5e-4.
BANDS, ROWS = 20, 5
#: Texts of a bucket that is looked through in one task, at most, and their shingles (8 bytes each).
SMALL, SMALL_SHINGLES = 512, 1 << 22
U = np.uint64
_STEP = 4


def regions_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The regions of the texts (64-bit keys), one for each distinct shingle, and n+1 offsets."""
    values, _, at = distinct(*shingles(texts))
    return mix(values), at


def signatures(regions: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart of each coordinate, as (texts, k) 64-bit dart ids; texts without regions get zeros."""
    n = np.diff(offsets)
    out = np.zeros((len(n), k), U)
    todo = np.flatnonzero(n > 0)
    until = (np.log(k) + 2.0) * k / np.maximum(n, 1)  # darts come at rate 1 in each region
    while len(todo):
        size = n[todo]
        row = np.repeat(np.arange(len(todo)), size)
        key = regions[np.repeat(offsets[todo] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
        limit = until[todo][row]
        past, ids, rows, times = np.zeros(len(key)), [], [], []
        turn = np.arange(1, _STEP + 1, dtype=U)
        while len(key):
            dart = mix(key[:, None] + turn[None, :] * U(0xD1342543DE82EF95))
            gap = -np.log(((dart >> U(12)).astype(np.float64) + 0.5) * 2.0**-52)
            when = past[:, None] + np.cumsum(gap, 1)
            hit = when <= limit[:, None]
            at = np.nonzero(hit)
            ids.append(mix(dart[at]))
            rows.append(row[at[0]])
            times.append(when[at])
            more = hit[:, -1]
            key, row, limit, past = key[more], row[more], limit[more], when[more, -1]
            turn = turn + U(_STEP)
        ids, rows, times = np.concatenate(ids), np.concatenate(rows), np.concatenate(times)
        slot = rows * k + (ids % U(k)).astype(np.int64)
        order = np.argsort(times, kind="stable")[::-1]
        least = np.zeros(len(todo) * k, U)
        filled = np.zeros(len(todo) * k, bool)
        least[slot[order]] = ids[order]  # the earliest is written last
        filled[slot] = True
        full = filled.reshape(-1, k).all(1)
        out[todo[full]] = least.reshape(-1, k)[full]
        todo = todo[~full]
        until[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) signed 64-bit keys of the bands, the band's number mixed in."""
    s = signature.reshape(-1, bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U)), s.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + s[:, :, r])
    return key.view(np.int64)


def _signed(bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            texts = text_array(part.column("text"))
            regions, at = regions_of(texts)
            keys = band_keys(signatures(regions, at, bands * rows), bands, rows)
            some = np.diff(at) > 0
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * bands))), pa.int32()), pa.array(keys[some].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("content"), flat, pa.array(np.diff(at))], ["id", "content", "keys", "size"])

    return run


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        values, _, at = distinct(*shingles(text_array(part.column("text"))))
        flat = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column("content"), flat], ["content", "shingles"])


def _within(similarity: float):
    """Links within each run of rows of one group: all texts of a group end up compared or connected."""

    def linked(contents: list[bytes], sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        root, out = list(range(len(sets))), []
        for j in range(len(sets)):
            for i in range(j):
                if root[i] == root[j]:
                    continue
                a, b = sets[i], sets[j]
                if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
                    continue
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if shared >= similarity * (len(a) + len(b) - shared) - 1e-9:
                    out.append((contents[i], contents[j]))
                    old, new = root[j], root[i]
                    root = [new if r == old else r for r in root]
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, contents, sets, out = None, [], [], []
        for batch in batches:
            values, at = np.asarray(batch.column("shingles").flatten()), np.concatenate(([0], np.cumsum(batch.column("shingles").value_lengths().to_numpy())))
            for i, (group, content) in enumerate(zip(batch.column("group").to_pylist(), batch.column("content").to_pylist(), strict=True)):
                if group != now:
                    out += linked(contents, sets)
                    now, contents, sets = group, [], []
                contents.append(content)
                sets.append(values[at[i] : at[i + 1]].copy())
        out += linked(contents, sets)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["a", "b"])

    return run


def _led(similarity: float):
    """Links between the leaders and the members of each run of rows of one group, leaders first.

    A member is linked to one leader of each component that it is alike to, so links are no more than
    members and leaders.  Holds the leaders' sets (a block of them) and one batch of members.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leading, index = None, [], None
        for batch in batches:
            a, b = [], []
            values, at = np.asarray(batch.column("shingles").flatten()), np.concatenate(([0], np.cumsum(batch.column("shingles").value_lengths().to_numpy())))
            columns = [batch.column(c).to_pylist() for c in ("group", "leads", "content", "root")]
            for i, (group, leads, content, root) in enumerate(zip(*columns, strict=True)):
                own = values[at[i] : at[i + 1]]
                if group != now:
                    now, leading, index = group, [], None
                if leads:
                    leading.append((content, root, own.copy()))
                    continue
                if index is None:
                    index = _Leaders(leading, similarity)
                for leader in index.alike(content, root, own):
                    a.append(leader)
                    b.append(content)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


class _Leaders:
    """The shingles of a block of leaders, each with the leaders that hold it."""

    def __init__(self, leading: list[tuple[bytes, bytes, np.ndarray]], similarity: float) -> None:
        self.contents, self.similarity = [x[0] for x in leading], similarity
        self.sizes = np.array([len(x[2]) for x in leading], np.int64)
        flat = np.concatenate([x[2] for x in leading])
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(leading)), self.sizes)[order]
        self.values, first = np.unique(flat[order], return_index=True)
        self.ends = np.append(first, len(flat))
        self.number: dict[bytes, int] = {}  # of a component, as far as known here
        self.component = np.array([self.number.setdefault(x[1], len(self.number)) for x in leading])

    def alike(self, content: bytes, root: bytes, own: np.ndarray) -> list[bytes]:
        """A like leader of each other component; these components become one with the member's."""
        place = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        place = place[self.values[place] == own]
        n = self.ends[place + 1] - self.ends[place]
        at = np.repeat(self.ends[place] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else place
        shared = np.bincount(self.owner[at], minlength=len(self.sizes))
        mine = self.number.setdefault(root, len(self.number))
        like = (shared >= self.similarity * (self.sizes + len(own) - shared) - 1e-9) & (self.component != mine)
        if not like.any():
            return []
        found, first = np.unique(self.component[like], return_index=True)
        self.component[np.isin(self.component, found)] = mine
        for known, number in self.number.items():
            if number in found:
                self.number[known] = mine
        return [self.contents[i] for i in np.flatnonzero(like)[first]]


def linked_components(texts: DataFrame, rows: DataFrame, similarity: float, small: int = SMALL, room: int = SMALL_SHINGLES, tables: Tables | None = None) -> DataFrame:
    """The components (node, root) of all links between like contents that share a bucket.  `texts`: content, keys, size; `rows`: content, text.

    A bucket of at most `small` texts with at most `room` shingles is looked through in one task; equal buckets of several bands are
    one.  In larger ones the heads lead first and then blocks, as large as that, of those members that
    haven't led and aren't in their head's component; members are dealt to tasks by about as many, each with the whole
    block of leaders.

    Texts are made distinct within each task before they are shuffled.  The sizes of buckets and the
    groups of small ones grow with the input and are never broadcast; other joins are left to Spark's own
    check of the size.
    """
    tables = tables or Tables(rows.sparkSession)
    keys = texts.select("content", "size", F.explode("keys").alias("key"))
    parts = F.greatest(F.ceil(F.count("*") / small), F.ceil(F.sum("size") / room)).cast("int")
    sized = tables.write(keys.groupBy("key").agg(F.count("*").alias("n"), parts.alias("parts")).where("n > 1"), "sized")
    members = tables.write(keys.join(sized.hint("merge"), "key").select("key", "content", "size", "n", "parts"), "members")
    wanted = tables.write(members.select("content").distinct(), "wanted")
    sets = tables.write(rows.dropDuplicates(["content"]).join(wanted, "content").mapInArrow(_sets, "content binary, shingles array<bigint>"), "sets")
    groups = members.where("parts = 1").groupBy("key").agg(F.array_sort(F.collect_list("content")).alias("all")).select("all").distinct()
    groups = tables.write(groups.select(F.xxhash64("all").alias("group"), F.explode("all").alias("content")), "groups")
    within = groups.hint("merge").join(sets, "content").repartition("group").sortWithinPartitions("group", "content")
    found = tables.write(within.mapInArrow(_within(similarity), "a binary, b binary"), "links")
    crowded = members.where("parts > 1")
    roots = components(found, tables)
    if crowded.isEmpty():
        tables.keep("least")
        return roots
    weights = tables.write(crowded.groupBy("content").agg(F.sum("n").alias("weight")), "weights")
    crowded = tables.write(crowded.join(weights, "content").select("key", "content", "size", "parts", "weight"), "crowded")
    order = F.struct((-F.col("weight")).alias("order"), F.col("content").alias("head"))
    heads = tables.write(crowded.groupBy("key").agg(F.min(order).alias("first")).select("key", "first.head"), "heads")
    state = crowded.join(heads, "key").select("*", (F.col("content") == F.col("head")).alias("leads"), F.lit(False).alias("led"))
    state = tables.write(_rooted(state, roots), "state")
    turn = Window.partitionBy("key").orderBy(F.desc("weight"), "content")
    upto = turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        leaders = state.where("leads")
        block = leaders.select("key", "content", "root", "leads", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"))
        # where all leaders are in one component, its members have nothing to look for
        spread = tables.write(leaders.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")), "spread")
        others = state.join(spread, "key").where("low != high or root != low")
        others = others.select("key", "content", "root", F.lit(False).alias("leads"), F.pmod(F.xxhash64("content"), "parts").cast("int").alias("chunk"))
        dealt = tables.write(block.union(others).select(F.xxhash64("key", "chunk").alias("group"), "leads", "content", "root"), "dealt")
        compared = dealt.join(sets, "content").repartition("group").sortWithinPartitions("group", F.desc("leads"), "content")
        # what was connected before is said in as few edges as there are nodes
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        found = tables.write(known.union(compared.mapInArrow(_led(similarity), "a binary, b binary")), "links")
        roots = components(found, tables)
        state = tables.write(_rooted(state.withColumn("led", F.expr("led or leads")).drop("root", "leads"), roots), "state")
        main = tables.write(state.where("content = head").select("key", F.col("root").alias("main")), "main")
        # a rank with a limit alone is cut in each task before the shuffle, so no task has all that wait in a bucket
        waiting = state.join(main, "key").where("not led and root != main").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= small)
        block = waiting.withColumn("upto", F.sum("size").over(upto)).where((F.col("turn") == 1) | (F.col("upto") <= room))
        following = tables.write(block.select("key", "content", F.lit(True).alias("next")), "following")
        if following.isEmpty():
            tables.keep("least")
            return roots
        # buckets in which nobody waits are done with
        state = state.join(following.select("key").distinct(), "key").join(following, ["key", "content"], "left")
        state = tables.write(state.withColumn("leads", F.coalesce("next", F.lit(False))).drop("next"), "state")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """`members` with the component of each content; one without links is its own."""
    return members.join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, keep: tuple[str, ...] = (), tables: Tables | None = None) -> DataFrame:
    """Each row's class: returns id_col, the columns named in `keep`, class_id and is_first.

    Two texts are linked if they are equal, or if the sets of their shingles (five words; all words of a
    shorter text) have a Jaccard similarity of `similarity` or more; classes are the components of the
    links.  class_id is the least id in the class; is_first marks one row of the class, of a text with
    that id.  Texts without words (null, empty, blank) are linked only to equal ones, null and empty
    being equal.  Rows that repeat an id are told apart by text; a null id is no class_id unless the
    class has no other.  Ids are whole numbers.  A kept column that has the name of a result gets _kept
    behind it.  An empty table gives an empty result.

    The result reads a table of `tables` (of its own if none is given), which the caller may drop once
    the result is written.
    """
    carried = Kept((id_col, *keep), ("class_id", "is_first"))
    tables = tables or Tables(docs.sparkSession)
    own = docs.select(id_column(docs, id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    signed = own.select("id", _content(F.col("text")).alias("content"), "text").mapInArrow(_signed(bands, rows), "id bigint, content binary, keys array<bigint>, size bigint")
    each = signed.groupBy("content", "id").agg(F.first("keys").alias("keys"), F.first("size").alias("size"), F.count("*").alias("copies"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "copies")).alias("least")
    texts = tables.write(each.groupBy("content").agg(least, F.first("keys").alias("keys"), F.first("size").alias("size")), "texts")
    by_content = own.select(_content(F.col("text")).alias("content"), "text")
    linking = Tables(docs.sparkSession)
    roots = linked_components(texts, by_content, similarity, tables=linking)
    classed = texts.select("content", "least").join(roots, F.col("content") == F.col("node"), "left")
    classed = tables.write(classed.select("content", "least", F.coalesce("root", "content").alias("root")), "classed")
    linking.keep()
    first = F.min(F.struct(F.col("least.none"), F.col("least.id"), "content", F.col("least.copies"))).alias("first")
    leads = tables.write(classed.groupBy("root").agg(first), "leads")
    classes = classed.join(leads, "root").select("content", F.col("first.id").alias("class_id"), (F.col("content") == F.col("first.content")).alias("first"), F.col("first.copies").alias("copies"))
    classes = tables.write(classes, "classes")
    tables.keep("classes")
    every = docs.select(id_column(docs, id_col).alias("id"), _content(F.coalesce(named(text_col), F.lit(""))).alias("content"), *carried.inside())
    made = every.join(classes, "content").withColumn("is_first", F.col("first") & F.col("id").eqNullSafe(F.col("class_id")))
    if not classes.where("first and copies > 1").isEmpty():
        # one of equally first rows: the first in each of many parts, and the first of those
        split = F.col("is_first") & (F.col("copies") > 1)
        turn = lambda *by: F.row_number().over(Window.partitionBy("content", *by).orderBy(F.xxhash64(*carried.names))) == 1
        parts = made.where(split).withColumn("part", F.spark_partition_id()).withColumn("is_first", turn("part")).drop("part")
        ahead = parts.where("is_first").withColumn("is_first", turn())
        made = made.where(~split).unionByName(parts.where("not is_first")).unionByName(ahead)
    return made.select(*carried.outside(), "class_id", "is_first")


def _content(text: Column) -> Column:
    """The 16-byte hash that names a text."""
    return F.unhex(F.md5(text.cast("binary")))
