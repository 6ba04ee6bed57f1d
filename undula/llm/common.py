"""What several operators share: lineage cuts, bounded Arrow slices and deterministic samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step holds; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session's spark.checkpoint.dir names, for all executors and the driver.

    Where that is unset, a local session gets a temporary one; a cluster's gets a RuntimeError, as its
    executors share no such folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="undula-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so that later stages survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Tables:
    """Named Parquet tables in the shared folder, for loops that cut their lineage in each turn.

    Unlike checkpoints they have true sizes (a checkpoint keeps its plan's estimate, whose digits double
    with each join in a loop), small files are read many to a task, and a table goes when it is replaced.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}
        self.folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """`df` as it is read from its table; the earlier table of this name is deleted afterwards."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete these tables; what is yet to be computed mustn't read them."""
        for path in [self.paths.pop(n) for n in names if n in self.paths]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        self.drop(*[n for n in self.paths if n not in names])


def text_array(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The array as one pa.large_string without nulls (null becomes empty)."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    return array.cast(pa.large_string()).fill_null("")


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a pa.large_string and its n+1 offsets into them."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if len(array) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with at most `limit` bytes in `column` (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(np.diff(text_bytes(text_array(batch.column(column)))[1]))
        i = 0
        while i < batch.num_rows:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(i, j - i)
            i = j


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n: the fixed folds of the learning operators."""
    return F.crc32(doc_id.cast("string")) % n


def hash_share(key: Column, share: float, seed: str) -> Column:
    """True for a pseudo-random `share` of the keys, the same ones on every run."""
    low = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40))
    return low < F.lit(int(min(1.0, share) * (1 << 40)))


def named(name: str) -> Column:
    """The top-level column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_column(df: DataFrame, name: str) -> Column:
    """The column as bigint; ValueError if it isn't of whole numbers."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise ValueError(f"ids must be whole numbers: column {name} is {kind.simpleString()}")
    return named(name).cast("bigint")


class Kept:
    """Columns that an operator carries along, under names of their own inside.

    They come out under their old names; one that has the name of a column which the operator makes
    (`made`, capitals apart) gets _kept behind it, as often as it takes.
    """

    def __init__(self, keep: Iterable[str], made: Iterable[str]) -> None:
        self.keep = tuple(keep)
        self.names = [f"keep_{i}" for i in range(len(self.keep))]
        taken, self.out = {m.lower() for m in made} | {k.lower() for k in self.keep}, []
        made = {m.lower() for m in made}
        for name in self.keep:
            final = name
            if name.lower() in made:
                while final.lower() in taken:
                    final += "_kept"
                taken.add(final.lower())
            self.out.append(final)

    def inside(self) -> list[Column]:
        """The columns under their inner names."""
        return [named(c).alias(n) for c, n in zip(self.keep, self.names, strict=True)]

    def outside(self) -> list[Column]:
        """The inner columns under the names that they come out with."""
        return [F.col(n).alias(o) for n, o in zip(self.names, self.out, strict=True)]

    def schema(self, rows: DataFrame, made: str) -> str:
        """The inner columns' schema as they are in `rows`, and the made ones'."""
        return ", ".join([*(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in self.names), made])
