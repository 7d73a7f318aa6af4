"""What the training-data operators share: tables, hold-out rule, scratch tables, Arrow mapping."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts that split on white space only.
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACE_WORDS_B = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes that lower-case A to Z and leave the rest.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hold_out(doc_id: Column, folds: int) -> Column:
    """True where crc32 of the id as text is divisible by folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def held_out_py(doc_id: int | None, folds: int) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % folds == 0


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset a folder of this machine stands in, if Spark runs on this
    machine alone; on a cluster that would be another folder for each executor, so it is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="sedimenta-")
        sc.setCheckpointDir(root)
    return root


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes df under the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table made by saved() that nothing reads any more. Shuffle files behind tables that are written stay until
    the driver's JVM collects its garbage, which may take long in a small driver, so it is asked to."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        jvm.System.gc()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which what the task has freed goes back to the system. Python workers outlive their tasks, and
    allocators would keep the memory of each stage's largest task for as long."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return inner


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows, so that what is made of one is bounded by that many texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def word_numbers(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (split by ASCII white space) of the texts, and how many words each text has.

    All words of the texts are hashed together, eight bytes a step; words of up to eight bytes collide with none of
    their length. lower: A to Z count as a to z.
    """
    encoded = [t.encode() if t else b"" for t in texts]
    data = b" ".join([b"", *encoded, b"        "])
    data = data.translate(LOWER) if lower else data
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[raw].view(np.int8))) + 1
    start, left = edge[::2], edge[1::2] - edge[::2]
    begins = np.cumsum([1, *(len(e) + 1 for e in encoded)])
    counts = np.diff(np.searchsorted(start, begins))
    eight = np.ndarray((max(0, len(raw) - 7),), "<u8", data, strides=(1,))
    h = left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    at = np.arange(len(start))
    while len(at):
        h[at] = mixed(h[at] ^ eight[start[at]] & _FIRST_BYTES[np.minimum(left[at], 8)])
        at = at[left[at] > 8]
        start[at] += 8
        left[at] -= 8
    return h, counts


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], Iterator[dict] | list[dict]]], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow row by row: make() runs once a task and gives the function from a row to its output rows."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, out = make(), []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    out.extend(f(row))
                    if len(out) >= rows:
                        yield pa.RecordBatch.from_pylist(out, schema=kind)
                        out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return df.mapInArrow(trimmed(run), schema)


def bounded_labels(labels: DataFrame, column: str, limit: int, folds: int, value: int | None = None) -> DataFrame:
    """At most `limit` labelled training rows (doc_id, label), the ones whose ids hash smallest; small enough to broadcast."""
    rows = labels.select(F.col("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label is not null")
    if value is not None:
        rows = rows.where(F.col("label") == value)
    rows = rows.where(~hold_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def apart(df: DataFrame) -> DataFrame:
    """df for a join in which both sides are shuffled. A few columns of numbers look small in their files, so without this
    Spark gathers millions of rows in the driver to send them to every task."""
    return df.hint("merge")


#: Classes beyond this share of all rows are joined by broadcast; there are fewer of them than its inverse.
HOT_SHARE = 0.005


def join_classes(rows: DataFrame, classes: DataFrame, key: str | list[str]) -> DataFrame:
    """rows, each of a key that is not null, joined to classes (one row for each key, `n`: how many rows have it).

    The rows of a class that holds many are not moved to one task: classes beyond HOT_SHARE of all rows, fewer than
    1 / HOT_SHARE by that alone, are broadcast, and the rest meets by a shuffle in which no key has more than that share.
    """
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1000, int(total * HOT_SHARE))
    hot = classes.where(F.col("n") > least)
    many = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return many.unionByName(rest.join(classes.where(F.col("n") <= least), key))
