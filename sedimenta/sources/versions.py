"""Sources, and versioned Parquet tables: folders of files, and a log whose newest entry names the ones that count."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, TimestampNTZType, TimestampType


def read_staged_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with header, the schema's columns as text; typing is a later, checked step."""
    return spark.read.schema(StructType([StructField(f.name, StringType()) for f in schema])).option("header", True).csv(path)


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """table_name, column_name, data_type, nullable and ordinal of every table and view that the catalog lists."""
    rows = []
    for t in spark.catalog.listTables(database):
        name = t.name if t.isTemporary or not t.database else f"{t.database}.{t.name}"
        rows += [(t.name, f.name, f.dataType.simpleString(), f.nullable, n + 1) for n, f in enumerate(spark.table(name).schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean, ordinal int")


def since(df: DataFrame, column: str, after, upto=None) -> DataFrame:
    """Rows after a watermark (none: all) and not beyond `upto`; a plain comparison, which scans push down."""
    if after is not None:
        df = df.where(F.col(column) > F.lit(after))
    return df if upto is None else df.where(F.col(column) <= F.lit(upto))


def not_yet_loaded(source: DataFrame, column: str, after) -> DataFrame:
    """Source rows from a watermark on, before anything is made of them. Rows with the watermark's own stamp come along,
    since some may have arrived later; what is known of them is told by key. Rows without a readable stamp cannot be told to
    be old and come along. A stamp column is compared as it is, so scans push the comparison down; a text column is cast."""
    if after is None or column not in source.columns:
        return source
    stamped = isinstance(source.schema[column].dataType, (TimestampType, TimestampNTZType))
    at: Column = F.col(column) if stamped else F.nullif(F.col(column).cast("string"), F.lit("")).try_cast("timestamp_ntz")
    return source.where((at >= F.lit(after)) | at.isNull())


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, stamp: str | None = None, after=None, parts: int = 8, properties: dict[str, str] | None = None) -> DataFrame:
    """A table of a database, read by several tasks at once, from a watermark on.

    The database is asked for the least and greatest key of the rows that are due, and each task reads a range of keys;
    rows without a key come with the first. The watermark is a plain comparison on the column, which Spark hands down with
    the ranges, so rows of earlier loads never leave the database. Rows without a stamp cannot be told to be old and come
    along. Keys should be whole numbers; ranges are as even as the keys are.
    """
    properties = properties or {}
    whole = spark.read.jdbc(url, table, properties=properties)

    def due(df: DataFrame) -> DataFrame:
        return df if stamp is None or after is None else df.where((F.col(stamp) >= F.lit(after)) | F.col(stamp).isNull())

    low, high = due(whole).agg(F.min(key), F.max(key)).first()
    if low is None:
        return due(whole)
    width = max(1, -(-(int(high) - int(low) + 1) // parts))
    name = f'"{key}"'
    cuts = [int(low) + i * width for i in range(1, parts) if int(low) + i * width <= int(high)]
    sides = [None, *cuts, None]
    ranges = []
    for a, b in zip(sides, sides[1:]):
        own = " AND ".join([f"{name} >= {a}"] * (a is not None) + [f"{name} < {b}"] * (b is not None)) or "1 = 1"
        ranges.append(own if a is not None else f"({own}) OR {name} IS NULL")
    return due(spark.read.jdbc(url, table, predicates=ranges, properties=properties))


class Conflict(OSError):
    """Another writer has committed to the table since this one looked at it."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with this text unless there is one of that name; False if there is. Of several writers one wins, and
    readers never see a part of it.

    On local disks a hard link is made or refused in one act; on HDFS a rename is refused where the name is taken. Object
    stores have neither: there the put itself carries the condition, and appears as a whole.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    scheme, draft_name = fs.getUri().getScheme(), f".{uuid.uuid4().hex}"
    if scheme == "file":
        local = fs.makeQualified(target).toUri().getPath()
        draft = os.path.join(os.path.dirname(local), draft_name)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    if scheme in ("hdfs", "viewfs", "webhdfs"):
        draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), draft_name)
        out = fs.create(draft, True)
        out.write(text.encode())
        out.close()
        try:
            done = fs.rename(draft, target)
        except Exception as e:  # noqa: BLE001  py4j wraps what the JVM throws
            if "FileAlreadyExists" not in str(e):
                raise
            done = False
        if not done:
            fs.delete(draft, False)
        return bool(done)
    try:
        out = fs.createFile(target).recursive().overwrite(False).opt("fs.option.create.conditional.overwrite", "true").build()
        out.write(text.encode())
        out.close()
    except Exception as e:  # noqa: BLE001
        if any(x in str(e) for x in ("FileAlreadyExists", "PreconditionFailed", "412")):
            return False
        raise
    return True


def packed(writer: DataFrameWriter) -> DataFrameWriter:
    """Parquet that takes less room than Spark's default codec leaves: warehouses are written once and hold much text."""
    return writer.option("compression", "zstd")


#: Parts that a task writes side by side before it sorts what is left, and how much of a compressed shuffle a task reads.
WRITERS, READS = 64, "8m"
_WRITERS, _READS = "spark.sql.maxConcurrentOutputFileWriters", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: How large a side of a join may look before Spark may send it to every task unasked: by its files, and by its shuffle.
SMALL_FILES, SMALL_SHUFFLE = "128k", "1m"
_BY_FILES, _BY_SHUFFLE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
_held, _held_lock = {}, threading.Lock()


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, tuple[str, tuple]]):
    """Settings of the session by name: the value, and those that count as not set. Where they are set otherwise they stay,
    and the last of several holders puts them back."""
    with _held_lock:
        for c, (value, unset) in wanted.items():
            n, before = _held.get((id(spark), c), (0, spark.conf.get(c, None)))
            _held[id(spark), c] = (n + 1, before)
            if n == 0 and before in unset:
                spark.conf.set(c, value)
    try:
        yield
    finally:
        with _held_lock:
            for c in wanted:
                n, before = _held.pop((id(spark), c))
                if n > 1:
                    _held[id(spark), c] = (n - 1, before)
                elif before is None:
                    spark.conf.unset(c)
                else:
                    spark.conf.set(c, before)


def unsorted_writes(spark: SparkSession):
    """Writes by part keep a file open for each of WRITERS parts instead of sorting all rows by part first: rows that are
    spread out just before they are written are many times what the task has read, and the sort would spill them. Shuffles
    are read in pieces of READS, since Spark's own measure, 64 MB as compressed, is more than a task can add up in memory."""
    return _settings(spark, {_WRITERS: (str(WRITERS), (None, "0")), _READS: (READS, (None, "64MB", "67108864b"))})


def small_broadcasts(spark: SparkSession):
    """Spark sends a side of a join to every task where it looks small, and it looks at packed sizes: ten megabytes of a
    table's keys in order are many millions of rows, which the driver gathers, several at a time. So only what looks very
    small goes unasked; sides that are bounded by their nature are sent by a hint, and the others are shuffled."""
    return _settings(spark, {_BY_FILES: (SMALL_FILES, (None, "10MB", "10485760b")), _BY_SHUFFLE: (SMALL_SHUFFLE, (None,))})


@dataclass
class Commit:
    """An entry of a table's log: which folders hold each part, how the rows look, and what its writer noted."""

    number: int
    schema: str
    parts: dict[str, str]
    meta: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"schema": self.schema, "parts": self.parts, "meta": self.meta})


class Table:
    """Readers see what the newest entry of the log names, and files are complete before an entry names them.

    Rows lie in parts (a whole table is one part without a name). A writer makes new folders for the parts it changes and
    then puts the next number into the log; the other parts keep their folders and files. The number is put only if it
    is not there, so of two writers that began from one entry one raises Conflict, or with update() begins again from
    the newer entry. A crash at any point leaves the old state or the new one.

    Folders that none of the last KEEP entries names go; readers that have begun are safe for that long. Of the log
    itself the last LOG entries stay.
    """

    KEEP, LOG = 3, 1000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._seen: int | None = None

    # --- the log ---

    def numbers(self) -> list[int]:
        at = self._path(f"{self.path}/_log")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def entry(self, number: int) -> Commit:
        stream = self._fs.open(self._path(f"{self.path}/_log/{number:012d}.json"))
        try:
            told = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Commit(number, told["schema"], told["parts"], told["meta"])

    def state(self) -> Commit | None:
        """The newest entry; what this object writes next builds on it."""
        numbers = self.numbers()
        self._seen = numbers[-1] if numbers else 0
        return self.entry(numbers[-1]) if numbers else None

    # --- rows ---

    def read(self, parts: Iterable | None = None, state: Commit | None = None, with_part: bool = False) -> DataFrame | None:
        """The rows of all parts, or of some; with_part: with the part in the column `_part`. None: nothing was ever written."""
        state = state or self.state()
        if state is None:
            return None
        schema = StructType.fromJson(json.loads(state.schema))
        wanted = None if parts is None else {str(p) for p in parts}
        folders = [f"{self.path}/{v}" for p, v in state.parts.items() if wanted is None or p in wanted]
        columns = [F.col(f"`{c}`") for c in schema.names]
        if not folders:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumn("_part", F.lit(None).cast("int")) if with_part else empty
        if with_part:
            schema = StructType([*schema, StructField("_part", IntegerType())])
            columns.append(F.col("_part"))
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders).select(*columns)

    def _write(self, df: DataFrame, by: Column | None) -> dict[str, str]:
        """Writes rows to a new folder; the folder of each part. A column `_part` of the rows is no column of the table."""
        version = f"_v=x{uuid.uuid4().hex}"
        if by is None:
            packed(df.write).parquet(f"{self.path}/{version}")
            return {"": version}
        with unsorted_writes(self.spark):
            packed(df.withColumn("_part", F.coalesce(by.cast("int"), F.lit(-1))).write.partitionBy("_part")).parquet(f"{self.path}/{version}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{version}"))]
        return {n.removeprefix("_part="): f"{version}/{n}" for n in names if n.startswith("_part=")}

    def _commit(self, base: int, schema: str, parts: dict[str, str], written: dict[str, str], meta: dict) -> Commit:
        new = Commit(base + 1, schema, parts, meta)
        if not put_if_absent(self.spark, f"{self.path}/_log/{new.number:012d}.json", new.text()):
            for folder in {v.partition("/")[0] for v in written.values()}:
                self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            raise Conflict(f"another writer has committed entry {new.number} of {self.path}")
        self._seen = new.number
        self._clean(new.number)
        return new

    def _clean(self, number: int) -> None:
        numbers = [n for n in self.numbers() if n <= number]
        old = [n for n in numbers if n <= number - self.KEEP]
        if old:  # the entry that has just left the last KEEP
            kept = {v for n in numbers if n > number - self.KEEP for v in self.entry(n).parts.values()}
            for folder in set(self.entry(old[-1]).parts.values()) - kept:
                self._fs.delete(self._path(f"{self.path}/{folder}"), True)
        for n in numbers[: -self.LOG]:
            self._fs.delete(self._path(f"{self.path}/_log/{n:012d}.json"), False)

    def replace(self, df: DataFrame, by: Column | None = None, meta: dict | None = None) -> Commit:
        """All rows anew (also none: a full delete), from the entry that this object last read; `by` gives each row's part."""
        base = self._seen
        if base is None:
            base = max(self.numbers(), default=0)
        written = self._write(df, by)
        return self._commit(base, df.drop("_part").schema.json(), written, written, meta or {})

    def replace_parts(self, df: DataFrame, by: Column, parts: Iterable, state: Commit, meta: dict | None = None) -> Commit:
        """The rows of some parts anew, all of which df holds; the other parts keep their files. A part that df has no row
        of goes. The notes of the entry before stay where `meta` does not change them."""
        written, gone = self._write(df, by), {str(p) for p in parts}
        if stray := set(written) - gone:
            raise ValueError(f"rows of parts that are not replaced: {sorted(stray)}")
        kept = {p: v for p, v in state.parts.items() if p not in gone}
        return self._commit(state.number, df.drop("_part").schema.json(), kept | written, written, state.meta | (meta or {}))

    def note(self, state: Commit, **meta) -> Commit:
        """The same rows under a new entry with other notes."""
        return self._commit(state.number, state.schema, state.parts, {}, state.meta | meta)

    def update(self, change: Callable[[DataFrame | None], DataFrame | None], tries: int = 5) -> Commit | None:
        """Replaces the rows by what `change` makes of them; begins again from the newer rows where another writer was
        faster. No rows are replaced if it gives None."""
        for left in range(tries - 1, -1, -1):
            state = self.state()
            new = change(None if state is None else self.read(state=state))
            if new is None:
                return None
            try:
                return self.replace(new, meta=state.meta if state else None)
            except Conflict:
                if not left:
                    raise
