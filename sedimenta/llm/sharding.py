"""Sharding along a Hilbert curve over quantised metadata.

Language, source and text length are quantised to BITS bits each; rows are ordered by their place on the curve, ties
by doc_id and then by content, and the order is cut into runs. Law `rows`: the shards' row counts differ by at most
one. Law `bytes`: a row goes to the shard in which the middle of its bytes falls. Only ids, sizes and checksums are
shuffled for the order, never texts; the order comes from range partitions whose sizes are added up, so no task
holds more than its range, however many rows share a curve index.

Null texts have no bytes; null languages and sources share a bucket of their own. Repeated rows stay, each with a place
of its own. Very long texts count by their size only. Null ids come first among ties. Empty tables give no rows. Other
columns are read by write_shards alone, which carries them along under any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sedimenta.llm.common import dropped, saved, table

SHARDS, BITS, ROW_BYTES = 40, 8, 16


def hilbert_index(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of coordinates (rows x dimensions, each under 2**bits)."""
    x = coordinates.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):  # undo the turns and mirrors of each level, from the coarsest
        low = (1 << b) - 1
        for d in range(dims):
            mirrored = (x[d] >> b) & 1 == 1
            swap = np.where(mirrored, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(mirrored, low, swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):  # Gray code over the dimensions
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[dims - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> b) & 1)
    return out


def _name(c: Column, bits: int = BITS) -> Column:
    """A cell for each name, by hash; null has one of its own."""
    return F.when(c.isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(c.cast("string")), F.lit((1 << bits) - 1)))


def _length(size: Column, bits: int = BITS) -> Column:
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(size / F.lit(float(ROW_BYTES))) * 12)).cast("long")


def placed(documents: DataFrame, bits: int = BITS, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, the quantised dimensions d0 to d2, and the curve index of every row. Texts stop here,
    unless whole is set: then the row goes along as the struct `row`."""
    name, length = lambda c: _name(F.col(c), bits), _length(F.col("size"), bits)
    row = [F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")] if whole else []
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), *row)
    rows = rows.select("doc_id", "size", "text_crc32", name("lang").alias("d0"), name("source").alias("d1"), length.alias("d2"), *(["row"] if whole else []))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("d0", "d1", "d2")], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_index(at, bits))], names=[*batch.schema.names, "curve"])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("curve", LongType())]))


def ordered(rows: DataFrame) -> DataFrame:
    """rows with `rank` from 0 and `before`, the bytes ahead, in curve order."""
    key = ["curve", "doc_id", "text_crc32", "size"]
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, *key).sortWithinPartitions(*key)
    kept = saved(ranged.withColumn("_m", F.monotonically_increasing_id()), "curve")  # partition in the high bits, place in it in the low ones
    kept_rows = kept.withColumn("_part", F.expr("_m >> 33")).withColumn("_at", F.expr(f"_m & {(1 << 33) - 1}"))
    running = F.expr("sum(size) over (partition by _part order by _at rows between unbounded preceding and current row) - size")
    parts = kept_rows.groupBy("_part").agg(F.count("*").alias("n"), F.sum("size").alias("b")).orderBy("_part").collect()  # as many as partitions
    offsets, at, size = [], 0, 0
    for r in parts:
        offsets.append((r["_part"], at, size))
        at, size = at + r["n"], size + r["b"]
    start = spark.createDataFrame(offsets, "_part long, _rows long, _bytes long")
    return kept_rows.withColumn("_run", running).join(F.broadcast(start), "_part").withColumn("rank", F.col("_rows") + F.col("_at")).withColumn("before", F.col("_bytes") + F.col("_run")).drop("_m", "_part", "_at", "_run", "_rows", "_bytes").withColumn("_n", F.lit(at)).withColumn("_total", F.lit(size))


def shard(documents: DataFrame, shards: int = SHARDS, law: str = "rows", whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, curve and d0 to d2 of every row, and the row itself where whole is set."""
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    rows = ordered(placed(documents, whole=whole))
    if law == "rows":
        # the first n mod shards runs have a row more
        each, more = F.floor(F.col("_n") / shards), F.col("_n") % shards
        wide = more * (each + 1)
        no = F.when(F.col("rank") < wide, F.floor(F.col("rank") / (each + 1))).otherwise(more + F.floor((F.col("rank") - wide) / F.greatest(each, F.lit(1))))
        slot = F.when(F.col("rank") < wide, F.col("rank") % (each + 1)).otherwise((F.col("rank") - wide) % F.greatest(each, F.lit(1)))
        out = rows.withColumn("shard", no.cast("int")).withColumn("slot", slot.cast("long"))
    else:
        out = rows.withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("before") + F.col("size") / 2) * shards / F.col("_total"))).cast("int"))
        firsts = out.groupBy("shard").agg(F.min("rank").alias("_first"))
        out = out.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("rank") - F.col("_first"))
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", "curve", "d0", "d1", "d2", *(["row"] if whole else []))


def op5_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def manifest(sharded: DataFrame) -> DataFrame:
    """One row per shard: rows, bytes, and the least and greatest value of each dimension, by which readers skip shards."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("d0", "d1", "d2", "curve") for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), *ends)


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """Writes the rows of documents, all columns, below path/shard=N in curve order; gives the manifest, which it writes as
    path-manifest. A column `shard` of documents gives way to the shard. Rows carry their own place, so repeated rows
    keep the law as any others do; the rows lie in curve order, so each task writes a few neighbouring shards."""
    rows = saved(shard(documents, shards, law, whole=True), "placed")
    rows.select(*[F.col(f"row.`{c}`") for c in documents.columns if c != "shard"], "shard").write.partitionBy("shard").parquet(path)
    manifest(rows).write.parquet(f"{path}-manifest")
    dropped(rows)
    return documents.sparkSession.read.parquet(f"{path}-manifest")


def shards_for(manifest: DataFrame, lang: str | None = None, source: str | None = None, sizes: tuple[int, int] | None = None) -> list[int]:
    """Shards that can hold rows of a language, of a source, and of sizes (UTF-8 bytes of the text plus ROW_BYTES) from one to
    another; None: any. As many numbers as shards at most."""
    def overlaps(d: str, low: Column, high: Column) -> Column:
        return (F.col(f"min_{d}") <= high) & (F.col(f"max_{d}") >= low)

    can = F.lit(True)
    for d, value in (("d0", lang), ("d1", source)):
        if value is not None:
            can = can & overlaps(d, _name(F.lit(value)), _name(F.lit(value)))
    if sizes is not None:
        can = can & overlaps("d2", _length(F.lit(sizes[0])), _length(F.lit(sizes[1])))
    return sorted(r["shard"] for r in manifest.where(can).select("shard").collect())


def read_shards(spark, path: str, lang: str | None = None, source: str | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Rows that write_shards wrote to path, of a language, a source and sizes; files of other shards are not opened."""
    wanted = shards_for(spark.read.parquet(f"{path}-manifest"), lang, source, sizes)
    rows = spark.read.parquet(path).where(F.col("shard").isin(wanted))
    for c, value in (("lang", lang), ("source", source)):
        if value is not None:
            rows = rows.where(F.col(c) == value)
    if sizes is not None:
        rows = rows.where((F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).between(*sizes))
    return rows
