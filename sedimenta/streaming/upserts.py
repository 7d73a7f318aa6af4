"""The batch merges driven by a stream: each micro-batch goes through the same plan as a scheduled load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.merges import upsert
from sedimenta.sources.versions import Conflict, Table


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream; its schema is read once."""
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def _in_turn(target: Table, query: str, batch_id: int, change) -> None:
    """Changes a table once for each batch of a query: the table's log keeps the last batch that each query has brought in,
    in the same entry as its rows, so a batch that is delivered again after a crash finds itself there and does nothing."""
    while True:
        state = target.state()
        done = dict(state.meta.get("ledger", {})) if state else {}
        if done.get(query, -1) >= batch_id:
            return
        try:
            return change(state, {"ledger": done | {query: batch_id}})
        except Conflict:  # another query of the table was faster
            continue


def upsert_stream(source: DataFrame, target: Table, key: list[str], order: str, checkpoint: str, buckets: int = 8):
    """Applies all available rows and stops. Of a key's rows the one of the greatest order counts, whichever batch brings it:
    a row takes the place of one whose order is not greater. Only the buckets that a batch's keys fall into are rewritten.
    Rows without a key or an order are no state of anything and do not count."""
    by = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def apply(batch: DataFrame, batch_id: int) -> None:
        def change(state, meta) -> None:
            fit = batch.where(" AND ".join(f"{c} IS NOT NULL" for c in (*key, order)))
            newest = fit.groupBy(*key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*").persist()
            try:
                if state is None:
                    target.replace(newest, by, meta)
                    return
                touched = [r[0] for r in newest.select(by).distinct().collect()]  # as many as buckets at most
                current = target.read(touched, state)
                # the newer of both: a batch's row wins a tie, as a later delivery
                both = current.withColumn("_n", F.lit(0)).unionByName(newest.withColumn("_n", F.lit(1)))
                rows = both.groupBy(*key).agg(F.max_by(F.struct(*current.columns), F.struct(order, "_n")).alias("r")).select("r.*")
                target.replace_parts(rows, by, touched, state, meta)
            finally:
                newest.unpersist()

        _in_turn(target, checkpoint, batch_id, change)

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and type, with a bound on late events. Watermarks need instants, so stamps
    without a zone are read in the session's."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))


def windowed_stream(events: DataFrame, target: Table, checkpoint: str, late: str = "1 day", width: str = "1 hour"):
    """windowed_counts of all available rows, upserted into a table by window and type; a window's row follows late events."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total").withColumn("_part", F.date_format("hour", "yyyyMMdd").cast("int"))

        def change(state, meta) -> None:
            by, own = F.col("_part"), rows.persist()
            try:
                if state is None:
                    target.replace(own, by, meta)
                    return
                days = [r[0] for r in own.select("_part").distinct().collect()]  # days that late events reach back to
                target.replace_parts(upsert(target.read(days, state, with_part=True), own, ["hour", "event_type"]), by, days, state, meta)
            finally:
                own.unpersist()

        _in_turn(target, checkpoint, batch_id, change)

    counts = windowed_counts(events, late, width)
    return counts.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
