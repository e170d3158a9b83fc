"""Structured Streaming: classify files as they arrive, resumably.

The keyword classifier is a stateless projection, so the stream needs no
watermark or state store: ``readStream`` on a folder, the same transform as
batch, and a sink whose commit log gives exactly-once output. Progress and
running totals live in tables keyed by ``batch_id`` instead of driver memory,
so a restarted query resumes where its checkpoint says.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sectorscope.functions.lexicon import Lexicon
from sectorscope.functions.text import AUX_TEXT_COLUMNS
from sectorscope.operators.classify import classify_companies
from sectorscope.operators.responses import billable
from sectorscope.sources.files import NULL_TOKENS


def _source(spark: SparkSession, path: str, schema: StructType, fmt: str,
            max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
        return _null_tokens(_load(reader, path, max_files_per_trigger))
    return _load(reader, path, max_files_per_trigger)


def _null_tokens(stream: DataFrame) -> DataFrame:
    """The null rule of ``files.scan``: a string cell that is a null token is null."""
    return stream.withColumns({f.name: F.when(~F.col(f"`{f.name}`").isin(*NULL_TOKENS), F.col(f"`{f.name}`"))
                               for f in stream.schema.fields if f.dataType.simpleString() == "string"})


def _load(reader, path: str, max_files_per_trigger: int | None) -> DataFrame:
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def classify_stream(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str,
                    main: str, aux: Sequence[str] = AUX_TEXT_COLUMNS, lexicon: Lexicon | None = None,
                    fmt: str = "parquet", max_files_per_trigger: int | None = None,
                    keep: Sequence[str] | None = None) -> StreamingQuery:
    """Start a stream that classifies every new file under ``source`` into ``sink`` (parquet).

    Runs with ``availableNow``: processes what is there, then stops; run it
    again later to pick up new files only.
    """
    stream = classify_companies(_source(spark, source, schema, fmt, max_files_per_trigger), main, aux, lexicon)
    if keep:
        stream = stream.select(*keep)
    return (stream.writeStream.format("parquet").outputMode("append")
                  .option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start(sink))


def classify_stream_with_progress(spark: SparkSession, source: str, schema: StructType, sink: str,
                                  metrics: str, checkpoint: str, main: str,
                                  aux: Sequence[str] = AUX_TEXT_COLUMNS, lexicon: Lexicon | None = None,
                                  fmt: str = "parquet", max_files_per_trigger: int | None = None,
                                  cost_per_row: float = 0.0) -> StreamingQuery:
    """Like ``classify_stream`` but through ``foreachBatch``, writing one metrics row per batch.

    Keyword mode is free, so ``cost_per_row`` is 0 by default. Each batch overwrites its own ``batch_id=`` partition in both tables, so a
    batch replayed after a failure replaces its earlier output (idempotent).
    """
    def run_batch(batch: DataFrame, batch_id: int) -> None:
        started = datetime.now(timezone.utc)
        seen = Observation()
        out = classify_companies(batch, main, aux, lexicon).withColumn("batch_id", F.lit(batch_id))
        # the figures come with the write, nothing is read back
        (out.observe(seen, F.count(F.lit(1)).alias("n_rows"),
                     F.count_if(billable(F.col("Predicted_Archetype"))).alias("n_billable"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id").parquet(sink))
        stats = batch.sparkSession.createDataFrame([(seen.get["n_rows"], seen.get["n_billable"])], "n_rows bigint, n_billable bigint")
        row = stats.withColumns({"batch_id": F.lit(batch_id).cast("bigint"),
                                 "batch_cost": F.col("n_billable") * F.lit(cost_per_row),
                                 "started_at": F.lit(started),
                                 "finished_at": F.current_timestamp()})
        (row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id").parquet(metrics))

    return (_source(spark, source, schema, fmt, max_files_per_trigger)
            .writeStream.foreachBatch(run_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# ETA display formats, below a minute / below an hour / longer.
ETA_SECONDS, ETA_MINUTES, ETA_HOURS = "%ds", "%dm %ds", "%dh %dm"
# End of fixed values.


def duration_text(seconds: Column) -> Column:
    """"42s", "3m 5s" or "2h 7m", like the reference's ETA display."""
    s = F.floor(seconds).cast("bigint")
    return (F.when(seconds < 60, F.format_string(ETA_SECONDS, s))
             .when(seconds < 3600, F.format_string(ETA_MINUTES, F.floor(s / 60).cast("bigint"), s % 60))
             .otherwise(F.format_string(ETA_HOURS, F.floor(s / 3600).cast("bigint"),
                                        F.floor((s % 3600) / 60).cast("bigint"))))


def progress_table(spark: SparkSession, metrics: str, total_rows: int | None = None) -> DataFrame:
    """Per-batch metrics with running totals, rate and ETA (one row per micro-batch).

    The window runs over the metrics table, which has one row per batch.
    """
    m = spark.read.parquet(metrics)
    w = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    out = m.select("batch_id", "n_rows", "n_billable", "batch_cost",
                   F.sum("n_rows").over(w).alias("rows_done"),
                   F.sum("batch_cost").over(w).alias("cost_so_far"),
                   F.min("started_at").over(w).alias("_t0"), "finished_at")
    elapsed = F.unix_micros("finished_at") / 1e6 - F.unix_micros("_t0") / 1e6
    out = out.withColumns({"elapsed_s": elapsed,
                           "rows_per_s": F.try_divide(F.col("rows_done").cast("double"), elapsed)})
    if total_rows is not None:
        remaining = F.lit(total_rows) - F.col("rows_done")
        eta = F.coalesce(F.try_divide(remaining.cast("double"), F.col("rows_per_s")), F.lit(0.0))
        out = out.withColumns({"pct_done": F.try_divide(F.col("rows_done") * 100.0, F.lit(float(total_rows))),
                               "eta_s": eta, "eta_text": duration_text(eta)})
    return out.drop("_t0")
