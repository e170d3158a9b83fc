"""One row per company from a stream whose files repeat companies.

The row kept is the first or the last by a stated order, not by arrival, so the
result is that of the whole table, however it was cut into files. The state
holds one row a key; it goes when the watermark has passed the key's latest
event time, and a key that comes again after that counts as a new one. Each
batch appends the rows that changed under its number; ``latest`` reads the last
one of each key.

The state is a table beside the stream's checkpoint: a batch is reduced to one
row a key by an aggregate and joined with the table its predecessor left, all
in Spark's own operators, with no call a key. A batch thus costs its rows and
one pass over the state. A batch that is run again starts from the same table
and replaces what it wrote before; tables older than that are deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Kept:
    """A stream's rows as ``key``, ``order``, ``event_time`` and ``row`` (JSON), and which of a key's rows is kept."""

    rows: DataFrame
    delay: str
    last: bool


def keep_one(stream: DataFrame, key: str, order: str, event_time: str, delay: str = "1 day", last: bool = False) -> Kept:
    """Keep each key's first (or last) row; ``write_kept`` runs it.

    ``order`` is a whole number; of equal ones the row with the smallest JSON text counts. Rows with a null key, order
    or event time are left out, and so are those that come when the watermark (the latest event time of the batches
    before, less ``delay``) has passed their event time.
    """
    rows = (stream.dropna(subset=[key, order, event_time])
            .select(F.col(key).alias("key"), F.col(order).cast("bigint").alias("order"), F.col(event_time).alias("event_time"),
                    F.to_json(F.struct("*")).alias("row")))
    return Kept(rows, delay, last)


def _folder(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def _advance(batch: DataFrame, batch_id: int, kept: Kept, states: str) -> DataFrame:
    """Write the state table after a batch, ``states``/<batch>, and its watermark, ``states``/<batch>-mark, which commits
    it; the rows that changed come back."""
    spark = batch.sparkSession
    fs, top = _folder(spark, states)
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    done = sorted(int(n[:-5]) for n in names if n.endswith("-mark") and int(n[:-5]) < batch_id)
    mark = spark.read.parquet(f"{states}/{done[-1]}-mark").first()["mark"] if done else 0
    sign = F.lit(-1 if kept.last else 1)
    new = (batch.where(F.unix_micros("event_time") > mark * 1000).groupBy("key")
           .agg(F.min(F.struct((sign * F.col("order")).alias("order"), "row")).alias("new"),
                F.max(F.unix_millis("event_time")).alias("at")))
    schema = T.StructType([batch.schema["key"], T.StructField("held", new.schema["new"].dataType), T.StructField("expires", T.LongType())])
    held = (spark.read.parquet(f"{states}/{done[-1]}").where(F.col("expires") >= mark).select("key", "held", "expires")
            if done else spark.createDataFrame([], schema))
    best = F.least("held", "new")
    seen = Observation()
    # a key's time counts from its latest batch, as far as the watermark is not beyond it
    (held.join(new, "key", "full")
     .select("key", best.alias("held"),
             F.when(F.col("at").isNull(), F.col("expires")).otherwise(F.greatest("at", F.lit(mark + 1))).alias("expires"),
             (F.col("held").isNull() | (F.col("held") != best)).alias("changed"), "at")
     .observe(seen, F.max("at").alias("at")).drop("at")
     .write.mode("overwrite").parquet(f"{states}/{batch_id}"))
    delay = F.unix_millis(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {kept.delay}"))
    at = F.lit(seen.get["at"]).cast("bigint")
    (spark.range(1).select(F.greatest(F.lit(mark).cast("bigint"), at - delay).alias("mark"))
     .write.mode("overwrite").parquet(f"{states}/{batch_id}-mark"))
    for old in done[:-1]:
        for name in (f"{old}-mark", str(old)):
            fs.delete(_folder(spark, f"{states}/{name}")[1], True)
    return (spark.read.parquet(f"{states}/{batch_id}").where("changed")
            .select("key", (sign * F.col("held.order")).alias("order"), F.col("held.row").alias("row")))


def write_kept(kept: Kept, sink: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's changed rows under ``batch_id=``; a batch that is run again replaces its own."""
    states = f"{checkpoint.rstrip('/')}/kept"

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        changed = _advance(batch, batch_id, kept, states)
        (changed.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink))

    return (kept.rows.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """The kept row of every key, with the stream's columns."""
    rows = spark.read.parquet(sink)
    newest = Window.partitionBy("key").orderBy(F.desc("batch_id"))
    kept = rows.withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    return kept.select(F.from_json("row", schema).alias("r")).select("r.*")
