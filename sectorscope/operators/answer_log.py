"""Model answers kept while a run goes on, so that a run that fails asks only for what is missing.

The log is a folder. A request is known by the hash of its text, so equal
requests are asked once. The requests that no committed part answers are dealt
into parts by that hash and asked part by part, each in one Spark job; a part's
answers count once its commit marker stands beside them. A later run reads the
committed parts, takes their requests off by an anti join, and asks the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sectorscope.session import scratch_path

#: Bytes of prompts that one task of the dealing holds, about.
TASK_BYTES = 128 << 20

#: A request's hash, its answer, the message of a call that failed, and the run that asked.
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("request", "response_json", "error", "run")])


def request_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def part_of(request: Column, parts: int) -> Column:
    """The part of a request: the first four digits of its hash, modulo the number of parts."""
    return (F.conv(F.substring(request, 1, 4), 16, 10).cast("int") % parts).cast("int")


def _folder(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def committed_parts(spark: SparkSession, log: str) -> list[str]:
    """The folders of the parts whose markers stand; one name a part."""
    fs, commits = _folder(spark, f"{log.rstrip('/')}/commits")
    names = [s.getPath().getName() for s in fs.listStatus(commits)] if fs.exists(commits) else []
    return [f"{log.rstrip('/')}/parts/{n}" for n in sorted(names)]


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """All committed answers: ``request``, ``response_json``, ``error``, ``run``."""
    folders = committed_parts(spark, log)
    return spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)


def ask(requests: DataFrame, fn: Callable, log: str, run: str, parts: int = 16, batch_rows: int = 1) -> DataFrame:
    """Answer ``requests`` (column ``prompt``) through the log; the whole log comes back.

    ``fn`` gets a pandas frame of ``batch_rows`` rows (``request``, ``prompt``) and returns ``request``,
    ``response_json`` and, if it likes, ``error``. An exception in it fails the run: the parts committed before stay.
    Null prompts are not asked.
    """
    spark = requests.sparkSession
    log = log.rstrip("/")
    # the prompts are written with a number a row, as they come; what is asked is then settled on hashes and numbers alone
    stored, seen = scratch_path(spark, "requests"), Observation()
    (requests.where("prompt is not null")
     .select(request_key(F.col("prompt")).alias("request"), "prompt", F.monotonically_increasing_id().alias("row"))
     .observe(seen, F.coalesce(F.sum(F.octet_length("prompt")), F.lit(0)).alias("bytes")).write.parquet(stored))
    wanted = spark.read.schema("request string, prompt string, row bigint").parquet(stored)
    pending = (wanted.groupBy("request").agg(F.min("row").alias("row"))
               .join(read_log(spark, log).select("request"), "request", "left_anti").select("row"))
    # written once: every part reads its own rows only. Prompts are alike and shrink many times when compressed, so the
    # number of tasks comes from their true size and not from that of the shuffled files
    path = scratch_path(spark, "pending-requests")
    tasks = max(spark.sparkContext.defaultParallelism, -(-seen.get["bytes"] // TASK_BYTES))
    (wanted.repartition(tasks, "row").join(pending.repartition(tasks, "row"), "row", "left_semi")
     .select("request", "prompt", part_of(F.col("request"), parts).alias("part"))
     .write.partitionBy("part").parquet(path))
    left = spark.read.schema("request string, prompt string, part int").parquet(path)

    def answers(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch_rows):
                got = fn(pdf.iloc[at:at + batch_rows].reset_index(drop=True))
                if "error" not in got.columns:
                    got = got.assign(error=None)
                yield got[["request", "response_json", "error"]].assign(run=run)

    for part in sorted(r["part"] for r in left.select("part").distinct().collect()):
        name = f"{run}-{part}-{uuid.uuid4().hex[:8]}"
        (left.where(F.col("part") == part).select("request", "prompt").mapInPandas(answers, SCHEMA)
         .write.parquet(f"{log}/parts/{name}"))
        fs, marker = _folder(spark, f"{log}/commits/{name}")
        fs.create(marker, True).close()
    return read_log(spark, log)


def log_responder(fn: Callable, log: str, run: str, key: str = "company_id", parts: int = 16,
                  batch_rows: int = 1) -> Callable[[DataFrame], DataFrame]:
    """A responder for ``responses.classify_with_model`` that asks through the log."""
    def respond(requests: DataFrame) -> DataFrame:
        answers = ask(requests.select("prompt"), fn, log, run, parts, batch_rows)
        return (requests.select(key, request_key(F.col("prompt")).alias("request")).join(answers, "request")
                .select(key, "response_json", "error", "request", "run"))
    return respond
