"""Small helpers shared by the operators of this package.

Words are the runs of ``[^\\x20\\x09-\\x0D]+``: ``bytes.split()`` on UTF-8
splits at exactly those six characters, so texts travel as binary columns and
are never decoded only to be split.
"""

from __future__ import annotations

import gc
import re
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from sectorscope.session import scratch_path

WS_CHARS = " \t\n\x0b\x0c\r"


_LETTERS = re.compile(r"[^\W\d_]+")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _is_numeral(c: str) -> bool:
    """Word characters that are no letters, digits or underscores: fractions, superscripts, Roman numerals and the like."""
    return c.isalnum() and not c.isalpha() and not c.isdecimal()


#: Those of the basic plane; a set with others is matched one by one, which takes microseconds a character.
_NUMERALS = re.compile("[" + "".join(c for c in map(chr, range(1 << 16)) if _is_numeral(c)) + "]")


def letter_runs(text: str) -> list[str]:
    """The runs of letters of a text."""
    if not text.isascii():
        text = _NUMERALS.sub(" ", text)
        if _ASTRAL.search(text):
            text = _ASTRAL.sub(lambda m: " " if _is_numeral(m[0]) else m[0], text)
    return _LETTERS.findall(text)


def has_letter(text: str) -> bool:
    found = _LETTERS.search(text)
    return found is not None and (text.isascii() or any(map(str.isalpha, text)))


def as_bytes(col: str) -> Column:
    """The UTF-8 bytes of a text column; null stays null."""
    return F.col(f"`{col}`").cast("string").cast("binary")


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]],
                schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with batches as dictionaries of Python lists.

    ``fn`` gets the columns of one batch and returns the columns of
    ``schema``; the row counts may differ.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch.to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, fields)


def with_fields(df: DataFrame, carried: str, ddl: str) -> StructType:
    """The schema of one column of ``df`` followed by the columns of ``ddl``."""
    return StructType([StructField(carried, df.schema[carried].dataType), *StructType.fromDDL(ddl).fields])


def row_struct(cols: Iterable[str]) -> Column:
    """The named columns as one struct ``row``, so that no name of the input can clash with a result's."""
    return F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")


def crc_mod(id_col: str, mod: int) -> Column:
    """``crc32(doc_id as text) mod n``, the fold of a document; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % mod


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and the path for ``discard``."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a ``stored`` table that nothing will read again."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a ``stored`` table that nothing will read again, and let Spark drop finished jobs' shuffle files.

    Spark drops them when the driver's JVM collects its garbage, which this asks for.
    """
    delete_table(spark, path)
    for _ in range(2):  # the second round takes what the first one's finalizers let go
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
