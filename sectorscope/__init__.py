"""sectorscope: lexicon classification and profiling of company tables on Spark.

Every operator is a ``DataFrame -> DataFrame`` transform built from Spark
expressions; see ``README.md`` for the module map.
"""

from sectorscope.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
