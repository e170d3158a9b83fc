"""Command line: classify a company table and write the results.

    spark-submit --py-files sectorscope.zip sectorscope/cli.py companies.csv --out results/
    python -m sectorscope.cli companies.parquet --out results/ --desc 3 --mode model \\
        --responses stored.parquet --key company_id --age-cutoff 2010

The run is one Spark job per output: the input is scanned, classified in one
projection (model mode: left-joined to stored responses on the key), and
written under ``<out>/mode=<mode>/run_id=<run>``. Choices the interactive
flow asks for are arguments; columns are given by name or position.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorscope.functions import text as tx
from sectorscope.functions.lexicon import read_lexicon
from sectorscope.operators import corrections, profiles, resume
from sectorscope.operators import responses as rs
from sectorscope.operators.classify import classify_companies
from sectorscope.sources import files


def _column(columns: Sequence[str], choice: str | None, default: str) -> str:
    """A column by name or by 0-based position; ``default`` when not given."""
    if choice is None:
        return default
    if choice in columns:
        return choice
    if choice.isdigit() and int(choice) < len(columns):
        return columns[int(choice)]
    raise SystemExit(f"no column {choice!r}; columns: {', '.join(columns)}")


def parse_args(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="sectorscope", description="Classify a company table.")
    p.add_argument("input", help="CSV, JSON or Parquet file or folder")
    p.add_argument("--input-format", choices=["csv", "json", "parquet"],
                   help="format of the input; default: from its extension")
    p.add_argument("--single-line", action="store_true",
                   help="CSV cells hold no line breaks, so that large files can be split")
    p.add_argument("--out", required=True, help="base folder of the results")
    p.add_argument("--name", help="company name column (name or 0-based position); default: the first")
    p.add_argument("--desc", help="description column (name or position); default: first named "
                                  "like 'description', else the second")
    p.add_argument("--mode", choices=["keywords", "model"], default="keywords")
    p.add_argument("--responses", help="model mode: table of stored responses (key, response_json)")
    p.add_argument("--responses-format", choices=["csv", "json", "parquet"],
                   help="format of the responses; default: from their extension")
    p.add_argument("--key", default="company_id", help="model mode: id column shared with the responses")
    p.add_argument("--resume", help="table of results saved earlier: rows whose key has a label there are taken over "
                                    "and not classified again (needs --key)")
    p.add_argument("--resume-format", choices=["csv", "json", "parquet"],
                   help="format of the saved results; default: from their extension, else Parquet")
    p.add_argument("--lexicon", help="keyword mode: table of keywords (cat_ord, category, kw_ord, keyword), CSV or Parquet")
    p.add_argument("--infer-types", action="store_true", help="give the columns of a CSV the types that all their values have")
    p.add_argument("--scorer", default="native", choices=["native", "aho", "arrow"])
    p.add_argument("--age-cutoff", type=float, help="apply the age correction with this founding-year cutoff")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv"], help="output format")
    p.add_argument("--run-id", help="run id of the output folder; default: the current time")
    return p.parse_args(argv)


def _saved_results(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The saved results; the output folder of an earlier run has no extension and is Parquet."""
    fmt = args.resume_format or ("parquet" if "." not in args.resume.rstrip("/").rsplit("/", 1)[-1] else None)
    saved = files.scan(spark, args.resume, fmt)
    if args.key not in saved.columns:
        raise SystemExit(f"--key {args.key!r} is not a column of the saved results")
    return saved


def classify_table(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, str, str]:
    """The input, the result table for ``args`` (both lazy) and the chosen name / description columns."""
    df = files.scan(spark, args.input, args.input_format, multi_line=not args.single_line)
    if args.infer_types:
        df = files.infer_types(df)
    default_name, default_desc = files.column_mapping(df.columns)
    name_col = _column(df.columns, args.name, default_name)
    desc_col = _column(df.columns, args.desc, default_desc)
    source = df
    if args.age_cutoff is not None:
        df = corrections.founding_year(df)  # on the input: its whole-column choice never repeats a join
    saved = None
    if args.resume:
        if args.key not in df.columns:
            raise SystemExit(f"--key {args.key!r} is not a column of the input")
        saved = _saved_results(spark, args)
        df = resume.pending_rows(df, saved, args.key)
    lexicon = read_lexicon(spark, args.lexicon) if args.lexicon else None
    result = classify_companies(df, desc_col, lexicon=lexicon, scorer=args.scorer)
    if args.mode == "model":
        if not args.responses:
            raise SystemExit("--mode model needs --responses (a table of stored responses)")
        if args.key not in df.columns:
            raise SystemExit(f"--key {args.key!r} is not a column of the input")
        stored = files.scan(spark, args.responses, args.responses_format)
        # the prompt's company name comes from the default name columns, as in
        # the row classifier; the chosen name column is for display only
        result = rs.classify_with_model(
            df, result, rs.stored_responder(stored, args.key), tx.company_name(df),
            tx.combined_text(df, desc_col), tx.industries(df), key=args.key)
    if args.age_cutoff is not None:
        result = corrections.age_correction(result, args.age_cutoff)
    if saved is not None:
        result = resume.with_saved(result, saved, source, args.key)
    return source, result, name_col, desc_col


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parse_args(argv)
    if spark is None:
        from sectorscope.session import get_spark
        spark = get_spark()
    df, result, name_col, desc_col = classify_table(spark, args)
    shape = files.table_shape(df).first()
    print(f"rows: {shape['n_rows']}, columns: {shape['n_columns']}; "
          f"name: {name_col!r}, description: {desc_col!r}; mode: {args.mode}")
    path = files.export_results(result, args.out, args.mode, args.run_id, args.format)
    written = spark.read.format(args.format).option("header", True).load(path) \
        if args.format == "csv" else spark.read.parquet(path)
    for row in profiles.archetype_counts_all(written).toLocalIterator():  # every label, a partition at a time
        print(f"  {row[profiles.ARCH]}: {row['n']}")
    print(f"written: {path}")
    return path


if __name__ == "__main__":
    main(sys.argv[1:])
