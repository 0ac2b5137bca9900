"""The stages as jobs for ``spark-submit``; every stage reads and writes files.

    collect    pages (Parquet: url, attack, html)   -> raw records, JSON Lines
    clean      raw records                          -> clean records, JSON Lines
    nest       clean records                        -> nested XML
    features   nested XML                           -> feature XML (and Parquet)
    eda        nested XML                           -> one table per report
    dashboard  feature XML                          -> one table per panel
    explain    feature XML                          -> explanations XML

Files come in the order of their names, records in the order in which they stand in
them. The first stage that reads files without numbers numbers the records; the stages
write the number with each record (``_seq``, in XML an attribute) and go by it, whatever
becomes of the files in between. "The last record of an id" and "the first N" mean that order.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from vulnspark import schemas
from vulnspark.schemas import SEQ, with_seq
from vulnspark.operators.cleaning import clean_records
from vulnspark.operators.features import StepCounts, build_features, to_feature_xml
from vulnspark.operators.pages import to_raw_columns
from vulnspark.operators.reshape import nest_records
from vulnspark.operators.views import dashboard_view, eda_view
from vulnspark.plans import collect_records, consumers
from vulnspark.sources import in_sequence, numbered, read_records, read_xml, with_document_order, write_records, write_xml


def _records(spark: SparkSession, a: argparse.Namespace, schema) -> DataFrame:
    rows = read_records(spark, a.input, with_seq(schema), a.array, order=True)
    # Arrays are put together before the first row is there; one file's are enough to tell.
    some = read_records(spark, a.input, with_seq(schema), array=True, one_file=True) if a.array else None
    return in_sequence(rows, SEQ, peek=some)


def _nested(spark: SparkSession, a: argparse.Namespace, schema) -> DataFrame:
    rows = read_xml(spark, a.input, with_seq(schema), encoding=a.encoding, order=True)
    # Any record tells whether the files carry numbers, one in a comment too.
    some = read_xml(spark, a.input, with_seq(schema), on_error="keep", comments=False)
    return in_sequence(rows, SEQ, peek=some)


def collect(spark: SparkSession, a: argparse.Namespace) -> None:
    pages = numbered(with_document_order(spark.read.parquet(a.input)), SEQ)
    order = [*([a.order] if a.order else []), SEQ]
    found = collect_records(pages, order=order, limit=a.limit)
    write_records(to_raw_columns(found, SEQ), a.output, array=a.to_array)


def clean(spark: SparkSession, a: argparse.Namespace) -> None:
    raw = _records(spark, a, schemas.RAW_RECORD)
    write_records(clean_records(raw, legacy=a.legacy), a.output, array=a.to_array)


def nest(spark: SparkSession, a: argparse.Namespace) -> None:
    write_xml(nest_records(_records(spark, a, schemas.CLEAN_RECORD)), a.output)


def features(spark: SparkSession, a: argparse.Namespace) -> None:
    counts = StepCounts()
    table = build_features(_nested(spark, a, schemas.RAW_XML), [SEQ], keep=[SEQ], counts=counts)
    if a.parquet:
        table.write.parquet(a.parquet)
        table = spark.read.parquet(a.parquet)
    write_xml(to_feature_xml(table), a.output)
    if a.report:
        counts.report(spark).write.json(a.report)


def _kept(view: DataFrame, path: str) -> DataFrame:
    """The view as a table beside the results, which all of them read."""
    view.write.parquet(path)
    return view.sparkSession.read.parquet(path)


def _write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")


def eda(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _kept(eda_view(_nested(spark, a, schemas.RAW_XML)), f"{a.output}/view")
    _write_tables(consumers.eda_report(rows, [SEQ]), a.output)


def dashboard(spark: SparkSession, a: argparse.Namespace) -> None:
    source = read_xml(spark, a.input, schemas.FEATURE_XML, encoding="auto", on_error="empty")
    rows = _kept(dashboard_view(source), f"{a.output}/view")
    panels = consumers.panels(rows, a.severity, a.attack, a.minimum, a.query, a.top)
    _write_tables(panels, a.output)


def explain(spark: SparkSession, a: argparse.Namespace) -> None:
    module, _, name = a.model.partition(":")
    loaded = importlib.import_module(module)
    cloudpickle.register_pickle_by_value(loaded)
    predict = getattr(loaded, name)
    found = consumers.explanations(_nested(spark, a, schemas.FEATURE_XML), predict, [SEQ], a.limit)
    write_xml(found, a.output, root_tag="cve_explanations")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vulnspark.jobs")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(run) -> argparse.ArgumentParser:
        sub = jobs.add_parser(run.__name__)
        sub.set_defaults(run=run)
        sub.add_argument("input")
        sub.add_argument("output")
        return sub

    one = job(collect)
    one.add_argument("--order", help="a column; the limit takes the pages that come first by it instead of by document order")
    one.add_argument("--limit", type=int, help="at most so many pages per search term")
    two = job(clean)
    two.add_argument("--legacy", action="store_true")
    for sub in (one, two):
        sub.add_argument("--to-array", action="store_true", help="write JSON arrays, one per file")
    for sub in (two, job(nest)):
        sub.add_argument("--array", action="store_true", help="the files hold JSON arrays")
    one = job(features)
    one.add_argument("--parquet", help="also keep the feature table here")
    one.add_argument("--report", help="write the rows dropped per step here")
    two, three = job(eda), job(explain)
    for sub in (one, two, three):
        sub.add_argument("--encoding", default="utf-8", choices=["utf-8", "latin-1", "auto"])
    three.add_argument("--model", required=True, help="module:function, list of prompts to list of answers; its code travels along")
    three.add_argument("--limit", type=int, help="only the first so many rows")
    four = job(dashboard)
    four.add_argument("--severity", nargs="*", default=list(consumers.filters.DEFAULT_SEVERITIES))
    four.add_argument("--attack", nargs="*", default=[])
    four.add_argument("--minimum", type=float, default=0.0)
    four.add_argument("--query", default="")
    four.add_argument("--top", type=int, default=25, help="0 shows all")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName(f"vulnspark {a.job}").getOrCreate(), a)


if __name__ == "__main__":
    main()
