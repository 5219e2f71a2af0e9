"""Registration and expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def slices(texts: Sequence[str], most: int = 2_000_000) -> Iterator[slice]:
    """Consecutive slices of about ``most`` characters, to bound what a batch takes while it is worked on."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))
