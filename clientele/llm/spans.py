"""Spans found in a text, and the columns that reports derive from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Offsets are code points, end exclusive. ``base`` marks spans of the fixed patterns.
SPANS = "array<struct<kind: string, start: int, end: int, score: double, base: boolean>>"


def with_spans(docs: DataFrame, name: str, finder: Callable[[], Callable[[str], list[tuple]]], text: Column) -> DataFrame:
    """``docs`` with a column of spans. Spans of every whole text, in Arrow batches; a null text has no spans. ``finder``
    makes the function that finds them, once in each task."""

    @F.pandas_udf(SPANS)
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = finder()
        for texts in parts:
            yield pd.Series([[dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in find(t)] if t else []
                             for t in texts], dtype=object)

    small_batches(docs.sparkSession)
    return docs.withColumn(name, spans(text))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def listed(spans: Column, kinds: Sequence[str], by_kind: bool) -> Column:
    """``kind:start:end`` of the spans, comma-joined, by kind as listed and start or the
    other way round."""
    rank = F.array(*[F.lit(k) for k in kinds])

    def key(s: Column) -> Column:
        place = F.array_position(rank, s["kind"]).cast("int")
        order = (place, s["start"]) if by_kind else (s["start"], place)
        return F.struct(*[c.alias(f"k{i}") for i, c in enumerate((*order, s["end"]))],
                        F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("said"))

    return F.array_join(F.transform(F.array_sort(F.transform(spans, key)), lambda s: s["said"]), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])
