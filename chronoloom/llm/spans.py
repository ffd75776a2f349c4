"""What the span finders (personal data, secrets) share: running a finder over whole texts, and digests of spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm._common import column, rows_of

#: (kind, start, end in code points, of the base rules or not)
Span = tuple[str, int, int, bool]
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_spans(docs: DataFrame, key: str, text: str, make: Callable[[], Callable[[str], list[Span]]]) -> DataFrame:
    """key and `spans` of every row, the finder made once a task. A null text has no spans. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for batch in batches:
            for part in rows_of(batch):
                names = ("kind", "start", "end", "base")
                found = [[dict(zip(names, s, strict=True)) for s in find(t)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, _ARROW)], names=["key", "spans"])

    source = docs.select(column(key).alias("key"), column(text).alias("text"))
    return source.mapInArrow(run, f"key {source.schema[0].dataType.simpleString()}, spans {SPANS}").toDF(key, "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """Counts of base spans by kind, base_sha256 and all spans as text. The spans come sorted."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(column(key), *map(count, kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def by_start(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    order = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))
