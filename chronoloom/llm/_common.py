"""Plumbing the corpus operators share: the cluster's shared folder, saved tables, ASCII-only text expressions."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark deletes the shuffle files of a write at its end, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The folders of single processes without spark.checkpoint.dir, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A single process (master local[...]) that has
    none gets one of its own; a cluster without it is refused, for a folder of the driver isn't seen by executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _LOCAL.get(spark.sparkContext.applicationId) or f"file://{tempfile.mkdtemp(prefix='chronoloom-')}"
        _LOCAL[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(hadoop, True)


class Saved:
    """A table written to the shared folder, so that its lineage ends there and survives lost executors. It belongs to
    the innermost open Scope, which drops it at its end if nobody has before; outside of any, the session's end does."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark, self.path, self.dropped = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", False
        _owners()[-1].append(self)
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        if not self.dropped:
            self.dropped = True
            remove(self.spark, self.path)


#: The tables that no scope owns; the session's end drops them.
_SESSION: list[Saved] = []
#: The tables of the open scopes of a thread (or context), the innermost last.
_OPEN: contextvars.ContextVar[tuple[list[Saved], ...]] = contextvars.ContextVar("open scopes", default=())


def _owners() -> tuple[list[Saved], ...]:
    return (_SESSION, *_OPEN.get())


class Scope:
    """Owns the tables that are saved inside: `with Scope() as scope:` drops them at its end, also when it fails, but
    for those that are handed on by scope.result(), which then belong to the scope around."""

    def __enter__(self) -> Scope:
        self.kept: list[Saved] = []
        self.before = _OPEN.set((*_OPEN.get(), []))
        return self

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """df, computed and saved, for use after the scope's end."""
        out = Saved(df, name)
        self.kept.append(out)
        return out.df

    def __exit__(self, failure: type | None, *_: object) -> None:
        own = _owners()[-1]
        _OPEN.reset(self.before)
        for table in own:
            if failure is None and table in self.kept:
                _owners()[-1].append(table)
            else:
                table.drop()


@atexit.register
def _drop_results() -> None:
    for table in _SESSION:
        with contextlib.suppress(Exception):  # the gateway may be gone by now
            table.drop()


def saved(df: DataFrame, name: str) -> DataFrame:
    return Saved(df, name).df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def filtered(df: DataFrame, name: str, keep: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of df for whose values of a column the function that keep() makes in each task says so. Arrow kernels
    resolve columns by their names, so that these go by number meanwhile."""
    at = df.columns.index(name)
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = keep()
        for batch in batches:
            for part in rows_of(batch):
                yield part.filter(pa.array(told(part.column(at).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df, saved, with `index`: its rows' places by `order`, from 1. Rows are range-sorted and numbered inside their
    ranges; what the ranges before hold is summed over one row for each. Rows that `order` leaves equal go to one task."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = saved(placed, name).withColumn("__range", F.shiftright("__at", 33))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = placed.join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range")
    return met.withColumn("index", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__range", "__before")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def rows_of(batch: pa.RecordBatch, size: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in slices, so that what a kernel holds at once stays small."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


