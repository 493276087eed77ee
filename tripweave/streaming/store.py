"""State of a stream as tables that survive a restart.

A table is a base and up to ``every`` deltas, one per micro-batch; a merge function makes one row per key of them.  When the
deltas are full they are merged into a new base, so the size on disk follows the keys and not the number of batches.

A batch writes its deltas to places that no earlier commit refers to, and then one marker row.  The marker is what counts:
a batch that dies before it leaves nothing behind that is ever read, and a batch that is repeated after it is skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.common import q
from ..session import in_parallel

AT = "_at"  # 0 for the base, then the place of the delta
MARKER = "version bigint, base int, deltas int"
SLOTS = 4  # markers kept
Merge = Callable[[DataFrame], DataFrame]


def keep_last(*keys: str) -> Merge:
    """The row of the latest batch of each key."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, AT)]
        last = F.max_by(F.struct(*map(q, rest)), AT).alias("_last")
        return rows.groupBy(*map(q, keys)).agg(last).select(*map(q, keys), "_last.*")
    return merge


def add_up(*keys: str, largest: Sequence[str] = ()) -> Merge:
    """Sums of each key; of the columns in ``largest``, the maximum."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, AT)]
        return rows.groupBy(*map(q, keys)).agg(*[(F.max if c in largest else F.sum)(q(c)).alias(c) for c in rest])
    return merge


REPLACE = None  # the rows of the latest batch alone


class Store:
    """Tables with one marker; ``merges`` gives each table's merge function."""

    def __init__(self, spark: SparkSession, out: str, merges: Mapping[str, Merge | None], every: int = 16):
        self.spark, self.out, self.merges, self.every = spark, out.rstrip("/"), dict(merges), every
        self.schemas: dict[str, T.StructType] = {}

    def marker(self):
        """(version, base, deltas) of the last batch that was committed, or None."""
        try:
            rows = self.spark.read.schema(MARKER).parquet(f"{self.out}/commits").collect()  # a row per slot
        except AnalysisException as ex:
            if ex.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return max(rows, key=lambda r: r["version"], default=None)

    @property
    def version(self) -> int | None:
        m = self.marker()
        return None if m is None else m["version"]

    def path(self, name: str, kind: str, slot: int) -> str:
        return f"{self.out}/{name}/{kind}={slot}"

    def read(self, name: str, kind: str, slots: Sequence[int]) -> DataFrame:
        """Rows of some bases or deltas with their slot as a column ``kind``."""
        paths = [self.path(name, kind, k) for k in slots]
        if name not in self.schemas:
            self.schemas[name] = self.spark.read.parquet(paths[0]).schema  # after a restart; one job, and no more
        return self.spark.read.schema(T.StructType([*self.schemas[name].fields, T.StructField(kind, T.IntegerType())])).option("basePath", f"{self.out}/{name}").parquet(*paths)

    def merged(self, name: str, base: int, deltas: int) -> DataFrame:
        """Base (-1: none) and the first so many deltas as one table."""
        if self.merges[name] is REPLACE:
            return self.read(name, "delta", [deltas - 1]).drop("delta") if deltas else self.read(name, "base", [base]).drop("base")
        rows = [self.read(name, "base", [base]).withColumn(AT, F.lit(0)).drop("base")] if base >= 0 else []
        rows += [self.read(name, "delta", range(deltas)).withColumn(AT, F.col("delta") + 1).drop("delta")] if deltas else []
        return self.merges[name](reduce(DataFrame.unionByName, rows))

    def table(self, name: str) -> DataFrame:
        """The merged table as of the last commit."""
        m = self.marker()
        if m is None:
            raise RuntimeError("no batch has been committed")
        return self.merged(name, m["base"], m["deltas"])

    def begin(self, version: int) -> Batch | None:
        """The batch to write; None if it was committed before."""
        m = self.marker()
        if m is not None and version <= m["version"]:
            return None
        return Batch(self, version, m["base"] if m is not None else -1, m["deltas"] if m is not None else 0)


class Batch:
    """One batch of a store: each table is written once, then the batch is committed."""

    def __init__(self, store: Store, version: int, base: int, deltas: int):
        self.store, self.version, self.base, self.deltas = store, version, base, deltas
        self.first = base < 0 and not deltas
        self.written: set[str] = set()

    def write(self, deltas: Mapping[str, DataFrame]) -> Batch:
        in_parallel(lambda x: x[1].write.mode("overwrite").parquet(self.store.path(x[0], "delta", self.deltas)), deltas.items())
        self.written |= set(deltas)
        self.store.schemas.update({k: T.StructType(df.schema.fields) for k, df in deltas.items()})
        return self

    def table(self, name: str) -> DataFrame:
        """The merged table, with this batch if it has been written."""
        return self.store.merged(name, self.base, self.deltas + (name in self.written))

    def commit(self) -> None:
        if self.written != set(self.store.merges):
            raise ValueError(f"tables {sorted(self.store.merges)} expected, got {sorted(self.written)}")
        base, n = self.base, self.deltas + 1
        if n >= self.store.every:
            base = 1 if self.base == 0 else 0
            in_parallel(lambda k: self.table(k).write.mode("overwrite").parquet(self.store.path(k, "base", base)), self.store.merges)
            n = 0
        row = self.store.spark.createDataFrame([(self.version, base, n)], MARKER).coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.store.out}/commits/slot={self.version % SLOTS}")


def add(store: Store, version: int, deltas: Mapping[str, DataFrame]) -> None:
    """Write and commit a batch that needs no look at its own tables; nothing happens if it was committed before."""
    batch = store.begin(version)
    if batch is not None:
        batch.write(deltas).commit()
