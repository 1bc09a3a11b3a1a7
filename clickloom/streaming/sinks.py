"""Result tables: append, adding and replacing upserts, delete-and-insert; each batch takes effect once.

A table is a log of small deltas and a fold of all that came before: a batch writes its own rows alone, and they are merged when the table
is read. Every FOLD deltas, or when the kind of change changes, the deltas are folded into one table. A delta is written beside
the others and renamed when whole, under the ids of its query and batch, so a batch that is run again finds it and does nothing. One
writer at a time. Nulls in keys are equal.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Deltas that are merged on reading at most.
FOLD = 8


@dataclass(frozen=True, order=True)
class Delta:
    """A folder of changes: place in the log, query and batch that made it, kind of change, keys, and the column that is added to."""

    number: int
    query: str
    batch: int
    kind: str
    keys: tuple[str, ...]
    value: str

    def name(self) -> str:
        return "~".join([f"d-{self.number:012d}", self.query, str(self.batch), self.kind, ".".join(self.keys), self.value])

    @classmethod
    def of(cls, name: str) -> Delta:
        number, query, batch, kind, keys, value = name.split("~")
        return cls(int(number[2:]), query, int(batch), kind, tuple(k for k in keys.split(".") if k), value)


class VersionedTable:
    """A keyed table under a path of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, path: str, schema: str, fold: int = FOLD):
        self.spark, self.path, self.schema, self.fold = spark, path, schema, fold
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._files = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(path))

    def _log(self) -> tuple[int, list[Delta]]:
        """Number that the last fold reaches to (-1: none), and the deltas after it."""
        names = [x.getPath().getName() for x in self._files.listStatus(self._path(self.path))]
        folded = max((int(n[2:]) for n in names if n.startswith("f-")), default=-1)
        return folded, sorted(d for n in names if n.startswith("d-") and (d := Delta.of(n)).number > folded)

    def _folded_batches(self, folded: int) -> dict[str, int]:
        """The last batch of each query that the fold holds."""
        if folded < 0:
            return {}
        return {r.query: r.batch for r in self.spark.read.schema("query string, batch long").parquet(f"{self.path}/b-{folded:012d}").collect()}

    def batches(self, query: str = "0") -> list[int]:
        """Batches of a query that took effect since the last fold, and the last one before."""
        folded, log = self._log()
        before = self._folded_batches(folded)
        return ([before[query]] if query in before else []) + [d.batch for d in log if d.query == query]

    def _state(self, folded: int, log: list[Delta]) -> DataFrame:
        base = self.spark.read.schema(self.schema).parquet(f"{self.path}/f-{folded:012d}") if folded >= 0 else self.spark.createDataFrame([], self.schema)
        if not log:
            return base
        columns, kind, keys, value = base.columns, log[0].kind, list(log[0].keys), log[0].value
        every = base.withColumn("_number", F.lit(-1).cast("long"))
        for d in log:
            every = every.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/{d.name()}").withColumn("_number", F.lit(d.number).cast("long")))
        if kind == "add":
            return every.groupBy(*keys).agg(F.sum(value).alias(value)).select(*columns)
        if not keys:
            return every.select(*columns)
        pick = F.max if kind == "replace" else F.min
        return every.withColumn("_own", pick("_number").over(Window.partitionBy(*keys))).where("_number = _own").select(*columns)

    def read(self, before: tuple[str, int] | None = None) -> DataFrame:
        """The table; before: as it was when that query's batch began, if the batch is in the log."""
        folded, log = self._log()
        if before is not None:
            own = [d.number for d in log if (d.query, d.batch) == before]
            log = [d for d in log if not own or d.number < own[0]]
        return self._state(folded, log)

    def _fold(self, folded: int, log: list[Delta]) -> int:
        number = log[-1].number
        known = self._folded_batches(folded)
        for d in log:
            known[d.query] = max(d.batch, known.get(d.query, d.batch))
        own = f"{self.path}/_tmp-{uuid.uuid4().hex}"
        self._state(folded, log).write.parquet(own)
        self.spark.createDataFrame(sorted(known.items()), "query string, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/b-{number:012d}")
        if not self._files.rename(self._path(own), self._path(f"{self.path}/f-{number:012d}")):
            raise OSError(f"{own} could not be renamed")
        for old in [d.name() for d in log] + ([f"f-{folded:012d}", f"b-{folded:012d}"] if folded >= 0 else []):
            self._files.delete(self._path(f"{self.path}/{old}"), True)
        return number

    def _commit(self, df: DataFrame, batch: int, query: str, kind: str, keys: list[str], value: str = "") -> bool:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", query):
            raise ValueError("a query's id has letters, digits, hyphens and underscores")
        folded, log = self._log()
        if any((d.query, d.batch) == (query, batch) for d in log) or batch <= self._folded_batches(folded).get(query, -1):
            return False
        last = max([folded, *(d.number for d in log)])
        if log and (len(log) >= self.fold or (log[0].kind, log[0].keys, log[0].value) != (kind, tuple(keys), value)):
            self._fold(folded, log)
        own = f"{self.path}/_tmp-{uuid.uuid4().hex}"
        df.write.parquet(own)
        name = Delta(last + 1, query, batch, kind, tuple(keys), value).name()
        if not self._files.rename(self._path(own), self._path(f"{self.path}/{name}")):
            raise OSError(f"{own} could not be renamed")
        return True

    def _typed(self, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.schema).schema.fields))

    def append(self, df: DataFrame, batch: int, keys: list[str] | None = None, query: str = "0") -> bool:
        """Add rows; with keys, only those whose key isn't there yet. False if the batch took effect before."""
        return self._commit(self._typed(df.dropDuplicates(keys) if keys else df), batch, query, "append", keys or [])

    def add(self, df: DataFrame, batch: int, keys: list[str], value: str, query: str = "0") -> bool:
        """Add value to the row of each key, or put the row in."""
        return self._commit(self._typed(df.groupBy(*keys).agg(F.sum(value).alias(value))), batch, query, "add", keys, value)

    def replace(self, df: DataFrame, batch: int, keys: list[str], query: str = "0") -> bool:
        """Put each row in the place of the rows with its key. With fewer keys than the table has: delete what matches, then insert."""
        return self._commit(self._typed(df), batch, query, "replace", keys)


def write_task_rows(df: DataFrame, path: str, task_id: int, mode: str = "append") -> None:
    """A batch result with its task's id, as Parquet partitioned by task."""
    df.withColumn("task_id", F.lit(task_id).cast("long")).write.mode(mode).partitionBy("task_id").parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def upsert_jdbc(df: DataFrame, url: str, table: str, keys: list[str], value: str | None = None, **options) -> None:
    """Upsert into a database table: executors write the rows to a table beside it, then one transaction merges them there.

    value: the column to add to; without it the rows with the same keys are deleted, then all rows inserted. Keys are compared with nulls equal.
    """
    beside = f"loom_{uuid.uuid4().hex[:20]}"
    write_jdbc(df, url, beside, "overwrite", **options)
    jvm = df.sparkSession.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            properties.setProperty(k, options[k])
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    same = " AND ".join(f'({table}."{k}" = {beside}."{k}" OR ({table}."{k}" IS NULL AND {beside}."{k}" IS NULL))' for k in keys)
    there = f"EXISTS (SELECT 1 FROM {beside} WHERE {same})"
    new = f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {beside}"
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        if value:
            statement.executeUpdate(f'UPDATE {table} SET "{value}" = "{value}" + (SELECT SUM({beside}."{value}") FROM {beside} WHERE {same}) WHERE {there}')
            statement.executeUpdate(f"DELETE FROM {beside} WHERE EXISTS (SELECT 1 FROM {table} WHERE {same})")
        else:
            statement.executeUpdate(f"DELETE FROM {table} WHERE {there}")
        statement.executeUpdate(new)
        statement.executeUpdate(f"DROP TABLE {beside}")
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one where that is unset and Spark runs in one local process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='loom-')).rstrip('/')}/{uuid.uuid4().hex}"
