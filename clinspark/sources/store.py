"""Record store: scans, point lookups, upserts, deletes, recovery by priority, quarantine, exports and readers."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Own folders of local sessions, by application, where none is set.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; where it is unset, one below the warehouse, or a temporary one of a local session."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_clinspark"
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="clinspark-shared-")
    return _own[sc.applicationId]


def cut_lineage(table: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    sc = table.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(table.sparkSession))
    return table.checkpoint()


def stored(table: DataFrame) -> DataFrame:
    """A copy in the shared folder that is as large as its files, for rounds of joins.

    A checkpoint keeps the size that was estimated, the product of what was joined: over rounds the number's digits grow
    so long that planning alone takes minutes.
    """
    spark = table.sparkSession
    at = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    table.write.parquet(at)
    return spark.read.schema(table.schema).parquet(at)


#: Rows that one task sorts at a time.
ROWS_PER_TASK = 1 << 20


def dealt(rows: DataFrame, *by: str, n: int | None = None, most: int = ROWS_PER_TASK) -> DataFrame:
    """Rows dealt by ``by`` into as many parts as their number (``n``, or counted) asks for, so that a task's memory doesn't grow with the table."""
    n = rows.count() if n is None else n
    return rows.repartition(max(math.ceil(n / most), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def get_item(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key wins; a change wins over a stored row of the same version."""
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank", "__new")


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def first_non_empty(sources: Iterable[DataFrame]) -> DataFrame:
    """Recovery: the first source that has rows, else the last one."""
    chosen = None
    for chosen in sources:
        if not chosen.isEmpty():
            return chosen
    if chosen is None:
        raise ValueError("no source")
    return chosen


def quarantine(table: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the rest; a null verdict is not valid."""
    ok = F.coalesce(valid, F.lit(False))
    return table.where(ok), table.where(~ok)


def keep_last(table: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """Bounded buffers: the last n rows of each group."""
    return table.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def recent(table: DataFrame, ts: str, key: str, limit: int, since=None, hash_column: str | None = None, hash_value: str | None = None) -> DataFrame:
    """Newest first; a hash filter, if given, goes before ``since``."""
    if hash_column and hash_value is not None:
        table = table.where(F.col(hash_column) == hash_value)
    elif since is not None:
        table = table.where(F.col(ts) >= F.lit(since))
    return table.orderBy(F.desc(ts), F.desc(key)).limit(limit)


def read_jsonl(spark: SparkSession, path: str, schema: str, drop_malformed: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE").json(path)


def read_documents_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document for each file, in the order of file names."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def write_census_csv(table: DataFrame, path: str) -> None:
    """All values quoted, quotes doubled; missing values and zeros become empty."""
    blank = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == "0"), F.lit("")).otherwise(F.col(c).cast("string")).alias(c) for c in table.columns]
    table.select(*blank).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def paired_rows(left: DataFrame, right: DataFrame, key: str, left_list: str, right_list: str) -> DataFrame:
    """Positions of two lists side by side, the shorter one filled with nulls."""
    a = left.select(key, F.posexplode_outer(left_list).alias("pos", "left"))
    b = right.select(key, F.posexplode_outer(right_list).alias("pos", "right"))
    return a.join(b, [key, "pos"], "full").where("pos IS NOT NULL")
