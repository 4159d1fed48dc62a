"""Table reads and writes, and the stored tables that cut lineage."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Sequence
from contextvars import ContextVar
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clustrial.functions import quoted

SLICE = "_slice"
SLICE_ROWS = 1 << 19
MIN_SLICES = 1


def read_table(
    spark: SparkSession, path: str, schema: str | StructType | None = None, columns: Sequence[str] = ()
) -> DataFrame:
    """A Parquet table; naming columns keeps the scan to those columns."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: str | StructType,
    columns: Sequence[str] = (),
) -> DataFrame:
    """A CSV file with header, an explicit schema and doubled quotes inside quotes.

    The position column some files start with (``_idx``) is dropped.
    """
    df = spark.read.schema(schema).csv(path, header=True, escape='"', enforceSchema=True)
    if columns:
        return df.select(*columns)
    return df.drop("_idx")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(
        path, header=True, escape='"', timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS"
    )


def save_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Save ``df`` as a catalog table in buckets by ``keys``, sorted within each, and read it.

    Tables saved with as many buckets by keys of the same types meet without a shuffle, and
    are grouped by their keys without one. One file is written for each bucket, so all rows
    of a key are in one file and task: sum facts that may have hot keys before saving them.
    A table of that name is replaced. ``path`` is by default in the shared folder.
    """
    path = path or f"{shared_folder(df.sparkSession)}/clustrial/{name}-{uuid.uuid4().hex}"
    files = df.repartition(buckets, *[F.col(quoted(c)) for c in keys])
    writer = files.write.format("parquet").mode("overwrite").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def append_all(frames: Iterable[DataFrame]) -> DataFrame:
    """The frames one after the other, matched by column name."""
    return reduce(lambda left, right: left.unionByName(right), frames)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="clustrial-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


_owner: ContextVar[TableStore | None] = ContextVar("owner", default=None)


def _path(spark: SparkSession, label: str) -> str:
    owner = _owner.get()
    folder = owner.folder if owner else f"{shared_folder(spark)}/clustrial"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str = "table") -> DataFrame:
    """Write once, read back: a frame used several times is computed once.

    The written table survives lost executors, gives every later branch the same
    values, and has a known size, so joins against it are planned from fact. Inside a
    ``TableStore`` the table belongs to it and is deleted with it.
    """
    path = _path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_counted(df: DataFrame, label: str = "table") -> tuple[DataFrame, int]:
    """``store``, with the number of rows counted while they are written."""
    seen = Observation()
    stored = store(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return stored, seen.get["rows"]


def input_bytes(df: DataFrame) -> int:
    """Bytes of all tables that ``df`` reads; a table of unknown size counts as Spark's largest."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.length()))


def sized(df: DataFrame) -> DataFrame:
    """``df``, stored first if the size of something it reads is unknown, as of an RDD or local rows."""
    return df if input_bytes(df) < 1 << 60 else store(df, "sized")


def store_in_slices(
    df: DataFrame, keys: Sequence[str], label: str = "slices", least: int | None = None
) -> DataFrame:
    """Store ``df`` range-partitioned by ``keys``, with the range number in ``_slice``.

    Slices are ordered: every key in slice i sorts before every key in slice j > i.
    Ranges follow the data, so a group holding a third of the rows spans many slices.
    The number is written with the row, hence stable in everything read from it.
    Rows are counted while they are stored a first time, whatever the size of the tables
    they come from; there is a slice for every ``SLICE_ROWS``, and at least ``least``.
    """
    stored, rows = store_counted(df, label)
    slices = max(least or MIN_SLICES, -(-rows // SLICE_ROWS))
    if slices == 1:
        return stored.withColumn(SLICE, F.lit(0))
    return store(stored.repartitionByRange(slices, *keys).withColumn(SLICE, F.spark_partition_id()), label)


def in_slices(df: DataFrame, keys: Sequence[str], label: str = "slices") -> tuple[DataFrame, DataFrame]:
    """``df`` stored, and its rows sorted by ``keys`` in partitions that follow each other.

    For one pass over sorted rows: only the first frame is written. Rows with equal keys
    may come in any order. Retried tasks give the same partitions, as ranges are drawn once
    for each plan from the stored rows.
    """
    stored, rows = store_counted(df, label)
    slices = max(MIN_SLICES, -(-rows // SLICE_ROWS))
    return stored, stored.repartitionByRange(slices, *keys).sortWithinPartitions(*keys)


class TableStore:
    """Stored tables with an owner: named by what they hold, read if present, deleted at the end.

    ``reuse(df, label)`` names a table by a hash of the canonical plan of ``df``, of the
    name, length and time of change of every file it reads, and of the settings that
    change results. If a finished table of that name is in the folder it is read, else it
    is written under another name and moved into place, so that of two writers one wins and
    an interrupted write is never read. Plans with parts that their text does not tell,
    such as Python functions or local rows, have no such name; they are stored anew.

    ``with TableStore(spark) as tables:`` makes every ``store`` inside its block write here
    too. Closing deletes the tables that this owner wrote; those of a folder opened with
    ``keep=True`` stay for later sessions, until ``clear``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, keep: bool = False):
        self.spark, self.keep = spark, keep
        self.folder = (folder or f"{shared_folder(spark)}/clustrial/owned-{uuid.uuid4().hex}").rstrip("/")
        self._own_folder = folder is None
        self._written: list[str] = []
        self._token = None

    def __enter__(self) -> TableStore:
        self._token = _owner.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _owner.reset(self._token)
        self.close()

    def reuse(self, df: DataFrame, label: str = "table") -> DataFrame:
        name = content_name(df)
        path = f"{self.folder}/{label}-{name or uuid.uuid4().hex}"
        if not (name and self._exists(f"{path}/_SUCCESS")):
            part = f"{self.folder}/_{uuid.uuid4().hex}"
            df.write.parquet(part)
            if not self._files(path).rename(self._place(part), self._place(path)):
                self._delete(part)  # another writer was first
                if not self._exists(f"{path}/_SUCCESS"):
                    raise OSError(f"{path} cannot be written")
            else:
                self._written.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete what this owner wrote, unless it is to be kept."""
        if self.keep:
            return
        for path in self._written:
            self._delete(path)
        self._written.clear()
        if self._own_folder:
            self._delete(self.folder)

    def clear(self) -> None:
        """Delete every table in the folder."""
        self._delete(self.folder)
        self._written.clear()

    def _place(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._place(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._files(path).exists(self._place(path))

    def _delete(self, path: str) -> None:
        self._files(path).delete(self._place(path), True)


# Leaves whose text, with the files they read, tells all they hold.
_TOLD = {"LogicalRelation", "Range", "OneRowRelation"}
# Classes of plan nodes and expressions that call code the plan only names.
_UNTOLD = re.compile(r"\.(?:\w*Python\w+|Scala\w+|\w*(?:MapIn|FlatMap|MapGroups|MapPartitions|MapElements|TypedFilter|Invoke)\w*)\"")
_SETTINGS = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive", "spark.sql.legacy.timeParserPolicy")


def content_name(df: DataFrame) -> str | None:
    """A name for what ``df`` holds, or None where its plan does not tell."""
    plan = df._jdf.queryExecution().analyzed()
    leaves = plan.collectLeaves()
    kinds = [leaves.apply(i) for i in range(leaves.length())]
    # All fields, however many: a plan's plain text leaves some out.
    text = plan.canonicalized().treeString(True, False, (1 << 31) - 1, False, False)
    if any(leaf.getClass().getSimpleName() not in _TOLD for leaf in kinds) or _UNTOLD.search(plan.toJSON()):
        return None
    told = [df.sparkSession.version, text, df.schema.json(), *[str(df.sparkSession.conf.get(s)) for s in _SETTINGS]]
    for leaf in kinds:
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            version = _files_version(df.sparkSession, leaf)
            if version is None:
                return None
            told.append(version)
    return hashlib.sha256("\0".join(told).encode()).hexdigest()


def _files_version(spark: SparkSession, leaf) -> str | None:
    """How files are read, and count and hash of their names, lengths and times of change.

    The canonical plan numbers columns, so their names come from the relation.
    """
    try:
        relation = leaf.relation()
        paths = relation.location().rootPaths()
        how = f"{relation.fileFormat().getClass().getName()} {relation.options().toString()} {leaf.schema().json()}"
    except Py4JError:  # not a relation of files
        return None
    roots = [paths.apply(i).toString() for i in range(paths.length())]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    mark = F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))
    n, total = files.agg(F.count(F.lit(1)), mark).first()
    return f"{how} {sorted(roots)} {n} {total}"
