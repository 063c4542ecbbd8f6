"""Materialising intermediate tables and size-checked broadcasts.

Iterative operators cut their lineage with tables written to the shared
folder that the cluster names in ``spark.checkpoint.dir``.  The folder is read
from the session; a temporary one is made only where the setting is absent and
the master is local (tests).
"""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows, and of bytes, that a lookup side may have to be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables (``spark.checkpoint.dir``)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="strandloom-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers (once a context)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parents[1]
    folder = pathlib.Path(tempfile.mkdtemp(prefix="strandloom-py-"))
    with zipfile.ZipFile(folder / "strandloom_package.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(folder / "strandloom_package.zip"))
    _SHIPPED.add(sc.applicationId)


class Table:
    """An intermediate table in the shared folder, with its row count and size."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema
        self._rows: int | None = None

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self, schema: str) -> DataFrame:
        """The table with its partition columns, also where nothing was written."""
        return self.spark.read.schema(schema).parquet(self.path)

    def rows(self) -> int:
        """Counted once, from the files' footers."""
        if self._rows is None:
            self._rows = self.df.count()
        return self._rows

    def bytes(self) -> int:
        p, fs = file_system(self.spark, self.path)
        return fs.getContentSummary(p).getLength()

    def drop(self) -> None:
        p, fs = file_system(self.spark, self.path)
        fs.delete(p, True)


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of one small file on any file system; None if there is none."""
    p, fs = file_system(spark, path)
    if not fs.exists(p):
        return None
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file on any file system, replaced if it is there."""
    p, fs = file_system(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def materialize(df: DataFrame, partition_by: list[str] | None = None, compression: str = "snappy") -> Table:
    """Write ``df`` to the shared folder and return it as a Table. Runs a job.

    The files are removed when the Spark driver ends, or by ``Table.drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandloom/{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    p, fs = file_system(spark, path)
    fs.deleteOnExit(p)
    return Table(spark, path, df.schema)


def lookup_join(left: DataFrame, right: Table, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join a large side with a materialised lookup table of unknown size.

    The lookup is broadcast only if its measured rows and bytes are below the
    bounds; otherwise the join shuffles, and adaptive execution splits hot keys
    of the left side (the lookup has one row for each key).
    """
    small = right.bytes() <= max_bytes and right.rows() <= max_rows
    side = F.broadcast(right.df) if small else right.df
    return left.join(side, on, how)


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def fresh(df: DataFrame, stem: str, taken: list[str] = ()) -> str:
    """A column name that ``df`` does not have (compared without case)."""
    have = {c.lower() for c in [*df.columns, *taken]}
    name, i = stem, 0
    while name.lower() in have:
        i += 1
        name = f"{stem}_{i}"
    return name


def require(df: DataFrame, *columns: str) -> None:
    """Raise ValueError naming the columns that ``df`` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}; have {', '.join(df.columns)}")
