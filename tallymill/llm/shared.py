"""Helpers that several operators of this package need: tables, shared scratch space, small maths."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word, as a character class body and as plain characters.
SPACES = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only where none is set on one machine, as in tests, a temporary one is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallymill-"))
    return context.getCheckpointDir()


def written(df: DataFrame, name: str, partitions: Sequence[str] = ()) -> DataFrame:
    """Write a frame to the shared folder and read it back: the lineage ends there.

    The files are in shared storage, so losing an executor costs nothing but its running tasks.
    They go when the application ends.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place, partitionBy=list(partitions) or None)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(place)


def placed(df: DataFrame, row: str) -> DataFrame:
    """`df` with a column `row`: a number for each row, the same in every job, however scans are split.

    Rows of Parquet files as they are read are named by their file, in order of path, and their
    place in it. Any other frame is written to the shared folder once, with its numbers.
    """
    files = _parquet_files(df)
    if files is None:
        return written(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    meta = df.metadataColumn("_metadata")
    if len(files) == 1:
        return df.withColumn(row, meta["row_index"])
    path, place, name, number = fresh(df.withColumn(row, F.lit(0)), "path", "place", "name", "number")
    # The driver knows the files already; one string keeps their list out of Python workers. The list
    # grows with the table, so Spark chooses how to join it.
    names = df.sparkSession.range(1).select(
        F.posexplode(F.split(F.lit("\0".join(sorted(files))), "\0")).alias(number, name))
    rows = df.select("*", meta["file_path"].alias(path), meta["row_index"].alias(place))
    of_file = F.coalesce(F.col(number).cast("long"), F.raise_error(F.lit("a file that was not listed")).cast("long"))
    return rows.join(names, F.col(path) == F.col(name), "left").select(
        *(F.col(f"`{c}`") for c in df.columns), (F.shiftleft(of_file, 40) + F.col(place)).alias(row))


def _parquet_files(df: DataFrame) -> list[str] | None:
    """The files of a frame that is Parquet files as they are read, each once; else None."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return None
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().toString() != "Parquet":
        return None
    path, uri = df.sparkSession._jvm.org.apache.hadoop.fs.Path, df.sparkSession._jvm.java.net.URI
    # Listed as file:///x, but named file:/x in a scan.
    files = [path(path(uri(x)).toString()).toUri().toString() for x in relation.location().inputFiles()]
    return files if files and len(set(files)) == len(files) else None


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Send texts to Python workers in batches of at most this many rows.

    Texts are far longer than the values that Spark's default batch is made for; an executor's
    memory holds a batch several times over.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small frames of iterative work."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def let(value: Column, body) -> Column:
    """Work a value out once and use it several times in `body`."""
    return F.transform(F.array(value), body)[0]


def bits_of(mask: int) -> int:
    """The signed 64-bit number with the bits of an unsigned one."""
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
