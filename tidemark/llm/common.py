"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than ASCII white space. ``bytes.split()``
#: without arguments cuts UTF-8 text at exactly these places.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = b" \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: For bytes.translate: lower-cases A-Z and nothing else.
LOWER_TABLE = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As words(), after lower-casing A-Z."""
    return text.encode().translate(LOWER_TABLE).split() if text else []


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def n_words(col: Column) -> Column:
    """Number of words of a text column as long; 0 for null. Runs in the JVM."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of an id written as text, modulo n; null ids give that of the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """A new, unused path in the folder that driver and executors share.

    The cluster names that folder in spark.checkpoint.dir. Where it is unset, a local master
    (tests, a laptop) gets a temporary folder, set for the session; a cluster gets an error,
    as every executor would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Spark drops the shuffle files of a query when it ends, rather than when the driver collects garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def dropping_shuffles(spark: SparkSession):
    """Queries run inside leave no shuffle files behind."""
    return _setting(spark, DROP_SHUFFLES, "true")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what a task makes of them has a bounded size."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: Tables that durable() has written and nobody has deleted yet, with their sessions.
_live: dict[str, SparkSession] = {}


def durable(df: DataFrame, arrow_rows: int = 10_000) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again; arrow_rows: as many go to Python at once.

    Cuts the lineage: nothing of df is computed twice, and the rows outlive any executor.
    The table goes by discard(), at the end of a scratch() block, or when the driver ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    _live[path] = spark
    with dropping_shuffles(spark), _setting(spark, ARROW_ROWS, str(arrow_rows)):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def owned_dir(spark: SparkSession) -> str:
    """A new path in the shared folder for files that tasks write themselves; it goes as durable() tables go."""
    path = shared_dir(spark)
    _live[path] = spark
    return path


def _delete(path: str) -> None:
    spark = _live.pop(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*frames: DataFrame) -> None:
    """Delete what durable() wrote for frames that nothing needs any more."""
    for df in frames:
        _delete(df.durable_path)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes the tables that durable() wrote inside, but for those put into the list."""
    before, kept = set(_live), []
    try:
        yield kept
    finally:
        for path in set(_live) - before - {df.durable_path for df in kept}:
            _delete(path)


@atexit.register
def _delete_the_rest() -> None:
    for path in list(_live):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001, the JVM may have ended first
            return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
