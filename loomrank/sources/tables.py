"""Input tables, small local tables, and intermediate results that more than one job reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}
_SAVED: dict[str, None] = {}
#: Tables of more rows are not broadcast, nor brought to the driver.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str, source: DataFrame | None = None) -> DataFrame:
    """df, shuffled by key where its source is so small and in so few files that most cores would have nothing to read.

    For work that costs far more than the shuffle, such as parsing. Larger tables, and those of a file per core, stay as they are.
    """
    spark, source = df.sparkSession, df if source is None else source
    cores = spark.sparkContext.defaultParallelism
    whole = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()) * cores
    if int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= whole or not 0 < len(source.inputFiles()) < cores:
        return df
    return df.repartition(cores, key)


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a relation whose size the planner knows: an empty one prunes the joins it stands in."""
    kind = StructType.fromDDL(schema)
    names = kind.fieldNames()
    values = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=to_arrow_schema(kind))
    return spark.createDataFrame(values, kind)


def settled(df: DataFrame, name: str, most: int = 20_000) -> DataFrame:
    """df computed once: as a local table up to `most` rows, else as saved()."""
    rows = df.limit(most + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= most else saved(df, name)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where it is unset and Spark runs in one process (as in tests), a temporary folder that is
    removed at exit; on a cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "local" not in _OWN:
        _OWN["local"] = tempfile.mkdtemp(prefix="loomrank-")
        atexit.register(shutil.rmtree, _OWN["local"], ignore_errors=True)
    return _OWN["local"]


def new_path(spark: SparkSession, name: str) -> str:
    """A folder for an intermediate result, which delete() and clean_up() know."""
    path = f"{shared_folder(spark).rstrip('/')}/loomrank-{uuid.uuid4().hex}/{name}"
    _SAVED[path] = None
    return path


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """saved() and the folder, for delete()."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there.

    Cuts the lineage and keeps several later jobs from computing df again; it outlives executors.
    clean_up() deletes it.
    """
    return save(df, name)[0]


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate results of this process; nothing that is computed from them may run later."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        if path not in _SAVED:
            raise ValueError(f"{path} is not an intermediate result of this process")
        folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        del _SAVED[path]


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the intermediate results that were saved inside."""
    before = set(_SAVED)
    try:
        yield
    finally:
        delete(spark, *[p for p in _SAVED if p not in before])


def clean_up(spark: SparkSession) -> int:
    """Deletes every intermediate result of this process and says how many there were. For the end of a program: tables
    returned earlier, unless written elsewhere, can no longer be read."""
    paths = list(_SAVED)
    delete(spark, *paths)
    return len(paths)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if _SAVED and spark is not None and not _OWN:
        try:
            clean_up(spark)
        except Exception:  # the session has ended; the folder is left to its owner
            pass
