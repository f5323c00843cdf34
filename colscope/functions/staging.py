"""Intermediate tables that several later steps read, written once to the shared folder of the cluster.

A written table survives the loss of executors, cuts the lineage, and gives the planner exact sizes.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: dict[int, tuple[DataFrame, str, str | None]] = {}  # frame, path, name in the catalog


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`. A single machine without that setting gets a folder of its own;
    a cluster without it is an error, as executors would not see each other's files."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='colscope-')}")
    return _own[0]


def staged(df: DataFrame, reader: SparkSession | None = None, folders: str | None = None, **options: str) -> DataFrame:
    """Write `df` to the shared folder, in one folder per value of `folders` if given, and read it back, in the session `reader`
    where one is given."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    (df.write.partitionBy(folders) if folders else df.write).options(**options).parquet(path)
    back = (reader or df.sparkSession).read.schema(df.schema).parquet(path)
    _written[id(back)] = (back, path, None)
    return back


def own_session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session with the settings of `spark` but for those given, to read written tables in."""
    own = spark.newSession()
    for name, value in {**spark.conf.getAll, **settings}.items():
        if name in settings or (name.startswith("spark.sql.") and spark.conf.isModifiable(name)):
            own.conf.set(name, value)
    return own


def file_a_part(spark: SparkSession) -> SparkSession:
    """A session that reads every file by itself, not several small ones together."""
    return own_session(spark, {"spark.sql.files.maxPartitionBytes": str(2**30), "spark.sql.files.openCostInBytes": str(2**30)})


def bucketed(df: DataFrame, column: str, folders: str, **options: str) -> DataFrame:
    """The same as `staged`, in one folder per value of `folders` and hashed into buckets by `column`, as many as there are
    shuffle partitions, so that later groupings by that column need no shuffle."""
    spark, name = df.sparkSession, f"staged_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").options(path=path, **options).partitionBy(folders)
    writer.bucketBy(buckets, column).saveAsTable(name)
    back = spark.table(name)
    _written[id(back)] = (back, path, name)
    return back


def discard(*frames: DataFrame) -> None:
    """Remove the tables behind frames that `staged` returned; other frames are left alone."""
    for frame in frames:
        back, path, name = _written.pop(id(frame), (None, None, None))
        if back is not None:
            spark = back.sparkSession
            if name is not None:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def tables() -> int:
    """How many staged tables are still there."""
    return len(_written)


@contextlib.contextmanager
def scope():
    """Remove on leaving all tables staged inside, but for the frames added to the list that it gives. Results built on the
    others must have been written by then."""
    before, kept = set(_written), []
    try:
        yield kept
    finally:
        stay = before | {id(frame) for frame in kept}
        discard(*[frame for key, (frame, *_) in list(_written.items()) if key not in stay])


@atexit.register
def _clear() -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        discard(*[frame for frame, *_ in list(_written.values())])
