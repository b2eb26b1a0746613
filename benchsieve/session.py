"""Session settings that operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a folder of its own; a cluster without
    the setting is an error, since a machine-local folder would not be shared.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "benchsieve-checkpoints")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage (survives lost executors)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Folders that ``stage_table`` has written, in order.
_staged: list[str] = []


def register_staged(path: str) -> None:
    """A folder that an operator has written itself, for ``drop_staged``."""
    _staged.append(path)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later steps then start from columnar files, with column pruning, instead of
    running the plan again. ``drop_staged`` deletes what is no longer read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(schema).parquet(path)


def staged() -> int:
    """How many tables have been staged so far, for ``drop_staged``."""
    return len(_staged)


def drop_staged(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables staged after ``since`` others, but for the last ``keep``.

    Call it once their readers have been written: results of operators may read
    staged tables when they run.
    """
    end = len(_staged) - keep
    fs = None
    for path in _staged[since:end]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs or at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(at, True)
    del _staged[since:end]


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out to all cores when the scan has fewer splits than cores.

    A file of one row group is one task however many cores there are.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
