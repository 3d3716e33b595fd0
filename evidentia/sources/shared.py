"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that is set, or the one that
    ``spark.checkpoint.dir`` names, which is then set.

    Without either, a local session (driver and executors are one process) gets
    a folder of its own; on a cluster it is an error, as one machine's folder is
    no use to the others.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="evidentia-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if its scan has fewer than half as many
    splits: a file of one row group is one task otherwise, whatever is computed
    from its texts.  A large table has more splits and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: for a costly
    one that several branches read, and where a lost executor shouldn't cost the
    whole lineage."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
