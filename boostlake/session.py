"""Session settings and durable tables of the engine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Partial results that one task adds up.
FAN_IN = 64


def session(app: str = "boostlake", **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; ``conf`` adds to them."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return SparkSession.builder.appName(app).config(map={**base, **conf}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local one is set if the master is local; on a cluster that
    is an error, as executors would write to disks of their own."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        held = sc._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not is_local(sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {sc.master} share")
        where = f"file:///tmp/boostlake-checkpoints/{sc.applicationId}"
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def is_local(master: str) -> bool:
    """Whether tasks run in the driver's own process."""
    return master == "local" or master.startswith("local[")


def tables_dir(spark: SparkSession) -> str:
    """The application's own folder of stored tables."""
    return f"{shared_dir(spark)}/boostlake-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame | None) -> None:
    """Delete the files of a table made by ``stored``, through Spark's own file system layer."""
    if df is not None:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def clean(spark: SparkSession) -> None:
    """Delete all stored tables of this application; frames that read them can't be used afterwards."""
    _delete(spark, tables_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def input_tasks(df: DataFrame) -> int:
    """About how many tasks read the sources of ``df``, from the size of their files; where that isn't known, as many as run at once."""
    conf = df.sparkSession.conf
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    once = df.sparkSession.sparkContext.defaultParallelism
    per = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    shuffled = int(conf.get("spark.sql.shuffle.partitions"))
    return max(once, shuffled, -(-size // per) if size < 1 << 60 else 0)


def steps(df: DataFrame) -> int:
    """Steps of FAN_IN before the last one in which partial results of all tasks are added up."""
    n, tasks = 0, input_tasks(df)
    while tasks > FAN_IN:
        n, tasks = n + 1, -(-tasks // FAN_IN)
    return n
