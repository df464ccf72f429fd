"""Places and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one key may bring to one task, and the largest number of keys that can hold more than their share (see spread()).
KEY_ROWS, HOT_KEYS = 1_000, 50_000

_own_dir: dict[str, str] = {}
#: The tables that a thread has written: what runs in another one is never its to remove.
_of_thread = threading.local()


def _made() -> list[str]:
    if not hasattr(_of_thread, "made"):
        _of_thread.made = []
    return _of_thread.made


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where driver and executors are one process may it be unset."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="vellum-")
    return _own_dir[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made_so_far() -> int:
    """How many tables written() has made in this thread, for discard()."""
    return len(_made())


def discard(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Remove the tables that written() has made in this thread since then, but for those that keep reads. What was computed from them must be written or done with."""
    read = {f.rsplit("/", 1)[0] for df in keep for f in df.inputFiles()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in _made()[since:] if not any(r.endswith(p.rsplit("/", 1)[1]) for r in read)]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
        _made().remove(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(left: DataFrame, right: DataFrame, on: list[str], by: Column, counts: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right on columns that few values may dominate in left; by: what tells the rows of one value apart.

    counts has on and k, the number of rows of left. A value with more than most of them is dealt to several tasks and its rows
    of right go to each. As most is at least a HOT_KEYS-th of the rows of all values above KEY_ROWS, fewer than HOT_KEYS values
    have more: that many short rows are all that is broadcast. Without such a value it is a plain join.
    """
    above = counts.where(F.col("k") > KEY_ROWS).select(*on, "k")
    if above.isEmpty():
        return left.join(right, on, how)
    above = written(above, "hot-keys")
    total = above.agg(F.sum("k")).first()[0]
    most = max(KEY_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(above.where(F.col("k") > most).select(*on, F.ceil(F.col("k") / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    copied = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [*on, "_part"], how).drop("_part")
