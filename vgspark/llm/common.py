"""What the operators of this subpackage share: tables, shared storage, words and components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in ``sf_dir``, which may be a path that only Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
            found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, what: str = "part") -> DataFrame:
    """``df`` written to the shared folder as a table and read back: its lineage ends there and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` if it comes straight from files, so that its rows keep their order and numbers whenever they are read again; else a stored copy."""
    plan = df._jdf.queryExecution().executedPlan().treeString()
    own = all(re.search(r"FileScan|BatchScan|Project|Filter|ColumnarToRow|WholeStageCodegen|AdaptiveSparkPlan|LocalTableScan", x) for x in plan.split("\n") if x.strip())
    return df if own and "rand(" not in plan else stored(df, "rows")


def dropped(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def words(text: str | None) -> list[bytes]:
    """The words of ``text`` with A-Z lower-cased, as UTF-8; null has none."""
    return text.encode().lower().split() if text else []


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` ``(a, b)``; the root is the smallest node that can be reached.

    Alternating large and small stars. Each step is a minimum by key, combined before
    the shuffle, and a join that can be split where a node has many neighbours.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = stored(large, "large")
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
        small = stored(small.select("e.*").where("x <> y").distinct(), "edges")
        dropped(e, large)
        e = small
        now = e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("y").alias("node")).distinct()
    return e.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone: it does so when both collectors have found them unused."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bitmap(df: DataFrame, col: Column | str, bits: int = 25) -> np.ndarray:
    """A filter of fixed size over the longs in ``col``: bit ``x mod 2**bits`` is set for each x. Its words are made on the executors."""
    i = F.col(col).bitwiseAND((1 << bits) - 1) if isinstance(col, str) else col.bitwiseAND((1 << bits) - 1)
    words = df.select(i.alias("i")).groupBy(F.shiftright("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(i & 63 AS INT))")).alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    return out


def in_bitmap(found: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of the unsigned ``x`` may be in the filter."""
    i = x & np.uint64(len(found) * 64 - 1)
    return (found[i >> np.uint64(6)] >> (i & np.uint64(63)) & np.uint64(1)).astype(bool)


def is_remainder(col: Column | str, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, is ``rest``; a null id never is."""
    return F.coalesce(F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % mod == rest, F.lit(False))
