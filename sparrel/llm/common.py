"""Shared plumbing: scratch tables, skew-safe joins, tokenizer chunks, word hashes.

Scratch tables live under ``spark.checkpoint.dir`` (a folder all executors share), are
written by Spark's own committers and re-read, so lineage is cut at a place that survives
the loss of executors.  They are in a folder of the application's own there, which is removed
when the JVM ends in order.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009..U+000D.
WS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is set on a local master."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.gettempdir()


def own_dir(spark: SparkSession) -> str:
    """The application's folder in the shared one, removed when the JVM ends."""
    context = spark.sparkContext
    own = getattr(context, "_sparrel_dir", None)
    if own is None:
        own = f"{shared_dir(spark)}/sparrel-{uuid.uuid4().hex}"
        p = spark._jvm.org.apache.hadoop.fs.Path(own)
        system = p.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(p)
        system.deleteOnExit(p)  # of a folder that does not exist yet, this would be forgotten
        context._sparrel_dir = own
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a scratch table and return a frame that reads it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a scratch table that no later step reads."""
    spark = df.sparkSession
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, of any name."""
    return [F.col(quoted(c)) for c in df.columns]


#: A key is hot when it holds more than one row in HOT_SHARE; there are at most HOT_SHARE such keys.
HOT_SHARE = 1000


def join_by_key(left: DataFrame, groups: DataFrame, key: str, total: int, spread) -> DataFrame:
    """Left outer join of rows with one row per key, whatever the sizes of the groups.

    ``groups`` has ``key`` (never null), ``n_rows`` (rows of the key in ``left``) and any
    other columns.  Keys of more than total / HOT_SHARE rows, of which there cannot be more
    than HOT_SHARE, are broadcast; all others meet in a sort-merge join in which no key holds
    more than that share.  Rows already served are dealt out by ``spread`` (a column of
    ``left``) and so match nothing in the second join.
    """
    values = [c for c in groups.columns if c != key]
    limit = total // HOT_SHARE
    pack = groups.select(F.col(key).alias("_k"), F.struct(*values).alias("_v"), F.col("n_rows").alias("_n"))
    hot = pack.where(F.col("_n") > limit).select(F.col("_k").alias("_hk"), F.col("_v").alias("_hv"))
    # zero for all keys, but no constant: Catalyst would fold one into the condition and deal rows by the key alone
    zero = F.pmod(F.col("_n"), F.lit(1)).cast("int")
    cold = pack.where(F.col("_n") <= limit).select(F.col("_k").alias("_ck"), zero.alias("_cs"), F.col("_v").alias("_cv"))
    out = left.join(F.broadcast(hot), left[key] == F.col("_hk"), "left")
    salt = F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int") + 1)
    out = out.withColumn("_s", salt).join(cold.hint("merge"), (F.col(key) == F.col("_ck")) & (F.col("_s") == F.col("_cs")), "left")
    picked = [F.coalesce(F.col(f"_hv.{c}"), F.col(f"_cv.{c}")).alias(c) for c in values]
    return out.select(*[left[quoted(c)] for c in left.columns], *picked)


#: Rows of a few numbers that one task may hold of one key, whatever the number of machines.
ONE_TASK = 1_000_000


def hot_join(left: DataFrame, right: DataFrame, key: str, spread, total: int) -> DataFrame:
    """Left outer join of a written table of ``total`` rows with one row per key, whose hot keys are split.  A table
    of at most ``ONE_TASK`` rows cannot have a key that one task doesn't hold, and is joined as it is."""
    if total <= ONE_TASK:
        return left.join(right, key, "left")
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return join_by_key(left, right.join(counts, key), key, total, spread).drop("n_rows")
