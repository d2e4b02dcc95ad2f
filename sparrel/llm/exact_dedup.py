"""Operator 4: exact dedup against a persistent digest index.

The index holds the digests of all texts seen so far with the row that stays, in a few runs: tables
bucketed and sorted by digest, one file for each bucket.  A batch of documents is grouped by digest;
the groups are shuffled once and meet every run in a sort-merge anti-join that neither shuffles nor sorts
the run; the groups that all runs lack become a new run.  When there are more than ``MOST_RUNS``, they
are merged into one.

The bucket count and the names of the runs stand in a manifest beside them.  A run counts only once a
manifest names it, so a failed append leaves nothing but files that nobody reads.  Manifests are numbered, and
a writer claims the next number by creating a file that must not exist yet: a second writer at the same time
is refused.  A batch that is appended twice adds nothing, so a failed run may be repeated.

Texts are equal when they are the same after each run of white space became one space; null counts
as empty.  The row with the smallest doc_id stays (of a batch; a text that an earlier batch brought
keeps that batch's row).  Null doc_id: never stays before another.  Ties, that is rows alike in text and
doc_id: one of them stays, and they may be a large share of all rows.  Very long texts: only their digests
are shuffled or kept.  Empty table: nothing is added.  Other columns, of any type and name, are ignored by the
report and kept by the filter.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, all_columns, free_name, join_by_key, materialise, quoted, scratch_path

#: Version of the layout, and runs of an index beyond which they are merged.
VERSION, MOST_RUNS = 1, 8
#: Rows that follow one another in a partition and may be counted together when they are alike.
PLACE_BITS = 12
#: Shuffle partitions that one task takes of digests: their number suits the texts, of which digests are a small part.
PARTITIONS_A_TASK = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _fewer_tasks(digests: DataFrame) -> DataFrame:
    """Several shuffle partitions in each task, but no fewer tasks than cores.  However few rows a task has, it takes a page
    of memory for each sort and aggregate, and writes a file; on a local file system that starts three processes."""
    spark = digests.sparkSession
    tasks = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_A_TASK)
    return digests.coalesce(max(tasks, spark.sparkContext.defaultParallelism))


class IndexBusy(RuntimeError):
    """Another writer has claimed the next version of the index, or died while it had."""


class DigestIndex:
    """The index at ``path``; made there when nothing is.

    ``buckets`` is fixed when the index is made (as many as the session's shuffle partitions, if not given)
    and read from its manifest later; another number than that is refused.  Runs are sorted tables whose order
    Spark only uses with spark.sql.legacy.bucketedTableScan.outputOrdering, which is set on the session."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        context = spark.sparkContext
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(context._jsc.hadoopConfiguration())
        if not self._versions():
            self._claim(0)
            self._commit(0, {"version": VERSION, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": []})
        self.state = self._load()
        if self.state["version"] != VERSION:
            raise ValueError(f"the index at {path} has version {self.state['version']}, this is version {VERSION}")
        if buckets not in (None, self.buckets):
            raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}")

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    # the manifest
    def _at(self, name: str):
        return self._fs_path(f"{self.path}/{name}")

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._at("manifest")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _load(self) -> dict:
        self.version = self._versions()[-1]
        stream = self._fs.open(self._at(f"manifest/{self.version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _claim(self, version: int) -> None:
        try:
            self._fs.create(self._at(f"manifest/{version:08d}.claim"), False).close()
        except Exception as e:
            raise IndexBusy(f"version {version} of the index at {self.path} is claimed; release({version}) if its writer is dead") from e

    def release(self, version: int) -> None:
        """Give up the claim of a writer that has died."""
        if version in self._versions():
            raise ValueError(f"version {version} is committed")
        self._fs.delete(self._at(f"manifest/{version:08d}.claim"), False)

    def _commit(self, version: int, state: dict) -> None:
        part = self._at(f"manifest/{version:08d}.part")
        stream = self._fs.create(part, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if not self._fs.rename(part, self._at(f"manifest/{version:08d}.json")):
            raise IndexBusy(f"version {version} of the index at {self.path} could not be committed")
        self.version, self.state = version, state

    # the runs
    def _table(self, run: str) -> str:
        """The catalog's name of a run; the same whoever opens the index."""
        name = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{run}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'"
        )
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(self._table(r)) for r in self.state["runs"]]

    def read(self) -> DataFrame:
        """digest, keep_id of all that the index holds."""
        none = self.spark.createDataFrame([], "digest binary, keep_id long")
        return reduce(DataFrame.unionByName, self.runs(), none)

    def absent(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks."""
        return reduce(lambda g, run: g.join(run.hint("merge"), "digest", "left_anti"), self.runs(), groups)

    def known(self, groups: DataFrame) -> DataFrame:
        """The groups that the index holds, with its keep_id."""
        for k, run in enumerate(self.runs()):
            groups = groups.join(run.select("digest", F.col("keep_id").alias(f"_keep{k}"), F.lit(True).alias(f"_in{k}")).hint("merge"), "digest", "left")
        n = range(len(self.state["runs"]))
        kept = F.coalesce(*[F.col(f"_keep{k}") for k in n]) if n else F.lit(None).cast("long")
        held = F.coalesce(*[F.col(f"_in{k}") for k in n]) if n else F.lit(False)
        return groups.where(held).withColumn("keep_id", kept).drop(*[f"_{x}{k}" for x in ("keep", "in") for k in n])

    def append(self, groups: DataFrame) -> None:
        """Add the groups (digest, keep_id) that the index lacks."""
        version = max(self._versions()) + 1
        self._claim(version)
        try:
            if version != self.version + 1:
                self.state = self._load()
            runs = [*self.state["runs"], self._write(self.absent(groups), f"run_{version:08d}")]
            if len(runs) > MOST_RUNS:
                self.state = self.state | {"runs": runs}
                runs = [self._write(self.read(), f"run_{version:08d}_all")]
            self._commit(version, self.state | {"runs": runs})
        except BaseException:
            if version not in self._versions():
                self.state = self._load()
                self.release(version)
            raise

    def vacuum(self) -> None:
        """Delete the runs that the last manifest does not name; nobody may be reading an older one."""
        self.state = self._load()
        for s in self._fs.listStatus(self._fs_path(self.path)):
            run = s.getPath().getName()
            if run.startswith("run_") and run not in self.state["runs"]:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
                self._fs.delete(s.getPath(), True)

    def _write(self, rows: DataFrame, run: str) -> str:
        self._fs.delete(self._at(run), True)
        name = self._table(run)
        # all of a bucket in one task, so one file; the writer sorts it
        _fewer_tasks(rows.select("digest", "keep_id").repartition(self.buckets, "digest")).write.insertInto(name, overwrite=True)
        self.spark.catalog.refreshTable(name)
        return run


def _kinds(docs: DataFrame) -> DataFrame:
    """digest, doc_id, place, copies: rows alike in digest and doc_id that stand near each other are one.
    So a kind has a few thousand copies at most, however many rows are alike."""
    place = F.shiftright(F.monotonically_increasing_id(), PLACE_BITS)
    return docs.select(digest(F.col("text")).alias("digest"), F.col("doc_id"), place.alias("place")).groupBy("digest", "doc_id", "place").agg(F.count(F.lit(1)).alias("copies"))


def _decide(docs: DataFrame, index: DigestIndex | None, batches: int) -> DataFrame:
    """digest, doc_id, place, copies, keep_id, n_rows, first of each kind of row, after they went into the index in
    batches of ascending doc_id; ``first`` is the place of the copy that stays among rows alike."""
    fresh = index is None
    index = index or DigestIndex(docs.sparkSession, scratch_path(docs.sparkSession, "digest-index"))
    kinds = materialise(_fewer_tasks(_kinds(docs)), "digests")
    bounds = []
    if batches > 1:
        cuts = kinds.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0]
        bounds = sorted({*(cuts or [])})
    number = reduce(lambda n, b: n + F.when(F.col("keep_id") <= b, 0).otherwise(1), bounds, F.lit(0))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("least")
    groups = kinds.groupBy("digest").agg(least, F.sum("copies").alias("n_rows"))
    groups = groups.select("digest", F.col("least.doc_id").alias("keep_id"), F.col("least.place").alias("first"), "n_rows")
    groups = materialise(_fewer_tasks(groups), "digest-groups")
    total = groups.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    for k in range(len(bounds) + 1):
        index.append(groups.where(number == k))
    known = index.known(groups.withColumnRenamed("keep_id", "least"))
    if not fresh:
        # where an earlier batch's row stays and is there again, its place is looked up
        moved = known.where(~F.col("keep_id").eqNullSafe(F.col("least")))
        again = moved.select(F.col("digest").alias("d"), F.col("keep_id").alias("i"))
        again = kinds.join(again, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i"))).groupBy("digest").agg(F.min("place").alias("again"))
        known = known.join(again, "digest", "left").withColumn("first", F.coalesce("again", "first"))
    return join_by_key(kinds, known.select("digest", "keep_id", "first", "n_rows"), "digest", total, F.struct("digest", "doc_id", "place"))


def _stays() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == F.col("first"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The documents go into the index in ``batches`` of ascending doc_id, as a growing corpus would; each meets
    what those before it brought.  Nothing in the result depends on their number."""
    kinds = _decide(docs, index, batches)
    out = kinds.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("k"))
    kept = _stays() & (F.col("k") == 1)
    return out.select("doc_id", "keep_id", F.col("n_rows").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """The rows that stay, with the columns of ``docs``.  Of rows alike in text and doc_id one stays,
    whichever comes first in a partition."""
    kinds = _decide(docs, index, batches)
    d, i, n = free_name(docs, "digest"), free_name(docs, "keep_id"), free_name(docs, "n_alike")
    stays = kinds.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stays = stays.groupBy("digest", "doc_id").agg(F.sum("copies").alias(n)).withColumnsRenamed({"digest": d, "doc_id": i})
    rows = docs.withColumn(d, digest(F.col("text")))
    rows = rows.join(stays, (rows[quoted(d)] == stays[quoted(d)]) & rows["doc_id"].eqNullSafe(stays[quoted(i)])).drop(stays[quoted(d)], i)
    single = rows.where(F.col(n) == 1).select(*all_columns(docs))
    repeated = rows.where(F.col(n) > 1).groupBy(d).agg(F.first(F.struct(*all_columns(docs))).alias("r")).select("r.*")
    return single.unionByName(repeated)
