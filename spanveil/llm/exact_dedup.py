"""Exact dedup by a log-structured merge index of text digests. Native DataFrame code only.

The tasks that read the input are dealt to memtables. A memtable is flushed as a sorted run: one entry a
digest with the smallest and largest id and the number of rows, and beside it a filter, a bitmap of its
digests. FANOUT runs of a level are merged into one of the next: an entry whose digest no other run's
filter knows is passed on as it is, only the others are shuffled and merged. Compaction goes on until one
run is left. Digests with more than one row are hits, and their texts are compared byte by byte: the
smallest and the largest text of a digest must be the same.

A filter has a fixed size, so that its broadcast is bounded; the fuller it is, the more entries are
shuffled (32 bytes and three numbers each), but none is lost.

Cases: null text counts as empty. Rows that repeat an id with an equal text stand or fall together;
a null id stays only where its group has no other. Texts that share a digest but differ (forced in
tests by a short digest) are grouped by the text itself. An empty table gives no rows. Columns other
than id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.common import ascii_lower, fresh_path, join_hot, register, settled, stage, with_filter


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


#: Memtables that the input is dealt to.
MEMTABLES = 4
#: Bits of a run's filter: 256 bitmaps of 4 KB.
RUN_FILTER_BITS = 1 << 23


def _slot() -> Column:
    return F.pmod(F.xxhash64("_d"), F.lit(RUN_FILTER_BITS)) + 1


class MergeIndex:
    """Sorted digest runs in levels, each with its filter; FANOUT runs of a level are merged into one of the next."""

    FANOUT = 4

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        #: The paths of each level's runs.
        self.levels: list[list[str]] = [[]]
        #: The path of each run's filter.
        self.filters: dict[str, str] = {}

    def flush(self, keyed: DataFrame) -> None:
        """keyed: _id, _d, _m (the memtable's number, below MEMTABLES). Each memtable becomes a run."""
        path = register(fresh_path(self.spark, "lsm-runs"))
        entries = keyed.groupBy("_m", "_d").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"), F.count("*").alias("_n"))
        self.schema = entries.drop("_m").schema
        entries.sortWithinPartitions("_m", "_d").write.partitionBy("_m").parquet(path)
        runs = self.spark.read.schema(entries.schema).parquet(path)
        self._filter(runs.select("_m", "_d")).write.partitionBy("_m").parquet(register(f"{path}-filter"))
        for m in sorted(r["_m"] for r in runs.select("_m").distinct().collect()):
            self._add(0, f"{path}/_m={m}", f"{path}-filter/_m={m}")

    def _add(self, level: int, run: str, kept: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        self.filters[run] = kept
        if len(self.levels[level]) >= self.FANOUT:
            self._merge(level)

    @staticmethod
    def _filter(rows: DataFrame) -> DataFrame:
        """_m, _bucket, _bits of the digests of each run."""
        return rows.withColumn("_slot", _slot()).groupBy("_m", F.bitmap_bucket_number("_slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(path)

    def _filters(self, runs: list[str]) -> DataFrame:
        """One filter of all runs: _bucket, _bits."""
        parts = [self.spark.read.schema("_bucket long, _bits binary").parquet(self.filters[run]) for run in runs]
        return functools.reduce(DataFrame.unionByName, parts).groupBy("_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))

    def _merge(self, level: int) -> None:
        runs = self.levels[level]
        if len(runs) > 1:
            known, lone = [], []
            for run in runs:
                others = self._filters([x for x in runs if x != run])
                at = F.bitmap_bit_position("_slot")
                byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
                maybe = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
                probed = self._read(run).withColumn("_slot", _slot()).withColumn("_bucket", F.bitmap_bucket_number("_slot")).join(F.broadcast(others), "_bucket", "left")
                probed = probed.select("_d", "_low", "_high", "_n", maybe.alias("_maybe"))
                known.append(probed.filter("_maybe").drop("_maybe"))
                lone.append(probed.filter("not _maybe").drop("_maybe"))
            shared = functools.reduce(DataFrame.unionByName, known).groupBy("_d").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.sum("_n").alias("_n"))
            merged = functools.reduce(DataFrame.unionByName, lone, shared).select("_d", "_low", "_high", "_n")
        else:
            merged = self._read(runs[0])
        path = register(fresh_path(self.spark, f"lsm-level{level + 1}"))
        merged.sortWithinPartitions("_d").write.parquet(path)
        register(f"{path}-filter")
        self._filters(runs).write.parquet(f"{path}-filter")
        self.levels[level] = []
        self._add(level + 1, path, f"{path}-filter")

    def compact(self) -> DataFrame:
        """Merges until one run is left; one entry a digest: _d, _low, _high, _n."""
        while sum(map(len, self.levels)) > 1:
            self._merge(next(k for k, runs in enumerate(self.levels) if runs))
        left = [run for runs in self.levels for run in runs]
        return self._read(left[0]) if left else None


@settled
def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = sha256_digest,
) -> DataFrame:
    """One row for each of docs: id_col, keep_id, group_size, kept, digest (binary). keep: smallest or largest."""
    memtable = F.pmod(F.spark_partition_id(), F.lit(MEMTABLES)).alias("_m")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_raw"))
    rows = stage(_normalised(texts, normalise, digest).select("_id", "_d", memtable), "dedup-rows")
    total = rows.count()
    index = MergeIndex(docs.sparkSession)
    index.flush(rows)
    entries = index.compact()
    if entries is None:
        return _result(rows.select("_id", "_d", F.col("_id").alias("_rep"), F.lit(0).cast("long").alias("_n")), id_col)
    hits = stage(entries.filter("_n > 1").select("_d", F.col("_low" if keep == "smallest" else "_high").alias("_rep"), "_n"), "dedup-hits")

    members = with_filter(rows.select("_id", "_d"), hits, ["_d"])
    single = members.filter(~F.col("_maybe")).select("_id", "_d", F.col("_id").alias("_rep"), F.lit(1).cast("long").alias("_n"))
    maybe = members.filter("_maybe").drop("_maybe")
    found = join_hot(maybe, hits, "_d", "_n", total, "_id", "left")
    placed = stage(found.select("_id", "_d", F.when(F.col("_n").isNotNull(), F.col("_rep")).otherwise(F.col("_id")).alias("_rep"), F.coalesce("_n", F.lit(1)).alias("_n")), "dedup-placed")

    # Byte verification: texts that the filter of hit ids lets pass are read again. Of a digest's copies in a task one text is left before they shuffle.
    again = with_filter(texts, placed.filter("_n > 1").select("_id"), ["_id"]).filter("_maybe").drop("_maybe")
    bounds = _normalised(again, normalise, digest).groupBy("_d").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"))
    if not bounds.filter("_a <> _b").isEmpty():
        return _split_collisions(_normalised(texts, normalise, digest), id_col, keep)
    return _result(single.unionByName(placed), id_col)


def _normalised(texts: DataFrame, normalise: Callable[[Column], Column], digest: Callable[[Column], Column]) -> DataFrame:
    return texts.select("_id", normalise(F.coalesce("_raw", F.lit(""))).alias("_t")).withColumn("_d", digest(F.col("_t")))


def _result(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(
        F.col("_id").alias(id_col), F.col("_rep").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_id").eqNullSafe(F.col("_rep")).alias("kept"), F.col("_d").alias("digest")
    )


def _split_collisions(rows: DataFrame, id_col: str, keep: str) -> DataFrame:
    """Different texts shared a digest: group by digest and text."""
    pick = F.min if keep == "smallest" else F.max
    groups = rows.groupBy("_d", "_t").agg(pick("_id").alias("_rep"), F.count("*").alias("_n"))
    return _result(rows.join(groups, ["_d", "_t"]), id_col)
