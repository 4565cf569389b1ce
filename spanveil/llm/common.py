"""What the training-data operators share: staged tables, ASCII folding, bounded id filters, row keys, hot keys.

No function here loses a row or a column: names that a function adds for itself are chosen so that they
clash with none of the table's, null keys are ordinary values, and rows that are equal in a key stand or
fall together. Empty tables give empty tables.
"""

from __future__ import annotations

import atexit
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of an id filter: 2**25 bits are 1024 bitmaps of 4 KB, so its broadcast never exceeds 4 MB.
#: Beyond about 10 M members it lets more rows pass to the exact join behind it; it never drops one.
FILTER_BITS = 1 << 25
#: Most rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20
#: A key with more than 1/HOT_SHARE of all rows is hot, so fewer than HOT_SHARE keys can be.
HOT_SHARE = 512
#: Parts that a hot key is split in.
HOT_PARTS = 64



class _Running(threading.local):
    """Staged tables of the operators that are running, the innermost last."""

    def __init__(self) -> None:
        self.scopes: list[list[str]] = []


_running = _Running()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without one gets one of its own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanveil-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanveil/{name}-{uuid.uuid4().hex}"


def remover(spark: SparkSession) -> Callable[[list[str]], None]:
    """Removes paths; also once the session is stopped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove(paths: list[str]) -> None:
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)

    return remove


def register(path: str) -> str:
    """path is removed when the operator that is running is done."""
    if _running.scopes:
        _running.scopes[-1].append(path)
    return path


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = register(fresh_path(spark, name))
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written at once, so that the tables it staged on the way can be removed.

    For results that are narrow. The result goes with the session, or with the operator that called."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args: object, **kwargs: object) -> DataFrame:
        spark = docs.sparkSession
        remove, out = remover(spark), fresh_path(spark, operator.__name__)
        _running.scopes.append([])
        try:
            made = operator(docs, *args, **kwargs)
            made.write.parquet(out)
        finally:
            remove(_running.scopes.pop())
        if _running.scopes:
            _running.scopes[-1].append(out)
        else:
            atexit.register(remove, [out])
        return spark.read.schema(made.schema).parquet(out)

    return run


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS and BATCH_BYTES: a batch of texts is held by the JVM, off its heap and by Python at once."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(rows, str(min(BATCH_ROWS, int(spark.conf.get(rows, "10000"))) if int(spark.conf.get(rows, "10000")) > 0 else BATCH_ROWS))
    spark.conf.set(size, f"{BATCH_BYTES}b")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; pure ASCII text takes the fast native path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, lower))


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if its files come in fewer than two splits a core: small tables are one row group, hence one task's work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(cores)


def free_name(name: str, *tables: DataFrame) -> str:
    """name, lengthened until no table has a column like it."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _slot(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)) + 1


def with_filter(df: DataFrame, members: DataFrame, keys: list[str], flag: str = "_maybe") -> DataFrame:
    """df with a boolean: false means surely not among members, by a broadcast bitmap of at most 4 MB.

    keys name the columns in both; null keys are ordinary values here. flag must not be a column of df, see free_name."""
    slot, bucket, bits = (free_name(n, df, members) for n in ("_slot", "_bucket", "_bits"))
    value = _slot(*[F.col(f"`{k}`") for k in keys])
    maps = (
        members.select(value.alias(slot))
        .groupBy(F.bitmap_bucket_number(slot).alias(bucket))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias(bits))
    )
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    probed = df.withColumn(slot, value).withColumn(bucket, F.bitmap_bucket_number(slot))
    return probed.join(F.broadcast(maps), bucket, "left").withColumn(flag, hit).drop(bucket, slot, bits)


def drop_keys(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is in dropped (a column of the same name); rows that the filter clears don't shuffle."""
    flag = free_name("_maybe", df)
    probed = with_filter(df, dropped.select(key), [key], flag)
    clear = probed.filter(~F.col(flag)).drop(flag)
    rest = probed.filter(F.col(flag)).drop(flag).alias("l")
    gone = dropped.select(F.col(key)).distinct().alias("r")
    rest = rest.join(gone, F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")), "left_anti")
    return clear.union(rest)


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells all its rows apart, equal ones too, and that column's name.

    The key is where a row stands: a hash of its file's path, and its number in the file. Tables that aren't
    read from Parquet files are staged first."""
    key = free_name("_row", docs)
    try:
        place = docs.metadataColumn("_metadata")
        keyed = docs.withColumn(key, F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row")))
        keyed.schema  # noqa: B018 (analysed here)
    except AnalysisException:
        return with_row_key(stage(docs, "rows"))
    return keyed, key


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, id_col: str, how: str = "inner") -> DataFrame:
    """left join right on key, where right has one row a key and its column rows counts left's rows of it.

    Keys with over 1/HOT_SHARE of total rows (fewer than HOT_SHARE keys, so their broadcast is bounded)
    are split in HOT_PARTS parts by id_col, and right's row is repeated for each.
    """
    is_hot = F.col(rows) * HOT_SHARE > F.lit(total)
    hot = right.filter(is_hot).select(key, F.lit(HOT_PARTS).alias("_parts"))
    salted = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(id_col), F.lit(HOT_PARTS)).cast("int"))
    ).drop("_parts")
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, F.lit(HOT_PARTS - 1)).otherwise(F.lit(0)))))
    return salted.join(many, [key, "_salt"], how).drop("_salt")
