"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks. Native DataFrame code only.

A source's documents are dealt to shards by a seeded hash and laid end to end in seeded order; a block
is the next `block` words of a shard, as many in all shards of a source. A source's house is its target in
blocks, rounded. Its shards' votes are their shares of the target, and the house's seats go to the highest
quotients vote / (2 s + 1), those of equal quotients to the first shard: the seats that a divisor of one
block gives, corrected by the highest quotients left out, or the lowest let in, until the house is full.
A shard with q seats and b blocks takes every block q div b times, and q mod b of them once more: an
evenly spaced selection from a seeded start.

Targets: sources in order of code point, null last, weigh 1, 2, 3, repeating, and share all words; a target
stops at `cap` times its source's words and what is left over is shared anew by weight, until none is above.

Sizes: sources are ranked and shared by sums over their table, never in one task; a source has at most
MOST_SHARDS shards, so that its house is filled in one.

Cases: null text has size 0 and takes 0 words; a null source is a source; sources without words get
target 0; rows that repeat an id are separate documents; an empty table gives no rows. Only the named
columns are read, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.common import settled, stage

WORD = r"[^\x20\x09-\x0D]+"
#: A shard has about so many documents: enough that blocks mix, few enough for one task. A source has at most so many shards.
SHARD_DOCS, MOST_SHARDS = 512, 4096
#: Words of a block at most, and blocks that the shards of a source hold and take at least, down to blocks of
#: one word: what rounding and a shard's short last block cost is then less than 1/1000 of a target.
MOST_WORDS, LEAST_BLOCKS = 1024, 2048
#: Up to so many sources or shards, their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds _rank, from 0, by source in order of code point, null last: by ranges, each ranked by itself."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(sources.repartitionByRange(parts, F.col("_source").asc_nulls_last()).withColumn("_p", F.spark_partition_id()), "mix-ranges")
    before = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    # One row a range.
    before = before.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    own = Window.partitionBy("_p").orderBy(F.col("_source").asc_nulls_last())
    return dealt.join(F.broadcast(before), "_p").withColumn("_rank", F.col("_before") + F.row_number().over(own) - 1).drop("_p", "_before")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """sources: _source, _docs, _words, one row a source. Adds _weight and _target."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = stage(_ranked(sources).withColumn("_weight", weight).drop("_rank"), "mix-weights")
    full = F.col("_words") * cap / F.col("_weight")
    level, known = None, -1
    # What a weight of one gets once the sources known to be full are served; each round may fill more.
    while True:
        over = F.lit(False) if level is None else full < F.lit(level)
        n, total, served, free = weighed.agg(F.count_if(over), F.sum("_words"), F.sum(F.when(over, F.col("_words") * cap)), F.sum(F.when(~over, F.col("_weight")))).first()
        if n == known or not free:
            break
        level, known = float(total - (served or 0)) / free, n
    water = F.lit(0.0 if level is None else level)
    return weighed.withColumn("_target", F.least((F.col("_words") * cap).cast("double"), water * F.col("_weight")))


def _hash_number(h: Column, start: int) -> Column:
    return F.conv(F.substring(h, start, 8), 16, 10).cast("long")


def shard_seats(shards: DataFrame, cap: int = 3) -> DataFrame:
    """shards: _k (source), _shard, _len, _words, _target, _b. Adds _blocks and _quota: the seats of each source's house."""
    c = F.col
    begun = (
        shards.withColumn("_blocks", F.greatest(F.lit(1), F.ceil(c("_len") / c("_b"))))
        .withColumn("_vote", F.when(c("_words") > 0, c("_target") * c("_len") / c("_words")).otherwise(0.0))
        .withColumn("_seats", F.least(F.floor(c("_vote") / c("_b") + F.lit(0.5)), c("_blocks") * cap))
        .withColumn("_open", F.floor(c("_target") / c("_b") + F.lit(0.5)) - F.sum("_seats").over(Window.partitionBy("_k")))
    )
    # Quotients next in line: few, as a house is off by half a seat a shard and a shard has thousands.
    near = F.floor(c("_seats") / LEAST_BLOCKS) + 1
    more = F.when(c("_open") > 0, F.sequence(F.lit(0).cast("long"), near)).when((c("_open") < 0) & (c("_seats") > 0), F.sequence(F.lit(0).cast("long"), F.least(near, c("_seats") - 1)))
    lines = begun.select("_k", "_shard", "_vote", "_seats", "_open", "_blocks", F.explode(more).alias("_j"))
    lines = lines.filter((c("_open") < 0) | (c("_seats") + c("_j") < c("_blocks") * cap))
    quotient = F.when(c("_open") > 0, -c("_vote") / (2 * (c("_seats") + c("_j")) + 1)).otherwise(c("_vote") / (2 * (c("_seats") - c("_j")) - 1))
    first = Window.partitionBy("_k").orderBy(quotient, F.when(c("_open") > 0, c("_shard")).otherwise(-c("_shard")), "_j")
    won = lines.withColumn("_line", F.row_number().over(first)).filter(c("_line") <= F.abs("_open")).groupBy("_k", "_shard").agg(F.sum(F.signum("_open")).cast("long").alias("_won"))
    return begun.join(won, ["_k", "_shard"], "left").withColumn("_quota", c("_seats") + F.coalesce("_won", F.lit(0))).drop("_vote", "_seats", "_open", "_won")


@settled
def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3
) -> DataFrame:
    """One row for each of docs: id_col, source_col, size, source_size, target, taken, quota (its shard's blocks)."""
    c = F.col
    sized = docs.select(
        c(id_col).alias("_id"),
        c(source_col).alias("_source"),
        # The source as a key that is never null.
        F.coalesce(F.concat(F.lit("="), c(source_col).cast("string")), F.lit("")).alias("_k"),
        F.coalesce(F.regexp_count(c(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c(id_col).cast("string"), F.lit("")))).alias("_h"),
    )
    sized = stage(sized, "mix-sizes")
    sources = source_targets(sized.groupBy("_k", "_source").agg(F.count("*").alias("_docs"), F.sum("_size").alias("_words")), weights, cap)
    shards = F.least(F.ceil(c("_docs") / SHARD_DOCS), F.lit(MOST_SHARDS))
    block = F.greatest(F.lit(1), F.least(F.lit(MOST_WORDS), F.floor(F.least("_words", "_target") / (c("_shards") * LEAST_BLOCKS)))).cast("long")
    sources = stage(sources.withColumn("_shards", shards).withColumn("_b", block).select("_k", "_words", "_target", "_shards", "_b"), "mix-sources")

    side = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    placed = sized.join(side, "_k").withColumn("_shard", F.pmod(_hash_number(c("_h"), 1), c("_shards")))
    seats = shard_seats(placed.groupBy("_k", "_shard", "_words", "_target", "_b").agg(F.sum("_size").alias("_len"), F.min("_h").alias("_start")), cap)
    seats = stage(seats.select("_k", "_shard", "_blocks", "_quota", "_start"), "mix-seats")
    side = F.broadcast(seats) if seats.count() <= BROADCAST_SOURCES else seats
    order = Window.partitionBy("_k", "_shard").orderBy("_h", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_to", F.sum("_size").over(order)).join(side, ["_k", "_shard"])
    placed = (
        placed.withColumn("_from", c("_to") - c("_size"))
        .withColumn("_whole", F.expr("_quota div _blocks"))
        .withColumn("_rest", F.expr("_quota % _blocks"))
        .withColumn("_offset", F.pmod(_hash_number(c("_start"), 9), c("_blocks")))
        .withColumn("_b0", F.expr("_from div _b"))
        .withColumn("_b1", F.expr("(_to - 1) div _b"))
    )

    def chosen_before(b: str) -> Column:
        return F.expr(f"(({b}) * _rest + _offset) div _blocks")

    first = chosen_before("_b0 + 1") - chosen_before("_b0")
    last = chosen_before("_b1 + 1") - chosen_before("_b1")
    between = chosen_before("_b1") - chosen_before("_b0 + 1")
    once = F.when(c("_size") == 0, F.lit(0)).when(c("_b0") == c("_b1"), first * c("_size")).otherwise(
        first * ((c("_b0") + 1) * c("_b") - c("_from")) + between * c("_b") + last * (c("_to") - c("_b1") * c("_b"))
    )
    return placed.select(
        c("_id").alias(id_col), c("_source").alias(source_col), c("_size").alias("size"), c("_words").alias("source_size"), c("_target").alias("target"),
        (c("_whole") * c("_size") + once).cast("long").alias("taken"), c("_quota").cast("long").alias("quota"),
    )
