"""Scoring of detections against labels.

labels: file, start, end, class, variant (real, placeholder, lookalike). detections: runner, file, start,
end, class. Within a runner and file, detections in order of start and end each claim the first real
label of their class family that overlaps and isn't claimed yet. Claims depend on the claims before,
so they are a fold; a file's labels are one array, and files are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The classes that are reported.
CLASSES = ("secrets", "pii_email", "pii_ssn", "pii_card", "pii_phone")


def class_matches(a: Column, b: Column) -> Column:
    return (a == b) | (a.startswith("pii_") & b.startswith("pii_"))


def overlaps(a: Column, b: Column) -> Column:
    return (F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])) > 0


def candidates(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of a detection and a real label of its file that overlap and agree in class family, with IoU: an equi-join with a range residual."""
    d, x = detections.alias("d"), labels.filter("variant = 'real'").alias("x")
    inter = F.least("d.end", "x.end") - F.greatest("d.start", "x.start")
    on = (F.col("d.file") == F.col("x.file")) & (inter > 0) & class_matches(F.col("d.class"), F.col("x.class"))
    return d.join(x, on).select(
        "d.runner", "d.file", F.col("d.start").alias("d_start"), F.col("d.end").alias("d_end"), F.col("x.start").alias("l_start"), F.col("x.end").alias("l_end"), F.col("x.class").alias("class"), (inter / (F.greatest("d.end", "x.end") - F.least("d.start", "x.start"))).alias("iou")
    )


def benign_hits(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """Detections that overlap a placeholder or lookalike, of any class: a range semi-join."""
    d, x = detections.alias("d"), labels.filter("variant <> 'real'").alias("x")
    return d.join(x, (F.col("d.file") == F.col("x.file")) & (F.least("d.end", "x.end") > F.greatest("d.start", "x.start")), "left_semi")


def outcomes(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """runner, file, class, outcome (tp, fp, fn), exact, lookalike: a row a detection and a row a label that no one claimed."""
    # Order of labels: a class's first appearance in the file, then their own order.
    first = labels.groupBy("file", "class").agg(F.min("ordinal").alias("_first"))
    of_file = labels.join(first, ["file", "class"]).groupBy("file").agg(
        F.array_sort(F.collect_list(F.when(F.col("variant") == "real", F.struct("_first", "ordinal", "start", "end", "class")))).alias("real"), F.array_sort(F.collect_list(F.when(F.col("variant") != "real", F.struct("ordinal", "start", "end", "class")))).alias("benign")
    )
    runs = detections.select("runner").distinct()
    dets = detections.groupBy("runner", "file").agg(F.array_sort(F.collect_list(F.struct("start", "end", "class"))).alias("dets"))
    every = runs.crossJoin(of_file).join(dets, ["runner", "file"], "full_outer")
    none = F.array()
    row = "array<struct<class:string,outcome:string,exact:boolean,lookalike:boolean>>"
    real, benign = F.coalesce("real", none.cast("array<struct<_first:int,ordinal:int,start:int,end:int,class:string>>")), F.coalesce("benign", none.cast("array<struct<ordinal:int,start:int,end:int,class:string>>"))
    every = every.select("runner", "file", F.coalesce("dets", none.cast("array<struct<start:int,end:int,class:string>>")).alias("dets"), real.alias("real"), benign.alias("benign"))

    def known(c: Column) -> Column:
        return F.when(c.isin(*CLASSES), c).otherwise("secrets")

    def step(acc: Column, d: Column) -> Column:
        open_ = F.filter("real", lambda x: overlaps(d, x) & class_matches(d["class"], x["class"]) & ~F.array_contains(acc["claimed"], x["ordinal"]))
        hit = F.when(F.size(open_) > 0, open_[0])
        bad = F.filter("benign", lambda x: overlaps(d, x))
        bait = F.when(F.size(bad) > 0, bad[0])
        out = F.when(
            hit.isNotNull(), F.struct(hit["class"].alias("class"), F.lit("tp").alias("outcome"), ((hit["start"] == d["start"]) & (hit["end"] == d["end"])).alias("exact"), F.lit(False).alias("lookalike"))
        ).otherwise(F.struct(known(F.coalesce(bait["class"], d["class"])).alias("class"), F.lit("fp").alias("outcome"), F.lit(False).alias("exact"), bait.isNotNull().alias("lookalike")))
        return F.struct(F.when(hit.isNotNull(), F.concat(acc["claimed"], F.array(hit["ordinal"]))).otherwise(acc["claimed"]).alias("claimed"), F.concat(acc["rows"], F.array(out)).alias("rows"))

    start = F.struct(F.array().cast("array<int>").alias("claimed"), F.array().cast(row).alias("rows"))
    folded = every.withColumn("_f", F.aggregate("dets", start, step))
    lost = F.transform(F.filter("real", lambda x: ~F.array_contains(F.col("_f.claimed"), x["ordinal"])), lambda x: F.struct(x["class"].alias("class"), F.lit("fn").alias("outcome"), F.lit(False).alias("exact"), F.lit(False).alias("lookalike")))
    return folded.select("runner", "file", F.explode(F.concat(F.col("_f.rows"), lost)).alias("r")).select("runner", "file", "r.*")


def scores(found: DataFrame) -> DataFrame:
    """runner, class (and `overall`), tp, fp, fn, precision, recall, f1: a rollup."""
    counts = found.filter(F.col("class").isin(*CLASSES)).rollup("runner", "class").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")]).filter("runner is not null")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = counts.select("runner", F.coalesce("class", F.lit("overall")).alias("class"), "tp", "fp", "fn", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def rates(found: DataFrame, labels: DataFrame) -> DataFrame:
    """runner, lookalike_rate (of benign labels), exact_rate, partial_rate (of true positives)."""
    benign = labels.agg(F.count_if(F.col("variant") != "real").alias("_b"))
    n = found.groupBy("runner").agg(F.count_if("lookalike").alias("_l"), F.count_if(F.col("outcome") == "tp").alias("_tp"), F.count_if("exact").alias("_e"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return n.crossJoin(F.broadcast(benign)).select("runner", share(F.col("_l"), F.col("_b")).alias("lookalike_rate"), share(F.col("_e"), F.col("_tp")).alias("exact_rate"), share(F.col("_tp") - F.col("_e"), F.col("_tp")).alias("partial_rate"))


def throughput(bytes_: Column, ms: Column) -> Column:
    """MB a second; 0 without bytes or time."""
    return F.when((bytes_ > 0) & (ms > 0), bytes_ / F.lit(1048576.0) / (ms / 1000)).otherwise(0.0)


def nearest_rank(values: DataFrame, keys: list[str], value: str, ranks: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """The element at index min(n - 1, floor(p n / 100)) of the sorted values, from 0; not interpolated.

    Found by ranking within value counts, so that equal values are pre-aggregated."""
    from pyspark.sql import Window

    counts = values.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("_to", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    at = lambda p: F.least(F.col("_n") - 1, F.floor(F.col("_n") * p / 100))
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("_to") > at(p), F.col(value))).alias(f"p{p}") for p in ranks])
