"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signatures: a shingle's hash falls in one of UNIVERSE bins; a first permutation moves the bin, and a
second, shifted circularly by k, gives its value for coordinate k. So the values of one shingle for all
coordinates are one contiguous run of the second permutation, and a signature is the minimum of such
runs. Sets beyond TABLE_SHINGLES would fill the bins; for them both permutations are of all 64-bit
numbers and computed instead of looked up, and sets near that size get keys of both kinds. BANDS bands
of ROWS coordinates: a pair at the threshold 0.85 escapes all bands with a probability of 2e-8, and one
at 0.95 with less than 1e-19. Below 0.85, MOST_BANDS are taken: a pair at 0.80 escapes them with a
probability of 2e-8, too.

Documents with equal shingle sets are one class (by a 128-bit digest of the set) with its smallest id
as representative; only representatives are banded. Then, in buckets that hold two representatives:

1. Each representative is compared with one other, the smallest id of all its buckets: full sets meet in
   tasks that hold one set of the two and stream the others past it, so a large group of near copies is
   a star whose leaves are dealt over many tasks. The links so confirmed give components.
2. What is left are buckets whose members are in different components. Their sets meet bucket by bucket
   (buckets with equal members once), and an exact prefix filter (rarest shingles first) finds the pairs
   to compare; pairs that are in one component already aren't compared.
3. A bucket of over TILE_SHINGLES is split by the members' other bands first: a pair above the threshold
   that shares one band shares another. What is still larger is compared tile by tile.

Groups are never closed over links that aren't confirmed, so chains of weak candidates don't grow
together. Nothing is capped or sampled. Every link is confirmed on full sets of 64-bit shingle hashes,
whose words are hashed eight bytes at a time with full mixing (textnum.word_hashes).

Cases: null or blank text has no shingles and is linked with nothing; with fewer words than a shingle,
the whole sequence is the one shingle; rows that repeat an id are one document for linking, each with
its own shingle count; a null id is linked with nothing; an empty table gives no rows. Ids are
integers. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import bounded_batches, join_hot, settled, stage, with_filter
from spanveil.llm.graph import components
from spanveil.llm.textnum import U64, chunks, mix64, text_bytes, word_hashes, words

SHINGLE = 5
BANDS, ROWS = 56, 8
MOST_BANDS = 96
UNIVERSE = 1 << 20
#: Beyond so many shingles, permutations are computed: a table's bins would hold too many.
TABLE_SHINGLES = 1 << 16
#: Similarity in hundredths at and above which two documents are linked, where no other is given. Never below LEAST_PERCENT.
PERCENT, LEAST_PERCENT = 85, 80
#: A bucket's tile holds about so many shingles (8 bytes each).
TILE_SHINGLES = 1 << 20
#: Parts that the members compared with one leader are dealt to, at least.
STAR_PARTS = 64
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SEED = 20_240_607

_made: dict[str, np.ndarray] = {}


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second as a view whose row p holds its values from p on, circularly."""
    if not _made:
        rng = np.random.Generator(np.random.PCG64(SEED))
        first, second = rng.permutation(UNIVERSE).astype(np.int32), rng.permutation(UNIVERSE).astype(np.uint32)
        around = np.concatenate([second, second[: MOST_BANDS * ROWS]])
        _made["first"] = first
        _made["second"] = np.lib.stride_tricks.as_strided(around, (UNIVERSE, MOST_BANDS * ROWS), (4, 4), writeable=False)
        _made["mix"] = rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) * U64(2) + U64(1)
    return _made["first"], _made["second"]


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles."""
    raw, offsets = text_bytes(column)
    odd = mix64(np.arange(1, size + 1, dtype=U64)) | U64(1)
    for a, b in chunks(offsets):
        at, part = offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]]
        starts, ends, first = words(part, at, SPACE)
        h = word_hashes(part, starts, ends)
        n = max(0, len(h) - size + 1)
        grams = np.zeros(n, U64)
        for k in range(size):
            grams += h[k : k + n] * odd[k]
        grams = mix64(grams)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if j - i >= size:
                yield np.unique(grams[i : j - size + 1])
            elif j > i:
                yield mix64((h[i:j] * odd[: j - i]).sum(keepdims=True) + U64(j - i))
            else:
                yield np.zeros(0, U64)


def bands_for(percent: int) -> int:
    return BANDS if percent >= PERCENT else MOST_BANDS


def signature(shingles: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """By the permutations of UNIVERSE."""
    first, second = permutations()
    second = second[:, : bands * ROWS]
    at = first[(shingles & U64(UNIVERSE - 1)).astype(np.int64)]
    best = second[at[:512]].min(axis=0)
    for k in range(512, len(at), 512):
        np.minimum(best, second[at[k : k + 512]].min(axis=0), out=best)
    return best


def wide_signature(shingles: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """By permutations of all 64-bit numbers, the second shifted circularly as well."""
    shift = np.arange(bands * ROWS, dtype=U64)
    moved = mix64(shingles ^ U64(0x5851F42D4C957F2D))
    best = np.full(len(shift), ~U64(0))
    for k in range(0, len(moved), 256):
        np.minimum(best, mix64(moved[k : k + 256, None] + shift).min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray, kind: int = 0) -> np.ndarray:
    """One 64-bit key a band; the band's number and the kind of the signature are part of it."""
    rows = sig.reshape(-1, ROWS).astype(U64)
    return mix64((rows * _made["mix"]).sum(axis=1) + np.arange(1 + kind * MOST_BANDS, len(rows) + 1 + kind * MOST_BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15))


def bucket_keys(shingles: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The keys of a set's buckets. Two sets above LEAST_PERCENT have a kind of keys in common."""
    permutations()
    kinds = []
    if len(shingles) <= TABLE_SHINGLES:
        kinds.append(band_keys(signature(shingles, bands)))
    if 100 * len(shingles) > LEAST_PERCENT * TABLE_SHINGLES:
        kinds.append(band_keys(wide_signature(shingles, bands), 1))
    return np.concatenate(kinds)


def set_digest(shingles: np.ndarray) -> bytes:
    a, b = mix64(shingles + U64(1)), mix64(shingles ^ U64(0xA5A5A5A5A5A5A5A5))
    return int(a.sum()).to_bytes(8, "big") + int(np.bitwise_xor.reduce(b)).to_bytes(8, "big") + len(shingles).to_bytes(4, "big")


def sign(docs: DataFrame, id_col: str, text_col: str, n_bands: int = BANDS) -> DataFrame:
    """_id, _n (shingles), _set (digest; null if none), _bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutations()
        for batch in batches:
            n, sets, bands = [], [], []
            for s in shingle_sets(batch.column("_t")):
                n.append(len(s))
                sets.append(set_digest(s) if len(s) else None)
                bands.append(bucket_keys(s, n_bands).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["_id", "_n", "_set", "_bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(run, "_id long, _n long, _set binary, _bands array<long>")


class Forest:
    """Labels of nodes; a union renames the smaller side."""

    def __init__(self, labels: np.ndarray) -> None:
        _, self.label = np.unique(labels, return_inverse=True)
        order = np.argsort(self.label, kind="stable")
        cuts = np.flatnonzero(np.diff(self.label[order])) + 1
        self.members = {int(self.label[x[0]]): x.tolist() for x in np.split(order, cuts) if len(x)}

    def union(self, a: int, b: int) -> bool:
        x, y = int(self.label[a]), int(self.label[b])
        if x == y:
            return False
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        moved = self.members.pop(y)
        self.label[moved] = x
        self.members[x] += moved
        return True


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def link(sets: list[np.ndarray], percent: int = PERCENT, labels: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among sets that join what labels leaves apart: pairs of indexes, every one confirmed on full sets.

    Sets above the threshold share one of their rarest shingles, so the members of each such shingle's list
    are compared: first all with the list's first, which joins most, then those still apart with one another.
    side: if given, only sets on different sides are compared."""
    m = len(sets)
    forest, found = Forest(np.arange(m) if labels is None else labels), []
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    tokens, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, df))] = np.arange(len(tokens))
    order = np.lexsort((rank[token], owner))
    ranked = rank[token][order]
    start = np.concatenate([[0], np.cumsum(sizes)])
    prefix = sizes - (percent * sizes + 99) // 100 + 1
    within = (np.arange(len(ranked)) - np.repeat(start[:-1], sizes) < np.repeat(prefix, sizes)) & (np.sort(df)[ranked] > 1)
    place = np.lexsort((owner[order][within], ranked[within]))
    members, of = owner[order][within][place], ranked[within][place]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
    tested: set[int] = set()

    def test(x: int, y: int) -> None:
        pair = min(x, y) * m + max(x, y)
        if pair not in tested and (side is None or side[x] != side[y]):
            tested.add(pair)
            if similar(sets[x], sets[y], percent):
                forest.union(x, y)
                found.append((x, y))

    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        docs = members[a:b]
        if (forest.label[docs] == forest.label[docs[0]]).all():
            continue
        for x in docs[1:].tolist():
            if forest.label[x] != forest.label[docs[0]]:
                test(int(docs[0]), x)
        if (forest.label[docs] == forest.label[docs[0]]).all():
            continue
        for k in range(2, len(docs)):
            x = int(docs[k])
            near = docs[1:k]
            for y in near[forest.label[near] != forest.label[x]].tolist():
                if forest.label[y] != forest.label[x]:
                    test(x, y)
    return found


def _ids(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])


def _sets_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (np.frombuffer(s.as_buffer(), U64) for s in batch.column("_s"))


def _stars(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows _lead, _salt, _leaf, _id, _s in order of the first three, the leader's before its leaves': the leaves similar to their leader. One set is held at a time, and the leader's."""
    key, held = None, []
    for batch in batches:
        found = []
        for lead, salt, leaf, doc, s in zip(*(batch.column(c).to_pylist() for c in ("_lead", "_salt", "_leaf", "_id")), _sets_of(batch), strict=True):
            if (lead, salt) != key:
                key, held = (lead, salt), []
            if not leaf:
                # A copy: the batch's memory goes with the batch. Rows that repeat an id are one document.
                held.append(s.copy())
            elif any(similar(s, h, percent) for h in held):
                found.append((doc, lead))
        yield _ids(found)


def _bucket_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows _key, _i, _j, _tile, _id, _label, _s in order of the first three: links of each bucket that join labels."""
    key, ids, sets, labels, tiles = None, [], [], [], []

    def done() -> pa.RecordBatch:
        pairs = link(sets, percent, np.array(labels), np.array(tiles) if key[1] != key[2] else None) if len(set(labels)) > 1 else []
        return _ids([(ids[x], ids[y]) for x, y in pairs])

    for batch in batches:
        for k, i, j, tile, doc, label, s in zip(*(batch.column(c).to_pylist() for c in ("_key", "_i", "_j", "_tile", "_id", "_label")), _sets_of(batch), strict=True):
            if (k, i, j) != key:
                if len(sets) > 1:
                    yield done()
                key, ids, sets, labels, tiles = (k, i, j), [], [], [], []
            ids.append(doc)
            labels.append(label)
            tiles.append(tile)
            sets.append(s.copy())
    if len(sets) > 1:
        yield done()


class NearPairs:
    """The steps from buckets to confirmed links, for one table's representatives."""

    def __init__(self, sets: DataFrame, bands: DataFrame, percent: int) -> None:
        """sets: _id, _s. bands: _id, _n, _bands."""
        self.sets, self.bands, self.percent = sets, bands, percent
        self.parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def stars(self, buckets: DataFrame) -> DataFrame:
        """buckets: _id, _first. Links of each representative with the smallest of its buckets' firsts: a, b."""
        salts, percent = max(STAR_PARTS, self.parts), self.percent
        pairs = buckets.groupBy("_id").agg(F.min("_first").alias("_lead")).filter("_id <> _lead")
        pairs = pairs.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
        leaves = pairs.join(self.sets, "_id").select("_lead", "_salt", F.lit(1).alias("_leaf"), "_id", "_s")
        leads = pairs.select("_lead", "_salt").distinct().join(self.sets.withColumnRenamed("_id", "_lead"), "_lead").select("_lead", "_salt", F.lit(0).alias("_leaf"), F.col("_lead").alias("_id"), "_s")
        met = leaves.unionByName(leads).repartition(self.parts, "_lead", "_salt").sortWithinPartitions("_lead", "_salt", "_leaf")
        return stage(met.mapInArrow(lambda batches: _stars(batches, percent), "a long, b long"), "minhash-stars")

    def rest(self, buckets: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """buckets: _key, _id, _n. Rows of buckets whose members have different labels, buckets with equal members once: _key, _id, _n, _label, and _key, _sum of these."""
        labelled = buckets.join(roots.select(F.col("node").alias("_id"), "root"), "_id", "left").select("_key", "_id", "_n", F.coalesce("root", "_id").alias("_label"))
        labelled = stage(labelled, "minhash-labelled")
        mark: Column = F.xxhash64("_id")
        mixed = labelled.groupBy("_key").agg(
            F.min("_label").alias("_low"), F.max("_label").alias("_high"), F.count("*").alias("_members"), F.sum("_n").alias("_sum"), F.bit_xor(mark).alias("_x"), F.sum(mark.cast("decimal(38,0)")).alias("_y")
        ).filter("_low <> _high")
        once = stage(mixed.groupBy("_members", "_sum", "_x", "_y").agg(F.min("_key").alias("_key")).select("_key", "_sum"), "minhash-mixed")
        return labelled.join(once, "_key").select("_key", "_id", "_n", "_label"), once

    def bucket_links(self, rows: DataFrame, sizes: DataFrame) -> DataFrame:
        """Links within buckets that join labels: a, b."""
        percent = self.percent
        tiled = rows.join(sizes, "_key").withColumn("_tiles", F.ceil(F.col("_sum") / TILE_SHINGLES).cast("int"))
        tiled = tiled.withColumn("_tile", F.pmod(F.xxhash64("_id"), F.col("_tiles").cast("long")).cast("int")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        met = tiled.join(self.sets, "_id").select("_key", F.least("_tile", "_k").alias("_i"), F.greatest("_tile", "_k").alias("_j"), "_tile", "_id", "_label", "_s")
        met = met.repartition(self.parts, "_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j", "_id")
        return stage(met.mapInArrow(lambda batches: _bucket_links(batches, percent), "a long, b long"), "minhash-links")

    def deeper(self, rows: DataFrame) -> DataFrame:
        """rows: _key, _id, _n. Buckets of two bands each: that of _key and another."""
        both = rows.select("_key", "_id", "_n").join(self.bands.select("_id", F.explode("_bands").alias("_other")), "_id").filter("_other <> _key")
        return shared_buckets(both.select(F.xxhash64(F.least("_key", "_other"), F.greatest("_key", "_other")).alias("_key"), "_id", "_n").distinct())

    def links(self, buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """buckets: see shared_buckets. Confirmed links that give the components of all (a, b), and these (node, root)."""
        found = self.stars(buckets)
        roots = components(found)
        for last in (False, True):
            rows, sizes = self.rest(buckets, roots)
            if sizes.isEmpty():
                break
            small, large = sizes.filter(F.col("_sum") <= TILE_SHINGLES), sizes.filter(F.col("_sum") > TILE_SHINGLES)
            done = last or large.isEmpty()
            more = self.bucket_links(rows, sizes) if done else self.bucket_links(rows.join(small.select("_key"), "_key", "left_semi"), small)
            if not done:
                buckets = self.deeper(rows.join(large.select("_key"), "_key", "left_semi"))
                more = more.unionByName(self.stars(buckets))
            if not more.isEmpty():
                found = found.unionByName(more)
                roots = components(found)
            if done:
                break
        return found, roots


def shared_buckets(keys: DataFrame) -> DataFrame:
    """keys: _key, _id, _n. Adds _first, the smallest id of the bucket; only rows of buckets with two ids."""
    least = keys.groupBy("_key").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).filter("_first <> _last").drop("_last")
    # Keys, ids and sizes alone; a hot bucket's partition is split at run time, since it is the join's larger side.
    return stage(keys.join(least, "_key").select("_key", "_id", "_n", "_first"), "minhash-buckets")


@settled
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each of docs: id_col, n_shingles, component_id, kept, n_links (of the forest, for its class).

    percent: similarity in hundredths at and above which two documents are linked, LEAST_PERCENT or more."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"documents are linked from {LEAST_PERCENT} percent on")
    bounded_batches(docs.sparkSession)
    signed = stage(sign(docs, id_col, text_col, bands_for(percent)), "minhash")
    classes = signed.filter("_n > 0 and _id is not null").groupBy("_set").agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies"))
    classes = stage(classes, "minhash-classes")
    reps = signed.select("_id", "_n", "_set", "_bands").join(classes.select("_set", F.col("_rep").alias("_id")), ["_set", "_id"]).dropDuplicates(["_id", "_set"]).select("_id", "_n", "_bands")
    buckets = shared_buckets(reps.select(F.explode("_bands").alias("_key"), "_id", "_n"))

    members = buckets.select("_id").distinct()
    texts = with_filter(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t")), members, ["_id"]).filter("_maybe").select("_id", "_t")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([s.tobytes() for s in shingle_sets(batch.column("_t"))], pa.binary())], ["_id", "_s"])

    sets = stage(texts.join(members, "_id").select("_id", "_t").mapInArrow(to_sets, "_id long, _s binary"), "minhash-sets")
    links, roots = NearPairs(sets, reps, percent).links(buckets)
    links = links.distinct()

    degree = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("_links"))
    placed = classes.join(roots.withColumnRenamed("node", "_rep"), "_rep", "left").join(degree.withColumnRenamed("node", "_rep"), "_rep", "left")
    placed = placed.select("_set", "_copies", F.coalesce("root", "_rep").alias("_root"), F.coalesce("_links", F.lit(0)).alias("_links"))
    out = join_hot(signed.select("_id", "_n", "_set"), placed, "_set", "_copies", signed.count(), "_id", "left")
    component = F.coalesce("_root", "_id")
    return out.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links")
    )
