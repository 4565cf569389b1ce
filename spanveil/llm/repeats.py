"""Repeated passages across documents by suffix arrays.

A byte is removed if a `length`-byte string that covers it also starts in a document with a smaller id.

One suffix array over a corpus has no place on a cluster, so strings are first brought together: in
every window of `length` bytes the smallest hash of its GRAM-byte pieces (the leftmost of equals) is
its anchor. Equal windows have equal anchors at equal places, so all windows of a content meet under
one anchor hash, and consecutive windows mostly share an anchor.

1. Texts are packed in chunks of about a megabyte (compressed, in the shared folder).
2. Every chunk sends its distinct anchor hashes, shortened, to hash buckets; a bucket answers which
   occur in two chunks. Shortening can only send too much on.
3. Every chunk sends, for anchors that occur in two documents, the bytes of the windows under the
   anchor. A context that a chunk holds in several documents is sent once, for the smallest id; in the
   others it is removed for certain.
4. A bucket groups equal contexts. Where an anchor has different contexts, it builds their suffix
   array by two-stage sorting and takes adjacent suffixes with a common prefix of `length` as one
   string; the smallest id that has it decides. It answers a bit for each window.
5. Chunks gather the answers and cut their documents.

Every row between the stages is a packed block, bounded by the chunk; a bucket holds about BUCKET_BYTES
of text's anchors, and the number of buckets grows with the input. A chunk sends a row to each bucket that
its anchors fall in, so rows are fewer than anchors at every size. An anchor that HOT_CHUNKS chunks have
(a run of spaces) would bring its contexts from everywhere to one bucket: its windows go to buckets of
their own instead, each as a context. Hashes only bring contexts together; that two are equal is decided
on their bytes.

Cases: null text is empty; documents shorter than `length` stay whole; matches never cross documents;
rows that repeat an id don't remove from each other; a null id counts as the largest; an empty table gives
no rows. Ids are integers. Only the named columns are read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import bounded_batches, stage
from spanveil.llm.suffix import equal_windows, suffix_array
from spanveil.llm.textnum import _BASE, _BYTE, _INVERSE, U64, chunks, mix64, powers, text_bytes

LENGTH = 50
GRAM = 24
BUCKET_BYTES = 24 << 20
#: Shuffle partitions at most; beyond, a partition holds several buckets, one after the other.
MOST_PARTS = 100_000
#: Chunks that have an anchor from which on its windows are sent one by one.
HOT_CHUNKS = 4096
#: Bits of an anchor hash that are sent besides the bucket. A bucket holds about 2 M of them, so one in
#: two thousand is taken for another, at every size of the input.
SENT_BITS = 32
SEGMENT = 1 << 19
#: Bytes of contexts that one suffix array is made of (more where a single anchor has more).
SORT_BYTES = 1 << 20
NULL_ID = 2**63 - 1


def _deflate(*arrays: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


class Chunk:
    """Documents' bytes, ids (and which are null) and offsets."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> None:
        self.ids, self.raw, self.offsets, self.null = ids, raw, offsets, null

    def pack(self) -> bytes:
        return _deflate(np.array([len(self.ids)], np.int64), self.ids, self.offsets, self.null.astype(np.uint8), self.raw, level=3)

    @staticmethod
    def unpack(data: bytes) -> Chunk:
        flat = zstandard.ZstdDecompressor().decompress(data)
        n = int(np.frombuffer(flat, np.int64, 1)[0])
        head = np.frombuffer(flat, np.int64, 2 * n + 1, 8)
        at = 8 * (2 * n + 2)
        return Chunk(head[:n], np.frombuffer(flat, np.uint8, -1, at + n), head[n:], np.frombuffer(flat, np.uint8, n, at).astype(bool))


def lanes_of(raw: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1), writeable=False)


_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def equal_bytes(lanes: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the bytes from a on are those from b on, pair by pair."""
    same = size_a == size_b
    live, k = np.flatnonzero(same), 0
    while len(live):
        mask = _FIRST[np.minimum(size_a[live] - k, 8)]
        x, y = (np.ascontiguousarray(lanes[at[live] + k]).view("<u8").ravel() & mask for at in (a, b))
        same[live[x != y]] = False
        k += 8
        live = live[(x == y) & (size_a[live] > k)]
    return same


class Anchors:
    """The anchors of a chunk's windows, in order of place: hash, first window, number of windows, document."""

    def __init__(self, chunk: Chunk, length: int = LENGTH) -> None:
        raw, offsets = chunk.raw, chunk.offsets
        gram = min(GRAM, length)
        self.length, self.chunk = length, chunk
        total = np.zeros(len(raw) + 1, U64)
        np.cumsum(_BYTE[raw] * powers(_BASE, max(1, len(raw)))[: len(raw)], out=total[1:])
        self.total = total
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last = len(raw) - length
        ends = np.concatenate([offsets[1:-1], [len(raw)]]) if len(offsets) > 1 else offsets
        for at in range(0, last + 1, SEGMENT):
            to = min(last + 1, at + SEGMENT)
            span = to - at + length - gram
            h = self._hash(np.arange(at, at + span), gram)
            key = (h & ~U64(0xFFFFF)) | np.arange(span, dtype=U64)
            wide, width = 1, length - gram + 1
            while wide * 2 <= width:
                key, wide = np.minimum(key[:-wide], key[wide:]), wide * 2
            if width > wide:
                key = np.minimum(key[: wide - width], key[width - wide :])
            place = (key & U64(0xFFFFF)).astype(np.int64)
            inside = np.ones(to - at, bool)
            for end in ends[(ends > at) & (ends < to + length)].tolist():
                inside[max(0, end - length + 1 - at) : max(0, end - at)] = False
            start = np.flatnonzero(inside)
            if not len(start):
                continue
            p = place[start]
            new = np.concatenate([[True], (np.diff(p) != 0) | (np.diff(start) != 1)])
            head = np.flatnonzero(new)
            found.append((h[p[head]], start[head] + at, np.diff(np.concatenate([head, [len(start)]]))))
        cat = lambda k, kind: np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind)
        self.hash, self.first, self.count = cat(0, U64), cat(1, np.int64), cat(2, np.int64)
        self.doc = np.searchsorted(offsets, self.first, side="right") - 1

    def _hash(self, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        return mix64((self.total[at + n] - self.total[at]) * powers(_INVERSE, len(self.total))[at])

    def sent(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (bucket, shortened hash) in order, as one number each; which of them each anchor has; which occur in two documents here."""
        short = (_bucket(self.hash, buckets) << U64(SENT_BITS)) | (self.hash >> U64(64 - SENT_BITS))
        distinct, which = np.unique(short, return_inverse=True)
        low, high = np.full(len(distinct), len(self.chunk.ids)), np.full(len(distinct), -1)
        np.minimum.at(low, which, self.doc)
        np.maximum.at(high, which, self.doc)
        return distinct, which, low != high

    def windows_alone(self, hot: np.ndarray) -> Anchors:
        """These anchors, those that are hot replaced by an anchor for each of their windows."""
        if not hot.any():
            return self
        out = Anchors.__new__(Anchors)
        out.length, out.chunk, out.total = self.length, self.chunk, self.total
        times = np.where(hot, self.count, 1)
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        out.first, out.doc = np.repeat(self.first, times) + step, np.repeat(self.doc, times)
        out.count = np.repeat(np.where(hot, 1, self.count), times)
        own = np.repeat(hot, times)
        out.hash = np.repeat(self.hash, times)
        out.hash[own] = mix64(out._hash(out.first[own], out.length) + U64(0x51ED270B))
        return out

    def contexts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the anchors chosen (indexes): the first of each distinct context by document id, the context's number for each, and each one's document id."""
        ids = self.chunk.ids[self.doc[chosen]]
        same = self.hash[chosen] * U64(3) + self._hash(self.first[chosen], self.count[chosen] + self.length - 1) * U64(5) + self.count[chosen].astype(U64)
        order = np.lexsort((chosen, ids, same))
        new = np.concatenate([[True], np.diff(same[order]) != 0]) if len(order) else np.zeros(0, bool)
        pair = np.flatnonzero(~new)
        if len(pair):
            x, y = chosen[order[pair - 1]], chosen[order[pair]]
            new[pair] = ~equal_bytes(lanes_of(self.chunk.raw), self.first[x], self.first[y], self.count[x] + self.length - 1, self.count[y] + self.length - 1)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        # In order of place, so that ids and overlapping bytes compress.
        kept = chosen[order[new]]
        by_place = np.argsort(kept)
        rank = np.empty(len(kept), np.int64)
        rank[by_place] = np.arange(len(kept))
        return kept[by_place], rank[which], ids


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h & U64(0xFFFFFFFF)) % U64(buckets)


def _columns(names: str, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names.split())


def _to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng = random.SystemRandom()
    for batch in batches:
        null = batch.column("_id").is_null().to_numpy(zero_copy_only=False)
        ids = batch.column("_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        raw, offsets = text_bytes(batch.column("_t"))
        for a, b in chunks(offsets):
            packed = Chunk(ids[a:b], raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], null[a:b]).pack()
            yield _columns("chunk data size", pa.array([rng.getrandbits(62)], pa.int64()), pa.array([packed], pa.binary()), pa.array([int(offsets[b] - offsets[a])], pa.int64()))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Rows bucket, chunk, data sorted by bucket: a bucket's rows at a time."""
    at, ids, blocks = None, [], []
    for batch in batches:
        for bucket, chunk, data in zip(batch.column("bucket").to_pylist(), batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if bucket != at:
                if blocks:
                    yield at, ids, blocks
                at, ids, blocks = bucket, [], []
            ids.append(chunk)
            blocks.append(data)
    if blocks:
        yield at, ids, blocks


class RepeatRemover:
    """The stages above, for one table."""

    SCHEMA = "bucket int, chunk long, data binary"

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, length: int) -> None:
        bounded_batches(docs.sparkSession)
        self.length = length
        rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
        self.chunks = stage(rows.mapInArrow(_to_chunks, "chunk long, data binary, size long"), "repeats-chunks", compression="none")
        size = self.chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        self.buckets = int(max(8, size // BUCKET_BYTES))
        self.parts = min(MOST_PARTS, max(self.buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def _exchange(self, blocks: DataFrame) -> DataFrame:
        return blocks.repartition(self.parts, "bucket").sortWithinPartitions("bucket", "chunk")

    def _with(self, answers: DataFrame, name: str, base: DataFrame) -> DataFrame:
        """base (chunk, ...) with the answers to each chunk, at most one a bucket."""
        packed = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data")).alias(name))
        return base.join(packed, "chunk", "left")

    def shared_anchors(self) -> DataFrame:
        buckets, length, hot_chunks = self.buckets, self.length, HOT_CHUNKS

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    distinct, _, _ = Anchors(Chunk.unpack(data), length).sent(buckets)
                    own = (distinct >> U64(SENT_BITS)).astype(np.int64)
                    short = distinct.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : SENT_BITS // 8]
                    cut = np.searchsorted(own, np.arange(buckets + 1))
                    use = np.flatnonzero(np.diff(cut))
                    yield _columns("bucket chunk data", pa.array(use, pa.int32()), pa.array([chunk] * len(use), pa.int64()), pa.array([short[cut[k] : cut[k + 1]].tobytes() for k in use], pa.binary()))

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, ids, blocks in _by_bucket(batches):
                short = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, SENT_BITS // 8)
                value = np.zeros((len(short), 8), np.uint8)
                value[:, : SENT_BITS // 8] = short
                value = value.view("<u8").ravel()
                order = np.argsort(value, kind="stable")
                equal = value[order[1:]] == value[order[:-1]]
                twice = np.zeros(len(value), bool)
                twice[order[1:]] |= equal
                twice[order[:-1]] |= equal
                cut = np.cumsum([0, *(len(x) // (SENT_BITS // 8) for x in blocks)])
                # A chunk sends a hash once, so its count here is the number of chunks.
                heads = np.concatenate([[0], np.flatnonzero(~equal) + 1])
                often = np.empty(len(value), bool)
                often[order] = np.repeat(np.diff(np.concatenate([heads, [len(value)]])) >= hot_chunks, np.diff(np.concatenate([heads, [len(value)]])))
                masks = [np.packbits(twice[a:b]).tobytes() + (np.packbits(often[a:b]).tobytes() if often[a:b].any() else b"") for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield _columns("bucket chunk data", pa.array([bucket] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(masks, pa.binary()))

        sent = self.chunks.select("chunk", "data").mapInArrow(send, self.SCHEMA)
        return stage(self._exchange(sent).mapInArrow(answer, self.SCHEMA), "repeats-anchors")

    @staticmethod
    def _chosen(anchors: Anchors, buckets: int, masks: list[dict] | None) -> tuple[Anchors, np.ndarray]:
        """The anchors, hot ones window by window, and the indexes of those that two documents have, here or elsewhere."""
        distinct, which, here = anchors.sent(buckets)
        cut = np.searchsorted((distinct >> U64(SENT_BITS)).astype(np.int64), np.arange(buckets + 1))
        shared, hot = here.copy(), np.zeros(len(here), bool)
        for x in masks or []:
            a, b = cut[x["bucket"]], cut[x["bucket"] + 1]
            bits, size = np.frombuffer(x["data"], np.uint8), (b - a + 7) // 8
            shared[a:b] |= np.unpackbits(bits[:size], count=b - a).astype(bool)
            if len(bits) > size:
                hot[a:b] |= np.unpackbits(bits[size:], count=b - a).astype(bool)
        times = np.where(hot[which], anchors.count, 1)
        return anchors.windows_alone(hot[which]), np.flatnonzero(np.repeat(shared[which], times))

    def repeated_windows(self, shared: DataFrame) -> DataFrame:
        buckets, length, chosen_of = self.buckets, self.length, self._chosen

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, data, masks in zip(*(batch.column(c).to_pylist() for c in ("chunk", "data", "masks")), strict=True):
                    anchors = Anchors(Chunk.unpack(data), length)
                    anchors, chosen = chosen_of(anchors, buckets, masks)
                    kept, _, _ = anchors.contexts(chosen)
                    own = _bucket(anchors.hash[kept], buckets).astype(np.int64)
                    use, blocks = [], []
                    order = np.argsort(own, kind="stable")
                    cut = np.searchsorted(own[order], np.arange(buckets + 1))
                    for k in np.flatnonzero(np.diff(cut)).tolist():
                        of = kept[order[cut[k] : cut[k + 1]]]
                        size = anchors.count[of] + length - 1
                        at = np.repeat(anchors.first[of] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                        use.append(k)
                        blocks.append(_deflate(np.array([len(of)], np.int64), (anchors.hash[of] >> U64(32)).astype(np.uint32), anchors.chunk.ids[anchors.doc[of]], anchors.count[of].astype(np.uint8), anchors.chunk.raw[at]))
                    yield _columns("bucket chunk data", pa.array(use, pa.int32()), pa.array([chunk] * len(use), pa.int64()), pa.array(blocks, pa.binary()))

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, ids, blocks in _by_bucket(batches):
                sizes, masks = judge_contexts(blocks, length)
                cut = np.cumsum([0, *sizes])
                out = [_deflate(masks[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield _columns("bucket chunk data", pa.array([bucket] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(out, pa.binary()))

        sent = self._with(shared, "masks", self.chunks.select("chunk", "data")).mapInArrow(send, self.SCHEMA)
        return stage(self._exchange(sent).mapInArrow(answer, self.SCHEMA), "repeats-windows")

    def cut(self, shared: DataFrame, repeated: DataFrame) -> DataFrame:
        buckets, length, chosen_of = self.buckets, self.length, self._chosen
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data, masks, windows in zip(*(batch.column(c).to_pylist() for c in ("data", "masks", "windows")), strict=True):
                    chunk = Chunk.unpack(data)
                    removed = removed_bytes(chunk, length, buckets, chosen_of, masks, windows)
                    spans, texts = [], []
                    for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True):
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], removed[a:b].astype(np.int8), [0]])))
                        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                        texts.append(chunk.raw[a:b][~removed[a:b]].tobytes())
                    own = pa.array(chunk.ids, pa.int64(), mask=chunk.null)
                    yield _columns("_id n_bytes spans kept", own, pa.array(np.diff(chunk.offsets), pa.int64()), pa.array(spans, span), pa.array(texts, pa.binary()))

        base = self._with(repeated, "windows", self._with(shared, "masks", self.chunks.select("chunk", "data")))
        return base.select("data", "masks", "windows").mapInArrow(run, "_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def judge_contexts(blocks: list[bytes], length: int) -> tuple[list[int], np.ndarray]:
    """The number of contexts in each block, and for each context a bit for each of its windows: set if a smaller id has it.

    Anchors come as 32 bits of their hashes; two that agree are sorted together, which changes nothing. Hashes are made block by block and suffix arrays for SORT_BYTES of contexts at a time, so that besides
    the contexts' own bytes a bucket needs little memory."""
    hashes, ids, counts, raws, contents, sizes = [], [], [], [], [], []
    for block in blocks:
        flat = zstandard.ZstdDecompressor().decompress(block)
        n = int(np.frombuffer(flat, np.int64, 1)[0])
        hashes.append(np.frombuffer(flat, np.uint32, n, 8))
        ids.append(np.frombuffer(flat, np.int64, n, 8 + 4 * n))
        counts.append(np.frombuffer(flat, np.uint8, n, 8 + 12 * n))
        raws.append(np.frombuffer(flat, np.uint8, -1, 8 + 13 * n))
        contents.append(_content(raws[-1], counts[-1], length))
        sizes.append(n)
    h, doc, count, raw, content = (np.concatenate(x) for x in (hashes, ids, counts, [*raws, np.zeros(8, np.uint8)], contents))
    del hashes, ids, counts, raws, contents
    size = count.astype(np.int64) + length - 1
    start = np.cumsum(size) - size
    order = np.lexsort((doc, content, h))
    new_anchor = np.concatenate([[True], np.diff(h[order]) != 0])
    new = new_anchor | np.concatenate([[True], np.diff(content[order]) != 0])
    # Of equal hashes, bytes decide; contexts that differ after all go through the suffix array.
    lanes = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1), writeable=False)
    pair = np.flatnonzero(~new)
    for a in range(0, len(pair), SORT_BYTES):
        x, y = order[pair[a : a + SORT_BYTES] - 1], order[pair[a : a + SORT_BYTES]]
        new[pair[a : a + SORT_BYTES]] = ~equal_bytes(lanes, start[x], start[y], size[x], size[y])
    context = np.cumsum(new) - 1
    head = order[new]
    anchor = (np.cumsum(new_anchor) - 1)[new]
    best = doc[head]
    # Smallest id of each window, its own context's at first.
    windows = np.repeat(best, count[head])
    at = np.concatenate([[0], np.cumsum(count[head].astype(np.int64))])
    mixed = np.flatnonzero(np.bincount(anchor)[anchor] > 1)
    part = _parts(anchor[mixed], size[head[mixed]] + 1)
    for a, b in zip(part[:-1], part[1:], strict=True):
        _least_ids(windows, at, mixed[a:b], head, best, raw, start, size, length)
    masks = np.zeros(len(h), np.uint32)
    back = np.empty(len(h), np.int64)
    back[order] = context
    for k in range(int(count.max()) if len(count) else 0):
        has = count > k
        smaller = windows[at[back[has]] + k] < doc[has]
        masks[has] |= smaller.astype(np.uint32) << np.uint32(k)
    return sizes, masks


def _content(raw: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """A hash of each context's bytes, at most SORT_BYTES of them at a time."""
    size = count.astype(np.int64) + length - 1
    end = np.cumsum(size)
    out = np.empty(len(size), U64)
    row = 0
    while row < len(size):
        first = int(end[row] - size[row])
        to = max(row + 1, int(np.searchsorted(end, first + SORT_BYTES, side="right")))
        piece, e = raw[first : end[to - 1]], end[row:to] - first
        total = np.zeros(len(piece) + 1, U64)
        np.cumsum(_BYTE[piece] * powers(_BASE, len(piece)), out=total[1:])
        b = e - size[row:to]
        out[row:to] = mix64((total[e] - total[b]) * powers(_INVERSE, len(piece) + 1)[b]) + count[row:to].astype(U64)
        row = to
    return out


def _parts(anchor: np.ndarray, size: np.ndarray) -> list[int]:
    """Bounds of runs of whole anchors of about SORT_BYTES each."""
    if not len(anchor):
        return [0]
    heads = np.flatnonzero(np.concatenate([[True], np.diff(anchor) != 0]))
    before = (np.cumsum(size) - size)[heads] // SORT_BYTES
    return [*heads[np.concatenate([[True], np.diff(before) != 0])].tolist(), len(anchor)]


def _least_ids(windows: np.ndarray, at: np.ndarray, mixed: np.ndarray, head: np.ndarray, best: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> None:
    """Lowers windows to the smallest id among equal windows of the contexts mixed, by their suffix array."""
    span = size[head[mixed]]
    place = np.cumsum(span + 1) - (span + 1)
    text = np.zeros(int((span + 1).sum()), np.uint16)
    inner = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
    text[np.repeat(place, span) + inner] = raw[np.repeat(start[head[mixed]], span) + inner].astype(np.uint16) + 1
    owner = np.repeat(np.arange(len(mixed)), span + 1)
    reach = np.repeat(place + span, span + 1) - np.arange(len(text))
    found, group = equal_windows(text, suffix_array(text, reach), reach, length)
    of = owner[found]
    least = np.full(int(group.max()) + 1, NULL_ID)
    np.minimum.at(least, group, best[mixed[of]])
    slot = at[mixed[of]] + found - place[of]
    windows[slot] = np.minimum(windows[slot], least[group])


def removed_bytes(chunk: Chunk, length: int, buckets: int, chosen_of: object, masks: list[dict] | None, windows: list[dict] | None) -> np.ndarray:
    """Whether each byte of the chunk is removed."""
    anchors = Anchors(chunk, length)
    anchors, chosen = chosen_of(anchors, buckets, masks)
    edge = np.zeros(len(chunk.raw) + 1, np.int64)
    if len(chosen):
        kept, which, ids = anchors.contexts(chosen)
        own = _bucket(anchors.hash[kept], buckets).astype(np.int64)
        order = np.argsort(own, kind="stable")
        cut = np.searchsorted(own[order], np.arange(buckets + 1))
        bits = np.zeros(len(kept), np.uint32)
        for x in windows or []:
            bits[order[cut[x["bucket"]] : cut[x["bucket"] + 1]]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(x["data"]), np.uint32)
        every = np.where(ids > chunk.ids[anchors.doc[kept]][which], np.uint32(0xFFFFFFFF), bits[which])
        for k in range(int(anchors.count[chosen].max())):
            has = (anchors.count[chosen] > k) & ((every >> np.uint32(k)) & np.uint32(1)).astype(bool)
            at = anchors.first[chosen[has]] + k
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each of docs: id_col, n_bytes, spans (removed runs in bytes), kept (the bytes left)."""
    if length - min(GRAM, length) + 1 > 32:
        raise ValueError("a context holds at most 32 windows")
    remover = RepeatRemover(docs, id_col, text_col, length)
    shared = remover.shared_anchors()
    return remover.cut(shared, remover.repeated_windows(shared)).withColumnRenamed("_id", id_col)
