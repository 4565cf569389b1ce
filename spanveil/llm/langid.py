"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language on the executors; the log-probability matrix (BUCKETS x languages,
at most LANGUAGES of them, so 32 MB) is broadcast, and batches are scored in numpy: the n-grams of all
documents of a chunk gather their rows of the matrix at once, and the rows are summed by document.

Training reads about TRAIN_ROWS labelled rows at most, chosen by a hash of id and text, and learns the
LANGUAGES most frequent languages among them (of equally frequent ones, the first by code point). Every
row is scored over its whole text, in pieces, so a long text costs no more memory than a short one.

Cases: null text and text without letters is `und` with score 0; with nothing to learn from, every
row is `und`. Equal scores go to the first language by code point. Repeated rows are scored alike.
An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import bounded_batches
from spanveil.llm.textnum import U64, chunks, code_points, fold_letters, mix64, text_bytes

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Bound of the training sample.
TRAIN_ROWS = 20_000
SMOOTHING = 0.5
#: Most languages that are learnt.
LANGUAGES = 256
#: Hashes below a share of SPACE choose the sample: fine enough for any number of rows.
SPACE = 1 << 62
UNDETERMINED = "und"
#: Code points scored at a time.
PIECE = 1 << 18


def ngram_buckets(points: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point (the last n - 1 have none)."""
    if len(points) < n:
        return np.zeros(0, np.int64)
    h = np.full(len(points) - n + 1, n, U64)
    for k in range(n):
        h = h * U64(0x100000001B3) + points[k : len(points) - n + 1 + k].astype(U64)
    return (mix64(h) & U64(BUCKETS - 1)).astype(np.int64)


def _folded(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunk by chunk: its first row, the folded code points of its documents, where each begins (and the last ends), and which have letters."""
    raw, offsets = text_bytes(column)
    for a, b in chunks(offsets):
        at = offsets[a : b + 1] - offsets[a]
        points, first = code_points(raw[offsets[a] : offsets[b]], at)
        folded, letters = fold_letters(points)
        seen = np.concatenate([[0], np.cumsum(letters)])
        yield a, folded, first, seen[first[1:]] > seen[first[:-1]]


def _grams(points: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of all orders that lie within one document, and the documents, a piece at a time."""
    for n in ORDERS:
        for at in range(0, len(points), PIECE):
            buckets = ngram_buckets(points[at : at + PIECE + n - 1], n)
            start = np.arange(at, at + len(buckets))
            doc = np.searchsorted(first, start, side="right") - 1
            whole = start + n <= first[doc + 1]
            yield buckets[whole], doc[whole]


class LanguageModel:
    def __init__(self, languages: list[str], prior: np.ndarray, table: np.ndarray) -> None:
        """table: log-probabilities, a row a language."""
        self.languages, self.prior, self.table = languages, prior, np.ascontiguousarray(table.T)

    def scores(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log of prior times likelihood: a row a document, a column a language."""
        total = np.tile(self.prior, (len(first) - 1, 1))
        for buckets, doc in _grams(points, first):
            if len(doc):
                heads = np.flatnonzero(np.concatenate([[True], np.diff(doc) != 0]))
                total[doc[heads]] += np.add.reduceat(self.table[buckets], heads, axis=0)
        return total

    def predict(self, points: np.ndarray, first: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(letters), np.zeros(len(letters))
        s = self.scores(points, first)
        best = s.argmax(axis=1)
        share = 1.0 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, share, 0.0)


def threshold(rows: int, n: int) -> int:
    """Hashes below this, of SPACE, choose about rows of n."""
    return SPACE if n <= rows else SPACE * rows // n


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fits the model on about `rows` rows of labelled at most."""
    bounded_batches(labelled.sparkSession)
    usable = labelled.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l")).filter("_t is not null and _l is not null")
    n = usable.select("_l").count()
    usable = usable.filter(F.pmod(F.xxhash64("_id", "_t"), F.lit(SPACE)) < F.lit(threshold(rows, n)))
    often = usable.groupBy("_l").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_l").limit(LANGUAGES)
    languages = sorted(r["_l"] for r in often.collect())
    usable = usable.filter(F.col("_l").isin(languages)) if languages else usable.limit(0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("_l").to_pylist()
            for row, points, first, letters in _folded(batch.column("_t")):
                own = langs[row : row + len(letters)]
                for lang in own:
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    docs[lang] = docs.get(lang, 0) + 1
                names = list(dict.fromkeys(own))
                which = np.array([names.index(lang) for lang in own])
                for buckets, doc in _grams(points, first):
                    both = np.bincount(which[doc] * BUCKETS + buckets, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                    for lang, have in zip(names, both, strict=True):
                        sums[lang] += have
        for lang, have in sums.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * (len(at) + 1), pa.string()), "bucket": np.append(at, -1).astype(np.int32), "n": np.append(have[at], docs[lang]).astype(np.int64)})

    counted = usable.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    prior = np.zeros(len(languages))
    row = counted["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
    bucket, number = counted["bucket"].to_numpy(), counted["n"].to_numpy()
    grams = bucket >= 0
    table[row[grams], bucket[grams]] += number[grams]
    prior[row[~grams]] = number[~grams]
    with np.errstate(divide="ignore"):
        return LanguageModel(languages, np.log(prior / max(1.0, prior.sum())), np.log(table / table.sum(axis=1, keepdims=True)))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: id_col, lang_pred, score."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(points, first, letters) for _, points, first, letters in _folded(batch.column("_t"))]
            langs = [x for own, _ in found for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *(x for _, x in found)]), pa.float64())], ["_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(score, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)
