"""Personal data: patterns with checks, and a linear-chain CRF over word shapes.

Base spans come from four patterns (email, ip, card, phone), leftmost and non-overlapping per kind;
a match that fails its check (parts over 255, digit count, Luhn) is dropped and not tried shorter.

The CRF labels the words of every line as one of LABELS. Its features are hashes of a word's shape,
its digit count and, for short words, its spelling, for the word and its neighbours. It is trained on a
small labelled table made by rule (labelled_lines), by gradient ascent on the exact likelihood, and
decodes with Viterbi in numpy batches. A word whose score for O beats every other label by more than
all that transitions could give back is O in the best path whatever its neighbours are, so lines are
split there and only the stretches between go through the recursion: the same path as over the whole
line. Labelled stretches that touch no base span are added; base spans always stay.

Cases: null text is empty and has no spans; texts are processed whole, in bounded chunks of lines;
overlapping spans of different kinds all count; repeated rows are processed alike; an empty table
gives no rows. Offsets are code points, end exclusive. Only the named columns are read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import bounded_batches
from spanveil.llm.textnum import U64, chunks, code_points, mix64, text_bytes

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
#: The patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: IP's matches, found in time proportional to the text: one starts only where a run of digits does, and no digit is given back.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGIT, _LOCAL = re.compile("[0-9]"), re.compile(r"[A-Za-z0-9._%+-]+$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As EMAIL.finditer, but starting from each @ instead of every character."""
    done, at = 0, text.find("@")
    while at >= 0:
        if (local := _LOCAL.search(text, max(done, _local_start(text, at, done)), at)) and (m := EMAIL.match(text, local.start())):
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _local_start(text: str, at: int, floor: int) -> int:
    while at > floor and text[at - 1] in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-":
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start."""
    out = [("email", *span) for span in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# ---- words, shapes and features ------------------------------------------------------------------
VOCABULARY = 1 << 13
#: Character classes of a shape: 0 space, 1 lower, 2 upper, 3 digit, 4 other letter, then each of PUNCTUATION, then any other.
PUNCTUATION = "@.-()+:/_[],;#*"
OFFSETS = (-2, -1, 0, 1, 2)
PER_WORD = 4


def _class_table() -> np.ndarray:
    table = np.full(256, 5 + len(PUNCTUATION), np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = 0
    table[97:123], table[65:91], table[48:58] = 1, 2, 3
    for k, c in enumerate(PUNCTUATION):
        table[ord(c)] = 5 + k
    table[192:256] = 4
    return table


CLASS = _class_table()
TRIM = ".,;:!?"
_TRIMMED = np.array([ord(c) for c in TRIM], np.uint32)
DIGIT_BUCKET = np.array([0, 1, 2, 3, 4, 5, 5, 6, 6, 7, 8, 8, 9, *[10] * 7, 11])


class Words:
    """Words (runs of non-space) of code points: where they stand, their line, their features."""

    def __init__(self, points: np.ndarray, first: np.ndarray) -> None:
        kind = np.where(points < 256, CLASS[np.minimum(points, 255)], np.uint8(4))
        n = len(points)
        cut = np.zeros(n + 1, bool)
        cut[first] = True
        start, end = kind != 0, kind != 0
        start[1:] &= (kind[:-1] == 0) | cut[1:-1]
        end[:-1] &= (kind[1:] == 0) | cut[1:-1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        cut[1:-1] |= points[:-1] == 10
        self.line = np.cumsum(cut)[self.start]
        self.count = len(self.start)
        if not self.count:
            self.features = np.zeros((0, PER_WORD), np.int64)
            return
        # Features are of the word without the punctuation that ends it.
        end, used = self.end.copy(), kind != 0
        for _ in range(2):
            last = end - 1
            cut_off = np.isin(points[last], _TRIMMED) & (last > self.start)
            used[last[cut_off]] = False
            end -= cut_off
        digit = np.concatenate([[0], np.cumsum(kind == 3)])
        digits = np.minimum(digit[end] - digit[self.start], 20)
        # A collapsed shape: each class once per run, by its order among the word's runs.
        run = np.ones(n, bool)
        run[1:] = (kind[1:] != kind[:-1]) | cut[1:-1]
        order = np.cumsum(run)
        before = order[self.start]
        owner = np.repeat(np.arange(self.count), end - self.start)
        inside = np.flatnonzero(used)
        rank = np.minimum(order[inside] - before[owner], 40)
        shape = np.where(run[inside], mix64(kind[inside].astype(U64) * U64(64) + rank.astype(U64)), U64(0))
        bounds = np.concatenate([[0], np.cumsum(end - self.start)])[:-1]
        shape = np.add.reduceat(shape, bounds)
        lower = np.where((points >= 65) & (points < 91), points + 32, points)[inside]
        place = np.arange(len(inside)) - bounds[owner]
        spelled = np.add.reduceat(mix64(lower.astype(U64) * U64(1 << 20) + np.minimum(place, 1 << 19).astype(U64)), bounds)
        length = np.minimum(end - self.start, 32)
        spelled = np.where((length <= 8) & (digits == 0), spelled, U64(0))
        size = length.astype(U64)
        wide = digits.astype(U64)
        # What a word is made of, whatever the order: how many of each mark, and whether it is all hexadecimal.
        made = np.zeros(self.count, U64)
        for place, mark in enumerate(".:@-/"):
            seen = np.concatenate([[0], np.cumsum(points == ord(mark))])
            made = made * U64(9) + np.minimum(seen[end] - seen[self.start], 8).astype(U64) + U64(place == 0)
        low = points | 32
        seen = np.concatenate([[0], np.cumsum((kind == 3) | ((low >= 97) & (low < 103)) | (points == 58))])
        hexed = (seen[end] - seen[self.start]) == end - self.start
        made = (made * U64(2) + hexed.astype(U64)) * U64(64) + DIGIT_BUCKET[digits].astype(U64)
        self.features = np.stack([mix64(shape + U64(1)), mix64(shape * U64(31) + wide * U64(64) + np.where(digits > 0, size, U64(0)) + U64(2)), mix64(spelled + DIGIT_BUCKET[digits].astype(U64) * U64(3)), mix64(made * U64(0x9E3779B97F4A7C15) + U64(7))], axis=1)
        self.features = (self.features & U64(VOCABULARY - 1)).astype(np.int64)


class Crf:
    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        """weights: (offset, feature of a word, VOCABULARY, label); moves: (from, to)."""
        self.weights, self.moves = weights, moves

    def small(self) -> Crf:
        """In single precision, for decoding: its tables fit a core's cache."""
        return Crf(self.weights.astype(np.float32), self.moves.astype(np.float32))

    def emissions(self, words: Words) -> np.ndarray:
        out = np.zeros((words.count, len(LABELS)), self.weights.dtype)
        for o, shift in enumerate(OFFSETS):
            part = sum(self.weights[o, k][words.features[:, k]] for k in range(PER_WORD))
            if shift == 0:
                out += part
            elif words.count > abs(shift):
                k = abs(shift)
                a, b = (slice(k, None), slice(None, -k)) if shift < 0 else (slice(None, -k), slice(k, None))
                same = words.line[k:] == words.line[:-k]
                out[a] += np.where(same[:, None], part[b], part.dtype.type(0))
        return out

    def decode(self, words: Words, margin: float = 0.0) -> np.ndarray:
        """The best label of each word; margin is added to O."""
        if not words.count:
            return np.zeros(0, np.int64)
        score = self.emissions(words)
        score[:, 0] += margin
        give = 2 * (self.moves.max() - self.moves.min())
        sure = score[:, 0] - score[:, 1:].max(axis=1) > give
        labels = np.zeros(words.count, np.int64)
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return labels
        # Stretches of words that aren't sure, with the sure words at either side as fixed O.
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(open_) > 1) | (words.line[open_[1:]] != words.line[open_[:-1]])]))
        lengths = np.diff(np.concatenate([heads, [len(open_)]]))
        starts = open_[heads]
        for group in np.array_split(np.argsort(lengths, kind="stable"), max(1, len(heads) // 4096)):
            s, n = starts[group], lengths[group]
            left = (s > 0) & (words.line[np.maximum(s - 1, 0)] == words.line[s])
            last = s + n - 1
            right = (last + 1 < words.count) & (words.line[np.minimum(last + 1, words.count - 1)] == words.line[last])
            best = score[s] + np.where(left[:, None], self.moves[0], 0.0)
            back = np.zeros((int(n.max()), len(s), len(LABELS)), np.int8)
            for t in range(1, int(n.max())):
                alive = n > t
                through = best[alive][:, :, None] + self.moves[None]
                back[t, alive] = through.argmax(axis=1)
                best[alive] = through.max(axis=1) + score[s[alive] + t]
            best += np.where(right[:, None], self.moves[:, 0], 0.0)
            now = best.argmax(axis=1)
            for t in range(int(n.max()) - 1, -1, -1):
                alive = n > t
                labels[s[alive] + t] = now[alive]
                if t:
                    now[alive] = back[t, alive, now[alive]]
        return labels


# ---- the labelled table ----------------------------------------------------------------------------
#: Words of the labelled lines.
PLAIN = "the and of in to is was for on that with as at by from it are this be or an we you they can will would there le la les des une que pour dans est avec der die das und ist nicht mit für el los las una por con para como".split()
NAMES = "maria john li.wei anna_b k.schmidt j.doe pablo chloe t.okafor support info sales".split()
HOSTS = "example mail corp post web net-mail uni studio".split()
ENDS = "com org net de fr es io".split()
#: What stands before personal data in the labelled lines, and as often before none.
LEADS = "mail email contact call phone tel mobile fax ip host server address card visa pay write reach at: to: from: via".split()
AT, DOT = ["[at]", "(at)", "at", "AT", "<at>", "{at}"], ["[dot]", "(dot)", "dot", "DOT", "<dot>", "{dot}"]


def labelled_lines(n: int = 3000, seed: int = 5, forms: tuple[int, ...] = (0, 1, 2, 3, 4, 5)) -> list[list[tuple[str, str]]]:
    """The labelled table: lines of (word, label), personal data in forms that the patterns know and others that they don't, among lines without any.

    forms: which of each kind's six forms are used."""
    draw = random.Random(seed).random
    number = lambda low, high: low + int(draw() * (high - low))
    pick = lambda xs: xs[int(draw() * len(xs))]
    digits = lambda k: "".join(pick("0123456789") for _ in range(k))
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    tail = lambda: pick(["", "", "", ".", ",", ";"])

    def letters(most: int = 13) -> str:
        return "".join(pick("abcdefghijklmnopqrstuvwxyzéèêçüñß") for _ in range(number(1, most + 1)))

    def plain_name() -> str:
        return pick([pick(NAMES), "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(number(3, 10)))])

    def said() -> list[tuple[str, str]]:
        kind, form = pick(KINDS), pick(forms)
        if kind == "email":
            name, host, end, at, dot = plain_name(), pick([pick(HOSTS), plain_name()]), pick(ENDS), pick(AT), pick(DOT)
            spoken = [name, at, host, dot, end]
            words = [[f"{name}@{host}.{end}"], spoken, [f"{name}[at]{host}[dot]{end}"], [f"{name}(at){host}.{end}"], [f"{name}(at){host}(dot){end}"], [name, "@", f"{host}.{end}"]][form]
        elif kind == "ip":
            parts = [str(number(1, 256)) for _ in range(4)]
            six = [hexes(4) for _ in range(8)]
            words = [[".".join(parts)], [".".join(parts) + ":" + digits(4)], ["[.]".join(parts)], [".".join(parts) + "/" + pick(["8", "16", "24", "32"])], [":".join(six)], [":".join(six[:3]) + "::" + six[3]]][form]
        elif kind == "card":
            parts = [pick("3456") + digits(3), digits(4), digits(4), digits(4)]
            amex = ["3" + pick("47") + digits(2), digits(6), digits(5)]
            words = [parts, ["-".join(parts)], [".".join(parts)], ["/".join(parts)], amex, ["".join(parts)]][form]
        else:
            a, b, c = digits(3), digits(3), digits(4)
            words = [[f"+{digits(2)}", a, b, c], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], ["0" + digits(2), digits(4), digits(4)], [f"({a})", b, c]][form]
        words = [*words[:-1], words[-1] + tail()]
        lead = [(pick(LEADS) + pick(["", "", ":"]), "O")] if draw() < 0.5 else []
        return [*lead, *((w, kind) for w in words)]

    def plain() -> list[tuple[str, str]]:
        form = number(0, 18)
        word = letters()
        if form < 9:
            word = pick([pick(PLAIN), word, word.capitalize(), word, word.upper()]) + tail()
        elif form < 11:
            word = pick([pick(LEADS), "dot", "at", pick(ENDS), "de", "es", pick(PLAIN), f"({letters(5)})"])
        else:
            word = [
                digits(number(1, 5)), f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}",
                pick([word, word.capitalize(), word.upper()]) + pick(["%%%", "***", "###", "&&&", "$$$", "!!!"]), pick([f"#{digits(number(1, 7))}", f"{digits(2)}:{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(number(5, 9))}"]),
            ][form - 11]
        return [(word, "O")]

    lines = []
    for k in range(n):
        line: list[tuple[str, str]] = []
        for _ in range(number(3, 14)):
            line += plain()
        if k % 2 == 0:
            at = number(0, len(line) + 1)
            line[at:at] = said()
        lines.append(line)
    return lines


def train(lines: list[list[tuple[str, str]]], rounds: int = 45, rate: float = 0.5, decay: float = 0.3) -> Crf:
    """Adagrad ascent on the regularised log-likelihood, by forward-backward over all lines at once."""
    text = "\n".join(" ".join(w for w, _ in line) for line in lines)
    words = Words(np.array([ord(c) for c in text], np.uint32), np.array([0, len(text)]))
    gold = np.array([LABELS.index(y) for line in lines for _, y in line])
    n, most, count = np.array([len(x) for x in lines]), max(map(len, lines)), len(LABELS)
    at = np.concatenate([[0], np.cumsum(n)])[:-1]
    step = np.minimum(np.arange(most)[None], n[:, None] - 1) + at[:, None]
    real = np.arange(most)[None] < n[:, None]
    model = Crf(np.zeros((len(OFFSETS), PER_WORD, VOCABULARY, count)), np.zeros((count, count)))
    seen_w, seen_m = np.ones_like(model.weights), np.ones_like(model.moves)
    hot = np.eye(count)[gold]
    same = words.line[1:] == words.line[:-1]
    gold_moves = np.zeros((count, count))
    np.add.at(gold_moves, (gold[:-1][same], gold[1:][same]), 1)
    for _ in range(rounds):
        score = model.emissions(words)[step]
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, most):
            ahead = np.logaddexp.reduce(forward[:, t - 1, :, None] + model.moves[None], axis=1) + score[:, t]
            forward[:, t] = np.where(real[:, t, None], ahead, forward[:, t - 1])
        for t in range(most - 2, -1, -1):
            behind = np.logaddexp.reduce(model.moves[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(real[:, t + 1, None], behind, 0.0)
        whole = np.logaddexp.reduce(forward[:, -1], axis=1)
        each = np.exp(forward + backward - whole[:, None, None])
        expected = np.zeros((words.count, count))
        expected[step[real]] = each[real]
        pairs = np.exp(forward[:, :-1, :, None] + model.moves[None, None] + (score + backward)[:, 1:, None, :] - whole[:, None, None, None])
        slope_m = gold_moves - (pairs * real[:, 1:, None, None]).sum(axis=(0, 1)) - decay * model.moves
        rest = hot - expected
        slope_w = -decay * model.weights
        for o, shift in enumerate(OFFSETS):
            source = np.arange(words.count) + shift
            ok = (source >= 0) & (source < words.count)
            ok[ok] = words.line[source[ok]] == words.line[ok]
            for k in range(PER_WORD):
                at_ = words.features[source[ok], k]
                for y in range(count):
                    slope_w[o, k, :, y] += np.bincount(at_, rest[ok, y], VOCABULARY)
        seen_w += slope_w**2
        seen_m += slope_m**2
        model.weights += rate * slope_w / np.sqrt(seen_w)
        model.moves += rate * slope_m / np.sqrt(seen_m)
    return model


# ---- the operator ----------------------------------------------------------------------------------
#: Added to O when decoding: more of it adds fewer spans.
MARGIN = 0.0


#: What a stretch of a kind holds at least: forms of "at" in an address, digits elsewhere. Stretches without are junk that the model never saw.
HOLDS = {"email": re.compile(r"@|(?<![a-z])at(?![a-z])", re.I), "ip": re.compile(r"[0-9a-f][^.:]*[.:][^.:]*[.:]"), "card": re.compile(r"(?:[0-9][^0-9]*){12}"), "phone": re.compile(r"(?:[0-9][^0-9]*){7}")}


def crf_spans(model: Crf, points: np.ndarray, first: np.ndarray, margin: float = MARGIN) -> list[list[tuple[str, int, int]]]:
    """For each document, the labelled stretches, trailing punctuation left out."""
    words = Words(points, first)
    labels = model.decode(words, margin)
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(first) - 1)]
    on = np.flatnonzero(labels)
    if not len(on):
        return out
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(on) > 1) | (labels[on[1:]] != labels[on[:-1]]) | (words.line[on[1:]] != words.line[on[:-1]])]))
    for a, b in zip(on[heads].tolist(), on[np.concatenate([heads[1:], [len(on)]]) - 1].tolist(), strict=True):
        start, end = int(words.start[a]), int(words.end[b])
        while end > start and points[end - 1] < 128 and chr(points[end - 1]) in TRIM:
            end -= 1
        doc = int(np.searchsorted(first, start, side="right")) - 1
        if end > start and (end - start > 200 or HOLDS[LABELS[labels[a]]].search("".join(map(chr, points[start:end])))):
            out[doc].append((LABELS[labels[a]], start - int(first[doc]), end - int(first[doc])))
    return out


_default: list[Crf] = []


def default_model() -> Crf:
    """The model of the labelled table, trained once a process."""
    if not _default:
        _default.append(train(labelled_lines()).small())
    return _default[0]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """One row for each of docs: id_col, base and spans: arrays of struct(kind, start, end) by kind, then start."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.small() if model else default_model())
    kind_of = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_t")
            raw, offsets = text_bytes(column)
            base, every = [], []
            for a, b in chunks(offsets):
                points, first = code_points(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                added = crf_spans(shared.value, points, first)
                for k in range(a, b):
                    own = base_spans(column[k].as_py() or "")
                    more = [x for x in added[k - a] if not any(x[1] < e and s < x[2] for _, s, e in own)]
                    base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in own])
                    both = sorted([*own, *more], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
                    every.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in both])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(base, span), pa.array(every, span)], ["_id", "base", "spans"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    spans = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"_id {kind_of}, base {spans}, spans {spans}").withColumnRenamed("_id", id_col)
