"""Near-duplicate linking on inputs made to break it: colliding forms, chains, large groups, large sets."""

from __future__ import annotations

import random

import numpy as np

from spanveil.llm import minhash, textnum
from spanveil.llm.minhash import near_duplicates


def rows(spark, texts):
    return spark.createDataFrame([(k + 1, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, _key string")


def brute(texts, percent=85):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [x + 1 for x in label]


def components_of(spark, texts, **kwargs):
    return [r.component_id for r in near_duplicates(rows(spark, texts), **kwargs).orderBy("doc_id").collect()]


def thue_morse(n, a, b):
    word = a
    for _ in range(n):
        word += word.translate(str.maketrans(a + b, b + a))
    return word


def test_words_of_colliding_form_have_different_hashes():
    one, two = thue_morse(10, "a", "b"), thue_morse(10, "b", "a")
    raw = np.frombuffer(f"{one} {two} {one[:300]} {two[:300]}".encode(), np.uint8)
    starts, ends, _ = textnum.words(raw, np.array([0, len(raw)]), minhash.SPACE)
    assert len(set(textnum.word_hashes(raw, starts, ends).tolist())) == 4


def test_word_hashes_are_of_the_word_alone():
    rng = random.Random(1)
    words = ["".join(rng.choice("aAbBé") for _ in range(n)) for n in [*range(1, 40), 511, 512, 513, 2000] for _ in range(3)]
    seen = {}
    for shift in ("", "x ", "yyy  "):
        raw = np.frombuffer((shift + " ".join(words)).encode(), np.uint8)
        starts, ends, _ = textnum.words(raw, np.array([0, len(raw)]), minhash.SPACE)
        for s, e, h in zip(starts, ends, textnum.word_hashes(raw, starts, ends).tolist(), strict=True):
            word = raw[s:e].tobytes().lower()
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_thue_morse_documents_are_not_linked(spark):
    rng = random.Random(2)
    own = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(5))
    pairs = [f"{own()} {thue_morse(10, x, y)} " * 3 for x, y in (("a", "b"), ("b", "a"))]
    texts = [f"{thue_morse(10, x, y)} common tail of five words" for x, y in (("a", "b"), ("b", "a"))]
    assert components_of(spark, texts + pairs) == brute(texts + pairs) == [1, 2, 3, 4]


def test_chain_of_weak_candidates(spark):
    """Neighbours share 70 or 90 percent of a window that moves on: buckets join what must not be linked."""
    words = [f"c{k}" for k in range(900)]
    weak = [" ".join(words[k : k + 100]) for k in range(0, 700, 17)]
    close = [" ".join(words[k : k + 100]) for k in range(700, 790, 5)]
    rng = random.Random(3)
    texts = weak + close
    rng.shuffle(texts)
    assert components_of(spark, texts) == brute(texts)


def test_large_groups_split_and_tiled(spark, monkeypatch):
    """Two groups of near copies that share buckets but no link, in buckets of any size; some members link only to others than their group's first."""
    monkeypatch.setattr(minhash, "TILE_SHINGLES", 3000)
    monkeypatch.setattr(minhash, "STAR_PARTS", 3)
    rng = random.Random(4)
    base = [f"b{k}" for k in range(90)]
    texts = []
    for group in range(2):
        own = [f"g{group}x{k}" if group and k >= 78 else w for k, w in enumerate(base)]
        for _ in range(60):
            t = list(own)
            for _ in range(rng.randrange(3)):
                t[rng.choice((0, 1, 2, 86, 87, 88, 89))] = f"e{rng.randrange(99)}"
            texts.append(" ".join(t))
    assert components_of(spark, texts) == brute(texts)


def test_five_thousand_near_copies_are_one_group(spark):
    base = [f"n{k}" for k in range(120)]
    texts = [" ".join([*base, f"tail{k}"]) for k in range(5000)] + ["quite another text of six words"]
    got = components_of(spark, texts)
    assert got == [1] * 5000 + [5001]


def test_link_is_fast_on_near_copies():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
    sets = [np.unique(np.append(base[:59], np.uint64(k))) for k in range(20_000)]
    assert len(minhash.link(sets)) == 19_999


def test_sets_beyond_the_table(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TABLE_SHINGLES", 60)
    rng = random.Random(5)
    texts = []
    for n in (40, 50, 58, 62, 66, 74, 80, 200, 400):
        words = [f"t{n}x{rng.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join(["less", *words[1:]]), " ".join(words[: n * 9 // 10])]
    assert components_of(spark, texts) == brute(texts)


def test_wide_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 1 << 62, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    for sign in (minhash.signature, minhash.wide_signature):
        same = float((sign(a) == sign(b)).mean())
        assert abs(same - 0.6) < 0.1, (sign, same)


def test_nulls_repeats_and_other_thresholds(spark):
    words = " ".join(f"k{k}" for k in range(30))
    table = spark.createDataFrame([(None, words), (5, words), (5, words), (3, words + " x"), (7, None), (8, "\t \n")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(table).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == sorted([(None, 26, 3, False), (5, 26, 3, False), (5, 26, 3, False), (3, 27, 3, True), (7, 0, 7, True), (8, 0, 8, True)], key=repr)
