"""Language ID against a plain naive Bayes, and its sample's bounds."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from spanveil.llm import langid
from spanveil.llm.langid import predict, threshold, train
from spanveil.llm.textnum import fold_letters


def grams(text):
    points = np.array([ord(c) for c in text], np.uint32)
    folded, letters = fold_letters(points) if len(points) else (points, points.astype(bool))
    return [int(b) for n in langid.ORDERS for b in langid.ngram_buckets(folded, n)], bool(letters.any())


def brute(labelled, texts):
    counts, docs = {}, Counter()
    for text, lang in labelled:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text)[0])
            docs[lang] += 1
    out = []
    for text in texts:
        found, letters = grams(text or "")
        if not letters or not counts:
            out.append(("und", 0.0))
            continue
        s = {}
        for lang in sorted(counts):
            total = sum(counts[lang].values()) + langid.SMOOTHING * langid.BUCKETS
            s[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((counts[lang][g] + langid.SMOOTHING) / total) for g in found)
        best = max(s, key=lambda x: (s[x], [-ord(c) for c in x]))
        out.append((best, 1 / sum(math.exp(v - s[best]) for v in s.values())))
    return out


def test_equals_plain_naive_bayes(spark, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 37)
    rng = random.Random(1)
    alphabets = {"aa": "abcdé fgh", "bb": "abxyz ßij", "cc": "日本語 漢a"}
    make = lambda lang, n: "".join(rng.choice(alphabets[lang]) for _ in range(n))
    labelled = [(make(lang, rng.randint(1, 60)), lang) for lang in alphabets for _ in range(12)] + [(None, "aa"), ("orphan", None)]
    texts = [make(lang, n) for lang in alphabets for n in (1, 2, 3, 30, 200)] + [None, "", "12 !!", "🙂", "a", "A", "x" * 500]
    table = spark.createDataFrame([(k, t, lang, "c") for k, (t, lang) in enumerate(labelled)], "doc_id long, text string, lang string, _t string")
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] * 2, "doc_id long, text string, _id string")
    got = predict(docs, train(table)).collect()
    want = brute(labelled, texts)
    assert len(got) == 2 * len(texts)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-9)


def test_sample_is_bounded_at_every_size(spark):
    assert threshold(20_000, 10) == langid.SPACE
    for n in (10**5, 10**10, 10**12, 10**15):
        assert abs(threshold(20_000, n) / langid.SPACE * n - 20_000) < 1
    rows = spark.range(4000).selectExpr("cast(null as bigint) as doc_id", "concat('text ', id) as text", "case when id % 4 = 0 then 'de' else 'en' end as lang")
    model = train(rows, rows=400)
    assert model.languages == ["de", "en"] and abs(float(np.exp(model.prior[0])) - 0.25) < 0.1


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = spark.createDataFrame([(k, f"text {k}", lang) for k, lang in enumerate(["x", "y", "y", "z", "w", "y"])], "doc_id long, text string, lang string")
    assert train(rows).languages == ["w", "y"]
    assert train(rows.limit(0)).languages == []
