"""The licence scan against the model's own plain formula."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanveil.llm import licences


def test_scores_equal_the_plain_model(spark):
    """Family, score and agreement of paragraphs mixed from statements and other words, repeated words and ties included."""
    rng = random.Random(1)
    model = licences.fit()
    statements = [t for texts in licences.LABELLED.values() for t in texts]
    texts = list(statements)
    for _ in range(120):
        words = rng.choice(statements).split() + rng.choice(statements).split()[: rng.randrange(6)]
        rng.shuffle(words[rng.randrange(len(words)) :])
        texts.append(" ".join(words[: rng.randrange(1, len(words) + 1)] * rng.choice([1, 1, 2])))
    texts += ["quite other words", "", "mit", "the the the"]
    rows = spark.createDataFrame([(k, licences.tokens(t)) for k, t in enumerate(texts)], "k long, _w array<string>")
    weights = licences._inline(spark, [{"gram": g, "w": [float(v) for v in w]} for g, w in model.weights.items()], "gram:string,w:array<double>")
    got = {r.k: r for r in licences._scored(rows, ["k"], model, weights).collect()}
    for k, text in enumerate(texts):
        grams = licences.ngrams(licences.tokens(text)) & set(model.weights)
        assert (k in got) == bool(grams)
        p = model.probabilities(text)
        if not grams:
            assert model.families[int(np.argmax(p))] == licences.UNKNOWN
            continue
        assert got[k].score == pytest.approx(p.max(), abs=1e-9)
        assert p[model.families.index(got[k].family)] == pytest.approx(p.max(), abs=1e-12)
        own = set(licences.tokens(text))
        shared = [2 * len(set(licences.tokens(t)) & own) / (len(set(licences.tokens(t))) + min(len(own), len(set(licences.tokens(t))))) for t in licences.LABELLED[got[k].family]] if got[k].family != licences.UNKNOWN else [0.0]
        assert got[k].agreement == pytest.approx(max(shared))


def test_odd_tables(spark):
    """Ties, repeated rows, clashing names and very long texts."""
    line = "Released under the MIT License."
    long = "plain words here\n" * 20_000 + line + "\n" + "x" * 200_000
    rows = [(1, line, "g", "f"), (1, line, "g", "f"), (1, "other", "g", "f"), (None, line, "g", "f"), (2, long, "g", "f"), (3, None, "g", "f"), (4, "\n\n", "g", "f")]
    table = spark.createDataFrame(rows, "doc_id long, text string, gram string, family string")
    got = sorted(((r.doc_id, r.n_paragraphs, r.n_confirmed, r.families) for r in licences.licence_report(table).collect()), key=repr)
    assert got == sorted([(1, 1, 1, "mit"), (1, 1, 1, "mit"), (1, 1, 0, ""), (None, 1, 1, "mit"), (2, 20_002, 1, "mit"), (3, 0, 0, ""), (4, 0, 0, "")], key=repr)
    assert licences.licence_report(table.select(F.col("doc_id"), "text").limit(0)).collect() == []
