"""The training-data operators against brute force and SQL, and on null, empty, repeated and odd rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanveil.llm import chat, common, licences, minhash, mixing, pii, queries, repeats, suffix, textnum, warc
from spanveil.llm import decontaminate as decontaminate_module
from spanveil.llm.decontaminate import PhraseIndex, decontaminate
from spanveil.llm import exact_dedup as exact_dedup_module
from spanveil.llm.exact_dedup import MergeIndex, exact_dedup
from spanveil.llm.graph import components
from spanveil.llm.langid import predict, train
from spanveil.llm.mixing import mix_sources
from spanveil.llm.repeats import remove_repeats

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _t string, _h string"


def frame(spark, texts, sources=None):
    """Rows with clashing extra columns; ids from 1."""
    rows = [(k + 1, t, "en", (sources or ["s"] * len(texts))[k], 0, "x", "y", "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


WORDS = [f"w{k}" for k in range(400)]
ODD = [None, "", " ", "one", "One", "ONE", "é É", "a b c d", "A b c d", "\x00 nul", "🙂 ok", "x" * 5000, "word " * 3000]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(8, 120)) for _ in range(n)]
    near = [" ".join(w if rng.random() > 0.01 else "edit" for w in t.split()) for t in base[:20]]
    shared = prose(rng, 25)
    mixed = [t + " " + shared + " " + prose(rng, 10) for t in base[20:30]]
    return ODD + base + near + mixed + base[:5] + ["big group"] * 30


def test_exact_dedup_equals_brute_force_even_with_colliding_digests(spark):
    texts = corpus()
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[fold(t)].append(k + 1)
    for digest in (None, lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 2))):
        for keep, pick in (("smallest", min), ("largest", max)):
            got = exact_dedup(frame(spark, texts), keep=keep, **({"digest": digest} if digest else {})).collect()
            assert len(got) == len(texts)
            for r in got:
                ids = groups[fold(texts[r.doc_id - 1])]
                assert (r.keep_id, r.group_size, r.kept) == (pick(ids), len(ids), r.doc_id == pick(ids))


def test_merge_index_flushes_filters_and_compacts(spark, monkeypatch):
    """Many flushes fill levels; filters of one bit, which know everything, and of many change nothing."""
    for bits in (1, 1 << 23):
        monkeypatch.setattr(exact_dedup_module, "RUN_FILTER_BITS", bits)
        index = MergeIndex(spark)
        for k in range(3):
            rows = spark.range(3 * k, 3 * k + 5).selectExpr("id as _id", "unhex(sha2(cast(id as string), 256)) as _d", "cast(id % 3 as int) as _m")
            index.flush(rows)
        assert len(index.levels) == 2 and [len(x) for x in index.levels] == [1, 2]
        assert {(r._low, r._high, r._n) for r in index.compact().collect()} == {(k, k, 2 if k in (3, 4, 6, 7) else 1) for k in range(11)}
        assert sum(map(len, index.levels)) == 1


def test_null_ids_and_empty_tables(spark):
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert exact_dedup(odd).count() == 4 and minhash.near_duplicates(odd).count() == 4 and remove_repeats(odd).count() == 4
    assert decontaminate(odd, spark.createDataFrame([(None, "a"), (7, None)], "item_id long, text string")).count() == 4
    empty = frame(spark, ["x"]).limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (exact_dedup(empty), minhash.near_duplicates(empty), mix_sources(empty), decontaminate(empty, items), remove_repeats(empty), pii.find_pii(empty), licences.licence_report(empty), predict(empty, train(empty))):
        assert out.collect() == []
    assert decontaminate(frame(spark, ODD), items).filter("contaminated").count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, seq long, turn long, kind string, role string, text string")).count() == 0
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mixing_targets_and_limits(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 200)) for _ in range(300)] + [None]
    sources = [rng.choice(["a", "a", "a", "a", "b", "c", None]) for _ in texts]
    df = frame(spark, texts, sources)
    got = mix_sources(df).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_sources(df.repartition(7)).collect()), key=repr)
    size = {s: sum(len((t or "").split()) for t, x in zip(texts, sources, strict=True) if x == s) for s in set(sources)}
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    free, target = set(size), {}
    while True:
        rest = sum(size.values()) - sum(target.values())
        level = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if level[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            free.discard(s)
    target |= level
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 3 for s in size)


def test_seats_are_those_of_the_highest_quotients(spark, monkeypatch):
    """Against a plain Sainte-Laguë apportionment, with shards of very different lengths and ties."""
    rng = random.Random(7)
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", 4)
    rows, want = [], {}
    for k in range(12):
        lengths = [rng.choice([10, 10, 17, 40, 300]) for _ in range(rng.randint(1, 30))]
        words, block = sum(lengths), rng.choice([1, 3, 7])
        target = words * rng.choice([0.31, 0.5, 1.0, 1.7])
        votes = [target * n / words for n in lengths]
        seats = [0] * len(lengths)
        for _ in range(int(target / block + 0.5)):
            open_ = [x for x in range(len(lengths)) if seats[x] < 3 * max(1, -(-lengths[x] // block))]
            seats[max(open_, key=lambda x: (votes[x] / (2 * seats[x] + 1), -x))] += 1
        rows += [(f"s{k}", x, n, words, target, block) for x, n in enumerate(lengths)]
        want |= {(f"s{k}", x): n for x, n in enumerate(seats)}
    got = mixing.shard_seats(spark.createDataFrame(rows, "_k string, _shard long, _len long, _words long, _target double, _b long"))
    assert {(r._k, r._shard): r._quota for r in got.collect()} == want


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    words = {f"s{k:04}": rng.choice([0, 1, 5, 1000, 10**6]) for k in range(300)} | {None: 7}
    rows = [(s, 1, n) for s, n in words.items()]
    rng.shuffle(rows)
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(words, key=lambda s: (s is None, s)))}
    free, want = set(words), {}
    while True:
        level = (sum(words.values()) - sum(want.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * words[s]]
        if not over:
            break
        want |= {s: 3 * words[s] for s in over}
        free -= set(over)
    want |= {s: level * weight[s] for s in free}
    got = {r._source: r._target for r in mixing.source_targets(spark.createDataFrame(rows, "_source string, _docs long, _words long")).collect()}
    assert got == pytest.approx(want)


def test_language_id_held_out(spark):
    out = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").filter("held_out")
    right, n = out.agg(F.count_if(F.expr("lang = lang_pred")), F.count("*")).first()
    assert n > 100 and right / n > 0.95
    docs = frame(spark, ["the cat and the dog", "der Hund und die Katze ist", None, "123 !!!", "🙂"]).withColumn("lang", F.when(F.col("doc_id") == 2, "de").otherwise("en"))
    got = {r.doc_id: r for r in predict(docs, train(docs.filter("doc_id < 3"))).collect()}
    assert (got[1].lang_pred, got[2].lang_pred) == ("en", "de") and all(got[k].lang_pred == "und" and got[k].score == 0 for k in (3, 4, 5))


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize("tile", [1 << 20, 600])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE_SHINGLES", tile)
    texts = corpus(2) + [" ".join([*[f"g{k}" for k in range(80)][: 80 - e], *[f"e{e}{k}" for k in range(e)]]) for e in range(12)]
    sizes, label = brute_components(texts)
    for r in minhash.near_duplicates(frame(spark, texts)).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id - 1], label[r.doc_id - 1] + 1, label[r.doc_id - 1] == r.doc_id - 1)


def test_link_equals_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = rng.integers(0, 60, 40)
        sets = [np.unique(np.concatenate([base[: rng.integers(20, 40)], rng.integers(100, 110, 2)])).astype(np.uint64) for _ in range(12)]
        forest = minhash.Forest(np.arange(12))
        for x, y in minhash.link(sets):
            forest.union(x, y)
        brute = minhash.Forest(np.arange(12))
        for i in range(12):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                    brute.union(i, j)
        assert len(set(zip(forest.label, brute.label, strict=True))) == len(set(forest.label)) == len(set(brute.label))


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 7), (102, 100)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {k: 1 for k in range(1, 41)} | {k: 100 for k in (100, 101, 102)}


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = [(1, prose(rng, 30)), (2, prose(rng, 4)), (3, None), (4, "!!"), (10, prose(rng, 12)), (5, "Straße ÉTÉ one")]
    texts = [*ODD, items[0][1][20:160].upper(), f"x {items[1][1]} y {items[1][1]}", items[4][1], prose(rng, 300) + " " + items[0][1] + " " + items[4][1], "STRAßE, ÉTÉ one", "straße été one"]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = {r.doc_id: r for r in decontaminate(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k, t in enumerate(texts):
        w, hit, seen = cut(t), set(), set()
        for item, text in items:
            p = cut(text)
            for phrase in {tuple(p[i : i + 10]) for i in range(max(len(p) - 9, 1))} - {()}:
                for i in range(len(w) - len(phrase) + 1):
                    if tuple(w[i : i + len(phrase)]) == phrase:
                        hit |= set(range(i, i + len(phrase)))
                        seen.add(str(item))
        r = got[k + 1]
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == (len(w), len(hit), sorted(seen), bool(hit)), t


def test_decontamination_without_broadcasts(spark, monkeypatch):
    """Beyond the broadcast bound postings alone shuffle, so long texts cost what their words cost."""
    monkeypatch.setattr(decontaminate_module, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(9)
        item = prose(rng, 14)
        texts = [prose(rng, 50_000), prose(rng, 30_000) + " " + item + " " + prose(rng, 20_000), item]
        index = PhraseIndex(frame(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string"))
        plan = index._list(index.rows, index.vocabulary, 1)._jdf.queryExecution().executedPlan().toString()
        assert not any("array<" in line or "_w" in line for line in plan.splitlines() if "Exchange" in line)
        got = {r.doc_id: r for r in decontaminate(frame(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
        assert [(got[k].n_words, got[k].n_hit) for k in (1, 2, 3)] == [(50_000, 0), (50_014, 14), (14, 14)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = frame(spark, ["alpha beta gamma delta", "alpha beta x gamma delta", "delta gamma beta alpha", "alpha beta x x x x gamma delta", "alpha beta gamma"])
    assert sorted({r._id for r in PhraseIndex(docs, items, 4, slop=2).near().collect()}) == [1, 2, 3]


def test_pii_base_spans_and_round_trip(spark):
    texts = [*ODD, "a@b@c.d x@y é1.2.3.4é 256.1.1.1 +1 (555) 123-4567", "4539578763621486 4539578763621487", "mail maria [at] example [dot] com", "call (555) 123-4567 now", "0" * 5000 + ".1.1.1"]
    for r in pii.find_pii(frame(spark, texts)).collect():
        text = texts[r.doc_id - 1] or ""
        want = [("email", *m.span()) for m in pii.EMAIL.finditer(text)]
        want += [("ip", *m.span()) for m in pii.IP.finditer(text) if all(int(p.lstrip("0")[:9] or 0) <= 255 for p in m[0].split("."))]
        want += [("card", *m.span()) for m in pii.CARD.finditer(text) if 13 <= sum(c.isdigit() for c in m[0]) <= 19 and pii.luhn("".join(c for c in m[0] if c.isdigit()))]
        want += [("phone", *m.span()) for m in pii.PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        assert [(s.kind, s.start, s.end) for s in r.base] == want
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    assert any(tuple(s) == ("phone", 5, 19) for s in pii.find_pii(frame(spark, texts[-2:-1])).first().spans)


def test_crf_decodes_like_whole_line_viterbi():
    model = pii.train(pii.labelled_lines(200), rounds=20)
    text = " ".join(w for line in pii.labelled_lines(20, 77) for w, _ in line)
    words = pii.Words(np.array([ord(c) for c in text], np.uint32), np.array([0, len(text)]))
    score = model.emissions(words)
    best, back = score[0], []
    for t in range(1, len(score)):
        through = best[:, None] + model.moves
        back.append(through.argmax(axis=0))
        best = through.max(axis=0) + score[t]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    assert model.decode(words).tolist() == path[::-1]


def test_crf_held_out():
    """Of the personal data in lines that training didn't see, at least 0.9 of each kind is found."""
    model, lines = pii.default_model(), pii.labelled_lines(1500, 99)
    text = "\n".join(" ".join(w for w, _ in line) for line in lines)
    words = pii.Words(np.array([ord(c) for c in text], np.uint32), np.array([0, len(text)]))
    got, gold = model.decode(words, pii.MARGIN), np.array([pii.LABELS.index(y) for line in lines for _, y in line])
    line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    said = [(k, gold[line == k].max()) for k in range(len(lines)) if gold[line == k].any()]
    for kind in range(1, 5):
        found = [bool(((got == kind) & (gold == kind) & (line == k)).any()) for k, y in said if y == kind]
        assert sum(found) >= 0.9 * len(found) > 50, (pii.LABELS[kind], sum(found), len(found))
    assert ((got > 0) & (gold == 0)).sum() <= 0.02 * (gold == 0).sum()


def test_crf_on_forms_of_others():
    cases = {"call 555.867.5309 today": ("phone", "555.867.5309"), "ring 020 7946 0958 please": ("phone", "020 7946 0958"), "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up": ("ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"), "card 3782 822463 10005 ok": ("card", "3782 822463 10005")}
    for text, want in cases.items():
        spans = pii.crf_spans(pii.default_model(), np.array([ord(c) for c in text], np.uint32), np.array([0, len(text)]))[0]
        assert [(k, text[a:b]) for k, a, b in spans] == [want]
    for text in ("The year 2024 was good, at 12:30:45 on 2024-01-02", "version 1.2 of the report is de facto at home"):
        assert pii.crf_spans(pii.default_model(), np.array([ord(c) for c in text], np.uint32), np.array([0, len(text)]))[0] == []


def test_base_patterns_take_time_in_proportion_to_the_text():
    for text in ("1" * 1_000_000, "1." * 300_000, "+1" + "(" * 500_000, "a@" * 300_000, "1 " * 300_000, "9.9.9" * 200_000):
        began = time.perf_counter()
        pii.base_spans(text)
        assert time.perf_counter() - began < 10, text[:20]
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("0125.. a") for _ in range(rng.randrange(40)))
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in pii.IP.finditer(text)]


def test_chat_folds_events_and_round_trips(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "\\\\<|x|>", "<\\|", "a\n<|assistant|>\nb</s>\n", "", None, "[\\INST] <s> <<SYS>>"]
    log = [(1, k, k, "message", "user" if k % 2 else "assistant", t) for k, t in enumerate(odd)]
    log += [(2, 0, 0, "message", "user", "hi"), (2, 1, 1, "delta", "assistant", "Hel"), (2, 2, 1, "delta", "assistant", "lo"), (2, 3, 1, "regenerate", "assistant", None), (2, 4, 1, "delta", "assistant", "Bye"), (2, 6, 0, "edit", "user", "HI"), (2, 5, 1, "delta", "assistant", "!")]
    log += [(3, None, None, None, None, "x"), (3, 5, 200, "message", "a|>\nb", "late"), (3, 4, 3, "message", "assistant", "early")]
    df = spark.createDataFrame([(*r, "clash") for r in log], "conv_id long, seq long, turn long, kind string, role string, text string, _conv string")
    made = chat.format_conversations(df)
    assert all(sum(p.length for p in r.pieces) == len(r.formatted) for r in made.collect())
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(made).collect()}
    assert got[1] == [("user" if k % 2 else "assistant", t or "") for k, t in enumerate(odd)]
    assert got[2] == [("user", "HI"), ("assistant", "Bye!")]
    assert got[3] == [("assistant", "early"), ("a|>\nb", "late"), ("", "x")]


def test_chat_roles_and_loss_mask(spark):
    """The mask's spans, applied to the formatted text from outside, give the assistant's texts; no role breaks the marks."""
    roles = ["a<", "a|", "<|", "|>", "<|assistant|>", "a\\", "a<\\", "\\|>\n", "", "<", "assistant<", "</s>", "[INST]", "assistant", "é🙂<"]
    texts = ["hi", "<", "|>", "</s>", "<|assistant|>\nx</s>\n", "\\", "", "<</s>", "🙂 é"]
    log = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for r in roles for t in texts)] + [(2, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts * 20)]
    df = spark.createDataFrame(log, "conv_id long, turn long, role string, text string").withColumn("seq", F.col("turn")).withColumn("kind", F.lit(None).cast("string"))
    made = chat.format_conversations(df)
    for r in made.collect():
        at, learnt = 0, []
        for p in r.pieces:
            span = r.formatted[at + p.start : at + p.end]
            assert r.formatted[at + p.end : at + p.length] == "</s>\n" and r.formatted[at : at + 2] == "<|"
            if p.loss:
                learnt.append(re.sub(r"\\(\\?)", r"\1", span))
            at += p.length
        assert at == len(r.formatted)
        assert learnt == [t for c, _, role, t in log if c == r.conv_id and role == "assistant"]
        assert r.formatted.count("<|") == len(r.pieces)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for conv in (1, 2):
        assert [(t.role, t.text) for t in got[conv].turns] == [(role, t) for c, _, role, t in log if c == conv]
    digests = {r.conv_id: r for r in chat.digest_turns(chat.read_back(made)).collect()}
    want = "".join(t for c, _, role, t in log if c == 2 and role == "assistant")
    assert (digests[2].loss_chars, digests[2].loss_sha256) == (len(want), hashlib.sha256(want.encode()).hexdigest())
    broken = made.withColumn("pieces", F.slice("pieces", 2, 5))
    with pytest.raises(Exception, match="loss mask"):
        chat.digest_turns(chat.read_back(broken)).collect()


def brute_removed(texts):
    seen, out = {}, []
    raws = [(t or "").encode() for t in texts]
    for k, raw in enumerate(raws):
        for i in range(len(raw) - 49):
            seen.setdefault(raw[i : i + 50], k)
    for k, raw in enumerate(raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if seen[raw[i : i + 50]] < k:
                gone[i : i + 50] = b"\x01" * 50
        out.append(bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
@pytest.mark.parametrize("collide", [False, True])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, collide):
    """With anchors of any number of chunks taken as hot, and with hashes of contexts that all collide."""
    monkeypatch.setattr(textnum, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(repeats, "HOT_CHUNKS", hot)
    texts = corpus(6) + ["ab" * 100, "é" * 60, "é" * 60 + "z", "a" * 49, "a" * 50, "a" * 51] + [f"head{k} " + "-" * 70 + f" tail{k}" for k in range(40)]
    want = brute_removed(texts)
    if collide:
        monkeypatch.setattr(repeats, "_content", lambda raw, count, length: count.astype(np.uint64))
        blocks = []
        rng = random.Random(1)
        pool = ["".join(rng.choice("ab") for _ in range(50)).encode() for _ in range(8)]
        rows = [(rng.choice(pool), k) for k in range(40)]
        raw = np.frombuffer(b"".join(t for t, _ in rows), np.uint8)
        blocks.append(repeats._deflate(np.array([40], np.int64), np.zeros(40, np.uint32), np.arange(40, dtype=np.int64), np.ones(40, np.uint8), raw))
        _, masks = repeats.judge_contexts(blocks, 50)
        assert [bool(m) for m in masks] == [any(t == rows[j][0] for j in range(k)) for k, (t, _) in enumerate(rows)]
        return
    for r in remove_repeats(frame(spark, texts).repartition(3)).collect():
        assert bytes(r.kept) == want[r.doc_id - 1]
        assert r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans)


def test_repeats_largest_and_null_ids(spark):
    text = "the same fifty bytes and some more of them, said again and again"
    rows = spark.createDataFrame([(2**63 - 1, text), (None, text), (5, text), (None, text)], "doc_id long, text string")
    got = sorted(((r.doc_id, len(r.kept)) for r in remove_repeats(rows).collect()), key=repr)
    assert got == sorted([(2**63 - 1, 0), (None, 0), (5, len(text)), (None, 0)], key=repr)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(100):
        t = np.concatenate([np.r_[rng.integers(1, 1 + rng.integers(1, 4), rng.integers(1, 40)), 0] for _ in range(rng.integers(1, 6))]).astype(np.uint16)
        stops = np.flatnonzero(t == 0)
        reach = stops[np.searchsorted(stops, np.arange(len(t)))] - np.arange(len(t))
        key = lambda i: [(int(v), 0) if v else (0, i + j) for j, v in enumerate(t[i : i + reach[i] + 1])]  # noqa: B023, E731
        assert suffix.suffix_array(t, reach).tolist() == sorted(range(len(t)), key=key)


def test_licences(spark):
    texts = [*ODD, "x\nReleased under the MIT License.\ny", "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.", "He studied at MIT and later moved.", "SPDX-License-Identifier: MIT", "Licensed under CC BY-NC 4.0."]
    df = frame(spark, texts)
    got = {r.doc_id: r for r in licences.licence_report(df.unionByName(df.limit(len(ODD) + 1))).collect()}
    n = len(ODD)
    assert [got[k].families for k in range(n + 1, n + 6)] == ["mit", "apache,gpl", "", "mit", "cc-by-nc"]
    assert all(got[k].families == "" for k in range(1, n + 1)) and got[1].n_paragraphs == 0


def test_warc_splits_and_order(spark, tmp_path):
    body = "<p>" + "é payload " * 40
    rows = [(3, "http://a", body), (2, None, body), (9, "http://a\r\nX: y", body), (4, "u", None), (5, "u", "short"), (1, "u", "short"), (7, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, _html string")
    records = warc.record_types(pages, "page_id", "html", "url", 100)
    manifest = warc.write_archives(records.coalesce(1), f"file://{tmp_path}/w")
    want = {(str(i), hashlib.sha256((h or "").encode()).hexdigest(), len((h or "").encode())) for i, _, h in rows}
    for size in (64, 997, 1 << 22):
        got = warc.read_archives(manifest, size).collect()
        assert len(got) == len(rows) and {(r.page_id, r.payload_digest, r.payload_bytes) for r in got} == want
        assert {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == {"3": "2", "9": "2"}
        assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")


def test_warc_damage_links_and_odd_ids(spark, tmp_path):
    """A payload that isn't what the headers promise is told; revisits name a record that is there; null and repeated ids."""
    good = b"x" * 300
    digest = hashlib.sha256(good).hexdigest()
    records = [warc.record_bytes(1, "u", good, digest, None), warc.record_bytes(2, "u", good[:-1] + b"y", digest, None), warc.record_bytes(3, "v", good, digest, 1, "u")]
    path = tmp_path / "w.warc.gz"
    path.write_bytes(b"".join(map(warc.member, records)))
    manifest = spark.createDataFrame([(f"file://{path}", path.stat().st_size, 3)], "path string, bytes long, records long")
    got = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert [got[k].damaged for k in "123"] == [False, True, False]
    assert got["2"].payload_digest == hashlib.sha256(good[:-1] + b"y").hexdigest() and got["3"].refers_record == got["1"].record_id
    body = "p" * 200
    rows = [(None, "a", body), (4, "b", body), (4, "c", body), (9, "d", body), (None, "e", "q" * 150), (None, "f", "q" * 150), (None, None, None), (5, "g", body[:99]), (6, "h", body[:99])]
    out = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in out), key=repr) == sorted(
        [(None, "revisit", "4"), ("4", "response", None), ("4", "response", None), ("9", "revisit", "4"), (None, "response", None), (None, "response", None), (None, "response", None), ("5", "response", None), ("6", "response", None)], key=repr
    )
    known = {r.record_id for r in out}
    assert all(r.refers_record in known for r in out if r.record_type == "revisit") and not any(r.damaged for r in out)
    assert all(r.payload is None for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), payload=False).collect())


def test_id_filter_never_drops(spark):
    df, members = spark.range(2000).withColumnRenamed("id", "k"), spark.range(0, 2000, 7).withColumnRenamed("id", "k")
    kept = {r.k for r in common.with_filter(df, members, ["k"]).filter("_maybe").collect()}
    assert set(range(0, 2000, 7)) <= kept and len(kept) < 320
    assert common.drop_keys(df, members, "k").count() == 2000 - 286


def test_code_points():
    texts = ["aé🙂", "", "ß漢", None]
    raw, offsets = textnum.text_bytes(pa.array(texts))
    points, first = textnum.code_points(raw, offsets)
    assert ["".join(map(chr, points[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)] == [t or "" for t in texts]


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.exists(f"{SF}/documents.parquet"):
        pytest.skip("no driver tables")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    plain = lambda cols, rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for _, v in sorted(zip(cols, r, strict=True))) for r in rows)
    key = lambda rows: sorted(map(repr, rows))
    assert sorted(df.columns) == sorted(want.columns)
    assert key(plain(df.columns, [tuple(r) for r in df.collect()]) if name != "op8_warc" else [sorted(r.asDict().items()) for r in df.collect()]) == key(
        plain(want.columns, want.fetchall()) if name != "op8_warc" else [sorted(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    )


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(8)
    clean = [prose(rng, 60) for _ in range(20)]
    item = prose(rng, 20)
    texts = [*clean, None, "123", clean[0].upper(), " ".join(["new", *clean[1].split()[1:]]), clean[2] + " " + item]
    frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(range(1, 21))


def test_pipeline_near_dedup_links_from_80_percent(spark):
    """Two words replaced of 100 leave 86 of 106 shingles, 0.811; three leave 81 of 111, 0.730."""
    rng = random.Random(12)
    texts = []
    for k in range(20):
        words = [f"d{k}x{rng.randrange(10**6)}n{i}" for i in range(100)]
        for places in ((), (20, 60), (20, 50, 80)):
            texts.append(" ".join(f"new{k}" if i in places else w for i, w in enumerate(words)))
    got = {r.doc_id for r in corpus_pipeline.near(spark, frame(spark, texts), SF).collect()}
    assert got == {3 * k + j for k in range(20) for j in (1, 3)}
    assert minhash.near_duplicates(frame(spark, texts)).filter("kept").count() == 60


def test_mixing_meets_targets_of_small_sources_beside_a_huge_one(spark, monkeypatch):
    parts = {"b150": [150], "c300": [100] * 3, "d700": [7] * 100, "e2100": [700] * 3, "f1": [1], "g0": [0], "huge": [2000] * 100, "short": [1, 2, 3] * 500}
    rows = [(s, " ".join(["w"] * n)) for s, sizes in parts.items() for n in sizes]
    got = defaultdict(int)
    target = {}
    for r in mix_sources(frame(spark, [t for _, t in rows], [s for s, _ in rows])).collect():
        got[r.source] += r.taken
        target[r.source] = r.target
    assert [target[s] for s in ("b150", "c300", "d700", "e2100")] == [450, 900, 2100, 6300]
    assert all(abs(got[s] - target[s]) <= max(2, target[s] / 300) for s in parts), (got, target)


def test_licences_that_wrap_over_lines(spark):
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are", "met:"]
    lgpl = ["This library is free software; you can redistribute it and/or", "modify it under the terms of the GNU Lesser General Public", "License as published by the Free Software Foundation; either", "version 2.1 of the License, or (at your option) any later version."]
    mit = ["Permission is hereby granted, free of", "charge, to any person obtaining a copy", "of this software and associated", "documentation files, to deal", "in the Software without restriction"]
    cases = [
        ("\n".join(gpl), "gpl"),
        ("#!/bin/sh\n#\n" + "\n".join("# " + x for x in gpl) + "\n#\nset -e", "gpl"),
        ("/*\n" + "\n".join(" * " + x for x in bsd) + "\n */", "bsd"),
        ("\n".join("// " + x for x in lgpl) + "\r\n", "lgpl"),
        ("\n".join(mit), "mit"),
        ("\n".join(bsd) + "\n\n" + "\n".join(gpl) + "\nReleased under the MIT License.", "bsd,gpl,mit"),
        ("\n\n".join(gpl[:2]), ""),
        ("The program was free for the public.\nShe met the general of the foundation\nand published a license plate.", ""),
    ]
    got = {r.doc_id: r for r in licences.licence_report(frame(spark, [t for t, _ in cases])).collect()}
    assert [got[k + 1].families for k in range(len(cases))] == [f for _, f in cases]
    assert [got[k].n_confirmed for k in (1, 3, 4, 5, 6)] == [1, 1, 1, 1, 3]
