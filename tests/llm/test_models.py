"""Toxicity, quality and LM scores: held-out accuracy, location of sentences, a plain computation of the formula."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import lm_score, quality, toxicity

COMMON = [f"{a}{b}" for a in ("the", "on", "er", "in", "at") for b in ("", "ble", "tion", "ed", "sh", "ou")]


def sentence(rng, n=8):
    return " ".join(rng.choice(COMMON) for _ in range(n)).capitalize() + "."


def labelled(rng, n, spoil):
    rows = []
    for i in range(n):
        parts = [sentence(rng) for _ in range(rng.choice((1, 5, 40)))]
        bad = i % 3 == 0
        if bad:
            spoil(rng, parts)
        rows.append((i, " ".join(parts), int(bad)))
    return rows


def insult(rng, parts):
    k = rng.randrange(len(parts))
    parts[k] = parts[k][:-1] + " " + rng.choice(("grobnik", "grobnikly", "Zorch!", "zorched")) + "."


def noise(rng, parts):
    for k in range(len(parts)):
        parts[k] = " ".join(w + rng.choice(("$$$", "###")) for w in parts[k].split())


def test_toxicity_held_out_and_location(spark):
    rows = labelled(random.Random(3), 240, insult)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7777, None), (8888, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id % 4 != 1 or doc_id is null"))
    got = {r["id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(i, t, y) for i, t, y in rows if i % 4 == 1]
    assert all((got[i]["score"] >= 0.5) == bool(y) for i, _, y in held)
    for i, t, y in held:
        spans = got[i]["sentences"]
        assert bool(spans) == bool(y) and all(any(w in t[s["start"] : s["end"]].lower() for w in ("grobnik", "zorch")) for s in spans)


@pytest.mark.parametrize("scale", [1, 5])  # 449:2000 and 2000:2000 in the sample
def test_toxicity_long_clean_documents(spark, scale):
    """Label ratio, share of unexplained labels and long texts as in sf0.1."""
    rng = random.Random(scale)
    rows = []
    for i in range(3980 * scale):
        kind = "insult" if i % 3980 < 261 else "noise" if i % 3980 < 449 else "clean"
        parts = [sentence(rng, 4) for _ in range(1500 if i % 100 == 7 and scale == 1 else 300 if i % 100 == 7 else rng.randrange(1, 12))]
        if kind == "insult":
            insult(rng, parts)
        rows.append((i, " ".join(parts), int(kind != "clean")))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    known = ("grobnik", "zorch")
    clean = [t for _, t, _ in rows if not any(w in t.lower() for w in known)]
    longest = sorted(clean, key=len)[-20:]
    assert all(scorer.score(t)[0] < 0.5 for t in [*longest, *rng.sample(clean, 200)])
    assert all(scorer.score(t)[0] >= 0.5 for _, t, _ in rows if any(w in t.lower() for w in known))


def test_toxicity_noisy_or_by_hand():
    model = toxicity.Model(-3.0, {"bad": 2.0, "worse": 4.0})
    score, spans = toxicity.Scorer(model).score("Good day. Bad thing! worse and bad\nfine")
    p = [1 / (1 + np.exp(-z)) for z in (-3, -1, 3, -3)]
    assert score == pytest.approx(1 - np.prod([1 - x for x in p])) and [(s["start"], s["end"]) for s in spans] == [(19, 34)]


def test_toxicity_words_of_any_letters():
    """Scores and spans are those of words and sentences found one by one, whatever letters stand in the text."""
    model = toxicity.Model(-2.0, {"bad": 2.5, "caf\u00e9": 1.5, "stra-": 3.0, "\u03b1\u03c2": 4.0, "\u03b1\u03c3": -1.0, "i": 0.7, "\u00fcber-": 2.2, "k": 1.1, "ab": 0.9}, leak=0.01)
    pieces = ["bad", "BAD", "Caf\u00c9", "cafe\u0301", "Stra\u00dfen", "stra", "\u0391\u03a3", "\u0391\u03a3'\u0391", "\u0130", "I", "\u212a", "\u00dcberall", "\U0001f600", "\u2014", "a\u0301b", "ab_", "x\x00ab", "\x1cab\x1f", ".", "!?", "\n", "\r\n", "\u2028", "\u3002", " ", "\u00a0", ""]
    rng, scorer, sig = random.Random(8), toxicity.Scorer(model), lambda z: 1 / (1 + np.exp(-z))
    for text in [*pieces, *("".join(rng.choice(pieces) + rng.choice(("", " ")) for _ in range(rng.randrange(40))) for _ in range(400))]:
        ends = [m.start() for m in toxicity.SENTENCE_END.finditer(text)]
        p = [sig(model.bias + sum(model.weights.get(f, 0) for f in {f for w in toxicity.WORD.findall(part) for f in toxicity.word_features(w)})) for part in toxicity.SENTENCE_END.split(text)]
        score, spans = scorer.score(text)
        assert score == pytest.approx(1 - (1 - model.leak) * np.prod([1 - x for x in p]))
        want = [(ends[k - 1] if k else 0, [*ends, len(text)][k], pytest.approx(x)) for k, x in enumerate(p) if x >= model.cut]
        assert [(s["start"], s["end"], s["score"]) for s in spans] == want


def test_toxicity_time_grows_with_the_text():
    """A text of many sentences with known words: each is met once."""
    import time

    scorer = toxicity.Scorer(toxicity.Model(-9.0, {"bad": 2.0, "worse": 4.0}))
    began = time.process_time()
    assert scorer.score("so bad it is. " * 40_000)[1] == []
    assert time.process_time() - began < 5


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "..."), (2, "a" * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, none), carry=True).collect()
    assert len(scored) == 4 and all(0 <= r["score"] < 0.01 for r in scored) and {r["row"]["doc_id"] for r in scored} == {1, 2, None}
    assert toxicity.score(docs.limit(0), toxicity.Model(0.0)).count() == 0


def test_quality_held_out(spark):
    rows = labelled(random.Random(5), 240, noise)
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, id int")
    labels = spark.createDataFrame([(i, 1 - y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.train(docs, labels.where("doc_id % 4 != 1"))
    got = {r["id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if i % 4 == 1]
    assert sum((got[i] < 0.5) == bool(y) for i, y in held) >= 0.97 * len(held)


def test_quality_gradient_fits_and_attention_is_a_distribution():
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for k in range(120):
        x = rng.normal(0, 1, (rng.integers(1, 9), quality.FEATURES)).astype(np.float32)
        if k % 2:
            x[rng.integers(len(x)), 3] = 9  # one passage decides
        bags.append(x)
        labels.append(k % 2)
    model = quality.fit(bags, np.array(labels, float))
    starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
    s, a = model.score(np.concatenate(bags), starts)
    assert np.mean((s >= 0.5) == np.array(labels)) > 0.97 and np.allclose(np.add.reduceat(a, starts), 1)


@pytest.mark.parametrize("ones, zeros", [(360, 40), (200, 200), (20, 380)])
def test_quality_keeps_the_ratio_of_the_labels(spark, ones, zeros):
    """Texts that tell nothing score the share of the ones, although the sample holds as many of either as it can."""
    n = ones + zeros
    docs = spark.createDataFrame([(i, "all the same words") for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < ones)) for i in range(n)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample=120)
    assert abs(quality.score(docs.limit(1), model).first()["score"] - ones / n) < 0.03


def test_quality_trained_on_odd_rows(spark):
    rows = labelled(random.Random(8), 120, noise)
    odd = [(900, None, 0), (901, "", 0), (902, " \n\t", 1), (903, "word " * 30_000, 1), (0, rows[0][1], rows[0][2]), (None, "x y", 1)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows + odd], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows + odd[:4]], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["score"], r["n_passages"]))
    assert len(by[0]) == 2 and by[0][0] == by[0][1] and by[900] == by[901] == by[902] and by[903][0][1] == -(-30_000 // quality.PASSAGE_WORDS)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x " * 30_000), (2, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, none)).collect()
    assert [r["score"] for r in got] == [0.5] * 4 and max(r["n_passages"] for r in got) == 469
    assert quality.score(docs.limit(0), quality.fit([], np.zeros(0))).count() == 0


def test_lm_scores_equal_plain_formula(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(COMMON[:10] if i % 2 else COMMON) for _ in range(rng.randrange(0, 60))), i % 2 == 1) for i in range(60)] + [(60, None, None), (None, "The AT", False), (61, "unseen word", False), (61, "unseen word", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    model = lm_score.train(docs, F.col("good"), vocabulary=25, table_bits=20)
    counts = {}
    for _, t, _ in rows:
        for w in (t or "").lower().split():
            counts[w] = counts.get(w, 0) + 1
    vocabulary = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:25]
    ids = lambda t: [w if w in vocabulary else "?" for w in (t or "").lower().split()]
    uni, bi = [{}, {}], [{}, {}]
    for _, t, good in rows:
        own = ids(t)
        for k in [1] + [0] * bool(good):
            for a, b in zip(["^", *own], own, strict=False):
                bi[k][a, b] = bi[k].get((a, b), 0) + 1
                uni[k][b] = uni[k].get(b, 0) + 1
            if own:
                uni[k]["^"] = uni[k].get("^", 0) + 1

    def loss(k, own):
        total = sum(v for w, v in uni[k].items() if w != "^")
        out = []
        for a, b in zip(["^", *own], own, strict=False):
            plain = (uni[k].get(b, 0) + 1) / (total + 26)
            seen = uni[k].get(a, 0)
            out.append(-np.log2(lm_score.MIX * (bi[k].get((a, b), 0) / seen if seen else 0) + (1 - lm_score.MIX) * plain))
        return float(np.mean(out)) if out else 0.0

    got = lm_score.score(docs, model).collect()
    assert len(got) == len(rows)
    for r, (_, t, _) in zip(sorted(got, key=lambda r: (str(r["id"]), r["n_tokens"])), sorted(rows, key=lambda r: (str(r[0]), len(ids(r[1])))), strict=True):
        own = ids(t)
        assert r["n_tokens"] == len(own) and r["target_loss"] == pytest.approx(loss(0, own)) and r["background_loss"] == pytest.approx(loss(1, own))
        assert r["score"] == pytest.approx(loss(1, own) - loss(0, own))


@pytest.mark.parametrize("block_chars", [300, 10**9])
def test_lm_corpus_leaves_own_counts_out(spark, monkeypatch, block_chars):
    monkeypatch.setattr(lm_score, "BLOCK_CHARS", block_chars)
    rng = random.Random(19)
    rows = [(i, " ".join(rng.choice(COMMON[:12] if i % 2 else COMMON) for _ in range(rng.randrange(0, 60))), i % 3 == 1) for i in range(60)]
    rows += [(60, None, None), (61, "", True), (None, "The AT the", False), (62, "only here twice", True), (62, "only here twice", True), (63, "lone words", False), (64, "the on " * 20_000, False)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, good boolean, block int, target string")
    got = lm_score.score_corpus(docs, F.col("good")).collect()
    own = [(t or "").lower().split() for _, t, _ in rows]
    counted = lambda some: (Counter(x for d in some for x in (["^", *d] if d else [])), Counter(p for d in some for p in zip(["^", *d], d, strict=False)), sum(map(len, some)))
    size = len({w for d in own for w in d}) + 1
    want = []
    for k, (i, _, _) in enumerate(rows):
        losses = []
        for good_only in (True, False):
            uni, bi, total = counted([d for j, d in enumerate(own) if j != k and (rows[j][2] or not good_only)])
            bits = [-np.log2(lm_score.MIX * bi[a, b] / max(uni[a], 1) + (1 - lm_score.MIX) * (uni[b] + 1) / (total + size)) for a, b in zip(["^", *own[k]], own[k], strict=False)]
            losses.append(float(np.mean(bits)) if bits else 0.0)
        want.append((str(i), len(own[k]), *losses, losses[1] - losses[0]))
    have = sorted((str(r["id"]), r["n_tokens"], r["target_loss"], r["background_loss"], r["score"]) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])


def test_lm_counts_grow_with_the_corpus(spark, monkeypatch):
    """More distinct words than 50,000 and more bigrams than 2^21; rare words keep their own counts."""
    monkeypatch.setattr(lm_score, "BLOCK_CHARS", 2_000_000, raising=False)
    rows = [(i, " ".join(f"w{(i * 977 + k * k * (i % 13 + 1)) % 130_000}" for k in range(1500)), i % 2 == 0) for i in range(1700)]
    rows += [(9000, "rare1 rare2 rare1 rare2", True), (9001, "rare3 rare2 rare3", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    got = {r["id"]: r for r in lm_score.score(docs, lm_score.train(docs, F.col("good"))).collect()}
    uni, bi, total = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for _, t, good in rows:
        own = t.split()
        for k in (1, 0)[: 1 + good]:
            uni[k].update(["^", *own])
            bi[k].update(zip(["^", *own], own, strict=False))
            total[k] += len(own)
    size = len(uni[1])  # all words and the unknown one; the start is none
    assert size > 50_000 and len(bi[1]) > 2**21
    for i, t, _ in rows[::40] + rows[-2:]:
        own = t.split()
        want = [float(np.mean([-np.log2(lm_score.MIX * bi[k][a, b] / max(uni[k][a], 1) + (1 - lm_score.MIX) * (uni[k][b] + 1) / (total[k] + size)) for a, b in zip(["^", *own], own, strict=False)])) for k in (0, 1)]
        assert [got[i]["target_loss"], got[i]["background_loss"]] == pytest.approx(want)


def test_lm_empty_inputs(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, good boolean")
    model = lm_score.train(empty, F.col("good"))
    assert lm_score.score(empty, model).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {r["id"]: r["score"] for r in lm_score.score(docs, model).collect()} == {1: 0.0, 2: 0.0}
    assert lm_score.score_corpus(empty, F.col("good")).count() == 0
    assert {r["id"]: r["score"] for r in lm_score.score_corpus(docs, F.lit(None).cast("boolean")).collect()}.keys() == {1, 2}


def test_quality_score_equals_plain_attention():
    """Features, gated attention and score of a text, computed one passage and one unit at a time."""
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(0, 1, quality.FEATURES), rng.uniform(0.5, 2, quality.FEATURES), {
        "W": rng.normal(0, 0.3, (quality.FEATURES, 5)), "c": rng.normal(0, 1, 5), "V": rng.normal(0, 1, (5, 3)), "U": rng.normal(0, 1, (5, 3)), "u": rng.normal(0, 1, 3), "o": rng.normal(0, 1, 5), "b": np.array([0.3]),
    })
    text = " ".join("Hello WORLD 12 x9 a,b $$$ hello hello | /p ünï end. supercalifragilistic".split()[k % 12] for k in range(150))
    words = text.encode().split()
    sig = lambda z: 1 / (1 + np.exp(-z))
    encoded, energy = [], []
    for at in range(0, 150, quality.PASSAGE_WORDS):
        part = words[at : at + quality.PASSAGE_WORDS]
        x = np.zeros(quality.FEATURES)
        for k, w in enumerate(part):
            code = quality.word_code(w)
            x[code >> quality.SHAPES & 31] += 1
            for s in range(quality.SHAPES):
                x[quality.BUCKETS + s] += code >> s & 1
            for j, lag in enumerate((1, 2, 4)):
                x[quality.BUCKETS + quality.SHAPES + j] += at + k >= lag and words[at + k - lag] == w
        x /= len(part)
        x[-1] = min(1.0, np.log1p(150) / 10)
        x = (x.astype(np.float32) - model.mean) / model.scale
        p = model.parts
        h = np.array([np.tanh(sum(x[i] * p["W"][i, j] for i in range(quality.FEATURES)) + p["c"][j]) for j in range(5)])
        encoded.append(h)
        energy.append(sum(p["u"][j] * np.tanh(h @ p["V"][:, j]) * sig(h @ p["U"][:, j]) for j in range(3)))
    weight = np.exp(energy) / np.sum(np.exp(energy))
    want = sig(sum(w * h for w, h in zip(weight, encoded, strict=True)) @ model.parts["o"] + 0.3)
    score, attention = model.score(quality.passages(quality.WordCodes(), text.encode()), np.array([0]))
    assert score[0] == pytest.approx(want, rel=1e-5) and attention == pytest.approx(weight, rel=1e-4)


def test_toxicity_fit_is_at_a_minimum_of_its_loss():
    """Moving any learned number a little makes the weighted noisy-or loss no better."""
    rng = random.Random(4)
    bags = [([((k % 3,) if rng.random() < 0.7 else (), 1 + k % 2), ((), rng.randrange(1, 6))], int(k % 3 == 0 and rng.random() < 0.9 or rng.random() < 0.1)) for k in range(300)]
    share, ridge = 0.1, 0.02
    model = toxicity.fit(bags, ["f0", "f1", "f2"], share, ridge=ridge)
    labels = [y for _, y in bags]
    weigh = {1: share / np.mean(labels), 0: (1 - share) / (1 - np.mean(labels))}

    def loss(weights, bias, leak):
        total = ridge * sum(w * w for w in weights) / 2
        for bag, y in bags:
            clean = 1 - leak
            for hit, n in bag:
                clean *= (1 - 1 / (1 + np.exp(-bias - sum(weights[f] for f in hit)))) ** n
            total -= weigh[y] * np.log(1 - clean if y else clean)
        return total / len(bags)

    weights = [model.weights.get(f"f{k}", 0.0) for k in range(3)]
    best = loss(weights, model.bias, model.leak)
    for k in range(3):
        for step in (-0.1, 0.1):
            assert loss([w + step * (j == k) for j, w in enumerate(weights)], model.bias, model.leak) >= best - 1e-5
    for step in (0.9, 1.1):
        assert loss(weights, model.bias * step, model.leak) >= best - 1e-5 and loss(weights, model.bias, model.leak * step) >= best - 1e-5
