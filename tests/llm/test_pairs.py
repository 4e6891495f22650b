"""Jaccard join, substring dedup, decontamination and fingerprints against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import decontaminate, fingerprints, jaccard_join
from loomline.llm.common import block_bounds, block_number
from loomline.llm.components import connected_components
from loomline.llm.jaccard_join import jaccard_components
from loomline.llm.substring_dedup import substring_dedup

WORDS = [f"w{k}" for k in range(400)]


def corpus(seed=1, n=120):
    """Random texts with copies, near copies, shared passages and odd rows."""
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.choice((3, 30, 80, 200)))] for _ in range(n // 3)]
    rows, k = [], 0
    passage = [rng.choice(WORDS) for _ in range(70)]
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 9))):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        if i % 7 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage
        rows.append((k, rng.choice((" ", "\n", " \t")).join(words)))
        k += rng.choice((1, 3))
    return [*rows, (k, None), (k + 1, ""), (k + 2, "  \n"), (k + 3, "one"), (k + 4, "One"), (k + 5, "x " * 3000)]


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components_by_hand(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_components_equal_brute_force(spark, size, percent):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, component_id string, n long")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df, size=size, percent=percent).collect()}
    assert got == components_by_hand(rows, size, percent)


def test_jaccard_chain_of_near_copies_is_one_component(spark):
    rng = random.Random(3)
    words, rows = [rng.choice(WORDS) for _ in range(100)], []
    for i in range(40):  # neighbours link, far ones do not
        words = list(words)
        words[(7 * i) % 100] = f"new{i}"
        rows.append((i, " ".join(words)))
    got = {r["id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=90).collect()}
    assert got == {i: c for i, (_, c) in components_by_hand(rows, 3, 90).items()} and set(got.values()) == {0}


def test_jaccard_empty_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d"), (4, "A b c d"), (4, "a b c d"), (None, "only here"), (9, None)]
    got = sorted((str(r["id"]), str(r["component_id"]), r["n_shingles"]) for r in jaccard_components(spark.createDataFrame(rows, schema)).collect())
    assert got == sorted([("None", "4", 2), ("4", "4", 2), ("4", "4", 2), ("None", "None", 1), ("9", "9", 0)])


def test_jaccard_many_near_copies_of_which_few_link(spark):
    """500 texts that all share most shingles: two random edits each, so few pairs reach the threshold."""
    rng = random.Random(21)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(500):
        words = list(base)
        for at in rng.sample(range(120), 2):
            words[at] = f"e{rng.randrange(4)}"
        rows.append((i, " ".join(words)))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=90).collect()}
    truth = components_by_hand(rows, 3, 90)
    assert got == truth and 1 < len({c for _, c in truth.values()}) < 500


def test_jaccard_repeated_rows_are_verified_once(spark):
    rng = random.Random(22)
    words = [rng.choice(WORDS) for _ in range(90)]
    other = [*words[:40], "changed", *words[41:]]
    rows = [(1, " ".join(words))] * 50 + [(2, " ".join(other))] * 50 + [(None, " ".join(words[:50]))] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pair = spark.createDataFrame([(1, 2)], "a_rep long, b_rep long")
    assert jaccard_join._whole_sets(df.selectExpr("doc_id as id", "text"), pair, 3).count() == 2
    assert {(r["id"], r["component_id"]) for r in jaccard_components(df).collect()} == {(1, 1), (2, 1), (None, None)}


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 20, 300, 5000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            y = np.unique(np.concatenate((x[rng.random(len(x)) < 0.95], rng.integers(0, 2**64, max(1, n // 20), dtype=np.uint64))))
            bits = sum(int(a).bit_count() for a in (jaccard_join.parity_bits(x) ^ jaccard_join.parity_bits(y)).view(np.uint64))
            assert bits <= len(np.setxor1d(x, y)) and (n > 20 or bits > 0 or not len(np.setxor1d(x, y)))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), *[(100, k) for k in range(101, 140)]]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{k: 100 for k in range(100, 140)}}


def dedup_by_hand(rows, w):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - w + 1):
            first.setdefault(tuple(words[i][k : k + w]), i)
    out = {}
    for i, own in words.items():
        gone = set()
        for k in range(len(own) - w + 1):
            if first[tuple(own[k : k + w])] < i:
                gone.update(range(k, k + w))
        out[i] = (len(own), len(gone), b" ".join(x for k, x in enumerate(own) if k not in gone).decode())
    return out


@pytest.mark.parametrize("block_chars", [400, 10**9])
def test_substring_dedup_equals_brute_force(spark, block_chars):
    rows = corpus(seed=5)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    got = {r["id"]: r for r in substring_dedup(df, window=20, carry=True, block_chars=block_chars).collect()}
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == dedup_by_hand(rows, 20)
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in got.values())
    assert all(r["row"]["kept"] == 1 for r in got.values())


def test_substring_dedup_null_and_repeated_ids(spark):
    text = " ".join(WORDS[:30])
    rows = [(1, text), (1, text), (None, text), (2, text + " z"), (None, None)]
    got = sorted((str(r["id"]), r["n_removed"]) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=10).collect())
    assert got == [("1", 0), ("1", 0), ("2", 30), ("None", 0), ("None", 0)]
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_best_place_is_semi_global_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item, text = rng.integers(0, 4, rng.integers(1, 8)), rng.integers(0, 4, rng.integers(0, 12))
        every = [(edit_distance(item, text[a:b])) for a in range(len(text) + 1) for b in range(a, len(text) + 1)]
        d, a, b = decontaminate.best_place(item, text)
        assert d == min(every) == edit_distance(item, text[a:b])


def test_decontamination_recall_against_brute_force(spark):
    rng = random.Random(11)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12, 50)))) for k in range(20)] + [(90, "too shorty"), (91, None), (None, items_text := "a b c d e f g h")]
    rows, truth = [], set()
    for i in range(200):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(0, 120))]
        if i % 2:
            k, text = rng.choice(items[:20])
            own = text.split()
            for _ in range(rng.randrange(0, len(own) // 5 + 1)):
                at, what = rng.randrange(len(own)), rng.random()
                own[at : at + 1] = [rng.choice(WORDS)] if what < 0.5 else [] if what < 0.75 else [own[at], rng.choice(WORDS)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in own]
        rows.append((i, " ".join(words)))
    for i, text in rows:
        tokens = [w.lower() for w in decontaminate.WORD.findall(text)]
        for k, t in items[:20]:
            own = t.split()
            if decontaminate.best_place(np.array([hash(w) for w in own]), np.array([hash(w) for w in tokens], dtype=np.int64))[0] <= decontaminate.edits_allowed(len(own), 80):
                truth.add((i, k))
    rows += [(500, None), (501, ""), (None, items[0][1])]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for chunk in (4 << 20, 600):
        found = decontaminate.contaminated(docs, benchmark, chunk_bytes=chunk).collect()
        got = {(r["id"], r["item"]) for r in found if r["id"] is not None}
        for r in found:  # the reported place has the reported distance, and no place has a smaller one
            own, text = dict(items)[r["item"]].split(), dict(rows)[r["id"]]
            place = [w.lower() for w in decontaminate.WORD.findall(text[r["start"] : r["end"]])]
            every = np.array([hash(w.lower()) for w in decontaminate.WORD.findall(text)], dtype=np.int64)
            assert edit_distance(own, place) == r["distance"] == decontaminate.best_place(np.array([hash(w) for w in own]), every)[0]
        assert got <= truth and len(got) >= 0.95 * len(truth)
        assert (None, 0) in {(r["id"], r["item"]) for r in found}
    leaked = {i for i, _ in got}
    assert {r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect() if r["doc_id"] is not None} == {i for i, _ in rows if i is not None} - leaked
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert items_text


def test_fingerprints_of_following_and_edited_texts(spark):
    rng = random.Random(4)
    rows = [(3 * i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 300)))) for i in range(60)] + [(1000, None), (1001, "né"), (1002, rows_text := "a b c"), (1003, "a b c")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, edited string")
    texts = [t or "" for _, t in rows]
    for block in (10**9, 500):
        fingerprints.BLOCK_CHARS = block
        following = {r["id"]: (r["text"], r["following"]) for r in fingerprints.with_next(df, block_chars=block).collect()}
        assert following == {rows[k][0]: (texts[k], texts[(k + 1) % len(rows)]) for k in range(len(rows))}
    got = {r["id"]: r for r in fingerprints.compare_with_edits(df).collect()}
    for k, (i, _) in enumerate(rows):
        n = len(texts[k])
        edited = texts[k][: n - n // 4] + texts[(k + 1) % len(rows)][: n // 4]
        assert (got[i]["n_chars"], got[i]["edited"]) == (n, edited)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[1002]["fingerprint"] == got[1003]["fingerprint"] != "" and got[1002]["near_next"] == 1
    assert got[1000]["fingerprint"] == "" and rows_text

    def plain(text):  # one shingle at a time
        hashes, w = fingerprints.WordHash(), text.encode().split()
        own = {int(fingerprints.shingle_hashes(hashes.of(w[k : k + 5]), 5)[0]) for k in range(max(1, len(w) - 4))} if w else set()
        return {h for h in own if h <= fingerprints.FRACTION * 2**64} or set(sorted(own)[:1])

    for k, (i, _) in enumerate(rows):
        own = plain(texts[k])
        assert got[i]["fingerprint"] == "".join(f"{h:016x}" for h in sorted(own))
        for column, other in (("near_edited", got[i]["edited"]), ("near_next", texts[(k + 1) % len(rows)])):
            them = plain(other)
            assert got[i][column] == pytest.approx(len(own & them) / len(own | them) if own | them else 1.0)
    long = [got[3 * i] for i in range(60) if got[3 * i]["n_chars"] > 500]
    assert np.mean([r["near_edited"] for r in long]) > 0.4 and np.mean([r["near_next"] for r in long]) < 0.05


def test_sketches_merge_and_estimate_containment():
    words = fingerprints.WordHash()
    rng = random.Random(8)
    a = " ".join(rng.choice(WORDS) for _ in range(8000)).encode()
    b = " ".join(rng.choice(WORDS) for _ in range(2000)).encode()
    x, y, both = (fingerprints.sketch(words, t) for t in (a, b, a + b" " + b))
    assert fingerprints.containment(x, both) == 1 and fingerprints.containment(y, both) == 1
    merged = fingerprints.from_text(fingerprints.merged(fingerprints.as_text(x), fingerprints.as_text(y)))
    assert fingerprints.likeness(merged, both) > 0.98
    limit = fingerprints.FRACTION * 2**64
    above = next(k for k in (fingerprints.sketch(words, f"one two three four w{n}".encode()) for n in range(100)) if k[0] > limit)
    assert list(fingerprints.from_text(fingerprints.merged(fingerprints.as_text(above), fingerprints.as_text(x)))) == list(x)
    assert list(fingerprints.from_text(fingerprints.merged(fingerprints.as_text(above), ""))) == list(above)
    assert abs(len(x) / 7996 - fingerprints.FRACTION) < 0.02
    assert hashlib.sha256(fingerprints.as_text(x).encode()).digest() == hashlib.sha256(fingerprints.as_text(fingerprints.sketch(words, a)).encode()).digest()


def test_block_bounds_follow_characters(spark):
    """Long texts lie together: no block holds much more than its share of characters."""
    rows = [(i, "x" * (20_000 if 400 <= i < 440 else 50)) for i in range(2000)] + [(None, "n" * 5000)] * 20
    df = spark.createDataFrame(rows, "id long, text string")
    chars = sum(len(t) for _, t in rows)
    bounds = block_bounds(df, "id", "text", chars, 50_000)
    sizes = [r["c"] for r in df.where("id is not null").groupBy(block_number("id", bounds).alias("b")).agg(F.sum(F.length("text")).alias("c")).collect()]
    assert len(sizes) >= chars / 50_000 / 2 and max(sizes) <= 2 * 50_000 + 20_000
    assert block_bounds(df.limit(0), "id", "text", 0, 100) == []


def test_long_texts_and_clashing_columns(spark):
    rng = random.Random(30)
    long = " ".join(rng.choice(WORDS) for _ in range(60_000))
    item = " ".join(rng.choice(WORDS) for _ in range(25))
    rows = [(1, long, "a", 0, "b"), (2, f"head {long}", "a", 0, "b"), (3, f"{item} tail", "a", 0, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, block int, item string")
    cut = {r["id"]: r for r in substring_dedup(df, carry=True).collect()}
    assert (cut[2]["n_removed"], cut[2]["kept"], cut[2]["row"]["id"]) == (60_000, "head", "a")
    assert {r["id"]: r["component_id"] for r in jaccard_components(df).collect()} == {1: 1, 2: 1, 3: 3}
    benchmark = spark.createDataFrame([(9, item, 1)], "item_id long, text string, start int")
    found = decontaminate.contaminated(df, benchmark).collect()
    assert [(r["id"], r["item"], r["distance"]) for r in found] == [(3, 9, 0)]
    assert [r["id"] for r in decontaminate.clean(df, benchmark).collect()] == ["a", "a"]
    near = {r["id"]: r for r in fingerprints.compare_with_edits(df).collect()}
    assert near[1]["near_next"] > 0.99 and near[1]["n_chars"] == len(long)


def test_short_items_are_found_exactly(spark):
    items = [(1, "Zebra"), (2, "blue whale"), (3, "red, green; blue"), (4, "one two three four"), (5, "... !"), (6, "a b c d e f")]
    rows = [(1, "the ZEBRA ran"), (2, "a blue whale"), (3, "whale blue"), (4, "red green blue whale"), (5, "one two three x four"), (6, "one two three four"), (7, "..."), (8, None), (9, "a b X c d e f")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item"], r["distance"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (4, 2, 0), (4, 3, 0), (6, 4, 0), (9, 6, 1)}
    assert {r["item"] for r in decontaminate.contaminated(docs, benchmark, min_words=3).collect()} == {3, 4, 6}
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0


def test_word_run_filter_loses_no_place():
    """Whatever the threshold, a window within the allowed edits holds the runs that the filter asks for."""
    rng = random.Random(8)
    for percent in (30, 50, 60, 80, 100):
        for _ in range(60):
            m = rng.randrange(1, 15)
            own = [f"i{k}" for k in rng.sample(range(30), m)]
            text = list(own)
            for at in rng.sample(range(m), decontaminate.edits_allowed(m, percent)):
                text[at] = "other"
            matcher = decontaminate.Matcher([(1, " ".join(own))], percent, 0.99, 1)
            ids = matcher._numbers(" ".join(["z", "z", *text, "z"]))
            assert 2 in {s for _, starts in matcher._starts(ids) for s in starts.tolist()}


def test_fingerprints_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.compare_with_edits(empty).count() == 0 and fingerprints.fingerprints(empty).count() == 0
    lone = spark.createDataFrame([(5, "abcdefgh"), (None, "xyz")], "doc_id long, text string")
    assert {r["id"]: r["following"] for r in fingerprints.with_next(lone).collect()} == {5: "abcdefgh", None: "xyz"}


def test_sketches_of_short_texts_are_near_the_true_jaccard():
    words, rng = fingerprints.WordHash(), random.Random(12)
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    for _ in range(300):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 250))]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + [f"w{rng.randrange(5000)}" for _ in range(cut)]
        true = len(shingles(text) & shingles(edited)) / len(shingles(text) | shingles(edited))
        near = fingerprints.likeness(*(fingerprints.sketch(words, " ".join(t).encode()) for t in (text, edited)))
        assert near > 0 and abs(near - true) < 0.25
