"""Merkle manifest, importance resampling and SimHash against plain computations."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.llm import importance, merkle, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row) -> str:
    doc_id, text, lang, source, n_chars = row
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes: list[str], arity: int) -> tuple[str, list[list]]:
    """Root, and for each leaf the siblings before and after its ancestors."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            start = i // arity * arity
            proofs[leaf].append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + arity])))
            at[leaf] = i // arity
        nodes = [digest("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
    return nodes[0], proofs


def plain_manifest(rows, arity=3):
    """(id, group, leaf, subroot, root, proof) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        part = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((part, *plain_tree([plain_leaf(r) for r in part], arity)))
    root, tops = plain_tree([t[1] for t in trees], arity)
    return [(r[0], s, plain_leaf(r), sub, root, tuple(p + top)) for s, (part, sub, proofs), top in zip(order, trees, tops, strict=True) for r, p in zip(part, proofs, strict=True)]


def key_of(row):
    return str(row)


def manifest_rows(df):
    return sorted(((r.id, r.group, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.proof)) for r in df.collect()), key=key_of)


@pytest.mark.parametrize(("leaves", "fan", "arity"), [(100_000, 32, 3), (5, 3, 3), (3, 2, 2)])
def test_manifest_equals_plain_trees(spark, monkeypatch, leaves, fan, arity):
    """A hot group over many blocks, groups of one, null and empty groups, and several rounds of the reduction."""
    monkeypatch.setattr(merkle, "FAN", fan)
    rng = random.Random(3)
    groups = ["hot"] * 60 + [None, "", "ß", "a", "b"] * 4 + [f"one{i}" for i in range(25)]
    rows = [(i * 7 % 997, rng.choice(["", None, f"text {i}\n", "é" * i]), rng.choice(["en", None]), g, rng.choice([None, i])) for i, g in enumerate(groups)]
    found = merkle.merkle_manifest(spark.createDataFrame(rows, DOCS).repartition(5), arity=arity, leaves=leaves)
    assert manifest_rows(found) == sorted(plain_manifest(rows, arity), key=key_of)
    assert found.where(merkle.fold_proof(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_manifest_odd_rows(spark):
    """Null ids, ties of ids, repeated rows, a very long text, columns named like the operator's own; one row; no rows."""
    rows = [(None, "x", None, "s", 1), (None, "x", None, "s", 1), (2, "b", "en", "s", 1), (2, "a", "en", "s", 1), (2, "a", "en", "s", 1), (5, "long " * 200_000, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    clashing = df.withColumns({c: F.lit("?") for c in ("id", "group", "leaf", "other", "block", "row", "proof")})
    assert manifest_rows(merkle.merkle_manifest(clashing, leaves=2)) == sorted(plain_manifest(rows), key=key_of)
    (alone,) = merkle.merkle_manifest(df.limit(1)).collect()
    assert alone.leaf == alone.subroot == alone.root and alone.proof == []
    assert merkle.merkle_manifest(df.limit(0)).collect() == []


def test_manifest_tells_null_from_empty_and_columns_apart(spark):
    rows = [(1, None, "a", "b", 1), (1, "", "a", "b", 1), (1, "a", None, "b", 1), (1, "1:a", "", "b", 1), (1, "", "1:a", "b", 1)]
    assert len({r.leaf for r in merkle.merkle_manifest(spark.createDataFrame(rows, DOCS)).collect()}) == len(rows)


def test_manifest_proves_what_was_changed(spark):
    rows = [(i, f"line {i}\nend", "en", f"s{i % 3}", i) for i in range(30)]
    df = spark.createDataFrame(rows, DOCS)
    tampered = F.when(F.col("doc_id") % 5 == 0, merkle.digest_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.replace("text", F.lit("\n"), F.lit(""))))
    found = merkle.merkle_manifest(df, other=tampered).select("id", (merkle.fold_proof(F.col("other"), F.col("proof")) == F.col("root")).alias("kept"))
    assert {r.id for r in found.collect() if not r.kept} == {i for i in range(30) if i % 5 == 0}


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 30), min_size=1, max_size=6), arity=st.integers(2, 4), data=st.data())
def test_joining_forests_is_associative_and_commutative(sizes, arity, data):
    """However leaves are dealt to forests and in whatever order those are joined, the root is left and nothing else."""
    trees = {t: n for t, n in enumerate(sizes)} | {merkle.TOP: len(sizes)}
    leaves = [((t, 0, i), digest(f"{t} {i}")) for t, n in enumerate(sizes) for i in range(n)]
    dealt = data.draw(st.lists(st.integers(0, 4), min_size=len(leaves), max_size=len(leaves)))
    forests = []
    for part in sorted(set(dealt)):
        nodes = {k: d for (k, d), p in zip(leaves, dealt, strict=True) if p == part}
        merkle.settle(nodes, trees, arity)
        forests.append({"arity": arity, "sizes": trees, "nodes": [(*k, d) for k, d in nodes.items()]})
    while len(forests) > 1:
        a, b = data.draw(st.permutations(range(len(forests))))[:2]
        nodes, known, _ = merkle.unite([forests[a], forests[b]])
        forests = [f for i, f in enumerate(forests) if i not in (a, b)] + [{"arity": arity, "sizes": known, "nodes": [(*k, d) for k, d in nodes.items()]}]
    subroots = [plain_tree([d for (t, _, _), d in leaves if t == tree], arity)[0] for tree in range(len(sizes))]
    ((*_, root),) = forests[0]["nodes"]
    assert root == plain_tree(subroots, arity)[0]


# --- importance resampling ---

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall((text or "").encode().lower())
    return words, [b" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(rows, target, percent, least, buckets=10_000):
    """{id: (n_features, weight, score, rank)} for distinct ids."""
    counts = []
    for texts in ([t for _, t in rows], target):
        n = [0] * buckets
        for t in texts:
            for f in plain_features(t)[1]:
                n[zlib.crc32(f) % buckets] += 1
        counts.append(n)
    s, t = counts
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out, able = {}, []
    for i, text in rows:
        words, found = plain_features(text)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in found)
        h = int(digest(f"42:{i}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(found), weight, score, None]
        if len(words) >= least:
            able.append((-score, i))
    for rank, (_, i) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[i][3] = rank
    return {i: tuple(v) for i, v in out.items()}


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "l'été", "naïve", "42", "x", "w" * 70, "Ünder_score", "a-b", "\x85z", "日本"]
    return [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 19, 20, 40]))) for _ in range(n)]


@pytest.mark.parametrize("percent", [5, 50, 100, 0])
def test_resample_equals_plain(spark, percent):
    rows = list(enumerate(texts(150))) + [(2**62, "Alpha beta " * 12), (-(2**62), "naïve x " * 15), (900, None), (901, "")]
    target = texts(20, 2) + [None]
    found = importance.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), percent)
    assert {r.id: (r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()} == plain_resample(rows, target, percent, 20)


@settings(max_examples=80, deadline=None)
@given(words=st.lists(st.binary(min_size=1, max_size=90).map(lambda b: b.translate(importance.WORD_BYTES).replace(b" ", b"y")), max_size=12), chunk=st.integers(1, 5))
def test_buckets_are_crc32_of_the_joined_runs(words, chunk):
    old, importance.CHUNK = importance.CHUNK, chunk
    try:
        found = sorted(int(b) for part in importance.bucket_runs(importance.Words(), words, 10_000, 3) for b in part)
    finally:
        importance.CHUNK = old
    assert found == sorted(zlib.crc32(b" ".join(words[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1))


def test_words_are_runs_of_the_specified_bytes():
    every = bytes(range(256))
    assert importance.words_of(every) == WORD.findall(every.lower())


def test_resample_ties_repeated_rows_and_null_ids(spark):
    """Of equal rows, as many are drawn as there is room for; null ids come last among equal scores."""
    same = "alpha beta gamma delta " * 6
    rows = [(1, same)] * 40 + [(None, same)] * 3 + [(i, same) for i in range(2, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("?") for c in ("id", "rank", "score", "block", "key", "n")})
    found = importance.resample(df, df.select("text"), 60).collect()
    assert len(found) == 50 and sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 31))
    order = [(-r.score, r.id is None, r.id or 0) for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])]
    assert order == sorted((-r.score, r.id is None, r.id or 0) for r in found)[:30]


def test_resample_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 200_000), (2, "b " * 30)], "doc_id long, text string")
    assert importance.resample(df, some.select("text")).collect() == []
    assert {r.id: r["rank"] for r in importance.resample(some, df.select("text"), 100).collect()}.keys() == {1, 2}


def test_radix_selection_finds_the_kth_key(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 1, 5000, 2**40]), rng.randrange(2**62)) for _ in range(300)] + [(5000, 7)] * 30
    df = spark.createDataFrame(rows, "a long, b long").repartition(3)
    for k in (1, 2, 150, 200, 329, 330):
        assert importance.kth_key(df, ["a", "b"], k) == sorted(rows)[k - 1]
    assert importance.kth_key(df, ["a", "b"], 331) is None and importance.kth_key(df, ["a", "b"], 0) is None


# --- SimHash ---


def plain_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, bits=4):
    """{value: smallest value of its component}."""
    values = sorted(set(values))
    part = {v: v for v in values}
    for a, b in combinations(values, 2):
        if (a ^ b).bit_count() <= bits and part[a] != part[b]:
            low, high = sorted((part[a], part[b]))
            part = {v: low if p == high else p for v, p in part.items()}
    return part


def signed(v):
    return v - 2**64 if v >= 2**63 else v


@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet="aB é\t\n\x0b\x1f\xa0 z", max_size=60))
def test_fingerprint_equals_plain(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_of_a_long_text_in_slices(monkeypatch):
    text = " ".join(random.Random(2).choices(["one", "two", "three", "four"], k=1000))
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("size", [2, 3, 4])
def test_every_choice_of_shared_positions_holds_a_set(size):
    sets = simhash.position_sets(size, 4)
    assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 4))
    assert len(sets) <= {2: 7, 3: 24, 4: 70}[size]


def dense_fingerprints(seed=1):
    """Balls of values around centres, chains of near values, and values on their own."""
    rng = random.Random(seed)
    out = []
    for radius, n in ((3, 150), (9, 120), (6, 60)):
        centre = rng.getrandbits(64)
        places = rng.sample(range(64), 20)
        out += [centre ^ sum(1 << p for p in rng.sample(places, rng.randint(0, radius))) for _ in range(n)]
    at = rng.getrandbits(64)
    for _ in range(30):
        at ^= sum(1 << p for p in rng.sample(range(64), 4))
        out.append(at)
    return [*out, *(rng.getrandbits(64) for _ in range(150)), 0, 2**64 - 1]


@pytest.mark.parametrize(("hot", "minor", "chunk", "chance"), [(64, 256, 1000, 8), (4, 3, 5, 8), (2, 1000, 3, 0), (10**6, 10**6, 10**6, 8)])
def test_components_equal_brute_force(spark, monkeypatch, hot, minor, chunk, chance):
    """Short lists only; hot lists in chunks; crowded lists by half-way values; longer position sets."""
    for name, value in (("HOT", hot), ("MINOR", minor), ("CHUNK", chunk), ("BY_CHANCE", chance)):
        monkeypatch.setattr(simhash, name, value)
    values = dense_fingerprints()
    found = simhash.similar(spark.createDataFrame([(signed(v),) for v in sorted(set(values))], "fp long"))
    comps = {r.fp: r["comp"] for r in found.collect()}
    expected, groups = plain_components(values), {}
    for v, least in expected.items():
        groups.setdefault(least, set()).add(signed(v))
    mine = {}
    for fp, comp in comps.items():
        mine.setdefault(comp, set()).add(fp)
    assert sorted(map(sorted, mine.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_simhash_components_of_texts(spark):
    """Copies, near copies, short and empty texts, null ids, repeated rows, clashing columns."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t.upper()) for i, t in enumerate(base[:3])] + [(20 + i, t + f" tail{i}") for i, t in enumerate(base)]
    rows += [(100, ""), (99, None), (98, " \n"), (50, "one"), (51, "ONE"), (None, base[0]), (None, "nowhere else"), (7, base[1]), (7, base[1]), (3000, "word " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("?") for c in ("id", "fp", "comp", "n", "large")}).repartition(3)
    fps = [plain_fingerprint(t) for _, t in rows]
    part = plain_components(fps)
    least = {}
    for (i, _), v in zip(rows, fps, strict=True):
        if i is not None:
            least[part[v]] = min(least.get(part[v], i), i)
    found = sorted((str(r.id), r.fp, str(r.component_id)) for r in simhash.simhash_components(df).collect())
    assert found == sorted((str(i), signed(v), str(least.get(part[v]))) for (i, _), v in zip(rows, fps, strict=True))
    assert simhash.simhash_components(df.limit(0)).collect() == []


def test_tally_counts_equal_positional_bytes(spark):
    values = [0, 1, 0xFF00, 0xFF00FF00FF00FF00, 2**64 - 1, 1 << 63]
    found = spark.createDataFrame([(signed(v),) for v in values], "x long").select("x", simhash.tally(F.col("x")).alias("t"))
    assert {r.x: r.t for r in found.collect()} == {signed(v): v.to_bytes(8, "big").count(0) for v in values}


def test_no_pairs_within_a_dense_group(spark):
    """Values all within two bits of a centre come out as one component without as many links as pairs."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)} - {centre})
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    assert simhash.similar(fps).agg(F.countDistinct("comp"), F.count("*")).first() == (1, len(values))
    near = fps.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])).alias("value"))
    assert simhash._starred(near, "value").count() < 64 * len(values)
    assert np.log10(len(values) ** 2) > 6
