"""Full-text search against the embedded database's own full-text engine."""

import math
import random
import re
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomline.functions import words as W
from loomline.operators import fulltext as X
from loomline.operators import search
from loomline.sources import commits as C

TEXTS = [
    "Un café naïve, über den FLUSS.", "cafe CAFÉ café cafés", "l'été à la mer", "naïve ete ber uber", "foo_bar foo bar foo-bar", "a a a b", "x́y ́z ź̧a",
    "ǖ ộ ß STRASSE straße", "123 12 1٢ ١٢", "日本 Привет Σίσυφος ΣΙΣΥΦΟΣ", "", "...", "ḗté",
]


def corpus(n=120, seed=4):
    rng = random.Random(seed)
    every = [w for t in TEXTS for w in t.split()]
    return [(i, " ".join(rng.choices(every, k=rng.randrange(0, 15))), rng.choice(TEXTS)) for i in range(n)] + [(1000 + i, t, None) for i, t in enumerate(TEXTS)]


def fts(rows, match, weights=(8.0, 2.0), tokenize="unicode61"):
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE f USING fts5(text, title, tokenize='{tokenize}')")
    db.executemany("INSERT INTO f(rowid, text, title) VALUES (?, ?, ?)", [(i, t or "", n or "") for i, t, n in rows])
    return dict(db.execute(f"SELECT rowid, -bm25(f, {weights[0]}, {weights[1]}) FROM f WHERE f MATCH ?", (match,)).fetchall())


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, title string")


def scores(df):
    return {r["id"]: r["score"] for r in df.collect()}


WEIGHTS = {"text": 8.0, "title": 2.0}
QUERIES = [["café"], ["NAIVE", "uber"], ["ete"], ["na"], ["ber"], ["foo_bar"], ["a a"], ["xy"], ["z"], ["strasse"], ["straße", "12"], ["σισυφος"], ["привет"], ["日本"], ["ộ"], ["l'été"], ["absent"]]


def test_folding_equals_the_embedded_engine():
    """Every character of old that is still of its kind, and every accent."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    letters = [c for c in map(chr, [*range(1, 0xD800), *range(0xF900, 0x10000)])]
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(ord(c), f"a{c}b") for c in letters])
    found = {}
    for term, row in db.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        found.setdefault(row, []).append(term)
    differ = [c for c in letters if found[ord(c)] != W.words_of(f"a{c}b")]
    old = unicodedata.ucd_3_2_0
    assert [c for c in differ if old.category(c) != "Cn" and old.category(c)[0] == unicodedata.category(c)[0] and ord(c) < 0x2000] == []
    assert len(W.ACCENTS) == 25 and all(found[ord(c)] == ["ab"] for c in W.ACCENTS)


def test_words_and_folding_are_equal_in_spark_and_python(spark):
    got = frame(spark, corpus(10)).select("text", F.transform(W.words(F.col("text")), W.folded).alias("w"), W.count_words(F.col("text")).alias("n")).collect()
    assert all(r.w == W.words_of(r.text) and r.n == len(r.w) for r in got)


@pytest.mark.parametrize("prefix", [False, True])
def test_scan_equals_the_embedded_engine(spark, prefix):
    rows = corpus()
    df = frame(spark, rows).cache()
    for query in QUERIES:
        star = "*" if prefix else ""
        any_of = fts(rows, " OR ".join(f'"{t}"{star}' for t in query))
        hits = X.bm25(df, query, "id", WEIGHTS, prefix=prefix)
        assert scores(hits) == pytest.approx(any_of), query
        assert set(scores(hits.where(F.col("matched") == len(query)))) == set(fts(rows, " AND ".join(f'"{t}"{star}' for t in query))), query


def test_order_equals_the_embedded_engine(spark):
    rows = corpus(200, 9)
    want = sorted(fts(rows, '"cafe" OR "foo"').items(), key=lambda x: (-x[1], x[0]))
    got = X.bm25(frame(spark, rows), ["cafe", "foo"], "id", WEIGHTS).orderBy(F.col("score").desc(), "id").collect()
    assert [r.id for r in got] == [i for i, _ in want]


def test_stems_equal_the_embedded_engine(spark):
    rng = random.Random(3)
    vocabulary = "running runs relational cats café planned résumés hopping the été".split()
    rows = [(i, " ".join(rng.choices(vocabulary, k=8)), rng.choice(vocabulary)) for i in range(60)]
    for query in (["running"], ["cats", "planned"], ["hopping"]):
        match = " OR ".join(f'"{t}"*' for t in query)
        assert scores(X.bm25(frame(spark, rows), query, "id", WEIGHTS, prefix=True, porter=True)) == pytest.approx(fts(rows, match, tokenize="porter unicode61"))


CHECKED = [["café", "a a"], ["NAIVE", "uber", "ete"], ["foo_bar"], ["absent"]]


def check(spark, path, rows, queries=CHECKED, prefix=False):
    star = "*" if prefix else ""
    for query in queries:
        assert scores(X.indexed(spark, path, query, WEIGHTS, prefix)) == pytest.approx(fts(rows, " OR ".join(f'"{t}"{star}' for t in query))), query


def test_index_follows_inserts_updates_and_deletes(spark, tmp_path):
    """After each change, hits, document frequencies and mean length are those of the texts that are left."""
    path, rows = f"file://{tmp_path}/index", {r[0]: r for r in corpus(60)}
    put = lambda part, **kw: X.change_index(spark, path, frame(spark, part), columns=["text", "title"], **kw)
    assert put(list(rows.values())) == 1
    check(spark, path, rows.values())
    check(spark, path, rows.values(), [["caf"], ["a"], ["foo_b"]], prefix=True)
    changed = [(i, "Café nouveau " * (i % 3), "naïve") for i in range(0, 60, 3)] + [(5000, "entirely new été", None)]
    gone = [1, 4, 1003, 77777]
    assert put(changed, drop=spark.createDataFrame([(i,) for i in gone], "id long")) == 2
    rows |= {r[0]: r for r in changed}
    rows = {i: r for i, r in rows.items() if i not in gone}
    check(spark, path, rows.values())
    check(spark, path, rows.values(), [["caf", "foo_b"], ["n"]], prefix=True)
    put([(0, "twice changed café", None), (1, "back again café", None)])  # a document that was removed comes back
    rows |= {0: (0, "twice changed café", None), 1: (1, "back again café", None)}
    check(spark, path, rows.values())
    assert X.compact(spark, path) == 4
    check(spark, path, rows.values(), QUERIES[:2] + [['ba', 'foo']])
    assert X.vacuum(spark, path) == 3 and X.vacuum(spark, path) == 0
    put([(0, "after compaction uber", None)])
    X.change_index(spark, path, drop=spark.createDataFrame([(1,)], "id long"))
    rows |= {0: (0, "after compaction uber", None)}
    rows.pop(1)
    check(spark, path, rows.values())
    X.change_index(spark, path, drop=spark.createDataFrame([(i,) for i in rows], "id long"))
    assert X.indexed(spark, path, ["cafe"]).collect() == []


def test_index_of_a_writer_that_died_or_lost_is_not_read(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    X.change_index(spark, path, frame(spark, [(1, "one", "t")]), columns=["text", "title"])
    with pytest.raises(ValueError, match="distinct"):
        X.change_index(spark, path, frame(spark, [(2, "two", "t"), (2, "two", "t")]))
    with pytest.raises(ValueError, match="distinct"):
        X.change_index(spark, path, frame(spark, [(None, "two", "t")]))
    real = X.commit
    nothing = dict.fromkeys(("rows", "words"), 0) | dict.fromkeys(("postings", "documents", "void"), False)
    monkeypatch.setattr(X, "commit", lambda s, p, n, b: (real(s, p, n, b | nothing | {"data": "other"}), real(s, p, n, b)))  # another writer was first
    with pytest.raises(C.CommitConflict):
        X.change_index(spark, path, frame(spark, [(3, "three", "t")]))
    monkeypatch.setattr(X, "commit", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        X.change_index(spark, path, frame(spark, [(4, "four", "t")]))
    assert scores(X.indexed(spark, f"file://{tmp_path}/index", ["one"])).keys() == {1} and X.indexed(spark, path, ["four"]).collect() == []


def test_index_reads_the_buckets_of_the_query_only(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    X.change_index(spark, path, frame(spark, corpus(30)), columns=["text", "title"])
    plan = X.indexed(spark, path, ["cafe"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan) and "EqualTo(term,cafe)" in plan


def test_index_in_two_appends_equals_one(spark, tmp_path):
    df = frame(spark, corpus(40))
    search.write_index(df.where("id < 20"), "id", ["text", "title"], f"file://{tmp_path}/a", porter=True)
    search.write_index(df.where("id >= 20"), "id", ["text", "title"], f"file://{tmp_path}/a", mode="append", porter=True)
    for query in (["cafes"], ["foo", "a"]):
        assert scores(X.indexed(spark, f"file://{tmp_path}/a", query, WEIGHTS)) == pytest.approx(scores(X.bm25(df, query, "id", WEIGHTS, porter=True)))
    assert not math.isnan(sum(scores(X.indexed(spark, f"file://{tmp_path}/a", ["a"])).values()))


def test_memory_search_filters_after_the_statistics(spark):
    rows = [(1, None, "café one", "t", ["ann"]), (2, "2024-01-02", "cafe cafe", "t", ["bo"]), (3, "2024-03-01", "le café", "t", ["ann", "bo"]), (4, "2023-01-01", "café", "t", ["ann"]), (5, None, "tea", "t", None), (6, None, "tea", "t", []), (7, None, "x", "t", [])]
    df = spark.createDataFrame(rows, "id long, date string, text string, title string, entities array<string>")
    found = search.memory_search(df, ["cafe"], since="2024-01-01", entity="ann")
    assert [r.id for r in found.collect()] == [1, 3] or [r.id for r in found.collect()] == [3, 1]
    assert search.snippet("un café très noir", ["CAFE"], 2) == ">>café<< très …" or "café" in search.snippet("un café très noir", ["CAFE"], 2)
