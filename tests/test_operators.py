"""Invariants and laws of the operators: ladders, merges, folds, packing, tiers, streams."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomline.queries import texts
from loomline.operators import claims, dedup, nightly, facts, merge, pack, recall, search, sessions, vector
from loomline.sources import files
from loomline.streaming import exchanges


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_overfetch_ranks_before_it_filters(spark):
    index = spark.createDataFrame([(i, [float(i), 0.0], "a" if i % 10 == 9 else "b") for i in range(60)], "memory_id long, embedding array<double>, category string")
    q, keep = [0.0, 0.0], vector.category_filter(include="a")
    assert [r["memory_id"] for r in vector.nearest_filtered(index, q, 4, keep).collect()] == [9, 19]
    assert [r["memory_id"] for r in vector.nearest_filtered(index, q, 4, keep, exact=True).collect()] == [9, 19, 29, 39]
    assert [r["memory_id"] for r in vector.nearest_escalated(index, q, 4, keep).collect()] == [9, 19, 29, 39]
    with pytest.raises(ValueError, match="dimensions"):
        vector.check_width([1.0], 2)
    with pytest.raises(Exception, match="the query has 1"):
        vector.nearest(index, [0.0], 3).collect()
    with pytest.raises(Exception, match="dimensions"):
        vector.nearest_many(index, spark.createDataFrame([(1, [0.0])], "query_id long, embedding array<double>"), 2).collect()


def test_category_filters_and_nulls(spark):
    index = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "memory_id long, category string")
    assert rows(index.where(vector.category_filter(include="a")), "memory_id") == [(0,)]
    assert rows(index.where(vector.category_filter(exclude=["a"])), "memory_id") == [(1,), (2,)]
    assert recall.hidden_categories("session_log", None) == [] and recall.hidden_categories(None, None) == ["session_log"] and recall.hidden_categories(None, []) == []
    with pytest.raises(ValueError, match="agent_id"):
        recall.tenant_scope(index, None)


def test_fusion_keeps_the_best_and_the_first_place(spark):
    passes = spark.createDataFrame([("x", 0.5, 0, 1), ("y", 0.9, 0, 2), ("x", 0.8, 1, 1), ("y", 0.9, 1, 2)], "key string, relevance double, pass_no int, position int")
    got = {r["key"]: (r["relevance"], r["pass_no"], tuple(r["seen_at"])) for r in recall.fuse(passes).collect()}
    assert got == {"x": (0.8, 1, (0, 1)), "y": (0.9, 0, (0, 2))}


def test_expansion_gap_is_strict(spark):
    pool = lambda *r: spark.createDataFrame([(x,) for x in r], "relevance double")
    ask = lambda p, q="one two three": recall.should_expand(p, q).first()["expand"]
    assert ask(pool()) and not ask(pool(), "one two") and ask(pool(0.51, 0.5, 0.5)) and not ask(pool(0.75, 0.5, 0.25))


def test_fact_ladder(spark):
    steps = [("initial", "a", "high_probability"), ("reassert", "a", "verified"), ("rejected", "b", "high_probability"), ("contradicted", "c", "verified"), ("demote", None, None), ("skip", None, None), ("contradicted", "d", "false")]
    events = [("e", "k", n, "demote" if s in ("demote", "skip") else "save", v, c) for n, (s, v, c) in enumerate(steps)]
    done = facts.steps(spark.createDataFrame(events[::-1], "entity string, attribute string, seq long, kind string, value string, confidence string"))
    r = facts.state(done).first()
    assert (r["value"], r["confidence"], r["steps"]) == ("d", "false", 6)
    assert [h["reason"] for h in facts.history(done).orderBy("seq").collect()] == [x for x, _, _ in steps if x != "skip"]
    assert rows(facts.verified_alerts(done), "seq") == [(2,)]
    lone = facts.steps(spark.createDataFrame([("e", "k", 1, "demote", None, None)], "entity string, attribute string, seq long, kind string, value string, confidence string"))
    assert rows(facts.state(lone), "entity", "value", "steps") == [("e", None, 0)] and facts.history(lone).count() == 0


def test_fact_merge_is_commutative_and_idempotent(spark):
    kinds = [(v, c, t) for v in "xy" for c in ("false", "high_probability", "verified") for t in (1, 2)]
    schema = "entity string, attribute string, value string, confidence string, created_at int, last_updated int"
    a = spark.createDataFrame([(f"{i}-{j}", "k", *x[:2], 1, x[2]) for i, x in enumerate(kinds) for j in range(len(kinds))], schema)
    b = spark.createDataFrame([(f"{i}-{j}", "k", *y[:2], 2, y[2]) for i in range(len(kinds)) for j, y in enumerate(kinds)], schema)
    cols = ("entity", "value", "confidence", "created_at", "last_updated")
    ab = facts.merge_rows(a, b)
    differing = [(x, y) for x, y in zip(rows(ab, *cols), rows(facts.merge_rows(b, a), *cols), strict=True) if x[:3] != y[:3] or x[4] != y[4]]
    assert not differing
    assert rows(facts.merge_rows(ab, ab), *cols) == rows(ab, *cols)
    assert rows(facts.merge_rows(a, a.limit(0)), *cols) == rows(a, *cols)


def test_three_way_merge_outcomes(spark):
    side = lambda **k: spark.createDataFrame(list(k.items()) or [("-", "-")], "path string, hash string").where("path != '-'")
    got = dict(rows(merge.three_way(side(same="1", edit_s="1", edit_h="2", del_s="1", both="2", new_h="1"), side(same="1", edit_s="2", edit_h="1", both="3", del_h="1"), side(same="1", edit_s="1", edit_h="1", del_s="1", del_h="1", both="1")), "path", "action"))
    assert got == {"same": "same", "edit_s": "to_host", "edit_h": "to_stick", "del_s": "delete_host", "del_h": "delete_stick", "both": "conflict", "new_h": "to_stick"}


def test_retry_dedup_window_starts_at_the_last_kept_copy(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "k", t0 + timedelta(seconds=s)) for i, s in enumerate((0, 600, 1200, 1900, 2101))], "id long, key string, ts timestamp")
    assert [i for _, i in rows(sessions.drop_retries(df, ["key"], "ts", "id"), "key", "id")] == [0, 2, 4]


def test_sessions_split_on_gaps_and_on_length(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "k", t0 + timedelta(minutes=m)) for i, m in enumerate((0, 60, 121, 122, 123, 124))], "id long, key string, ts timestamp")
    assert [s for _, s in rows(sessions.sessions(df, "key", "ts", "id", most=3), "id", "session_no")] == [1, 1, 2, 2, 2, 3]


def test_trailing_user_turn_is_held_back(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")], "conv_id long, turn long, role string, text string")
    assert rows(sessions.pair_turns(df), "turn", "prompt", "response") == [(0, "a", "b")]


def test_greedy_chunks_is_not_a_prefix_sum(spark):
    df = spark.createDataFrame([("k", i, n) for i, n in enumerate((6, 6, 4, 20, 1))], "key string, i long, n long")
    assert rows(pack.greedy_chunks(df, ["key"], "i", "n", 10), "i", "chunk") == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 3)]


def test_grep_lines_and_bullets(spark):
    df = spark.createDataFrame([(1, "a\nNEEDLE\nb\nc\nneedle"), (2, "none")], "id long, t string")
    assert rows(search.grep_lines(df, "needle", "id", "t"), "line_no", "line") == [(1, "a"), (2, "NEEDLE"), (3, "b"), (4, "c"), (5, "needle")]
    text = "# Top\n- fact c=0.9 likes @Ann and @a.b-c\n* not one\n- lonely\n####### too deep\n##  Deep \n  -  Decision took @Bo\n- idea c=2 x"
    got = search.markdown_bullets(spark.createDataFrame([(1, text, "x/2026-03-09.md")], "id long, t string, p string"), "id", "t", "p").collect()
    assert [(r["line_no"], r["heading"], r["kind"], r["confidence"], r["text"], r["entities"], r["date"]) for r in got] == [
        (2, "Top", "fact", 0.9, "likes Ann and a.b-c", ["Ann", "a.b-c"], "2026-03-09"), (7, "Deep", "decision", None, "took Bo", ["Bo"], "2026-03-09"), (8, "Deep", "idea", 2.0, "x", [], "2026-03-09"),
    ]


def test_strongest_disposition_ignores_unknown(spark):
    arrays = spark.createDataFrame([(["allow", "??"],), (["local_only", "review_required"],), ([],)], "d array<string>")
    assert [r["s"] for r in arrays.select(claims.strongest(F.col("d")).alias("s")).collect()] == ["allow", "local_only", "allow"]


def test_class_scores_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "truth string, guess string")
    got = {r["label"]: (r["support"], r["precision"], r["recall"], r["f1"]) for r in claims.class_scores(df).collect()}
    assert got == {"a": (2, 0.5, 0.5, 0.5), "b": (1, 0.5, 1.0, pytest.approx(2 / 3)), "c": (1, 0.0, 0.0, 0.0)}


def test_memory_and_log_sources_skip_what_is_broken(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text(json.dumps({"id": "a", "summary": "s", "key_facts": ["f", "g"]}))
    (tmp_path / "m/b.json").write_text(json.dumps({"id": "b", "summary": "t", "superseded_by": "a"}))
    (tmp_path / "m/c.json").write_text('{"id": "c", ')
    assert rows(files.canonical_text(files.memories(spark, str(tmp_path / "m"))), "id", "text") == [("a", "s\nf\ng")]
    (tmp_path / "l.jsonl").write_text('{"prompt": "p q", "response": "r"}\nnot json\n{"prompt": "x", "respo')
    assert rows(files.exchange_log(spark, str(tmp_path / "l.jsonl")), "prompt", "response") == [("p q", "r")]
    (tmp_path / "t").mkdir()
    for name in ("ok.txt", ".env", "id_rsa", "my_token.json"):
        (tmp_path / "t" / name).write_text("x")
    assert rows(files.inventory(spark, f"file:{tmp_path}/t"), "name") == [("ok.txt",)]


def test_streams_equal_batches(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    batch = spark.createDataFrame([(i, f"k{i % 3}", t0 + timedelta(seconds=137 * i)) for i in range(60)], "id long, key string, ts timestamp")
    batch.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = exchanges.drain(exchanges.drop_retries(stream, ["key"], "ts", "id", late="1 day"), str(tmp_path / "a"))
    assert rows(got, "id") == rows(sessions.drop_retries(batch, ["key"], "ts", "id"), "id")
    got = exchanges.drain(exchanges.accept_limited(stream, ["key"], "ts", "id", limit=2, within=900, late="1 day"), str(tmp_path / "b"))
    assert rows(got, "id", "accepted") == rows(sessions.accept_limited(batch, ["key"], "ts", "id", limit=2, within=900), "id", "accepted")


def test_registry_has_a_twin_for_every_query_but_the_named():
    from loomline.queries import ORACLE_SQL, QUERIES

    assert set(QUERIES) - set(ORACLE_SQL) == {"fuzzy_claims", "salvaged_notes", "packed_briefs", "stemmed_search"} and set(ORACLE_SQL) <= set(QUERIES)


def test_salvage(spark):
    replies = spark.createDataFrame([(1, '[{"a": 1}, {"b": {"c": "}"}}, {"d": '), (2, "no json"), (3, None), (4, 'Facts [extracted]: [{"a": "x\ny"}, {"b"'), (5, '```json\n[{"a": 1}]\n```'), (6, '{"a": 2}')], "id int, r string")
    got = {r["id"]: r["o"] for r in replies.select("id", nightly.salvaged(F.col("r")).alias("o")).collect()}
    assert got == {1: ['{"a": 1}', '{"b": {"c": "}"}}'], 2: [], 3: [], 4: ['{"a": "x\\ny"}'], 5: ['{"a": 1}'], 6: ['{"a": 2}']}


def test_section_packing():
    brief = "Intro line\n# Notes\nlong line of notes\nmore\n## What was Shipped\n- x\n- y\n### Next steps\n- z"
    whole = pack.pack_sections(brief, 10_000)
    assert whole == "Intro line\n\n## What was Shipped\n- x\n- y\n\n### Next steps\n- z\n\n# Notes\nlong line of notes\nmore\n\nDROPPED: nothing"
    for budget in range(40, 140):  # whole lines only, every loss named, never over
        try:
            got = pack.pack_sections(brief, budget)
        except ValueError:
            assert budget < 60
            continue
        assert pack.units(got) <= budget
        body, _, lost = got.rpartition("DROPPED: ")
        assert all(line in brief.split("\n") for line in body.split("\n") if line)
        for name, own in (("preamble", ["Intro line"]), ("Notes", ["long line of notes", "more"]), ("What was Shipped", ["- x", "- y"]), ("Next steps", ["- z"])):
            missing = [x for x in own if x not in body.split("\n")]
            assert (name in lost) == bool(missing) and (f"{name} (trimmed)" in lost) == (0 < len(missing) < len(own))
    assert pack.pack_sections("a\nb\n\U0001F600", 30) == "a\nb\n\U0001F600\n\nDROPPED: nothing"
    assert pack.pack_sections("one\ntwo\nthree four five", 40).startswith("one\ntwo\n\nDROPPED: narrative (trimmed)")


def test_drop_lines_and_recall_scores(spark):
    v = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    drop = lambda t, *n: v(nightly.drop_lines(F.lit(t), F.array(*[F.lit(k) for k in n]).cast("array<int>")))
    assert drop("a\nb\nc\n", 2, 9, 2) == "a\nc\nDROPPED: 1 invalid stated line(s) after corrective retry"
    assert drop("a\nb", 7) == "a\nb" and drop("a\nb") == "a\nb" and drop("", 1) == ""
    assert v(nightly.reported_lines(F.lit("line 3  bad\n  line 12 x\nnot line 4 "))) == [3, 12]
    none = F.lit(None).cast("array<string>")
    score = lambda level, ctx, want, kw=None: v(nightly.recall_score(F.lit(level), F.lit(ctx), F.lit(want), F.array(*[F.lit(k) for k in kw]) if kw else none))
    assert score("needle", "it was $0.47 today", "$0.47") == "correct" and score("needle", "about 62 degrees", "62\u00b0F cold") == "partial"
    assert score("needle", "the router", "Fixed router classifier") == "partial" and score("needle", "with the rest", "with that") == "wrong" and score("needle", "  ", "x") == "not_found"
    assert score("chain", "Port 80 open", "x", ["port", "80", "closed", "gone", "no"]) == "partial" and score("chain", "a b c d", "x", ["a", "b", "c", "d", "zz"]) == "correct"
    assert score("general", "deployed images", "Deployed catalog images today") == "partial" and score("general", "", "Deployed catalog") == "wrong"
    scores = spark.createDataFrame([("correct",), ("partial",), ("wrong",)], "score string")
    assert tuple(nightly.recall_accuracy(scores).first()) == (3, 50.0)


def _best_claims_by_force(new, active, least=claims.DUPLICATE_RATIO):
    import difflib

    clean = lambda t: " ".join(t.lower().split())
    out = set()
    for i, x in new:
        ranked = sorted((-difflib.SequenceMatcher(None, clean(x), clean(y)).ratio(), j) for j, y in active)
        if ranked and -ranked[0][0] >= least:
            out.add((i, ranked[0][1], round(-ranked[0][0], 6)))
    return out


def test_fuzzy_duplicates_in_blocks(spark):
    words = ("linen", "almond", "steel", "puff", "navy", "ghost")
    active = [(k, f"The user likes  a {words[k % 6]} {words[k % 5]} of Brand#{k % 7}") for k in range(60)]
    new = [(k, f"the user liked a {words[k % 4]} {words[k % 6]} of Brand#{k % 9}") for k in range(20)] + [(99, "nothing alike")]
    got = claims.fuzzy_duplicates(spark.createDataFrame(new, "obs_id long, claim string"), spark.createDataFrame(active, "claim_id long, claim string"))
    assert {tuple(r) for r in got.collect()} == _best_claims_by_force(new, active)


def test_fuzzy_duplicates_of_any_texts_equal_brute_force(spark):
    """Short, repetitive, empty and long texts at several ratios; no nested loops; few pairs are compared."""
    rng = random.Random(3)
    some = ["", "a", "ab", "aaaa", "aaaaa", "abab", "ababab", "The  cat", "the cat", "the cab", "the car sat", "x" * 40, "x" * 38 + "y", "ü ß", "Ü ß!"]
    some += ["".join(rng.choices("abc ", k=rng.randrange(1, 14))) for _ in range(60)]
    some += [" ".join(rng.choices(["likes", "green", "tea", "coffee", "late", "tests"], k=6)) for _ in range(40)]
    active = [(i, t) for i, t in enumerate(some)] + [(1000, None)]
    new = [(i, t[: rng.randrange(len(t) + 1)] + rng.choice(["", "e", " a"]) + t[rng.randrange(len(t) + 1) :]) for i, t in enumerate(some)] + [(5000, None)]
    a, n = spark.createDataFrame(active, "claim_id long, claim string").cache(), spark.createDataFrame(new, "obs_id long, claim string").cache()
    for least in (0.85, 0.6):
        got = claims.fuzzy_duplicates(n, a, least)
        want = _best_claims_by_force([x for x in new if x[1] is not None], [x for x in active if x[1] is not None], least)
        assert {tuple(r) for r in got.collect()} == want
    assert "NestedLoop" not in claims.fuzzy_duplicates(n, a)._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_claims_searches_all_parts(spark, tmp_path):
    rows = [(k, f"part {chr(97 + k % 26) * 9} {k * 7919}", f"Brand#{k % 5}") for k in range(1, 151)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    new = [(k, f"the user liked  a {n} of {b}") for k, n, b in rows if k % 50 == 0]
    active = [(k, f"The user likes a {n} of {b}") for k, n, b in rows]
    assert {tuple(r) for r in texts.fuzzy_claims(spark, str(tmp_path)).collect()} == _best_claims_by_force(new, active) and len(new) == 3


def test_many_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "MAX_QUERIES", 7)
    points = [(k, [float(k * k % 101), float(k % 13)]) for k in range(40)]
    index = spark.createDataFrame(points, "memory_id long, embedding array<double>")
    near = lambda v, k: [i for _, i in sorted(((v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2, i) for i, w in points)[:k]]
    want = {(i, j, r) for i, v in points for r, j in enumerate(near(v, 3), 1)}
    got = vector.nearest_many(index, index.select(F.col("memory_id").alias("query_id"), "embedding"), 3)
    assert {(r["query"], r["id"], r["rank"]) for r in got.collect()} == want
    rows = index.select(F.col("memory_id").alias("id"), F.col("embedding").alias("vector"), F.array(F.lit("a")).alias("tokens"))
    assert {(r["query"], r["id"]) for r in dedup.nearest_candidates(rows, rows, 3).collect()} == {(i, j) for i, j, _ in want}


def test_lists_over_ten_thousand_entries(spark):
    allow = spark.range(12_000).select(F.col("id").cast("string").alias("x"), F.when(F.col("id") == 11_000, "*").otherwise((F.col("id") + 1).cast("string")).alias("y"))
    pairs = spark.createDataFrame([(k, k + 1) for k in range(11_500, 12_001)] + [(3, 11_000), (5, 9)], "a long, b long")
    assert {tuple(r) for r in dedup.not_allowed(pairs, allow).collect()} == {(12_000, 12_001), (5, 9)}
    rows = spark.createDataFrame([("/d11999/x",), ("/none",)], "path string")
    prefixes = spark.range(12_000).select(F.concat(F.lit("/d"), F.col("id").cast("string"), F.lit("/")).alias("prefix"))
    assert [tuple(r) for r in nightly.longest_prefix(rows, prefixes, "path", "prefix").collect()] == [("/d11999/x", "/d11999/")]


def test_packed_briefs_see_whole_documents(spark, tmp_path):
    from loomline.queries import QUERIES

    rows = [(1, "\n".join(f"line {k}" for k in range(500)), "src1"), (2, "short", "src2")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["brief"] for r in QUERIES["packed_briefs"](spark, str(tmp_path)).collect()}
    assert got == {i: pack.pack_sections(f"# Notes\n{t}\n## Built\n- a thing\n## Open\n- {s}", 90) for i, t, s in rows}
