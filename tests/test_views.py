import json

from pyspark.sql import functions as F

from loomline.operators import claims, index, nightly, sessions


def test_claim_files_are_unnested_and_exported(spark):
    c = lambda i, status="active", scope=None, sure=None: {"claim_id": i, "claim": f"says {i}", "type": "preference", "scope": scope, "confidence": sure, "status": status}
    own = {"owner_id": "o1", "stable_core": {"zeta": [c("z1", sure=0.5), c("z2", "retired", sure=0.9)], "alpha": [c("a1", scope=["work"], sure=0.5), c("a2")], "none": None},
           "negative_constraints": [c("n1", scope=["work", "home"], sure=0.7)], "situational_overlays": [{"overlay_id": "1", "name": "calm", "traits": None, "status": "active"}, {"overlay_id": "2", "name": "off", "status": "off"}]}
    rows = [own, {"owner_id": "o2"}]
    df = spark.createDataFrame([(json.dumps(x),) for x in rows], "v string").select(F.from_json("v", claims.CLAIM_FILE).alias("x")).select("x.*")
    every = claims.section_claims(df).orderBy("place").collect()
    assert [(r["section"], r["claim_id"]) for r in every] == [("stable_core.zeta", "z1"), ("stable_core.zeta", "z2"), ("stable_core.alpha", "a1"), ("stable_core.alpha", "a2"), ("negative_constraints", "n1")]
    out = {r["owner_id"]: r for r in claims.exported(df).collect()}
    assert [x["claim_id"] for x in out["o1"]["claims"]] == ["n1", "z1", "a1", "a2"]
    assert [tuple(x) for x in out["o1"]["overlays"]] == [("1", "calm", [])] and out["o2"]["claims"] == out["o2"]["overlays"] == []
    ids = lambda **k: [x["claim_id"] for x in claims.exported(df, **k).where("owner_id = 'o1'").first()["claims"]]
    assert ids(scopes=["work"]) == ["n1", "a1"] and ids(scopes=[]) == ids() and ids(limit=2) == ["n1", "z1"]


def test_confidence_is_a_word_or_a_number(spark):
    given = ["low", " HIGH ", "medium", "0.45", "7", "-1", "sure", "", None, "nan"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x string").select("k", claims.confidence_number(F.col("x")).alias("c")).orderBy("k").collect()
    assert [r["c"] for r in got] == [0.3, 0.9, 0.6, 0.45, 1.0, 0.0, 0.6, 0.6, 0.6, 0.6]


def test_corpus_entries_become_observations(spark):
    shape = "id string, label string, rationale string, observation struct<pattern:string,confidence:string,source_platform:string,source_session_id:string,context:string,evidence:array<struct<quote:string,turn_ref:string,origin_type:string,provenance_bucket:string>>>"
    entries = [("e1", "toxic", None, ("likes tea", "high", "cli", "s1", "kitchen", [("q", None, "typed", "trusted_local"), (None, "t7", None, None)])), ("e2", "benign", "r", (None, None, None, None, "", None))]
    a, b = claims.corpus_observations(spark.createDataFrame(entries, shape)).orderBy("obs_id").collect()
    assert (a["claim"], a["confidence"], a["tags"], a["label"], a["status"]) == ("likes tea", 0.9, ["kitchen"], "toxic", "pending")
    assert [tuple(x) for x in a["evidence"]] == [("e1_ev_0", "e1:turn-0", "q", "typed", "trusted_local"), ("e1_ev_1", "t7", "", None, None)]
    assert (b["claim"], b["confidence"], b["tags"], b["evidence"], b["platform"]) == ("", 0.6, [], [], "")


def test_project_notes_name_their_facts(spark):
    rows = [(1, "s", "did it", ["the DEEP sea", None, "else"], ["Deep Sea", "x y", None]), (2, None, None, None, ["p"]), (3, "s", "t", ["a"], None)]
    got = nightly.project_notes(spark.createDataFrame(rows, "memory_id long, session_id string, summary string, key_facts array<string>, projects array<string>")).orderBy("memory_id", "project").collect()
    assert [(r["memory_id"], r["project"], r["facts"]) for r in got] == [(1, "Deep Sea", ["the DEEP sea"]), (1, "x y", []), (2, "p", [])]
    assert got[0]["text"] == "Project: Deep Sea\nSession: s\nSummary: did it\nFacts:\n- the DEEP sea" and got[2]["text"] == "Project: p\nSession: \nSummary: \n"


def test_health_of_parts_and_tenants(spark):
    tenants = spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "hot long, warm long, cold long")
    status = lambda *p: tuple(nightly.health(tenants, F.array(*[F.lit(x).cast("boolean") for x in p])).first())
    assert status(True, True) == (5, 7, 9, "ok") and status(True, None)[3] == "degraded" and status(False, None)[3] == "down"
    assert tuple(nightly.health(tenants.limit(0), F.array(F.lit(True))).first()) == (0, 0, 0, "ok")


def test_calls_meet_their_last_result(spark):
    calls = spark.createDataFrame([("c1", "ls"), ("c2", "cat"), ("c3", "rm"), (None, "x")], "call_id string, tool string")
    results = spark.createDataFrame([("c1", 1, "old", 1, "o"), ("c1", 2, "ok", 0, "y" * 300), ("c2", 1, None, None, None), (None, 1, "s", 0, "z"), ("c9", 1, "s", 0, "z")], "call_id string, place int, status string, exit_code int, output string")
    got = {r["tool"]: (r["status"], r["exit_code"], r["output"]) for r in sessions.with_results(calls, results).collect()}
    assert got == {"ls": ("ok", 0, "y" * 200), "cat": ("", None, ""), "rm": (None, None, None), "x": (None, None, None)}


def test_paths_meet_their_longest_prefix(spark):
    paths = spark.createDataFrame([("a/b/c",), ("a/x",), ("b",), ("",), (None,)], "path string")
    found = lambda *p: {r["path"]: r["p"] for r in nightly.longest_prefix(paths, spark.createDataFrame([(x,) for x in p], "p string"), "path", "p").collect()}
    assert found("a/", "a/b", "a/b/c/d", None) == {"a/b/c": "a/b", "a/x": "a/"}
    assert found("", "b") == {"a/b/c": "", "a/x": "", "b": "b", "": ""} and found() == {}


def test_backfill_embeds_every_text_once(spark, tmp_path):
    class Counting:
        name, width, most = "counting", 1, 4000

        def embed(self, texts, query=False):
            for t in texts:
                with open(tmp_path / "calls", "a") as f:
                    f.write(f"{t}\n")
            return [[1.0] for _ in texts]

    rows = spark.createDataFrame([(k, f"text {k}") for k in range(6)], "memory_id long, text string")
    have = spark.createDataFrame([(0, [9.0])], "memory_id long, embedding array<double>")
    filled, statistics = index.backfill(rows, have, Counting())
    assert tuple(statistics.first()) == (6, 5, 1, 0, 0) and filled.count() == 6 and filled.where("memory_id = 0").first()["embedding"] == [9.0]
    assert sorted((tmp_path / "calls").read_text().splitlines()) == [f"text {k}" for k in range(1, 6)]
