"""Findings about larger tables: equal results on odd rows and on tables in several files, and work that does not grow faster than them."""

import hashlib
import os
import random

import duckdb
from pyspark.sql import functions as F

from loomline import adapters as A
from loomline.functions import digest
from loomline.operators import fulltext as T
from loomline.operators import ledger as L
from loomline.operators import wiki as W
from loomline.queries import ORACLE_SQL, QUERIES
from loomline.queries import provenance as R
from loomline.streaming import exchanges as X


def _twin(d, name):
    """Rows of a query's twin over tables that are files or folders of files."""
    con = duckdb.connect()
    for t in os.listdir(d):
        path = f"{d}/{t}/*.parquet" if os.path.isdir(f"{d}/{t}") else f"{d}/{t}"
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(ORACLE_SQL[name])
    return [c[0] for c in found.description], sorted(found.fetchall(), key=repr)


def _equals_twin(spark, d, name):
    rows = QUERIES[name](spark, str(d))
    columns, twin = _twin(str(d), name)
    assert sorted((tuple(r[c] for c in columns) for r in rows.collect()), key=repr) == twin
    return twin


def test_recall_grades_rounds_halves_as_its_twin(spark, tmp_path):
    """A tenth of 45 characters is 4.5: four of them, which do not make up the first keyword."""
    spark.createDataFrame([(91, "abcde " + "z" * 39)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(91, "q", "en", "src1", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert _equals_twin(spark, tmp_path, "recall_grades") == [(91, "wrong")]


def _states(stream, path):
    """Rows that a stream gives, and the most states that it held."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    held = max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out"), held


def _arrivals(spark, rows, at, path):
    """Rows as a stream of two files: those under the condition come first."""
    rows.where(at).coalesce(1).write.parquet(path)
    rows.where(f"NOT ({at})").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams_read_tables_in_several_files_and_pairs_keep_null_texts(spark, tmp_path):
    rows = [(c, t, ("user", "assistant")[t % 2], None if (c + t) % 5 == 0 else f"text {c} {t}") for c in range(40) for t in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert len(_equals_twin(spark, tmp_path, "stream_turn_pairs")) == 120


def test_facts_of_many_keys_are_held_in_few_states(spark, tmp_path):
    orders = spark.range(9000).select(F.col("id").alias("o_orderkey"), F.expr("id % 3000").alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.expr("concat(id % 4, '-X')").alias("o_orderpriority"), F.expr("timestamp_seconds(id * 1000)").alias("o_orderdate"))
    events = R._events(orders)
    stream = _arrivals(spark, events, "seq < 4500", f"{tmp_path}/in")
    found, held = _states(L.ledger_stream(stream), f"{tmp_path}/run")
    assert held <= 1024
    assert sorted(L.facts_of(found).collect(), key=repr) == sorted(L.facts_of(L.ledger(events)).collect(), key=repr)


def test_retries_of_many_keys_are_held_in_few_states(spark, tmp_path):
    rows = spark.range(6000).select(F.expr("id % 3000").alias("user_id"), F.lit("x").alias("prompt"), F.expr("timestamp_seconds(1700000000 + (id DIV 3000) * (id % 200))").alias("ts"), F.col("id").alias("event_id"))
    found, held = _states(X.drop_retries(_arrivals(spark, rows, "event_id < 3000", f"{tmp_path}/in"), ["user_id", "prompt"], "ts", "event_id", within=100, late="1 hour"), f"{tmp_path}/run")
    assert held <= 1024 and found.count() == 3000 + 1500
    limited, held = _states(X.accept_limited(_arrivals(spark, rows, "event_id < 3000", f"{tmp_path}/in2"), ["user_id"], "ts", "event_id", limit=1, within=100, late="1 hour"), f"{tmp_path}/run2")
    assert held <= 1024 and limited.where("accepted").count() == 3000 + 1500


def test_dropped_lines_cuts_a_text_into_lines_once(spark, tmp_path):
    texts = ["a\nb\n c\nd\n", "one", "", None, "\n\n\n", "x\n" * 500]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["dropped_lines"](spark, str(tmp_path))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert len(_equals_twin(spark, tmp_path, "dropped_lines")) == len(texts)


def test_searches_fold_a_text_once_and_read_it_once(spark, tmp_path):
    texts = ["Café café CAFE l'été", "d'une l ete or l ete", "für fur fur", "", "cafés", "noted idiots", "noting an idiot's notes", "the idiot the idiot"]
    rows = [(k, t, ("en", "fr")[k % 2], f"src{k % 3}", 1) for k, t in enumerate(texts * 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("accent_search", "bm25_search", "indexed_search"):
        assert _equals_twin(spark, tmp_path, name)
    for name in ("accent_search", "bm25_search", "stemmed_search"):
        plan = QUERIES[name](spark, str(tmp_path))
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString()
        final = text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
        assert "(?<!" not in final, "looks behind at every place of a text"
        assert final.count("translate(") <= 2 + (name == "stemmed_search"), "folds a column again"


def test_postings_meet_in_their_document_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "b a, B", "x"), (2, None, ""), (3, "", "a a")], "id long, text string, name string")
    rows = T.postings(docs, "id", ["text", "name"])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect())) == [(1, 4, 0, "a", [1]), (1, 4, 0, "b", [0, 2]), (1, 4, 1, "x", [0]), (3, 2, 1, "a", [0, 1])]


def test_large_tables_of_one_row_group_are_dealt_out(spark, tmp_path, monkeypatch):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(A, "SPREAD_BYTES", (1, 1000))
    monkeypatch.setattr(A, "PIECE_BYTES", 1 << 30)
    table = A.table(spark, str(tmp_path), "documents")
    busy = table.groupBy(F.spark_partition_id()).count().count()
    assert busy == spark.sparkContext.defaultParallelism and table.count() == 5000
    rows.repartition(spark.sparkContext.defaultParallelism).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert "Exchange" not in A.table(spark, str(tmp_path), "documents")._jdf.queryExecution().executedPlan().toString()


def test_only_texts_of_near_pairs_are_cut_into_tokens(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.expr("concat('alpha beta gamma delta epsilon zeta', id % 9)").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(30).cast("long").alias("n_chars"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(200).select(F.col("id").alias("vec_id"), F.expr("transform(sequence(1, 8), k -> cast(1 + 0.1 * sin(k * id) AS float))").alias("embedding"), F.lit(1).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("written_near_duplicates", "nightly_duplicates"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        filters = [x for x in plan.splitlines() if "Filter" in x and "[a-z0-9]+" in x]
        assert not filters, name
        assert _equals_twin(spark, tmp_path, name)


def test_a_digest_goes_on_where_it_was_left(monkeypatch):
    rng = random.Random(1)
    for way in (digest._fast, digest._plain):
        monkeypatch.setattr(digest, "_blocks", way)
        for _ in range(20):
            pieces = [rng.randbytes(rng.randrange(200)) for _ in range(rng.randrange(8))]
            state = digest.START
            for piece in pieces:
                state = digest.update(state, piece)
            assert digest.hexdigest(state) == hashlib.sha256(b"".join(pieces)).hexdigest()


def test_a_large_topic_is_many_parts(spark):
    """Records of one time, equal ones, topics without name, records without text and topics without any record's text."""
    rows = [("p", "big", f"2024-01-{i % 9:02}" if i % 7 else None, f"record {i % 50} \u00e9" * (i % 5)) for i in range(3000)]
    rows += [("p", f"small{k}", "2024", f"text {i}") for k in range(6) for i in range(k + 1)] + [(None, "big", "2024", "x"), ("p", None, None, "y"), ("p", "none", "2024", None), ("p", "small1", "2025", None)]
    clusters = spark.createDataFrame(rows, "section string, slug string, timestamp string, block string").repartition(5)
    pages = spark.createDataFrame([("p", "big", " so far \n"), ("p", "other", "x"), ("p", "small2", "")], "section string, slug string, body string")
    heads, parts = W.topic_prompt_parts(clusters, pages, part_bytes=8_000, row_bytes=1_000)
    parts = parts.persist()
    want = {(r["section"], r["slug"]): (r["n"], r["prompt"]) for r in W.topic_prompts(clusters, pages).collect()}
    texts = {(r["section"], r["slug"]): (r["n"], r["head"]) for r in heads.collect()}
    for r in parts.orderBy("part", "at").collect():
        n, text = texts[r["section"], r["slug"]]
        texts[r["section"], r["slug"]] = n, text + r["text"]
    assert texts == want
    sizes = [r["s"] for r in parts.groupBy("part").agg(F.sum(F.octet_length("text")).alias("s")).collect()]
    assert len(sizes) > 8 and max(sizes) < len(want["p", "big"][1]) / 4
    found = {(r["section"], r["slug"]): (r["n"], r["sha256"]) for r in W.prompt_digests(heads, parts).collect()}
    assert found == {k: (n, hashlib.sha256(text.encode()).hexdigest()) for k, (n, text) in want.items()}


def test_topic_prompts_equal_their_sql_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W.topic_prompt_parts, "__defaults__", (W.PromptWords(), 20_000, 3_000))
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.expr("concat('  alpha beta ', id % 9, repeat(' w', cast(id % 60 AS int)))").alias("text"), F.expr("if(id % 3 = 0, 'de', 'en')").alias("lang"), F.expr("concat('src', id % 4)").alias("source"), F.lit(30).cast("long").alias("n_chars"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert _equals_twin(spark, tmp_path, "topic_prompts")


def test_topic_prompts_of_an_empty_table(spark):
    none = spark.createDataFrame([], "section string, slug string, timestamp string, block string")
    assert W.prompt_digests(*W.topic_prompt_parts(none, none.select("section", "slug", F.col("block").alias("body")))).count() == 0


def _documents(spark, texts, path, langs=("en",)):
    """A table of documents: each text in each language, under ids from 0."""
    rows = [(i, text, lang, f"src{i % 3}", 0) for i, (text, lang) in enumerate((t, g) for t in texts for g in langs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")


def test_canonical_text_has_a_row_for_each_document(spark, tmp_path):
    """Empty and blank texts keep their line, null ones have no digest, and 4000 characters are code points."""
    _documents(spark, ["", None, " ", "\t\n", "a", " " * 5000, "e\u0301\U0001f469\u200d\U0001f467\r\n" * 700, "x" * 3996, "y" * 3999], tmp_path, ("en", "", None))
    twin = _equals_twin(spark, tmp_path, "canonical_text")
    assert len(twin) == 27 and twin[0][1] == hashlib.sha256(b"\nen\nsrc0").hexdigest() and sum(digest is None for _, digest in twin) == 11


def test_category_resolution_of_odd_texts_equals_its_twin(spark, tmp_path):
    """Empty, null and blank texts and quoted logs are no noise; boundaries of words are ASCII, and without case s and k have three forms."""
    texts = ["", None, " ", "\t\n", "[AUTO-CAPTURE] bug", "x (auto-sync from JSONL) policy", "invoked tool: picked", "\u00e9port", "a bug\u00e9", "a\u0301port", "inci\u017fe", "ho\u017ft", "a\u017fervice", "a bro\u212ae", "PIC\u212aED", "\u00e9:8080", "a:8080\u00e9", " :8080", "x10.0.0.1", "\u00df10.0.0.1", "wouldn't it be", "is the AI agent\u00e9", "report", "nothing"]
    _documents(spark, [t for t in texts for _ in range(84)], tmp_path)
    assert len(_equals_twin(spark, tmp_path, "category_resolution")) > 8
    assert len(_equals_twin(spark, tmp_path, "suggested_category")) > 5
