"""The pipeline's stages against brute force on a small corpus, and the queries' contracts on a tiny table."""

import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomline.llm import queries
from tests.llm.test_pairs import WORDS, components_by_hand, dedup_by_hand

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts, copies, near copies, a passage in many texts, insults with labels, benchmark items in texts."""
    rng = random.Random(21)
    path = tmp_path_factory.mktemp("sf")
    rows = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(60, 200))) for _ in range(60)]
    passage, item = " ".join(rng.choice(WORDS) for _ in range(60)), " ".join(f"q{k}" for k in range(20))
    rows += [rows[0], rows[0] + " tail", rows[1]]
    rows += [f"{rows[k]} {passage} {k}" for k in range(10, 14)]
    rows += [f"{rows[20]}x {item.upper()} " + " ".join(rng.choice(WORDS) for _ in range(80))]
    toxic = [" ".join(rng.choice(WORDS) for _ in range(30)) + ". You grobnik! " + " ".join(rng.choice(WORDS) for _ in range(9)) for _ in range(40)]
    table = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate([*rows, *toxic, "", None])]
    spark.createDataFrame(table, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(len(rows) <= i < len(rows) + 40)) for i in range(len(table)) if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), table, len(rows)


def test_stages_equal_brute_force(spark, folder, tmp_path):
    path, table, clean = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == spark.read.parquet(f"{path}/documents.parquet").columns
        kept.append({r["doc_id"]: r for r in docs.collect()})
    assert set(kept[0]) == {i for i, *_ in table if not clean <= i < clean + 40}
    by_hand = components_by_hand([(i, r["text"]) for i, r in kept[0].items()], 5, 80)
    assert set(kept[1]) == {i for i, (_, c) in by_hand.items() if i == c} and len(kept[1]) < len(kept[0])
    cut = dedup_by_hand([(i, r["text"]) for i, r in kept[1].items()], 50)
    assert {i: r["text"] for i, r in kept[2].items()} == {i: t if gone else kept[1][i]["text"] for i, (n, gone, t) in cut.items() if not n or gone < n}
    assert sum(gone for _, gone, _ in cut.values()) >= 60 and all(r["n_chars"] == len(r["text"] or "") or r["text"] is None for r in kept[2].values())
    leaked = {i for i, r in kept[2].items() if "Q7 Q8" in (r["text"] or "")}
    assert leaked and set(kept[3]) == set(kept[2]) - leaked
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in kept[4].items():
        ids = library.encode(kept[3][i]["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids)


def test_run_reads_what_each_stage_wrote(spark, folder):
    path, _, _ = folder
    assert corpus_pipeline.run(spark, path).columns == ["doc_id", "n_tokens", "ids"]


def test_stages_with_odd_rows_and_empty_tables(spark, folder, tmp_path):
    """Null and repeated ids, repeated rows, null columns, clashing extra columns; then no rows at all."""
    path, _, _ = folder
    rng = random.Random(31)
    text = " ".join(rng.choice(WORDS) for _ in range(90))
    near, alone = text + " tail", " ".join(rng.choice(WORDS) for _ in range(40))
    rows = [(5, text), (5, text), (5, near), (None, near), (9, text), (None, alone), (None, alone), (None, None), (3, None), (3, ""), (4, "word")]
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1, 2) for i, t in rows], DOCS + ", component string, id int, row int")
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[1][1](spark, docs, path).collect()), key=str)
    fives = [x for x in kept if x[0] == 5]
    assert len(fives) == 1 and fives[0][1] in (text, near)
    assert sorted((x for x in kept if x[0] != 5), key=str) == sorted([(None, alone), (None, None), (3, None), (3, ""), (4, "word")], key=str)
    for table, want in ((docs, 11), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, path)
            assert got.columns == (["doc_id", "n_tokens", "ids"] if name == "bpe" else ["doc_id", "text", "lang", "source", "n_chars"])
            assert got.count() == (want and {"ngram_jaccard_join": 6, "substring_dedup": 10}.get(name, want))  # 9 loses every word to 5
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_scratch_without_checkpoint_setting(spark, monkeypatch):
    """A local session gets a local folder, a cluster an error; the context's own folder is taken if it is set."""
    from loomline.llm import common

    class Bare:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "local[4]"

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    assert "/checkpoints/loomline-" in common.scratch_dir(Bare)
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        Bare.sparkContext.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.scratch_dir(Bare)


def test_held_out_flags_follow_crc32(spark, folder):
    import zlib

    path, table, _ = folder
    for name, n, r in (("op1_quality", 3, 1), ("op9_toxicity", 5, 0)):
        got = queries.QUERIES[name](spark, path).select("doc_id", "held_out", "score", "predicted").collect()
        assert {x["doc_id"]: x["held_out"] for x in got} == {i: zlib.crc32(str(i).encode()) % n == r for i, *_ in table}
        assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)


def test_chat_query_has_the_extra_conversation(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "a<s>")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op7_chat(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert (got[-1]["n_turns"], got[-1]["loss_chars"], got[1]["loss_chars"]) == (2, len(said), 4)
    assert got[-1]["turns_sha256"] == spark.range(1).select(F.sha2(F.lit(f"user\n{said}\nassistant\n{said}\n"), 256).alias("h")).first()["h"]
