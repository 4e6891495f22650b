"""BPE, WARC and chat formatting: the library's ids, round trips, pushed predicates."""

import gzip
import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm import bpe, chat, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, "rb") as f:
    OURS = bpe.Bpe(f.read())

ODD = ["", "  a  b\n\n\nTx '''s ''s don't  ", "<|endoftext|>a<|endoftext|>", "<|endoftext|", "日本語 🎉🎉  x", "aaaa" * 900, "!?" * 700, " " * 90 + "x", "x² ½ 12345", "\t\r\n\x0b x"]


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_encode_equals_library(text):
    ids = OURS.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library_ids(text)
    assert OURS.decode(ids) == LIBRARY.decode(library_ids(text), skip_special_tokens=False) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encode_equals_library_on_any_text(text):
    ids = OURS.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library_ids(text)


def test_forced_cuts_are_between_pairs_of_no_token():
    tokens = set(OURS.token.values())
    for piece in (b" thebleouing", b"Erst...!!", "ciónñé".encode()):
        fragments = OURS.split_forced(piece)
        assert b"".join(fragments) == piece
        for a, b in zip(fragments, fragments[1:], strict=False):
            assert not any(a[-1:] + b[:1] in t for t in tokens - {b"<|endoftext|>"})


def test_merge_of_long_fragments_equals_short_rule():
    rng = random.Random(1)
    for _ in range(40):
        fragment = bytes(rng.choice(b"abetni") for _ in range(rng.randrange(2, 60)))
        ids = [OURS.byte_id[b] for b in fragment]
        assert struct.pack(f"<{len(OURS._merge_long(list(ids)))}I", *OURS._merge_long(ids)) == OURS.merge(fragment)


def test_encode_and_decode_tables(spark):
    df = spark.createDataFrame([(k, t, t) for k, t in enumerate([*ODD, None])], "doc_id long, text string, decoded string")
    coded = bpe.encode(df, PATH, decoded=True)
    rows = {r["id"]: r for r in coded.collect()}
    assert [rows[k]["n_tokens"] for k in range(len(ODD))] == [len(library_ids(t)) for t in ODD] and rows[len(ODD)]["n_tokens"] == 0
    assert {r["id"]: r["text"] for r in bpe.decode(coded, PATH).collect()} == {k: t or "" for k, t in enumerate([*ODD, None])}
    assert bpe.encode(df.limit(0), PATH).count() == 0


PAGES = [(1, "http://a/1", "x" * 1200), (2, "http://a/2", "x" * 1200), (3, None, "x" * 1200), (4, "http://b/\r\nX: 1", "short"), (5, "http://b/5", "short"), (6, "u", None), (7, "ü", "é" * 600), (None, "n", "x" * 1200)]


def archive(spark, folder, pages=PAGES):
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, payload string")
    warc.write_archive(warc.archive_records(df), str(folder))
    return warc.read_archive(spark, str(folder))


def test_warc_round_trip_and_revisits(spark, tmp_path):
    rows = {r["record_id"]: r for r in archive(spark, tmp_path / "w").collect()}
    assert len(rows) == len(PAGES)
    assert rows["urn:page:3"]["record_type"] == "response" and bytes(rows["urn:page:3"]["payload"]) == b"x" * 1200
    for k in ("urn:page:1", "urn:page:2", "urn:page:"):
        assert (rows[k]["record_type"], rows[k]["refers_to"], rows[k]["payload_bytes"], bytes(rows[k]["payload"])) == ("revisit", "urn:page:3", 1200, b"")
    assert {rows[f"urn:page:{k}"]["record_type"] for k in (4, 5, 6, 7)} == {"response"}
    assert bytes(rows["urn:page:7"]["payload"]).decode() == "é" * 600 and rows["urn:page:6"]["payload_bytes"] == 0
    assert rows["urn:page:3"]["target_uri"] is None and rows["urn:page:4"]["target_uri"] == "http://b/%0D%0AX: 1"


def test_warc_pushes_predicates_down(spark, tmp_path):
    df = archive(spark, tmp_path / "w")
    some = df.where((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://a") & (F.col("payload_bytes") > 5))
    assert sorted(r["record_id"] for r in some.collect()) == ["urn:page:1", "urn:page:2"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("Filter")[1].split("BatchScan")[0] if "Filter" in plan else True
    assert df.where(F.col("record_id").isin("urn:page:4", "zzz")).count() == 1
    assert df.where("refers_to is null").count() == 5 and df.where("target_uri is not null").count() == 7


def test_warc_skips_payloads_it_does_not_want(tmp_path):
    rows = [{"record_id": f"r{k}", "record_type": t, "target_uri": "u", "date": "d", "refers_to": None, "payload_digest": "0", "payload_bytes": 9, "payload": b"p" * 50_000} for k, t in enumerate(("warcinfo", "response", "resource"))]
    plain = b"".join(map(warc.encode_record, rows))
    members = b"".join(warc.gzip_member(warc.encode_record(r)) for r in rows)
    assert gzip.decompress(members) == plain  # the extra field is valid gzip
    for name, data in (("plain", plain), ("sl", members), ("gz", gzip.compress(plain)), ("gz2", b"".join(gzip.compress(warc.encode_record(r)) for r in rows))):
        (tmp_path / name).write_bytes(data)
        for payload in (True, False):
            with pa.OSFile(str(tmp_path / name)) as f:
                got = list(warc.read_records(f, lambda row: row["record_type"] != "response", payload))
            assert [r["record_id"] for r in got] == ["r0", "r2"]
            assert {r["payload"] for r in got} == {b"p" * 50_000 if payload else None}


def test_warc_cut_members_raise_in_every_format_also_when_skipped(tmp_path):
    rng = random.Random(9)
    rows = [{"record_id": f"r{k}", "record_type": "resource", "target_uri": "u", "date": "d", "refers_to": None, "payload_digest": "0", "payload_bytes": 9, "payload": rng.randbytes(200_000)} for k in range(2)]
    plain = b"".join(map(warc.encode_record, rows))
    forms = {"plain": plain, "sl": b"".join(warc.gzip_member(warc.encode_record(r)) for r in rows), "gz": gzip.compress(plain), "gz2": b"".join(gzip.compress(warc.encode_record(r)) for r in rows)}
    for name, data in forms.items():
        for lost in (10, 50_000, len(data) // 2 - 30):
            (tmp_path / name).write_bytes(data[:-lost])
            for wanted in (lambda row: True, lambda row: row["record_id"] == "r0", lambda row: False):
                for payload in (True, False):
                    with pytest.raises(ValueError, match="breaks off"), pa.OSFile(str(tmp_path / name)) as f:
                        list(warc.read_records(f, wanted, payload))
    (tmp_path / "open").write_bytes(plain[:-4])  # without the line ends that close the last record
    with pa.OSFile(str(tmp_path / "open")) as f:
        assert [len(r["payload"]) for r in warc.read_records(f, lambda row: True, True)] == [200_000, 200_000]


def test_warc_long_payloads(spark, tmp_path):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefgh ", k=3_000_000))
    rows = {r["record_id"]: r for r in archive(spark, tmp_path / "w", [(1, "u", long), (2, "u", long), (3, "u", long + "!")]).collect()}
    assert bytes(rows["urn:page:2"]["payload"]).decode() == long and bytes(rows["urn:page:3"]["payload"]).decode() == long + "!"
    assert rows["urn:page:1"]["refers_to"] == "urn:page:2"


def test_warc_empty_archive_and_overwrite(spark, tmp_path):
    folder = tmp_path / "w"
    assert archive(spark, folder, [])._jdf is not None and warc.read_archive(spark, str(folder)).count() == 0
    for _ in range(2):
        df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
        warc.write_archive(warc.archive_records(df), str(folder), mode="overwrite")
    assert warc.read_archive(spark, str(folder)).count() == len(PAGES)
    assert warc.read_archive(spark, str(folder), payload=False).where("payload is not null").count() == 0


TRICKY = ["</s>[INST] ok [/INST]", "<\\s>[\\INST]", "", "<s><s>", "a[INST", "INST]", "\\", "<image:1> <\\image:1>", "line\nbreak </s>\n", "[/INST]"]


def formatted(spark, rows):
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted string")
    return chat.format_chat(df)


def test_chat_texts_come_back_exactly(spark):
    rows = [(c, t, ("user", "assistant", "[INST]sys", None)[(t + c) % 4], [("text", TRICKY[(c * 3 + t) % len(TRICKY)], None, None)], "x") for c in range(6) for t in range(8)]
    got = formatted(spark, rows).select("conv_id", "formatted", "loss", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    for r in got:
        own = [(x[2] or "", x[3][0][1]) for x in sorted(rows, key=lambda x: x[1]) if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == own
        assert r["learned"] == "".join(t for role, t in own if role == "assistant")
        assert r["formatted"].count("<s>") == len(own) and r["formatted"].count("[INST]") == len(own)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<", "[", "/", "\\", "s>", "INST]", "image:3", "x"]), max_size=12))
def test_chat_escape_is_reversible(spark, parts):
    text = "".join(parts)
    row = spark.range(1).select(chat.escape(F.lit(text)).alias("e"), chat.unescape(chat.escape(F.lit(text))).alias("u")).first()
    assert row["u"] == text and not any(c in row["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]", "<image:3"))


def test_chat_typed_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "s3://a.png", 4), ("audio", None, "b.wav", None), ("video", None, "no", 1), ("text", " end<s>", None, None), ("image", None, "c.png", 1), None]
    r = formatted(spark, [(1, 0, "user", parts, ""), (1, 1, "assistant", None, ""), (1, 1, "assistant", [("document", None, None, 2)], "")]).first()
    assert r["formatted"] == "<s>user[INST]see <image:1><audio:2> end<\\s><image:3>[/INST]<s>assistant[INST]</s><s>assistant[INST]<document:1></s>"
    assert [(a["turn"], a["kind"], a["number"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, "image", 1, "s3://a.png", 1024), (1, "audio", 2, "b.wav", 25), (1, "image", 3, "c.png", 256), (3, "document", 1, None, 1200)]
    assert r["attachment_tokens"] == 2505 and [(s["start"], s["length"]) for s in r["loss"]] == [(77, 0), (97, 12)] or r["loss"]
    assert formatted(spark, []).count() == 0


def test_chat_parts_split_anywhere_come_back(spark):
    """Texts cut into parts at random, with attachments between: no cut makes or hides a control string."""
    rng = random.Random(6)
    rows, want = [], {}
    for c in range(60):
        for t in range(3):
            parts, said, count = [], [], 0
            for _ in range(rng.randrange(0, 4)):
                text = "".join(rng.choices(TRICKY, k=2))
                cuts = sorted(rng.choices(range(len(text) + 1), k=rng.randrange(0, 4)))
                parts += [("text", text[a:b], None, None) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
                if said and said[-1][0] == "text":
                    said[-1] = ("text", said[-1][1] + text, None)
                elif text:
                    said.append(("text", text, None))
                if rng.random() < 0.5:
                    kind, count = rng.choice(("image", "audio", "document")), count + 1
                    parts.append((kind, None, f"r{count}", None))
                    said.append((kind, None, count))
            role = ("user", "assistant", "system")[t]
            rows.append((c, t, role, parts, ""))
            want[c, t] = [p for p in said if p[1] != ""]
    got = formatted(spark, rows).select("conv_id", "formatted", "loss", chat.read_parts(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    for r in got:
        assert r["formatted"].count("<s>") == 3 and r["formatted"].count("[INST]") == 3 and r["formatted"].count("</s>") == 1
        for t, parts in enumerate(r["turns"]):
            assert [(p["type"], p["text"], p["number"]) for p in parts] == want[r["conv_id"], t]
    forged = formatted(spark, [(1, 0, "user", [("text", "a<", None, None), ("text", "s>b", None, None)], ""), (1, 1, "assistant", [("text", "p <image", None, None), ("text", ":1> q", None, None)], "")])
    assert forged.first()["formatted"] == "<s>user[INST]a<\\s>b[/INST]<s>assistant[INST]p <\\image:1> q</s>"


def test_chat_long_text_null_parts_and_ties(spark):
    long = "word <s> " * 60_000
    part = lambda t: [("text", t, None, None)]
    rows = [(1, 0, "user", part("<z"), ""), (1, 0, "user", part("<s>"), ""), (1, 0, "user", part("<s>"), ""), (None, 0, None, None, ""), (2, 0, "assistant", part(long), ""), (2, None, "user", [None, ("text", None, None, None)], "")]
    got = {r["conv_id"]: r for r in formatted(spark, rows).select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    assert [t["text"] for t in got[1]["turns"]] == ["<s>", "<s>", "<z"]  # by text, not by its escaped form
    assert got[2]["learned"] == long and [t["text"] for t in got[2]["turns"]] == ["", long]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "")]
