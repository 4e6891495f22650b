"""The operators' queries opN_<name> over the driver's tables, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.adapters import spread
from loomline.llm.common import bounded_batches

#: Ids that are broadcast at most.
MAX_BROADCAST = 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    bounded_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return (spread(df) if name in ("documents", "pages") else df).select(*columns)


def _remainder(n: int) -> F.Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm import quality

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels", "doc_id", "quality").where(_remainder(3) != 1))
    return quality.score(docs, model).select(
        F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "focus"
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.jaccard_join import jaccard_components

    found = jaccard_components(_table(spark, sf_dir, "documents", "doc_id", "text"), size=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the labelled documents of good quality, the background all documents; own counts are left out."""
    from loomline.llm import lm_score

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    good = _table(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1").select("doc_id", F.lit(True).alias("good")).distinct()
    few = good.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST  # beyond that both sides are shuffled
    marked = docs.join(F.broadcast(good) if few else good, "doc_id", "left")
    return lm_score.score_corpus(marked, F.col("good")).select(F.col("id").alias("doc_id"), "n_tokens", "target_loss", "background_loss", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm import warc
    from loomline.llm.common import scratch_dir

    path = scratch_dir(spark)
    warc.write_archive(warc.archive_records(_table(spark, sf_dir, "pages", "page_id", "url", "html")), path)
    page = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    revisit = F.col("record_type") == "revisit"
    return warc.read_archive(spark, path).select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("payload_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.fingerprints import compare_with_edits

    found = compare_with_edits(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomline.llm.bpe import encode

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True).select(
        F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm import chat

    rows = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for k, role in enumerate(("user", "assistant"))
    ])).alias("r")).select("r.*")
    messages = rows.unionByName(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    done = chat.format_chat(messages).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item within 20 word edits in a hundred, and where."""
    from loomline.llm.decontaminate import contaminated

    found = contaminated(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance", "n_item_words", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm import toxicity

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels", "doc_id", "toxic").where(_remainder(5) != 0))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences"
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.substring_dedup import substring_dedup

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return substring_dedup(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of documents by source; the tampered leaf of every other document lacks its text's newlines."""
    from loomline.llm import merkle

    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = (_remainder(2) == 0) & F.contains("text", F.lit("\n"))
    tampered = F.when(hit, merkle.digest_of(*columns, F.replace("text", F.lit("\n"), F.lit(""))))
    folded = merkle.merkle_manifest(docs, other=tampered).withColumn("folded_root", merkle.fold_proof(F.col("other"), F.col("proof")))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    return folded.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.importance import resample

    drawn = resample(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "text"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.llm.simhash import simhash_components

    found = simhash_components(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_jaccard_join, op3_lm_score, op4_warc, op5_fingerprints, op6_bpe, op7_chat, op8_decontamination, op9_toxicity, op10_substring_dedup, op11_merkle_manifest, op12_importance_resampling, op13_simhash)
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS owner FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN owner IS NOT NULL AND owner IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN owner IS DISTINCT FROM page_id THEN owner END AS refers_to
        FROM o""",
    "op7_chat": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
            SELECT *, 3 + 6 + CASE role WHEN 'assistant' THEN 4 ELSE 7 END
                   + length(role) + len(regexp_extract_all(role, '[<\[]\\*/?(?:s>|INST\]|(?:image|audio|document):\d)'))
                   + length(text) + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\]|(?:image|audio|document):\d)')) AS piece
            FROM rows),
        joined AS (
            SELECT conv_id, count(*) AS n_turns, sum(piece)::BIGINT AS formatted_chars,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned
            FROM sized GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars
        FROM joined""",
    "op10_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        starts AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 48, 1))) AS s, words FROM w WHERE len(words) >= 50),
        windows AS (SELECT doc_id, s, array_to_string(words[s : s + 49], ' ') AS seq FROM starts),
        firsts AS (SELECT seq, min(doc_id) AS owner FROM windows GROUP BY seq HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT doc_id, s FROM windows JOIN firsts USING (seq) WHERE owner < doc_id),
        each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
        marked AS (
            SELECT e.doc_id, e.word, e.i, max(g.s) OVER (PARTITION BY e.doc_id ORDER BY e.i) AS last_start
            FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.s = e.i),
        kept AS (
            SELECT doc_id, count(*) FILTER (last_start IS NOT NULL AND i - last_start < 50) AS n_removed,
                   string_agg(word, ' ' ORDER BY i) FILTER (last_start IS NULL OR i - last_start >= 50) AS text
            FROM marked GROUP BY doc_id)
        SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op11_merkle_manifest": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                       || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                   text, replace(text, chr(10), '') AS bare,
                   list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT),
                       lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) & 1 = 1 AS even
            FROM documents),
        leaves AS (
            SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
                   sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) AS other, even
            FROM d),
        nodes AS (
            SELECT tree, 0 AS level, idx, n, leaf AS digest FROM leaves
            UNION ALL
            SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n),
        tops AS (
            SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM nodes WHERE n = 1) AS n, digest FROM nodes WHERE n = 1
            UNION ALL
            SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 3, n),
        runs AS (
            SELECT tree, level, idx // 3 AS run, list(digest ORDER BY idx) AS digests FROM nodes WHERE n > 1 GROUP BY ALL
            UNION ALL SELECT -1, level, idx // 3, list(digest ORDER BY idx) FROM tops WHERE n > 1 GROUP BY ALL),
        spots AS (
            SELECT doc_id, r.level, leaves.idx // (3 ** r.level)::BIGINT % 3 AS pos, digests FROM leaves JOIN runs r ON r.tree = leaves.tree AND r.run = leaves.idx // (3 ** (r.level + 1))::BIGINT
            UNION ALL SELECT doc_id, 1000 + r.level, leaves.tree // (3 ** r.level)::BIGINT % 3, digests FROM leaves JOIN runs r ON r.tree = -1 AND r.run = leaves.tree // (3 ** (r.level + 1))::BIGINT),
        proofs AS (
            SELECT doc_id, list({'b': array_to_string(digests[1 : pos], ''), 'a': array_to_string(digests[pos + 2 :], '')} ORDER BY level) AS steps FROM spots GROUP BY doc_id),
        done AS (
            SELECT doc_id, leaf, tree, coalesce(steps, []) AS steps, CASE WHEN even THEN other ELSE leaf END AS start FROM leaves LEFT JOIN proofs USING (doc_id)),
        folded AS (
            SELECT *, list_reduce([{'b': start, 'a': ''}] || steps, lambda x, s: {'b': sha256(s.b || x.b || s.a), 'a': ''}).b AS folded_root, (SELECT digest FROM tops WHERE n = 1) AS root FROM done)
        SELECT doc_id, leaf, nodes.digest AS subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.b || s.a), '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM folded JOIN nodes ON nodes.tree = folded.tree AND nodes.n = 1""",
    "op12_importance_resampling": r"""
        WITH crc AS (SELECT list(list_reduce([i] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
        texts AS (
            SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
        words AS (
            SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        features AS (
            SELECT side, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM words),
        counted AS (SELECT side, doc_id, f, count(*) AS n FROM features GROUP BY ALL),
        coded AS (
            SELECT f, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, 2 * strlen(f), 2), lambda i: (16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1)::BIGINT),
                lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
            FROM (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM counted)), crc),
        hits AS (SELECT side, doc_id, bucket, sum(n)::BIGINT AS n FROM counted JOIN coded USING (f) GROUP BY ALL),
        totals AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM hits GROUP BY bucket),
        alls AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM totals),
        gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM totals, alls),
        weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM hits JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
        scored AS (
            SELECT words.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || words.doc_id)[1:8])::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM words LEFT JOIN weights ON weights.doc_id = words.doc_id WHERE side = 0),
        ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
        SELECT scored.doc_id, n_features, weight, score, rank FROM scored LEFT JOIN ranked ON ranked.doc_id = scored.doc_id AND rank <= 5 * n // 100""",
}
