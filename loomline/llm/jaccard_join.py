"""N-gram Jaccard join as a grouped prefix join.

A document's set holds the distinct hashes of its word shingles. Two sets link when their Jaccard similarity is at
least ``percent`` / 100. Sets are ordered by one global order, rare shingles first; two sets that link share a shingle
among their first n - ceil(percent * n / 100) + 1, their prefix.

Plan.
1. Shingles are counted, as often as they occur, over all documents: each task sends sorted distinct hashes, packed, by
   hash range, and each range adds them up. Shingles of a level (log2 of the count) above a chosen one form the table of frequent
   shingles that all workers get; the level rises until the table has at most MAX_FREQUENT entries. The order is
   (level of a frequent shingle or 0, hash). Any global order is right; this one keeps posting lists short.
2. One pass over the texts writes (id, set size, hash of the set, prefix, parity bits). Equal sets become one class,
   classes with equal prefix and size one group.
3. Groups post their prefix shingles. Shingles that one group posts end there. Round one pairs each group with the
   first group of the posting lists and size bands of its three rarest shingles, and each class with the first class
   of its group. Round two does so again with what is left of the lists, cut by hash into STARS ways of buckets of about
   BUCKET groups, so that a member of a loose cluster meets many others. Both make pairs linear in the postings; pairs
   are verified on whole sets, links become components.
4. Round three takes what can still matter: from lists with more than one component, group pairs of fitting size and
   of different components, counted over all shingles they share in their prefixes. Of a pair that links, all shared
   shingles but the ones past a prefix are among those, so a pair that shares too few is out. The others are expanded
   to their classes and verified. Pairs within a component need no check, so thousands of near copies never become
   all pairs.

Parity bits filter pairs before any join emits them. Bit k of a set's PARITY_BITS is the parity of the number of its
shingles that hash to k, so two sets differ in at least as many shingles as bits. A pair whose bits differ in more
places than its sizes allow cannot link: texts that are close but not close enough never become pairs, in round three
inside the join's condition. The bits of sets much larger than PARITY_BITS tell little and let pairs pass to the
later filters; no link is ever lost to them.

Links that round three skips join classes that are connected already, so components are those of all links.

Defined cases: null and empty texts, and texts without words, have an empty set, link with nothing and are their own
component; equal rows are equal sets and their set is read once; a row with a null id gets the smallest id that its
component has (null if none); an empty table gives no rows; other columns are not returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import WordHash, discard, materialize, pack_sorted, range_slices, release, shingle_hashes, sized, texts_of, tidy, total_chars, unpack_sorted
from loomline.llm.components import connected_components

#: Bounds of memory: hashes one task gathers before it sends, hashes of one counting range, entries of the table of
#: frequent shingles, and the least count that makes a shingle frequent.
SEND_HASHES, RANGE_HASHES, MAX_FREQUENT, LEAST_FREQUENT = 1_500_000, 1_500_000, 2_000_000, 8
#: Ids that are broadcast at most; prefix shingles of a group that round one uses.
MAX_BROADCAST, LEADING = 1_000_000, 3
#: Ways in which round two cuts posting lists into buckets, and groups in a bucket.
STARS, BUCKET = 2, 8
#: Leading bits of a shingle by which a worker sees at once that it is not frequent.
HEAD_BITS = 24
#: Parity bits of a set, in columns of 64.
PARITY_BITS = 512
BITS = [f"p{k}" for k in range(PARITY_BITS // 64)]


def shingle_set(words: WordHash, text: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased."""
    return np.unique(shingle_hashes(words.of(text.lower().split()), size))


def set_key(found: np.ndarray) -> int:
    return int.from_bytes(blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity_bits(found: np.ndarray) -> np.ndarray:
    """The set's parity bits as signed 64-bit integers, by its hashes' leading bits."""
    odd = np.bincount((found >> np.uint64(64 - int(np.log2(PARITY_BITS)))).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sends(size: int, bits: int, mask: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, count = WordHash(), [], 0

        def packed() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            rows = [(r, pack_sorted(found[s]), np.minimum(times[s], 2**32 - 1).astype("<u4").tobytes()) for r, s in range_slices(found, bits)]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary()), pa.array([_squeeze(x[2]) for x in rows], pa.binary())],
                names=["range", "hashes", "times"],
            )

        for batch in sized(batches):
            for text in texts_of(batch.column(0)):
                held.append(shingle_hashes(words.of(text.lower().split()), size) & np.uint64(mask))
                count += len(held[-1])
                if count >= SEND_HASHES:
                    yield packed()
                    held, count = [], 0
        if count:
            yield packed()

    return send


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4")


def _add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    tidy()
    hashes = np.concatenate([unpack_sorted(h) for h in table.column("hashes").to_pylist()])
    times = np.concatenate([_expand(t) for t in table.column("times").to_pylist()]).astype(np.uint64)
    order = np.argsort(hashes, kind="stable")
    hashes, times = hashes[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    sums = np.add.reduceat(times, first)
    often = sums >= LEAST_FREQUENT
    return pa.table({"hash": pa.array(hashes[first][often].view(np.int64)), "level": pa.array(np.log2(sums[often]).astype(np.int32))})


def frequent_shingles(texts: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """A mask, the sorted masked hashes of frequent shingles, at most MAX_FREQUENT, and their levels.

    Counting needs only enough leading bits to tell the shingles of this input apart: 8 more than their number has.
    """
    _, chars = total_chars(texts, "text")
    bits = max(0, int(np.ceil(np.log2(max(1, chars / 5 / RANGE_HASHES)))))
    mask = (2**64 - 1) ^ (2 ** (64 - min(56, max(32, int(np.log2(max(1, chars / 5))) + 8))) - 1)
    counted = materialize(
        texts.mapInArrow(_sends(size, bits, mask), "range int, hashes binary, times binary").groupBy("range").applyInArrow(_add_up, "hash long, level int")
    )
    left, least = MAX_FREQUENT, 64
    for row in sorted(counted.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        if row["count"] > left:
            break
        left, least = left - row["count"], row["level"]
    table = counted.where(F.col("level") >= least).toArrow()
    discard(counted)
    hashes = table.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return mask, hashes[order], table.column("level").to_numpy().astype(np.uint8)[order]


def _signs(size: int, percent: int, shared):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, hot, level = shared.value
        words = WordHash()
        heads = np.zeros(1 << HEAD_BITS, bool)  # leading bits of frequent shingles: most others need no search
        heads[hot >> np.uint64(64 - HEAD_BITS)] = True
        for batch in sized(batches):
            n, keys, prefixes, parity = [], [], [], []
            for text in texts_of(batch.column(1)):
                found = shingle_set(words, text, size)
                n.append(len(found))
                keys.append(set_key(found))
                parity.append(parity_bits(found))
                if len(hot):
                    maybe = np.flatnonzero(heads[found >> np.uint64(64 - HEAD_BITS)])
                    cut = found[maybe] & np.uint64(mask)
                    at = np.minimum(np.searchsorted(hot, cut), len(hot) - 1)
                    rank = np.zeros(len(found), np.uint8)
                    rank[maybe] = np.where(hot[at] == cut, level[at], 0)
                    found = found[np.argsort(rank, kind="stable")]
                prefixes.append(found[: prefix_length(len(found), percent)].view(np.int64) if len(found) else None)
            ends = np.cumsum([0] + [0 if p is None else len(p) for p in prefixes])
            flat = np.concatenate([p for p in prefixes if p is not None] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), *(pa.array(x) for x in np.stack(parity).T)],
                names=["id", "text_hash", "n", "sid", "prefix", *BITS],
            )

    return sign


def _set_bytes(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sent = WordHash(), set()
        for batch in sized(batches):
            found = {}
            for text in texts_of(batch.column(0)):
                own = shingle_set(words, text, size)
                if (key := set_key(own)) not in sent:
                    sent.add(key)
                    found[key] = own.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["sid", "members"])

    return sets


def _links(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches):
            keep = []
            for a, b in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # two sorted runs: one merge
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b", "a_comp", "b_comp"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _fits(percent: int, a: str, b: str) -> Column:
    """Sizes that can reach the threshold."""
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def _near(percent: int, total: Column, one: str, other: str) -> Column:
    """Whether parity bits allow a link of two sets with ``total`` elements together; true where a side has none."""
    need = F.ceil(percent * total / (100 + percent))
    apart = sum((F.bit_count(F.col(one + p).bitwiseXOR(F.col(other + p))) for p in BITS[1:]), F.bit_count(F.col(one + BITS[0]).bitwiseXOR(F.col(other + BITS[0]))))
    return F.coalesce(apart <= total - 2 * need, F.lit(True))


def _as(prefix: str, *columns: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in columns]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """Per row: id, text_hash, n_shingles, component_id (smallest id linked), and for sets that are not empty sid, the class of
    equal sets, and component, which is one value for all rows that are linked."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hot = frequent_shingles(docs.select("text"), size)
    release(spark)
    shared = spark.sparkContext.broadcast(hot)
    signed = materialize(docs.select("id", "text", F.xxhash64("text")).mapInArrow(_signs(size, percent, shared), f"id long, text_hash long, n long, sid long, prefix array<long>, {', '.join(f'{p} long' for p in BITS)}"))
    full = signed.where("n > 0")

    classes = materialize(
        full.groupBy("sid", "n", "prefix", *BITS).agg(F.min("id").alias("rep"))
        .withColumn("gid", F.xxhash64("n", "prefix"))
    )
    one = [F.when(F.col("m") == 1, F.col(p)).alias(p) for p in BITS]  # a group of several classes has no bits of its own
    groups = materialize(classes.groupBy("gid", "n", "prefix").agg(F.min("sid").alias("head"), F.count("*").alias("m"), *[F.min(p).alias(p) for p in BITS]).select("gid", "n", "prefix", "head", "m", *one))
    posted = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    shared_tokens = posted.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1").select("token")
    lists = materialize(posted.join(shared_tokens, "token").select("token", "gid", "n", "pos"))

    # round one: the first group of each list and size band, and the first class of each group
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100))) if percent < 100 else F.col("n")
    banded = lists.where(F.col("pos") < LEADING).select("token", band.alias("band"), "gid")
    firsts = banded.groupBy("token", "band").agg(F.min("gid").alias("other"))
    star = _heads(banded.join(firsts, ["token", "band"]).where("gid != other").select("gid", "other").distinct(), groups)
    inner = classes.join(groups.where("m > 1").select("gid", "head"), "gid").where("sid != head").select(F.col("sid").alias("a"), F.col("head").alias("b"))
    lone = classes.select("sid", "gid", "n", "rep", *BITS, F.col("sid").alias("comp"))
    known, of_one = _joined(lone, _close(star.union(inner), lone, percent), docs, size, percent)
    release(spark)

    # round two: buckets of the lists that still hold several components
    placed = materialize(_mixed(lists.select("token", "gid", "n"), known).select("token", "gid", "n"))
    salt = F.explode(F.array(*[F.struct(F.lit(k).alias("way"), F.pmod(F.xxhash64("gid", "token", F.lit(k)), F.ceil(F.col("c") / BUCKET)).alias("salt")) for k in range(STARS)]))
    dealt = placed.join(placed.groupBy("token").agg(F.count("*").alias("c")), "token").select("token", "gid", salt.alias("s")).select("token", "gid", "s.way", "s.salt")
    firsts = dealt.groupBy("token", "way", "salt").agg(F.min("gid").alias("other"))
    star = _heads(dealt.join(firsts, ["token", "way", "salt"]).where("gid != other").select("gid", "other").distinct(), groups)
    known_two, of_two = _joined(known, _close(star, known, percent), docs, size, percent)
    release(spark)

    # round three: all pairs of lists and groups that hold several components still
    left = materialize(_mixed(placed, known_two).join(groups.select("gid", *BITS), "gid"))
    x = left.where("minor").select("token", *_as("x_", "gid", "n", "comp", *BITS))
    y = left.select("token", *_as("y_", "gid", "n", "comp", "minor", *BITS))
    apart = (F.col("x_gid") != F.col("y_gid")) & ~F.coalesce(F.col("x_comp") == F.col("y_comp"), F.lit(False)) & (~F.col("y_minor") | (F.col("x_gid") < F.col("y_gid")))
    total = F.col("x_n") + F.col("y_n")
    met = x.join(y, "token").where(apart & _fits(percent, "x_n", "y_n") & _near(percent, total, "x_", "y_")).select(
        F.least("x_gid", "y_gid").alias("g"), F.greatest("x_gid", "y_gid").alias("h"), total.alias("sum"), F.greatest("x_n", "y_n").alias("top")
    )
    # shingles past the prefix of the set whose prefix ends first are all that can be shared besides the ones met
    beyond = F.ceil(percent * F.col("top") / 100) - 1
    need = F.ceil(percent * F.col("sum") / (100 + percent))
    group_pairs = met.groupBy("g", "h", "sum", "top").agg(F.count("*").alias("met")).where(F.col("met") >= need - beyond).select("g", "h")
    torn = _state(known_two).where("comp is null").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    side = known_two.select("gid", "sid", "n", "rep", "comp", *BITS)
    rest = (
        group_pairs.union(torn).join(side.select(*_as("x_", *side.columns)), F.col("g") == F.col("x_gid"))
        .join(side.select(*_as("y_", *side.columns)), (F.col("h") == F.col("y_gid")) & (F.col("x_comp") != F.col("y_comp")) & ((F.col("g") != F.col("h")) | (F.col("x_sid") < F.col("y_sid"))) & _near(percent, total, "x_", "y_"))
        .select(F.col("x_sid").alias("a"), F.col("y_sid").alias("b"), F.col("x_comp").alias("a_comp"), F.col("y_comp").alias("b_comp"), F.col("x_rep").alias("a_rep"), F.col("y_rep").alias("b_rep"))
    )
    final, of_three = _joined(known_two, rest, docs, size, percent)
    smallest = final.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_class = materialize(final.join(smallest, "comp").select(F.col("sid").alias("class"), F.col("comp").alias("component"), "component_id"))
    rows = signed.select("id", "text_hash", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid"))
    out = rows.join(by_class, F.col("sid") == F.col("class"), "left").select(
        "id", "text_hash", F.col("n").alias("n_shingles"), "sid", "component", F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
    discard(classes, groups, lists, placed, left, *of_one, *of_two, *of_three)
    release(spark)
    return out


def _heads(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of groups (gid, other) as pairs of their first classes (a, b)."""
    head = groups.select("gid", "head")
    pairs = pairs.join(head, "gid").select(F.col("head").alias("a"), F.col("other").alias("gid"))
    return pairs.join(head, "gid").select("a", F.col("head").alias("b"))


def _close(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components whose sizes and parity bits allow a link, with what their verification needs."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = known.select("sid", "n", "rep", "comp", *BITS)
    allowed = (F.col("x_comp") != F.col("y_comp")) & _fits(percent, "x_n", "y_n") & _near(percent, F.col("x_n") + F.col("y_n"), "x_", "y_")
    pairs = pairs.join(side.select(*_as("x_", *side.columns)), F.col("a") == F.col("x_sid")).join(side.select(*_as("y_", *side.columns)), (F.col("b") == F.col("y_sid")) & allowed)
    return pairs.select("a", "b", F.col("x_comp").alias("a_comp"), F.col("y_comp").alias("b_comp"), F.col("x_rep").alias("a_rep"), F.col("y_rep").alias("b_rep"))


def _state(known: DataFrame) -> DataFrame:
    """(gid, comp) of each group; null if its classes lie in several components."""
    ends = known.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return ends.select("gid", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("comp"))


def _mixed(lists: DataFrame, known: DataFrame) -> DataFrame:
    """The posting lists with more than one component, with comp and whether the group is outside the list's largest."""
    placed = lists.join(_state(known), "gid")
    sizes = placed.groupBy("token", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("token").agg(F.max(F.when(F.col("comp").isNotNull(), F.struct("c", "comp"))).alias("top"), F.count("*").alias("comps"), F.count("comp").alias("whole"))
    mixed = mixed.where("comps > 1 or whole < comps").select("token", F.col("top.comp").alias("major"))
    minor = F.col("comp").isNull() | F.col("major").isNull() | (F.col("comp") != F.col("major"))
    return placed.join(mixed, "token").withColumn("minor", F.coalesce(minor, F.lit(True))).drop("major")


def _joined(known: DataFrame, pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """``known`` with the components that the pairs' links make, and the scratch tables of the round."""
    pairs = materialize(pairs)
    links = materialize(_verified(pairs, docs, size, percent).select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct())
    merged = connected_components(links)
    after = known.withColumnRenamed("comp", "was").join(merged, F.col("was") == F.col("node"), "left")
    after = materialize(after.select("sid", "gid", "n", "rep", *BITS, F.coalesce("component", "was").alias("comp")))
    return after, [pairs, links, merged, after]


def _whole_sets(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The whole set of each class in the pairs, once, from the text of its smallest id, or from its texts if it has no id.

    The ids are broadcast while they are at most MAX_BROADCAST; beyond that both sides are shuffled.
    """
    wanted = pairs.select(F.col("a_rep").alias("id")).union(pairs.select(F.col("b_rep").alias("id"))).distinct()
    few = wanted.count() <= MAX_BROADCAST
    named = wanted.where("id is not null")
    texts = docs.join(F.broadcast(named) if few else named, "id", "left_semi").select("text")
    if not wanted.where("id is null").isEmpty():
        texts = texts.union(docs.where("id is null").select("text").distinct())
    return texts.mapInArrow(_set_bytes(size), "sid long, members binary").dropDuplicates(["sid"])


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b, a_comp, b_comp) that link."""
    sets = _whole_sets(docs, pairs, size)
    a, b = sets.select(F.col("sid").alias("a"), F.col("members").alias("x")), sets.select(F.col("sid").alias("b"), F.col("members").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_comp", "b_comp", "x", "y").mapInArrow(_links(percent), "a long, b long, a_comp long, b_comp long")
