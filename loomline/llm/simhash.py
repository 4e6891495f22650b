"""SimHash near-duplicates: fingerprints of which few bits differ, found by a byte-position inverted index.

A fingerprint has 64 bits; a bit is 1 if more than half of the hashes of the text's word shingles, repeats included,
have it. The hash is XXH64, words are lower-cased A-Z. Two rows link when their fingerprints differ in at most ``bits``
bits (4); a row's component is the smallest id that its links reach.

Method. ``bits`` differing bits touch at most ``bits`` of the 8 bytes, so linked fingerprints share at least 8 - ``bits``
positional bytes. Lists of single positional bytes would hold a 256th of all fingerprints each; so postings are of
sets of positions, chosen so that every choice of 8 - ``bits`` positions holds one of them, and of as many bytes as it takes
for few lists to hold two fingerprints by chance. Pairs that meet in a list tally their shared positional bytes;
those with the guaranteed number are retained and verified by counting bits.

Plan. Texts are read once, fingerprints written; equal fingerprints are one from then on, however many copies have
them. No list emits all its pairs:

- fingerprints of lists longer than ``HOT`` are first joined to all that differ in up to two bits, by the
  65 values within one bit of each: those that share such a value are linked to the least of them, a row each;
- in a list, pairs are compared across the components found so far only: the members outside the list's largest component
  with all members, dealt out in chunks of ``CHUNK`` members; short lists have all members compared;
- a list with more than ``MINOR`` members outside is joined without pairs: its members send every value within two bits of
  them in the bytes that the list does not fix, and those that share one are linked to the least of them. Two values differ in
  four bits at most if and only if they share such a value, so nothing is missed or added, and rows stay linear.

Links are of different fingerprints, and components are found in Spark by star contraction.

Defined cases: null and empty texts and texts without words have the fingerprint zero and link like others; fewer words than
a shingle are one shingle; null ids are linked like others and never name a component unless no row of it has an id (null
then); repeated rows are returned as often; an empty table gives no rows; texts of any length are hashed whole; other
columns are not returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loomline.llm.common import discard, materialize, sized, texts_of
from loomline.llm.components import connected_components

SHINGLE, BITS, SEED = 4, 4, 42
#: Fingerprints that a list may hold by chance: so few that most postings are alone in their list and go at once. Of a list: members
#: that are all compared, members compared with all, members of one chunk of the rest.
BY_CHANCE, HOT, MINOR, CHUNK = 0.25, 64, 256, 1000
#: Shingles of a text that are hashed at a time.
SLICE = 100_000

BYTES = 8


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64 bits as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    joined, size = memoryview(b" ".join(words)), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, last, SLICE):
        to = min(at + SLICE, last)
        pieces = zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist(), strict=True)
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in pieces), ">u8", to - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big")


def _fingerprints(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches):
            found = np.array([fingerprint(t, size, seed) for t in texts_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "fp": pa.array(found.view(np.int64))})

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Per row: id, fp (the 64 bits as a signed long)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(size, seed), "id long, fp long")


def position_sets(size: int, shared: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` of the 8 positions such that any ``shared`` positions hold one of them.

    The fewer of: sets chosen greedily; all sets within so few parts of the positions that one part has ``size`` of them.
    """
    left, greedy = [set(c) for c in combinations(range(BYTES), shared)], []
    while left:
        best = max(combinations(range(BYTES), size), key=lambda s: sum(set(s) <= c for c in left))
        greedy.append(best)
        left = [c for c in left if not set(best) <= c]
    parts = (shared - 1) // (size - 1) if size > 1 else 1
    within = [c for k in range(parts) for c in combinations(range(k, BYTES, parts), size)]
    return min(greedy, within, key=len)


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << 8 * p for p in positions)
    return value - 2**64 if value >= 2**63 else value


def tally(x: Column) -> Column:
    """How many positional bytes are equal, given the exclusive or of two fingerprints."""
    return sum((F.when(x.bitwiseAND(F.lit(_mask((p,)))) == 0, 1).otherwise(0) for p in range(BYTES)), F.lit(0))


def _flips(places: list[int], bits: int) -> list[int]:
    """All values of up to ``bits`` ones at the given places, as signed longs."""
    found = [sum(1 << p for p in c) for k in range(bits + 1) for c in combinations(places, k)]
    return [v - 2**64 if v >= 2**63 else v for v in found]


def _starred(points: DataFrame, *by: str) -> DataFrame:
    """Links (a, b) of those that share a value of ``by`` to the least of them."""
    least = points.groupBy(*by).agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").drop("z")
    return points.join(least, list(by)).where("fp != a").select("a", F.col("fp").alias("b")).distinct()


def _listed(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(fp, set, key, n): postings in lists of n > 1 members."""
    of = F.array(*[F.struct(F.lit(k).alias("set"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("key")) for k, s in enumerate(sets)])
    postings = fps.select("fp", F.explode(of).alias("p")).select("fp", "p.*")
    return postings.join(postings.groupBy("set", "key").agg(F.count("*").alias("n")).where("n > 1"), ["set", "key"])


def _compared(members: DataFrame, bits: int) -> DataFrame:
    """Links of components: minor members of each list against the members of other components."""
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    left = members.where("minor").select("set", "key", F.col("fp").alias("a"), F.col("comp").alias("ca"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    right = members.select("set", "key", F.col("fp").alias("b"), F.col("comp").alias("cb"), F.col("minor").alias("both"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("chunk"))
    by = [left[c] == right[c] for c in ("set", "key", "chunk")]
    x = F.col("a").bitwiseXOR(F.col("b"))
    linked = [F.col("ca") != F.col("cb"), ~F.col("both") | (F.col("a") < F.col("b")), tally(x) >= BYTES - bits, F.bit_count(x) <= bits]
    return left.join(right, by + linked).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def similar(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, comp) of those of the distinct fingerprints ``fp`` that link with another; comp names their component."""
    if bits not in (2, 4, 6):
        raise ValueError("bits must be 2, 4 or 6: lists are joined by the values half way between two fingerprints")
    spark, shared = fps.sparkSession, BYTES - bits
    n = fps.count()
    size = next((s for s in range(min(2, shared), shared) if n <= BY_CHANCE * 256**s), shared)
    sets = position_sets(size, shared)
    listed = materialize(_listed(fps, sets))
    hot = listed.where(F.col("n") > HOT).select("fp").distinct()
    near = hot.select("fp", F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))").alias("value"))
    first = connected_components(_starred(near, "value"))
    known = materialize(first.withColumnsRenamed({"node": "fp", "component": "comp"}))
    discard(first)
    members = listed.join(known, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    sizes = members.groupBy("set", "key", "n", "comp").agg(F.count("*").alias("of"))
    lists = sizes.groupBy("set", "key", "n").agg(F.max_by("comp", F.struct("of", "comp")).alias("major"), F.max("of").alias("most")).where("most < n")
    minor, crowded = (F.col("n") <= HOT) | (F.col("comp") != F.col("major")), (F.col("n") > HOT) & (F.col("n") - F.col("most") > MINOR)
    mixed = materialize(members.join(lists.drop("n"), ["set", "key"]).select("set", "key", "n", "fp", "comp", minor.alias("minor"), crowded.alias("crowded")))
    flips = [(k, v) for k, s in enumerate(sets) for v in _flips([i for i in range(64) if i // 8 not in s], bits // 2)]
    values = F.broadcast(spark.createDataFrame(flips, "set int, flip long"))  # 8,239 rows, or 37,030 at most
    points = mixed.where("crowded").join(values, "set").select("set", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    links = known.where("fp != comp").select(F.col("comp").alias("a"), F.col("fp").alias("b"))
    found = materialize(links.union(_compared(mixed.where("not crowded"), bits)).union(_starred(points, "set", "key", "value")))
    discard(listed, known, mixed)
    out = connected_components(found).withColumnsRenamed({"node": "fp", "component": "comp"})
    discard(found)
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """Per row: id, fp (signed long), component_id."""
    rows = materialize(fingerprints(docs, id_col, text_col, size, seed))
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    comps = similar(classes.select("fp"), bits)
    named = classes.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(least, "comp").select("fp", "n", "component_id"))
    # at most 1000 classes hold more than a thousandth of all rows: their rows are not shuffled to one task each
    large = F.col("n") * 1000 > rows.count()
    spread = rows.join(F.broadcast(named.where(large).select("fp", F.lit(True).alias("large"), "component_id")), "fp", "left")
    alone = spread.where("large is null").select("id", "fp").join(named.where(~large).select("fp", "component_id"), "fp")
    return spread.where("large").select("id", "fp", "component_id").unionByName(alone.select("id", "fp", "component_id"))
