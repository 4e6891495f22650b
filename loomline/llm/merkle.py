"""Merkle dataset manifest: a tree of digests over a table, by group, with a proof for every row.

A row's leaf is the hash of its columns, a column written ``-`` if null, else its length in UTF-8 bytes, a colon and the
value. Per group, leaves ascend by id; every ``arity`` consecutive nodes (the last run may have fewer) become the hash
of their hexadecimal digests until one is left, the group's subroot. Subroots, ordered by group (null first, then by
bytes), become the root in the same way. A row's proof holds, level by level, the digests before and after the node on
its way to the root; whoever has a leaf, its proof and the root can check it with ``fold_proof``.

Method. A sparse forest maps (tree, level, index) to the digest of a node whose run of siblings is not yet complete.
Joining two forests unites their nodes, and wherever a run is complete (how many siblings it has is known from the
tree's size) it gives way to its parent, so the forest of the whole table holds the root only. The operation is
associative and commutative, and a forest of consecutive rows holds at most some runs a level at either end.

Plan. The table is read once: leaves are digested in the scan and only digests travel. They are written, dealt out by
range of (group, id) into blocks of some ``LEAVES`` leaves, so that a hot group is many blocks, and written again; the
driver gets one row of counts a block to number groups and leaves. Each block makes its forest, and a tree reduction
joins neighbouring forests, FAN at a time, in rounds on the executors. RDD.treeReduce would deal forests round-robin, so
that no run completes before the end, and has no way back; here each round's forests are kept, and the same rounds are
walked downwards: a joined forest hands every part the rest of the proofs of the nodes that the part gave up.

Defined cases: null ids come first in their group; rows of one group and id are ordered by their leaf; equal rows are
leaves each, and dealt apart however many there are; null and empty values have different leaves; a null group is a
group; texts of any length are digested whole; other columns are not returned, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import discard, materialize

ARITY = 3
#: Leaves of one block, blocks at least, and forests joined at a time.
LEAVES, LEAST_BLOCKS, FAN = 100_000, 16, 32
#: The tree of subroots; the tree of a group has the group's rank.
TOP = -1

#: A node is (tree, level, index).
Node = tuple[int, int, int]
STEP = pa.struct([("before", pa.string()), ("after", pa.string())])


def written(value: Column) -> Column:
    """A value so that no two sequences of values are written alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[written(v) for v in values]), 256)


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def join_digests(digests: Iterable[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


@lru_cache(4096)
def widths(leaves: int, arity: int) -> tuple[int, ...]:
    """Nodes of each level of a tree."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return tuple(out)


def settle(nodes: dict[Node, str], sizes: dict[int, int], arity: int) -> dict[Node, list[Node]]:
    """Replace complete runs of siblings by their parents, in place; parents, each after its children, with their children.

    The last node of a group's tree becomes a leaf of the tree of subroots without another hash.
    """
    todo, done, digests = list(nodes), {}, {}
    while todo:
        tree, level, index = key = todo.pop()
        if key not in nodes:
            continue
        width = widths(sizes[tree], arity)[level]
        if width == 1:
            if tree == TOP:
                continue
            children, parent = [key], (TOP, 0, tree)
        else:
            first = index - index % arity
            children, parent = [(tree, level, i) for i in range(first, min(first + arity, width))], (tree, level + 1, index // arity)
            if any(c not in nodes for c in children):
                continue
        digests = [nodes.pop(c) for c in children]
        nodes[parent] = digests[0] if width == 1 else join_digests(digests)
        done[parent] = list(zip(children, digests, strict=True))
        todo.append(parent)
    return done


def unite(forests: Iterable[dict]) -> tuple[dict[Node, str], dict[int, int], dict]:
    """The monoid's operation on written forests: nodes, sizes of their trees, and what was resolved on the way."""
    nodes, sizes, arity = {}, {}, ARITY
    for forest in forests:
        arity = forest["arity"]
        sizes |= {int(t): n for t, n in forest["sizes"].items()}
        nodes |= {(t, level, i): d for t, level, i, d in forest["nodes"]}
    return nodes, sizes, settle(nodes, sizes, arity)


def write_forest(nodes: dict[Node, str], sizes: dict[int, int], arity: int) -> str:
    trees = {tree for tree, _, _ in nodes} | {TOP}
    return json.dumps({"arity": arity, "sizes": {t: sizes[t] for t in trees}, "nodes": [[*key, d] for key, d in sorted(nodes.items())]})


def hand_down(done: dict[Node, list], chains: dict[Node, tuple | None], subroots: dict[int, str]) -> None:
    """Proofs of the children of all resolved nodes from those of the nodes left; a chain is (before, after, rest) or None."""
    for parent in reversed(done):
        rest, children = chains[parent], done[parent]
        if parent[0] == TOP and children[0][0][0] != TOP:
            (child, subroots[child[0]]), = children
            chains[child] = rest
            continue
        for k, (child, _) in enumerate(children):
            chains[child] = ("".join(d for _, d in children[:k]), "".join(d for _, d in children[k + 1 :]), rest)


def steps(chain: tuple | None) -> list[tuple[str, str]]:
    out = []
    while chain:
        before, after, chain = chain
        out.append((before, after))
    return out


def write_answer(nodes: Iterable[Node], chains: dict[Node, tuple | None], subroots: dict[int, str], root: str) -> str:
    nodes = list(nodes)
    trees = {tree for tree, _, _ in nodes} - {TOP}
    return json.dumps({"root": root, "subroots": {t: subroots[t] for t in trees}, "chains": [[*key, steps(chains[key])] for key in nodes]})


def read_answer(text: str) -> tuple[dict[Node, tuple | None], dict[int, str], str]:
    answer, chains = json.loads(text), {}
    for tree, level, index, proof in answer["chains"]:
        chain = None
        for before, after in reversed(proof):
            chain = (before, after, chain)
        chains[tree, level, index] = chain
    return chains, {int(t): d for t, d in answer["subroots"].items()}, answer["root"]


class _Places:
    """Of every block: rank of its first group, index of its first leaf in that group, leaves of its first and last groups."""

    def __init__(self, counted: list, arity: int):
        self.arity, self.blocks, rows, totals, rank, index, last = arity, [], [], {}, -1, 0, None
        for r in sorted(counted, key=lambda r: r["block"]):
            if r["first"] != last:
                rank, index = rank + 1, 0
            first = rank
            rank += r["n_groups"] - 1
            rows.append((first, index, rank))
            for group, n in {(first, r["n_first"]), (rank, r["n_last"])}:
                totals[group] = totals.get(group, 0) + n
            index = index + r["n_first"] if rank == first else r["n_last"]
            last = r["last"]
            self.blocks.append(r["block"])
        self.rows = np.array([(*row, totals[row[0]], totals[row[2]]) for row in rows], np.int64).reshape(-1, 5)
        self.groups = rank + 1

    def numbered(self, block: int, groups: list[str | None]) -> tuple[list[Node], dict[int, int]]:
        """The leaves of a block as nodes, given their groups in order, and the sizes of the trees."""
        first, index, last, n_first, n_last = self.rows[np.searchsorted(self.blocks, block)].tolist()
        nodes, rank, sizes = [], first, {TOP: self.groups}
        for k, group in enumerate(groups):
            if k and group != groups[k - 1]:
                rank, index = rank + 1, 0
            nodes.append((rank, 0, index))
            index += 1
            sizes[rank] = index
        sizes[first], sizes[last] = n_first, n_last
        return nodes, sizes


def _ordered(batches: Iterable[pa.RecordBatch]) -> tuple[list[tuple], str | None]:
    """Rows (group, id, leaf, other) of a block in order, and the answer that came with them."""
    rows, answer = [], None
    for batch in batches:
        part = zip(*[batch.column(c).to_pylist() for c in ("group", "id", "leaf", "other", "answer")], strict=True)
        for *row, said in part:
            if said is None:
                rows.append(row)
            else:
                answer = said
    rows.sort(key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    return rows, answer


def _forest_of(places):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = key[0].as_py()
        rows, _ = _ordered(batches)
        keys, sizes = places.value.numbered(block, [r[0] for r in rows])
        nodes = dict(zip(keys, [r[2].hex() for r in rows], strict=True))
        settle(nodes, sizes, places.value.arity)
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "forest": [write_forest(nodes, sizes, places.value.arity)]})

    return run


def _joined(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    forests = [json.loads(f) for f in table.column("forest").to_pylist()]
    nodes, sizes, _ = unite(forests)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "forest": [write_forest(nodes, sizes, forests[0]["arity"])]})


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answer to the forest of the whole table, whose one node is the root."""
    for batch in batches:
        for block, forest in zip(batch.column("block").to_pylist(), batch.column("forest").to_pylist(), strict=True):
            ((*node, root),) = json.loads(forest)["nodes"]
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "answer": [write_answer([tuple(node)], {tuple(node): None}, {}, root)]})


def _answered(parts: pa.Table, answers: pa.Table) -> pa.Table:
    """One round downwards: for each forest of a join, the rest of its nodes' proofs."""
    forests = [json.loads(f) for f in parts.column("forest").to_pylist()]
    chains, subroots, root = read_answer(answers.column("answer")[0].as_py())
    _, _, done = unite(forests)
    hand_down(done, chains, subroots)
    said = [write_answer([(t, level, i) for t, level, i, _ in f["nodes"]], chains, subroots, root) for f in forests]
    return pa.table({"block": parts.column("block").cast(pa.int32()), "answer": said})


def _proved(places):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, answer = _ordered(batches)
        chains, subroots, root = read_answer(answer)
        keys, sizes = places.value.numbered(key[0].as_py(), [r[0] for r in rows])
        nodes = dict(zip(keys, [r[2].hex() for r in rows], strict=True))
        hand_down(settle(nodes, sizes, places.value.arity), chains, subroots)
        for k in range(0, len(rows), 2000):
            part, own = rows[k : k + 2000], keys[k : k + 2000]
            proofs = [steps(chains[x]) for x in own]
            ends = np.cumsum([0, *map(len, proofs)])
            flat = [s for p in proofs for s in p]
            sides = [pa.array([s[i] for s in flat], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array([r[1] for r in part], pa.int64()),
                    "group": pa.array([r[0] for r in part], pa.string()),
                    "leaf": pa.array([r[2].hex() for r in part], pa.string()),
                    "other": pa.array([(r[3] or r[2]).hex() for r in part], pa.string()),
                    "subroot": pa.array([subroots[x[0]] for x in own], pa.string()),
                    "root": pa.array([root] * len(part), pa.string()),
                    "proof": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(sides, fields=list(STEP))),
                }
            )

    return run


PROVED = "id long, group string, leaf string, other string, subroot string, root string, proof array<struct<before:string,after:string>>"


def merkle_manifest(
    docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source",
    arity: int = ARITY, other: Column | None = None, leaves: int = LEAVES,
) -> DataFrame:
    """Per row: id, group, leaf, other, subroot, root, proof (per level: digests before and after, joined).

    ``other`` is a digest that travels along, such as that of a changed row; the leaf where it is null.
    """
    spark = docs.sparkSession
    leaf = digest_of(*[F.col(f"`{c}`") for c in columns])
    changed = F.lit(None).cast("binary") if other is None else F.unhex(other)
    digests = materialize(
        docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{group_col}`").cast("string").alias("group"), F.unhex(leaf).alias("leaf"), changed.alias("other"), F.monotonically_increasing_id().alias("row"))
    )
    blocks = max(LEAST_BLOCKS, -(-digests.count() // leaves))
    dealt = materialize(digests.repartitionByRange(blocks, "group", "id", "leaf", "row").select(F.spark_partition_id().alias("block"), "group", "id", "leaf", "other"))
    discard(digests)
    counted = dealt.groupBy("block", "group").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("group").isNotNull(), F.col("group"))
    mark = lambda r: F.sha2(F.coalesce(F.concat(F.lit("="), r["group"]), F.lit("-")), 256)
    ends = counted.groupBy("block").agg(F.count("*").alias("n_groups"), F.min(rank).alias("a"), F.max(rank).alias("z"), F.min_by("n", rank).alias("n_first"), F.max_by("n", rank).alias("n_last"))
    found = ends.select("block", "n_groups", mark(F.col("a")).alias("first"), mark(F.col("z")).alias("last"), "n_first", "n_last").collect()
    places = spark.sparkContext.broadcast(_Places(found, arity))  # 40 bytes a block
    rounds = [materialize(dealt.withColumn("answer", F.lit(None).cast("string")).groupBy("block").applyInArrow(_forest_of(places), "block int, forest string"))]
    above, left = F.floor(F.col("block") / FAN).cast("int").alias("above"), max((r["block"] for r in found), default=0) + 1
    while left > 1:
        rounds.append(materialize(rounds[-1].select(above, "forest").groupBy("above").applyInArrow(_joined, "block int, forest string")))
        left = -(-left // FAN)
    answers = rounds[-1].mapInArrow(_rooted, "block int, answer string")
    for forests in reversed(rounds[:-1]):
        said = answers.withColumnRenamed("block", "above").groupBy("above")
        answers = forests.select(above, "block", "forest").groupBy("above").cogroup(said).applyInArrow(_answered, "block int, answer string")
    answers = materialize(answers)
    discard(*rounds)
    both = dealt.withColumn("answer", F.lit(None).cast("string")).unionByName(answers, allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(_proved(places), PROVED)
