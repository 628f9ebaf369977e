"""Prefix trie of conversations in balanced parentheses.

A conversation is a path of turn digests. Equal paths are collapsed first (their conversation ids are
hashed in a stream), the distinct paths are range-partitioned into shards, and each shard writes its
part of the trie as parentheses: a node opens before its children and closes behind them. Range
min-max blocks over the excess answer ``findclose``, which delimits a subtree; counting the pairs
``()`` up to a place gives leaves; cumulative arrays along the opening parentheses give members and savings.

A shard is a stretch of the sorted paths, so two shards share only nodes on the path at which they meet:
the last path of one and the first of the next. The first shard that holds a shared node owns it (counts its words
once, and counts it as a child once); what each shard knows of its shared spine is emitted as partial sums, and these
few rows are merged by digest.

Defined results: null role or text is empty; rows without a conversation id belong to no conversation; turns of one
number stand by role, then by digest; repeated rows are repeated turns; without conversations there is no row. A conversation's
digests (16 bytes a turn) stand in one row, as a document's text does; the ids that end at one node are hashed by
one task, since SHA-256 runs through them in order, but as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hazegrid.llm.common import WORD_GAP, join_measured, stored

BLOCK = 64  # parentheses in a block of the min-max tree
SHARD_TURNS = 1 << 19  # turns of distinct paths to a shard, about
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_WIDTH = 16


class Parens:
    """Balanced parentheses (1 opens, 0 closes) with the least excess of each block, and of pairs of blocks, and so on."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = 1 << max(0, -(-len(bits) // BLOCK) - 1).bit_length()
        padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        padded[:len(bits)] = self.excess
        self.padded = padded
        self.levels = [padded.reshape(-1, BLOCK).min(axis=1)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2).min(axis=1))
        pairs = np.zeros(len(bits), dtype=bool)
        pairs[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.leaf = pairs

    def _in_block(self, start: np.ndarray, below: np.ndarray) -> np.ndarray:
        """First place from ``start`` to the end of its block with less excess than ``below``, else -1."""
        out = np.full(len(start), -1)
        at, todo = start.copy(), np.arange(len(start))
        while len(todo):
            hit = self.padded[at] < below[todo]
            out[todo[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at % BLOCK != 0)
            at, todo = at[more], todo[more]
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the next place of less excess."""
        below = self.excess[opens]
        out = self._in_block(opens, below)
        left = np.flatnonzero(out < 0)
        block, level, depth = opens[left] // BLOCK, np.zeros(len(left), dtype=np.int64), below[left]
        going = np.arange(len(left))
        for lv, low in enumerate(self.levels):  # up, until a right neighbour goes low enough
            if not len(going):
                break
            b = block[going]
            right = (b % 2 == 0) & (b + 1 < len(low))
            fits = np.zeros(len(b), dtype=bool)
            fits[right] = low[b[right] + 1] < depth[going[right]]
            block[going[fits]] += 1
            level[going[fits]] = lv
            block[going[~fits]] //= 2
            going = going[~fits]
        for lv in range(len(self.levels) - 1, 0, -1):  # down, to the first block low enough
            here = np.flatnonzero(level == lv)
            first = block[here] * 2
            block[here] = np.where(self.levels[lv - 1][first] < depth[here], first, first + 1)
            level[here] = lv - 1
        out[left] = self._in_block(block * BLOCK, depth)
        return out


def shared_turns(left: bytes, right: bytes) -> int:
    """Turns that two paths have in common from the start."""
    n = min(len(left), len(right)) // _WIDTH
    a, b = (np.frombuffer(x, dtype=np.uint64, count=2 * n).reshape(-1, 2) for x in (left, right))
    other = np.flatnonzero((a != b).any(axis=1))
    return int(other[0]) if len(other) else n


def _adjacent(turns: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each path but the first, the turns it shares with the one before."""
    n = np.minimum(size[1:], size[:-1])
    at = np.cumsum(n) - n
    inside = np.arange(int(n.sum())) - np.repeat(at, n)
    differ = np.flatnonzero((turns[np.repeat(start[:-1], n) + inside] != turns[np.repeat(start[1:], n) + inside]).any(axis=1))
    first = np.r_[differ, len(inside) + 1][np.searchsorted(differ, at)]
    return np.minimum(first - at, n)


def build(paths: list[bytes], words: np.ndarray, n: np.ndarray, first: np.ndarray, ends: list[str], before: int = -1, after: int = -1,
          extended: bool = False) -> dict[str, list | np.ndarray]:
    """Nodes of one shard in pre-order. ``paths`` are distinct and sorted, ``words`` those of all turns one after the
    other; ``n``, ``first`` and ``ends``: how many conversations have a path, their least id and the hash of their ids. ``before`` and
    ``after``: turns shared with the last path of the shard before and the first of the shard behind, -1 if there is none;
    ``extended``: the latter begins with the whole last path."""
    size = np.array([len(p) // _WIDTH for p in paths])
    start = np.cumsum(size) - size
    turns = np.frombuffer(b"".join(paths), dtype=np.uint64).reshape(-1, 2)
    shared = np.r_[0, _adjacent(turns, start, size)]
    opened = size - shared
    closed = np.r_[0, size[:-1] - shared[1:]]
    runs = np.r_[1, np.stack([closed, opened], axis=1).ravel(), size[-1] + 1]
    parens = Parens(np.repeat(np.r_[1, np.tile([0, 1], len(paths)), 0].astype(np.int8), runs))
    opens = np.flatnonzero(parens.bits)
    count = len(opens)
    closes = parens.findclose(opens)
    stop = np.arange(count) + (closes - opens + 1) // 2  # where a subtree ends in pre-order
    depth = parens.excess[opens] - 1
    of_path = np.r_[0, np.repeat(np.arange(len(paths)), opened)]
    last = np.cumsum(opened)  # node at which a path ends

    order = depth * (count + 1) + np.arange(count)
    by_depth = np.sort(order)
    parent = by_depth[np.maximum(np.searchsorted(by_depth, order - (count + 1)) - 1, 0)] % (count + 1)
    parent[0] = -1
    members = np.zeros(count, dtype=np.int64)
    members[last] = n
    least = np.full(count, np.iinfo(np.int64).max)
    least[last] = first
    level = np.searchsorted(by_depth, np.arange(int(depth.max()) + 2) * (count + 1))
    for d in range(int(depth.max()), 0, -1):
        here = by_depth[level[d]:level[d + 1]] % (count + 1)
        np.minimum.at(least, parent[here], least[here])

    def subtree(values: np.ndarray) -> np.ndarray:
        upto = np.r_[0, np.cumsum(values)]
        return upto[stop] - upto[:-1]

    owned = np.arange(count) > before
    n_convs = subtree(members)
    worth = np.r_[0, words[(start[of_path] + depth - 1)[1:]]]
    pairs = parens.leaf.copy()
    if extended:
        pairs[opens[last[-1]]] = False
    leaves = np.r_[0, np.cumsum(pairs)]
    children = np.bincount(parent[1:][owned[1:]], minlength=count)
    hashes = np.full(count, "", dtype=object)
    hashes[last] = ends

    spine = np.zeros(count, dtype=bool)
    spine[:before + 1] = True
    spine[by_depth[level[1:after + 2] - 1] % (count + 1)] = True  # the last node of each depth
    name = np.full(count, None, dtype=object)
    for i in np.flatnonzero(spine):
        p = paths[of_path[i]]
        name[i] = hashlib.md5(p[:int(depth[i]) * _WIDTH]).digest()
    above = [None if p < 0 else name[p] for p in parent]
    near = [None if p < 0 or spine[p] else int(least[p]) for p in parent]
    return {"node": list(name), "above": above, "conv_id": least, "depth": depth, "parent_conv_id": near, "n_convs": n_convs,
            "n_children": children, "n_leaves": leaves[closes] - leaves[opens], "saved_tokens": subtree(n_convs * worth - owned * worth),
            "ends": list(hashes)}


_NODES = ("node binary, above binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, ends string")


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id) sorted by both -> one row per key: how many, the least, the hash of all."""
    key, n, first, sha = None, 0, 0, None
    for b in batches:
        keys, ids = b.column("key").to_pylist(), b.column("conv_id").to_numpy()
        edges = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
        out = []
        for i, j in zip(edges, edges[1:]):
            part = ",".join(map(str, ids[i:j].tolist())).encode()
            if keys[i] == key:
                n += j - i
                sha.update(b"," + part)
                continue
            if key is not None:
                out.append((key, n, first, sha.hexdigest()))
            key, n, first, sha = keys[i], j - i, int(ids[i]), hashlib.sha256(part)
        yield _ends_batch(out)
    if key is not None:
        yield _ends_batch([(key, n, first, sha.hexdigest())])


def _ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "n", "first", "ends"])


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the ordered turns of each conversation as (turn, role, digest, words)."""
    who, said = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said).cast("binary"))
    words = F.size(F.filter(F.split(said, WORD_GAP), lambda w: w != ""))
    rows = conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), who.alias("role"), digest.alias("digest"), words.alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_heads(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % ``group``, then goes on
    behind its own first h; h = crc32 of the decimal c, modulo ``most``. None are taken from a conversation that does not exist."""
    turns = stored(turns.select("conv_id", F.transform("turns", lambda t: F.struct(t.digest.alias("digest"), t.words.cast("long").alias("words"))).alias("turns")), "turns")
    of = F.col("conv_id") - F.col("conv_id") % group
    heads = turns.where(of == F.col("conv_id")).select(F.col("conv_id").alias("_of"), F.slice("turns", 1, most - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.when(h > 0, F.slice("_head", F.lit(1), F.greatest(h, F.lit(1))))
    none = F.slice("turns", 1, 0)
    return turns.join(heads, of == F.col("_of"), "left").select("conv_id", F.concat(F.coalesce(head, none), own).alias("turns"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """(conv_id, turns of (digest, words)) -> a row per distinct prefix: conv_id (least member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    path = F.unhex(F.array_join(F.col("turns.digest"), ""))
    convs = stored(sequences.select("conv_id", path.alias("path"), F.col("turns.words").alias("words"), F.unhex(F.md5(path)).alias("key")), "convs")
    ends = convs.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    ends = stored(ends.mapInArrow(_hash_ends, "key binary, n long, first long, ends string"), "ends")
    distinct = convs.join(ends.drop("key"), F.col("conv_id") == F.col("first")).select("path", "words", "n", "first", "ends")
    total = convs.agg(F.sum(F.size("words") + 1)).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // SHARD_TURNS))
    shards = stored(distinct.repartitionByRange(tasks, "path").withColumn("shard", F.spark_partition_id()), "shards")

    # where neighbouring shards meet: two paths and three numbers for each
    rim = shards.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    over = W.orderBy("shard")

    @F.arrow_udf("int")
    def meet(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([-1 if a is None or b is None else shared_turns(a, b) for a, b in zip(left.to_pylist(), right.to_pylist())], pa.int32())

    rim = rim.select("shard", "low", "high", F.lag("high").over(over).alias("prior"), F.lead("low").over(over).alias("next"))
    rim = rim.select("shard", meet("prior", "low").alias("before"), meet("high", "next").alias("after"), (F.octet_length("high") / _WIDTH).cast("int").alias("deep"))
    edges = {r.shard: (r.before, r.after, r.after == r.deep) for r in rim.collect()}

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string())

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            words = t.column("words").combine_chunks().flatten()
            out = build(t.column("path").to_pylist(), words.to_numpy(), t.column("n").to_numpy(), t.column("first").to_numpy(),
                        t.column("ends").to_pylist(), *edges[t.column("shard")[0].as_py()])
            whole = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds)], list(out))
            yield from whole.to_batches(max_chunksize=50_000)

        held: list[pa.RecordBatch] = []
        for b in batches:
            shard = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and held[0].column("shard")[0].as_py() != shard[i]:
                    yield from done(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(i, j - i))
        if held:
            yield from done(pa.Table.from_batches(held))

    nodes = stored(shards.repartition(tasks, "shard").sortWithinPartitions("shard", "path").mapInArrow(grow, _NODES), "nodes")
    spine = nodes.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.max("above").alias("above"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends"))
    spine = stored(spine.select(*nodes.columns), "spine")
    merged = nodes.where(F.col("node").isNull()).unionByName(spine)
    parents = stored(spine.select(F.col("node").alias("_node"), F.col("conv_id").alias("_conv")), "parents")
    named = join_measured(merged, parents, [("above", "_node")])
    return named.select("conv_id", "depth", F.coalesce("parent_conv_id", "_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                        "saved_tokens", F.when(F.col("ends") == "", EMPTY_SHA).otherwise(F.col("ends")).alias("ends_sha256"))
