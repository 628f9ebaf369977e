"""Language-model scores by online logistic context mixing.

A text is its lower-cased words and one end. Words counted at least ``least`` times in training (so
many that the vocabulary fits), the end and one escape have Huffman codes; a token is
predicted bit by bit along its code. At each node of the code tree three predictors speak: the
node alone, the node with the last token, the node with the last two. The latter two are counts in
tables; a node owns a stretch of them in proportion to its visits, and the context is
hashed into that stretch, so contexts that collide share a node. Counts are shrunk to the
node's own probability, and what enters the mix is their logit minus the node's. Vocabulary and tables grow with
the square root of the training tokens (``VOCABULARY``, ``SLOTS``), since every task holds them: without bound, but
slower than the corpus.

The mix is a logistic sum with weights gated by the depth of the bit. Weights start alike for every
document and are learned online along it, block after block (4 tokens at first, then ever longer ones up
to 64, and 512 from token 1024 on), by damped Newton steps; a second
stage, gated by the confidence of the mix, corrects its calibration in the same way. A block is
predicted from what precedes it only, so the bits add up to a probability of the text, and a
document's score does not depend on its neighbours or on the partitioning.

An escaped word is either drawn by its training count or spelled byte by byte, with bit predictors
over the last none to three bytes, again counts in hashed tables, each shrunk to the shorter context.
Spelling is computed once per distinct word.

Corpus counts: words are summed by shuffle; the tables are summed part by part. Texts are split twice, for the words and for
their ids, which are stored; counting and scoring read the ids. Words outside the vocabulary, however many, are looked up by a join.

Defined results: a null text is empty, with the end as its only token; a null id counts as the empty
string when documents are held out; without training documents every token is unknown.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import in_batches, stored, texts

VOCABULARY = 55.0  # words with a code of their own: so many times the root of the training tokens
SLOTS, LEAST_SLOTS = 110.0, 1 << 18  # of each context table, likewise; and at least
SHRINK = 16.0
PARTS = 32  # pieces in which a table is summed
BATCH_WORDS = 25_000  # tokens scored together: their bits should stay in the processor's caches
GATES, LEVELS = 8, 8
START_WEIGHT = 0.6
DAMPING = 8.0
DISCOUNT = 0.75  # of the count of a rare word
SPELL_SLOTS = 1 << 20
SPELL_SHRINK = (0.8, 2.0, 2.0, 2.0)
END_BYTE = 0x20  # cannot stand in a word
LOG10_2 = math.log10(2)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


# --- the code tree ------------------------------------------------------------------------


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code length of each symbol, from two queues: sorted leaves, and merged pairs."""
    n = len(counts)
    order = np.argsort(counts, kind="stable")
    leaves, merged = counts[order].tolist(), []
    parent = np.zeros(2 * n - 1, dtype=np.int64)
    i, j = 0, 0
    for new in range(n, 2 * n - 1):
        weight = 0.0
        for _ in range(2):
            if i < n and (j >= len(merged) or leaves[i] <= merged[j]):
                weight += leaves[i]
                parent[i] = new
                i += 1
            else:
                weight += merged[j]
                parent[n + j] = new
                j += 1
        merged.append(weight)
    depth = np.zeros(2 * n - 1, dtype=np.int64)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    out = np.empty(n, dtype=np.int64)
    out[order] = depth[:n]
    return out


class Tree:
    """Canonical Huffman code. Inner nodes of one depth are numbered consecutively; ``path`` holds
    2 * node + bit for each bit of each symbol, symbol after symbol, from ``start`` on."""

    def __init__(self, counts: np.ndarray):
        self.length = code_lengths(counts)
        order = np.lexsort((np.arange(len(counts)), self.length))
        deepest = int(self.length.max())
        leaves = np.bincount(self.length, minlength=deepest + 1)
        base, first = np.zeros(deepest + 1, dtype=np.int64), np.zeros(deepest + 1, dtype=np.int64)
        code = np.zeros(len(counts), dtype=np.int64)
        start, at, inner, self.nodes = 0, 0, 1, 0
        for d in range(deepest + 1):
            n = int(leaves[d])
            code[order[at:at + n]] = start + np.arange(n)
            inner = (2 * inner if d else 1) - n  # twice those above, without the leaves
            base[d], first[d] = start + n, self.nodes
            self.nodes += inner
            at, start = at + n, (start + n) << 1
        self.start = np.cumsum(self.length) - self.length
        self.path = np.empty(int(self.length.sum()), dtype=np.int32)
        self.visits, self.ones = np.zeros(self.nodes), np.zeros(self.nodes)
        for d in range(deepest):
            w = np.flatnonzero(self.length > d)
            left = self.length[w] - d
            node, bit = first[d] + (code[w] >> left) - base[d], (code[w] >> (left - 1)) & 1
            self.path[self.start[w] + d] = 2 * node + bit
            self.visits += np.bincount(node, counts[w], self.nodes)
            self.ones += np.bincount(node, counts[w] * bit, self.nodes)

    def steps(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each symbol its number of bits and where they begin; for each bit of all symbols 2 * node + bit."""
        n = self.length[symbols]
        first = np.cumsum(n) - n
        at = np.repeat(self.start[symbols] - first, n)
        at += np.arange(len(at))
        return n, first, self.path[at].astype(np.int64)  # also used as an index, so not narrower

    def bits(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each bit of all symbols: position of its symbol, depth, node, bit."""
        n, first, step = self.steps(symbols)
        return np.repeat(np.arange(len(symbols)), n), np.arange(len(step)) - np.repeat(first, n), step >> 1, step & 1


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Layout:
    """Which stretch of the context tables a node owns."""

    def __init__(self, tree: Tree, slots: int):
        width = np.maximum(1, (slots * tree.visits / max(1.0, tree.visits.sum())).astype(np.int64))
        self.width = width.astype(np.uint64)
        self.start = np.cumsum(width) - width
        self.size = int(width.sum())

    def slots(self, node: np.ndarray, contexts: Sequence[np.ndarray]) -> Iterator[np.ndarray]:
        """Slots for each of ``contexts``: 32 hashed bits each."""
        start, width = self.start[node], self.width[node]
        for c in contexts:
            slot = c * width
            slot >>= np.uint64(32)
            slot = slot.view(np.int64)  # below the size of a table
            slot += start
            yield slot


class Vocabulary:
    """Ids of words: 0 escape, 1 end, then the words."""

    ESCAPE, END = 0, 1

    def __init__(self, words: list[bytes], counts: np.ndarray, slots: int = LEAST_SLOTS):
        self.ids = {w: i + 2 for i, w in enumerate(words)}
        self.counts = counts
        self.tree = Tree(np.maximum(counts, 1))
        self.layout = Layout(self.tree, slots)

    def parts(self) -> tuple:
        """Plain values, from which ``whole`` makes the vocabulary again without any work."""
        return self.ids, self.counts, vars(self.tree), vars(self.layout)

    @classmethod
    def whole(cls, parts: tuple) -> Vocabulary:
        out, tree, layout = cls.__new__(cls), Tree.__new__(Tree), Layout.__new__(Layout)
        vars(tree).update(parts[2])
        vars(layout).update(parts[3])
        out.ids, out.counts, out.tree, out.layout = parts[0], parts[1], tree, layout
        return out

    def encode(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words) + 1, dtype=np.int64)
        out[:-1] = np.fromiter(map(self.ids.get, words, repeat(self.ESCAPE)), np.int64, len(words))
        out[-1] = self.END
        return out


def _contexts(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the last and of the last two tokens before each; ``first``: where a document begins."""
    none = np.uint64(1 << 40)
    one = np.r_[none, ids[:-1].astype(np.uint64)]
    one[first] = none
    two = np.r_[none, one[:-1]]
    two[first] = none
    h1 = _mix64(one + np.uint64(1))
    return h1 >> np.uint64(32), _mix64(h1 ^ (two * np.uint64(0xD6E8FEB86659FD93))) >> np.uint64(32)


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of texts with about ``BATCH_WORDS`` tokens."""
    start, n = 0, 0
    for i, size in enumerate(sizes):
        n += size
        if n >= BATCH_WORDS or i == len(sizes) - 1:
            yield start, i + 1
            start, n = i + 1, 0


def context_counts(vocabulary: Vocabulary, batch: list[list[bytes]], tables: np.ndarray) -> None:
    """Add the bits of all texts to ``tables`` [context, bit, slot]."""
    count_ids(vocabulary, [vocabulary.encode(w) for w in batch], tables)


def count_ids(vocabulary: Vocabulary, texts_: list[np.ndarray], tables: np.ndarray) -> None:
    size = vocabulary.layout.size
    for a, b in _groups(list(map(len, texts_))):
        ids = texts_[a:b]
        flat = np.concatenate(ids)
        h = _contexts(flat, np.cumsum([0, *map(len, ids[:-1])]))
        n, _, step = vocabulary.tree.steps(flat)
        side = (step & 1) * size
        for t, slot in enumerate(vocabulary.layout.slots(step >> 1, [np.repeat(x, n) for x in h])):
            slot += side
            np.add.at(tables[t].reshape(-1), slot, 1)


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


def predictors(vocabulary: Vocabulary, tables: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Logit of each node, and what each slot of the context tables adds to it."""
    tree, layout = vocabulary.tree, vocabulary.layout
    p0 = (tree.ones + 0.5) / (tree.visits + 1.0)
    logit = _logit(p0)
    of_slot = np.repeat(np.arange(tree.nodes), layout.width.astype(np.int64))
    lift = [(_logit((t[1] + SHRINK * p0[of_slot]) / (t[0] + t[1] + SHRINK)) - logit[of_slot]).astype(np.float32) for t in tables]
    return logit.astype(np.float32), lift


_FIRST_BLOCKS = np.repeat(np.arange(5), [4, 4, 8, 16, 32])  # of the first 64 tokens


class Mixer:
    """Bits of whole texts under the model."""

    def __init__(self, vocabulary: Vocabulary, logit: np.ndarray, lift: list[np.ndarray]):
        self.vocabulary, self.logit, self.lift = vocabulary, logit, lift

    def score(self, batch: list[list[bytes]]) -> np.ndarray:
        """Bits of each text: codes only, without what is behind escapes."""
        return self.score_ids([self.vocabulary.encode(w) for w in batch])

    def score_ids(self, texts_: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([self._score(texts_[a:b]) for a, b in _groups(list(map(len, texts_)))]) if texts_ else np.zeros(0)

    def _score(self, ids: list[np.ndarray]) -> np.ndarray:
        v, docs = self.vocabulary, ids
        size = np.array(list(map(len, ids)))
        flat = np.concatenate(ids)
        first = np.cumsum(size) - size
        h1, h2 = _contexts(flat, first)
        doc = np.repeat(np.arange(len(docs)), size)
        pos = np.arange(len(flat)) - first[doc]
        block = np.where(pos < 64, _FIRST_BLOCKS[np.minimum(pos, 63)], np.where(pos < 1024, 4 + pos // 64, 18 + pos // 512))
        order = np.argsort(block, kind="stable")
        flat, h1, h2, doc, block = flat[order], h1[order], h2[order], doc[order], block[order]
        n, start, step = v.tree.steps(flat)
        node, bit = step >> 1, step & 1
        x = [lift[slot] for lift, slot in zip(self.lift, v.layout.slots(node, [np.repeat(h, n) for h in (h1, h2)]))]
        base = self.logit[node]
        lane = np.repeat(doc, n)
        gate = np.arange(len(step)) - np.repeat(start, n)  # the depth
        np.minimum(gate, GATES - 1, out=gate)
        gate += lane * GATES
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, dtype=np.int64)
        ends = np.r_[0, np.cumsum(v.tree.length[flat])][edges]
        n_gates, n_levels = len(docs) * GATES, len(docs) * LEVELS
        weight, force = np.full((2, n_gates), START_WEIGHT, dtype=np.float32), np.full((2, n_gates), DAMPING)
        shift, grip = np.zeros(n_levels, dtype=np.float32), np.full(n_levels, DAMPING)
        sign = (2 * bit - 1).astype(np.float32)
        total = np.zeros(len(docs))
        for a, b in zip(ends[:-1], ends[1:]):
            g, u, v_, side, own = gate[a:b], x[0][a:b], x[1][a:b], sign[a:b], lane[a:b]
            z = weight[0][g]
            z *= u
            part = weight[1][g]
            part *= v_
            z += part
            z += base[a:b]
            level = np.clip((z + 8) * 0.5, 0, LEVELS - 1).astype(np.int64)
            level += own * LEVELS
            z += shift[level]
            z *= side
            against = np.exp(np.clip(np.negative(z, out=z), -80, 80, out=z), out=z)  # odds of the other bit
            whole = against + 1
            total += np.bincount(own, np.log(whole), len(docs))
            miss = np.divide(against, whole, out=whole)
            wrong = side * miss
            sure = np.multiply(miss, 1 - miss, out=miss)
            for t, c in enumerate((u, v_)):
                pull = sure * c
                pull *= c
                force[t] += np.bincount(g, pull, n_gates)
                weight[t] += np.bincount(g, np.multiply(wrong, c, out=pull), n_gates) / force[t]
            grip += np.bincount(level, sure, n_levels)
            shift += np.bincount(level, wrong, n_levels) / grip
        return total / math.log(2)


# --- spelling -------------------------------------------------------------------------------


def _spelled_bits(words: list[bytes]):
    """For each bit of all words, end byte included: word, node of the byte tree, bit, last three bytes."""
    joined = np.frombuffer(b"".join(w + bytes([END_BYTE]) for w in words), dtype=np.uint8).astype(np.int64)
    size = np.array([len(w) + 1 for w in words])
    word = np.repeat(np.arange(len(words)), size)
    pos = np.arange(len(joined)) - np.repeat(np.cumsum(size) - size, size)
    last = [np.where(pos >= k, np.r_[np.full(k, END_BYTE), joined[:-k]][:len(joined)], END_BYTE) for k in (1, 2, 3)]
    shift = np.arange(7, -1, -1)
    node = (joined[:, None] | 256) >> (shift + 1)
    bit = (joined[:, None] >> shift) & 1
    return np.repeat(word, 8), node.ravel(), bit.ravel(), [np.repeat(x, 8) for x in last]


_SPELL_SIZES = (256, 1 << 16, SPELL_SLOTS, SPELL_SLOTS)


def _spell_slots(node: np.ndarray, last: list[np.ndarray]) -> list[np.ndarray]:
    two = (last[1] << 16 | last[0] << 8 | node).astype(np.uint64)
    three = two | (last[2] << 24).astype(np.uint64)
    shift = np.uint64(64 - (SPELL_SLOTS.bit_length() - 1))
    return [node, last[0] << 8 | node, (_mix64(two) >> shift).astype(np.int64), (_mix64(three + np.uint64(1 << 40)) >> shift).astype(np.int64)]


def spell_counts(words: list[bytes], tables: list[np.ndarray]) -> None:
    if words:
        _, node, bit, last = _spelled_bits(words)
        for t, slot in zip(tables, _spell_slots(node, last)):
            t += np.bincount(slot + t.shape[1] * bit, minlength=t.size).reshape(2, -1)


def spell_bits(words: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
    if not words:
        return np.zeros(0)
    word, node, bit, last = _spelled_bits(words)
    p = np.full(len(node), 0.5)
    for t, slot, s in zip(tables, _spell_slots(node, last), SPELL_SHRINK):
        p = (t[1][slot] + s * p) / (t[0][slot] + t[1][slot] + s)
    return -np.bincount(word, np.log2(np.where(bit == 1, p, 1 - p)), len(words))


# --- Spark ------------------------------------------------------------------------------------


def _summed(rows: DataFrame, make, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """Sum tables of counts that ``make(batches)`` yields in each task. Tables travel in ``PARTS``
    compressed parts, which are added up part by part; only the final tables reach the driver."""
    total = sum(math.prod(s) for s in shapes)
    cut = [total * i // PARTS for i in range(PARTS + 1)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = make(batches)
        if tables is None:
            return
        flat = np.concatenate([t.ravel() for t in tables]).astype("<i8")
        small = np.uint32 if flat.max(initial=0) < 1 << 32 else np.uint64
        data = [zlib.compress(flat[a:b].astype(small).tobytes(), 1) for a, b in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([np.dtype(small).itemsize] * PARTS, pa.int32()), pa.array(data, pa.binary())], ["part", "width", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, width, data in zip(*(c.to_pylist() for c in b.columns)):
                got = np.frombuffer(zlib.decompress(data), dtype=f"<u{width}").astype(np.int64)
                sums[part] = sums[part] + got if part in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(s.astype("<i8").tobytes(), 1) for s in sums.values()], pa.binary())], ["part", "data"])

    parts = rows.mapInArrow(send, "part int, width int, data binary").repartition(PARTS, "part").mapInArrow(add, "part int, data binary")
    flat = np.zeros(total, dtype=np.int64)
    for r in parts.collect():
        flat[cut[r.part]:cut[r.part + 1]] = np.frombuffer(zlib.decompress(r.data), dtype="<i8")
    out, at = [], 0
    for s in shapes:
        out.append(flat[at:at + math.prod(s)].reshape(s))
        at += math.prod(s)
    return out


def _tokens(b: pa.RecordBatch) -> list[list[bytes]]:
    return [t.lower().split() for t in texts(b.column("text"))]


def _ids(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in b.column("ids").to_pylist()]


def _pieces(b: pa.RecordBatch, rows: int = 200) -> Iterator[pa.RecordBatch]:
    """A few texts at a time: their words take several times the memory of the text."""
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)


def word_table(rows: DataFrame) -> DataFrame:
    """(word, c) for every word of every document; c: its count in training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        other: set[bytes] = set()
        for b in (p for whole in batches for p in _pieces(whole)):
            for words, out in zip(_tokens(b), b.column("held_out").to_pylist()):
                other.update(words) if out else train.update(words)
            if len(train) + len(other) > 1_000_000:
                yield from give(train, other)
                train, other = Counter(), set()
        yield from give(train, other)

    def give(train: Counter, other: set[bytes]) -> Iterator[pa.RecordBatch]:
        words = [*train, *(w for w in other if w not in train)]
        n = [*train.values(), *[0] * (len(words) - len(train))]
        for i in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i:i + 50_000], pa.binary()), pa.array(n[i:i + 50_000], pa.int64())], ["word", "c"])

    return stored(rows.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row."""
    spark = docs.sparkSession
    key = F.col(f"`{doc_id}`")
    rows = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), F.col(f"`{text}`").alias("text"))
    words = word_table(rows.select("held_out", "text"))
    n_train = rows.where(~F.col("held_out")).count()
    n_words, n_types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n = n_words + n_train
    types = n_types + (n_train > 0)
    floor = math.log10(n + types + 1)

    # the least count at which the vocabulary is within its size, from the histogram of counts
    room, slots = max(16, int(VOCABULARY * math.sqrt(n))), max(LEAST_SLOTS, int(SLOTS * math.sqrt(n)))
    histogram = words.where("c > 0").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    total, least = histogram.where("c > 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], 2
    few = {r.c: r.n for r in histogram.orderBy("c").limit(1 << 16).collect()}
    while total > room:
        total, least = total - few.get(least, 0), least + 1
    common = words.where(F.col("c") >= least).toArrow().sort_by([("c", "descending"), ("word", "ascending")])  # at most ``room`` rows
    # Good-Turing: tokens to expect of words unseen so far, and of those seen less than ``least`` times
    unseen, seen = few.get(1, 0), sum((c + 1) * few.get(c + 1, 0) for c in range(1, least))
    counts = np.r_[float(unseen + seen), float(n_train), common.column("c").to_numpy()]
    new = (unseen + 1) / (unseen + seen + 2)
    kept = sum((c - DISCOUNT) * k for c, k in few.items() if c < least)
    built = Vocabulary(common.column("word").to_pylist(), counts, slots)
    del common
    known, size = spark.sparkContext.broadcast(built.parts()), built.layout.size  # loaded once per Python worker
    rare = words.where(F.col("c") < least)

    def vocabulary() -> Vocabulary:
        return Vocabulary.whole(known.value)

    base_of = np.log10(np.r_[1.0, counts[1:] + 1]) - floor

    def encode(b: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary()
        batch = _tokens(b)
        base, held, rare_words, n_rare = [], [], [], []
        for w in batch:
            ids = v.encode(w)
            held.append(ids.astype(np.int32).tobytes())
            base.append(float(base_of[ids[ids > 0]].sum()))
            left = Counter(map(w.__getitem__, np.flatnonzero(ids == 0).tolist()))
            rare_words.append(list(left))
            n_rare.append(list(left.values()))
        size_ = [len(w) + 1 for w in batch]
        unknown_end = 0 if n_train else 1
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("held_out"), pa.array(size_, pa.int64()), pa.array([s - sum(r) - unknown_end for s, r in zip(size_, n_rare)], pa.int64()),
             pa.array(base, pa.float64()), pa.array(list(map(len, texts(b.column("text")))), pa.int64()), pa.array(held, pa.binary()),
             pa.array(rare_words, pa.list_(pa.binary())), pa.array(n_rare, pa.list_(pa.int64()))],
            ["doc_id", "held_out", "n_tokens", "n_known", "base", "n_bytes", "ids", "words", "times"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = rows.mapInArrow(lambda batches: (encode(p) for b in batches for p in _pieces(b)),
                              f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, n_bytes long, ids binary, words array<binary>, times array<long>")
    encoded = stored(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")

    def train(batches: Iterator[pa.RecordBatch]):
        tables, v = None, vocabulary()
        for b in (p for whole in batches for p in _pieces(whole, 1000)):
            tables = np.zeros((2, 2, size), dtype=np.int64) if tables is None else tables
            count_ids(v, _ids(b), tables)
        return None if tables is None else [tables]

    tables = _summed(encoded.where(~F.col("held_out")).select("ids"), train, [(2, 2, size)])[0]
    context = spark.sparkContext.broadcast(predictors(built, tables))
    del built, tables

    def spell_train(batches: Iterator[pa.RecordBatch]):
        tables = None
        for b in batches:
            tables = [np.zeros((2, s), dtype=np.int64) for s in _SPELL_SIZES] if tables is None else tables
            spell_counts(b.column("word").to_pylist(), tables)
        return tables

    spelling = spark.sparkContext.broadcast([t.astype(np.float32) for t in _summed(words.where("c > 0").select("word"), spell_train, [(2, s) for s in _SPELL_SIZES])])

    def spell(b: pa.RecordBatch) -> pa.RecordBatch:
        c = np.asarray(b.column("c"), dtype=np.float64)
        bits = np.concatenate([spell_bits(b.column("word").slice(i, 2000).to_pylist(), spelling.value) for i in range(0, b.num_rows, 2000)]) if b.num_rows else np.zeros(0)
        drawn = np.log2(np.maximum((1 - new) * (c - DISCOUNT) / max(kept, 1.0), 1e-300))
        spelled = np.logaddexp2(drawn, math.log2(new) - bits)
        return pa.RecordBatch.from_arrays([b.column("word"), pa.array(c > 0), pa.array(np.log10(c + 1) - floor), pa.array(spelled * LOG10_2)], ["_word", "known", "base", "score"])

    worth = stored(rare.mapInArrow(in_batches(spell), "_word binary, known boolean, base double, score double"), "worth")

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        bits = Mixer(vocabulary(), *context.value).score_ids(_ids(b))
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "n_bytes"]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(-bits * LOG10_2, pa.float64())], [*names, "score"])

    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "n_bytes", "ids").mapInArrow(
        lambda batches: (score(p) for b in batches for p in _pieces(b, 500)), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, n_bytes long, score double")
    pairs = encoded.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    looked = pairs.join(worth, F.col("word") == F.col("_word")).groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.when(F.col("known"), F.col("k")).otherwise(0)).alias("_known"), F.sum(F.col("k") * F.col("base")).alias("_base"), F.sum(F.col("k") * F.col("score")).alias("_score"))
    full = scored.join(looked, F.col("row") == F.col("_row"), "left")
    out = F.col("score") + F.coalesce("_score", F.lit(0.0))
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), out.alias("score"),
        (-out / LOG10_2 / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"))
