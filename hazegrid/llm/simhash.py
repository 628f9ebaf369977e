"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within the radius have some segment that
differs in at most ``floor(radius / segments)`` bits, one bit here. So each fingerprint stands in a
table under each segment's value and visits the values one bit away; since of two values one bit
apart one lacks the bit the other has, visiting the values with one *more* bit is enough. Rows that
meet under a value are compared over all bits. Only distinct fingerprints take part.

No bucket is emitted as pairs: beyond ``SMALL`` rows a bucket is walked breadth-first, which yields
one link per row and component. Values that more than ``CHUNK`` fingerprints own are dealt out in
chunks, every two of which meet in one task, so a task's memory is bounded and no link is lost.

Defined results: null counts as empty text; a text without words has fingerprint zero; texts with
fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import free_names, in_batches, join_measured, scratch, stored
from hazegrid.llm.graph import components

SMALL = 64
CHUNK = 4096
_STEP = 1 << 16  # shingles hashed at a time
HALVES = (32, 32)


def shingles(words: list[bytes], k: int) -> list[bytes]:
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)))))


def hashes(items: list[bytes], seed: int) -> np.ndarray:
    """XXH64 of each item, unsigned."""
    return np.frombuffer(b"".join(map(partial(xxhash.xxh64_digest, seed=seed), items)), dtype=">u8")


def fingerprint(words: list[bytes], k: int, seed: int) -> int:
    """Bit i is set where over half the shingles' hashes have it."""
    if not words:
        return 0
    n = max(len(words) - k + 1, 1)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _STEP):
        h = hashes(shingles(words[i:i + _STEP + k - 1], k), seed)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _prints_of(column: pa.Array, k: int, seed: int) -> pa.Array:
    """Fingerprints of a string column as signed longs; the words of one text at a time."""
    f = [fingerprint((t or b"").lower().split(), k, seed) for t in column.cast(pa.binary()).to_pylist()]
    return pa.array(np.array(f, dtype=np.uint64).view(np.int64))


def fingerprints(rows: DataFrame, text: str, k: int, seeds: Sequence[int]) -> DataFrame:
    """Replace the column ``text`` by the fingerprint words f0, f1, ..., one per seed, as signed longs."""
    others = [c for c in rows.columns if c != text]
    names = [f"f{i}" for i in range(len(seeds))]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        prints = [_prints_of(b.column(text), k, s) for s in seeds]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in others), *prints], [*others, *names])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others), *(f"{n} long" for n in names)])
    return rows.select(*(F.col(f"`{c}`") for c in (*others, text))).mapInArrow(in_batches(one), schema)


def _segments(widths: Sequence[int], n_words: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of each segment."""
    starts = [sum(widths[:i]) for i in range(len(widths))]
    return [(w, s, width) for w in range(n_words) for s, width in zip(starts, widths)]


def _ball_rows(prints: DataFrame, widths: Sequence[int]) -> DataFrame:
    """A row for each table value a fingerprint owns, and for each that it visits."""
    names = prints.columns
    layout = _segments(widths, len(names))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        f = [np.asarray(b.column(c), dtype=np.int64).view(np.uint64) for c in names]
        keys, owner, at = [], [], []
        every = np.arange(b.num_rows)
        for s, (w, shift, width) in enumerate(layout):
            v = (f[w] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            table = np.uint64(s << 40)
            keys.append(v | table)
            owner.append(np.ones(len(v), dtype=bool))
            at.append(every)
            for i in range(width):
                free = np.flatnonzero((v >> np.uint64(i)) & np.uint64(1) == 0)
                keys.append(v[free] | np.uint64(1 << i) | table)
                owner.append(np.zeros(len(free), dtype=bool))
                at.append(free)
        where = np.concatenate(at)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owner)), *(pa.array(x[where].view(np.int64)) for x in f)],
            ["key", "owner", *names])

    return prints.mapInArrow(in_batches(one), "key long, owner boolean, " + ", ".join(f"{c} long" for c in names))


def _deal_hot(rows: DataFrame, prints: DataFrame, widths: Sequence[int]) -> DataFrame:
    """Add ``chunk``: 0 for ordinary values; for hot ones, rows are copied to pairs of chunks."""
    names = prints.columns
    owned = [(F.lit(s << 40).bitwiseOR(F.shiftrightunsigned(names[w], shift).bitwiseAND((1 << width) - 1)))
             for s, (w, shift, width) in enumerate(_segments(widths, len(names)))]
    hot = stored(prints.select(F.explode(F.array(*owned)).alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
                 .where(F.col("_n") > CHUNK).select("_key", F.ceil(F.col("_n") / CHUNK).cast("int").alias("_k")), "hot")
    if hot.isEmpty():
        return rows.withColumn("chunk", F.lit(0))
    mine = F.pmod(F.xxhash64(*names), F.col("_k")).cast("int")
    others = F.sequence(F.lit(0), F.col("_k") - 1)
    pair = F.when(F.col("owner"), F.transform(others, lambda j: F.least(j, mine) * F.col("_k") + F.greatest(j, mine))).otherwise(
        F.transform(others, lambda j: j * F.col("_k") + j))
    dealt = join_measured(rows, hot, [("key", "_key")])
    return dealt.select("key", "owner", *names, F.explode(F.when(F.col("_k").isNull(), F.array(F.lit(0))).otherwise(pair)).alias("chunk"))


def _distance(prints: list[np.ndarray], i, j) -> np.ndarray:
    return sum(np.bitwise_count(p[i] ^ p[j]).astype(np.int64) for p in prints)


def _walk(prints: list[np.ndarray], owners: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that connect what is connected in a large bucket. Starts from the rows nearest to the
    bitwise majority, so that copies of one text hang on the text they come from."""
    bits = np.concatenate([np.unpackbits(p[owners].view(np.uint8).reshape(-1, 8), axis=1) for p in prints], axis=1)
    middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(owners)).view(np.uint64)
    far = sum(np.bitwise_count(p[owners] ^ m).astype(np.int64) for p, m in zip(prints, middle))
    left = owners[np.argsort(far, kind="stable")]
    a, b = [], []
    while len(left):
        queue, left, guests, at = [left[0]], left[1:], visitors, 0
        while at < len(queue):
            x, at = queue[at], at + 1
            if len(left):
                near = _distance(prints, x, left) <= radius
                hits, left = left[near], left[~near]
                queue.extend(hits)
                a.append(np.full(len(hits), x)), b.append(hits)
            if len(guests):
                near = _distance(prints, x, guests) <= radius
                hits, guests = guests[near], guests[~near]
                a.append(np.full(len(hits), x)), b.append(hits)
    return a, b


def _links_of(key: np.ndarray, owner: np.ndarray, prints: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by bucket, owners first."""
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[edge, len(key)])
    a, b = [], []
    for s, n in zip(edge[size > SMALL], size[size > SMALL]):
        rows = np.arange(s, s + n)
        own = owner[s:s + n]
        if own.any():
            x, y = _walk(prints, rows[own], rows[~own], radius)
            a += x
            b += y
    length = np.repeat(size, size)
    index = np.arange(len(key))
    for k in range(1, SMALL):
        i = index[(length > k) & (length <= SMALL)]
        i = i[i + k < len(key)]
        i = i[owner[i] & (key[i] == key[i + k])]
        if not len(i):
            break
        i = i[_distance(prints, i, i + k) <= radius]
        a.append(i), b.append(i + k)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, dtype=np.int64),) * 2


def links(prints: DataFrame, radius: int, widths: Sequence[int], tasks: int) -> DataFrame:
    """Distinct fingerprints (f0, ...) -> links (a0, ..., b0, ...) that connect all that lie within ``radius``."""
    names = prints.columns
    rows = _deal_hot(_ball_rows(prints, widths), prints, widths)
    rows = rows.repartition(tasks, "key", "chunk").sortWithinPartitions("key", "chunk", F.col("owner").desc())
    out = [f"{side}{i}" for side in "ab" for i in range(len(names))]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def done(columns: list[np.ndarray]) -> pa.RecordBatch:
            key, chunk, owner, *f = columns
            bucket = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])])
            a, b = _links_of(bucket, owner, [x.view(np.uint64) for x in f], radius)
            return pa.RecordBatch.from_arrays([pa.array(x[i]) for i in (a, b) for x in f], out)

        for b in batches:
            new = [np.asarray(b.column(c).to_numpy(zero_copy_only=False)) for c in ("key", "chunk", "owner", *names)]
            rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            if not len(rest[0]):
                continue
            before = np.flatnonzero((rest[0] != rest[0][-1]) | (rest[1] != rest[1][-1]))
            if len(before):  # the last bucket may go on in the next batch
                last = int(before[-1]) + 1
                yield done([x[:last] for x in rest])
                rest = [x[last:] for x in rest]
        if rest is not None and len(rest[0]):
            yield done(rest)

    return rows.mapInArrow(match, ", ".join(f"{c} long" for c in out))


def _linked(prints: DataFrame, radius: int) -> DataFrame:
    """(node, root) of the distinct stored fingerprints f0 that others are linked to."""
    if not 0 <= radius <= 3:
        raise ValueError("two segments of 32 bits find every pair within 3 bits, not beyond")
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return components(links(prints, radius, HALVES, tasks).select(F.col("a0").alias("a"), F.col("b0").alias("b")))


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: smallest id reachable over links of at
    most ``radius`` (0 to 3) differing bits. A component whose ids are all null has a null id."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = stored(fingerprints(rows, "text", k, [seed]), "prints")
    roots = _linked(stored(rows.select("f0").distinct(), "distinct"), radius)
    least = stored(rows.groupBy("f0").agg(F.min("doc_id").alias("least")), "least")
    of_root = least.join(roots, F.col("f0") == F.col("node"), "left").select(F.col("f0").alias("_f"), F.coalesce("root", "f0").alias("_root"), "least")
    ids = of_root.groupBy(F.col("_root").alias("_r")).agg(F.min("least").alias("component_id"))
    named = stored(join_measured(of_root, stored(ids, "ids"), [("_root", "_r")]).select("_f", "component_id"), "named")
    return join_measured(rows, named, [("f0", "_f")]).select(
        "doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, unchanged, without all but one of each group that ``simhash_groups`` forms
    with the same ``k``, ``seed`` and ``radius``: the one with the smallest id, null last.

    Defined results: of rows equal in id or all without one, one stays; null, empty and blank texts are one group
    (fingerprint zero), joined by any text whose fingerprint has up to ``radius`` bits; columns of any name pass through.
    """
    spark = docs.sparkSession
    mark, row = free_names(docs, "_print", "_row")

    @F.arrow_udf("long")
    def printed(column: pa.Array) -> pa.Array:
        return _prints_of(column, k, seed)

    path = scratch(spark, "marked")
    marked = docs.withColumn(mark, printed(F.col(f"`{text}`").cast("string"))).withColumn(row, F.monotonically_increasing_id())
    marked.write.option("compression", "zstd").parquet(path)
    marked = spark.read.schema(marked.schema).parquet(path)
    ids = stored(marked.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{mark}`").alias("f0"), F.col(f"`{row}`").alias("row")), "ids")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("w")
    least = stored(ids.groupBy("f0").agg(first), "least")
    roots = _linked(least.select("f0"), radius)
    winners = join_measured(least, roots, [("f0", "node")]).groupBy(F.coalesce("root", "f0")).agg(F.min("w").alias("w"))
    winners = stored(winners.select(F.col("w.row").alias("won")), "winners")
    gone = free_names(marked, "_gone")[0]
    lost = stored(ids.join(winners, F.col("row") == F.col("won"), "left_anti").select(F.col("row").alias(gone)), "lost")
    kept = join_measured(marked, lost, [(row, gone)], "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
