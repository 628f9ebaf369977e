"""Cross-tokenizer alignment: which ids of two tokenizers stand for the same bytes, counted by external spills.

Both tokenizers cut the same bytes; where cuts of both coincide, groups end, and every token of one side is
linked to every token of the other side in its group. A pair of ids counts as often as documents hold it linked.

Each task collects (pair, document, occurrences) records; a full buffer is sorted, radix-partitioned by the first side's
id and spilled as a *run* of zstd blocks: the pairs with their number of documents, and apart from them the
documents. Pair blocks are shuffled by radix and arrive by first pair; a heap of open blocks merges them, side-major,
so when the next block begins behind an id, all pairs of that id are counted and its highest count is known. Counts
then stream back to the blocks they came from, and each run adds them up for its documents.

A hot id or pair has one entry per run in the merge, however many documents hold it. A run ends between documents.

A byte-level tokenizer whose ids follow the order of its merges is run by the faster of the two libraries that read such
vocabularies (``ranks_of``); tests hold both against each other over every code point and over texts.

Defined results: null and empty texts, and texts whose bytes one of the tokenizers does not give back, have no tokens,
zeros and an empty ``groups_sha256``; one row per row of the input, whatever its id; special strings are plain text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import stored, texts
from hazegrid.llm.tokcount import PATTERN

RUN_LINKS = 1 << 21  # links buffered before a run is spilled
RUN_DOCS = 1 << 19  # and documents; the last batch may add as many again
DOC_BITS = 20
BLOCK_PAIRS, BLOCK_RECORDS = 4096, 1 << 15
SLICE = 1 << 20  # links made at a time
BATCH_BYTES = 1 << 20  # texts tokenized at a time
RADICES = 64  # at least so many


# --- both tokenizers ---------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level tokenizers: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(tokenizer) -> dict[bytes, int] | None:
    """Token bytes with their ids, if merging by least id is what the tokenizer does: plain byte-level BPE
    without a normalizer, that splits by the usual pattern, and whose merges give ids in ascending order."""
    spec = json.loads(tokenizer.to_str())
    model, split, alphabet = spec["model"], spec["pre_tokenizer"] or {}, byte_alphabet()
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not (plain and usual and spec["normalizer"] is None):
        return None
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    merged = [model["vocab"].get("".join(p), -1) for p in pairs]
    ordered = all(a < b for a, b in zip(merged, merged[1:])) and set(alphabet) <= set(model["vocab"]) and (not merged or merged[0] > max(model["vocab"][c] for c in alphabet))
    ids = {bytes([b]): model["vocab"].get(c, -1) for c, b in alphabet.items()}
    known = {i: t for t, i in model["vocab"].items()}
    return ids | {bytes(alphabet[c] for c in known[i]): i for i in merged} if ordered else None


def _by_ranks(tokenizer):
    ranks = ranks_of(tokenizer)
    if ranks is None:
        return None
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizers:
    """Ids of texts from both sides, and the bytes of every id."""

    def __init__(self, byte_level: str, piece_model: str):
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = "1", "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_file(byte_level)
        self.left.no_truncation()
        self.left.no_padding()
        self.left.encode_special_tokens = True
        self.fast = _by_ranks(self.left)
        self.right = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        alphabet, n = byte_alphabet(), self.left.get_vocab_size()
        names = (self.left.id_to_token(i) or "" for i in range(n))
        self.left_bytes = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in names]
        self.right_bytes = []
        for i in range(self.right.get_piece_size()):
            piece = self.right.id_to_piece(i)
            odd = self.right.is_control(i) or self.right.is_unknown(i)
            self.right_bytes.append(b"" if odd else bytes([int(piece[3:5], 16)]) if self.right.is_byte(i) else piece.replace("▁", " ").encode())
        self.left_size = np.array(list(map(len, self.left_bytes)))
        self.right_size = np.array(list(map(len, self.right_bytes)))
        # how a token is written in a document's list of groups: before a comma, and at the end of its side
        self.written = [f"{i}{end}".encode() for ends in (",|", ",;") for i in range(max(n, len(self.right_bytes))) for end in ends]
        self.second = 2 * max(n, len(self.right_bytes))

    def encode(self, raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides, None where the bytes do not come back."""
        out: list = [None] * len(raw)
        some = [i for i, t in enumerate(raw) if t]
        if not some:
            return out
        right = self.right.encode([raw[i].decode() for i in some], num_threads=1)
        same = [(i, r) for i, r in zip(some, right) if b"".join(map(self.right_bytes.__getitem__, r)) == b" " + raw[i]]
        whole = [" " + raw[i].decode() for i, _ in same]
        if self.fast is not None:  # its tokens are a partition of the bytes
            left = [self.fast.encode_to_numpy(t, disallowed_special=()).astype(np.int64) for t in whole]
        else:
            left = [np.array(e.ids, dtype=np.int64) for e in self.left.encode_batch_fast(whole, add_special_tokens=False)]
        for (i, r), ids in zip(same, left):
            if self.fast is not None or b"".join(map(self.left_bytes.__getitem__, ids.tolist())) == b" " + raw[i]:
                out[i] = ids, np.array(r, dtype=np.int64)
        return out


@lru_cache(maxsize=2)
def tokenizers_of(byte_level: str, piece_model: str) -> Tokenizers:
    return Tokenizers(byte_level, piece_model)


# --- blocks ------------------------------------------------------------------------------------


def _pack(*columns: np.ndarray) -> bytes:
    """Arrays of non-negative numbers, byte planes apart, compressed."""
    parts = [np.array([len(columns)], dtype="<i8").tobytes()]
    for c in columns:
        width = 4 if not len(c) or int(c.max()) < 1 << 32 else 8
        planes = np.ascontiguousarray(c.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
        parts += [np.array([len(c), width], dtype="<i8").tobytes(), planes.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    at, out = 8, []
    for _ in range(int(np.frombuffer(data, dtype="<i8", count=1)[0])):
        n, width = map(int, np.frombuffer(data, dtype="<i8", count=2, offset=at))
        planes = np.frombuffer(data, dtype=np.uint8, count=n * width, offset=at + 16).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))
        at += 16 + n * width
    return out


class Codes:
    """A pair of ids as one number: radix, then first id, then second id."""

    def __init__(self, left: int, right: int, radices: int):
        self.right, self.radices, self.rows = right, radices, -(-left // radices)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a % self.radices) * self.rows + a // self.radices) * self.right + b

    def radix(self, code: np.ndarray) -> np.ndarray:
        return code // (self.rows * self.right)


class Run:
    """Records of the documents since the last spill: pair code << DOC_BITS | document, with occurrences."""

    def __init__(self):
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_fresh, self.docs = 0, []
        self.key, self.times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, key: np.ndarray) -> None:
        """Links, each counting once."""
        key = np.sort(key)
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        self.add_counted(key[edge], np.diff(np.r_[edge, len(key)]))

    def add_counted(self, key: np.ndarray, times: np.ndarray) -> None:
        self.fresh.append((key, times))
        self.n_fresh += len(key)
        if self.n_fresh >= RUN_LINKS:
            self.settle()

    def settle(self) -> None:
        if not self.fresh:
            return
        key = np.concatenate([self.key, *(k for k, _ in self.fresh)])
        times = np.concatenate([self.times, *(t for _, t in self.fresh)])
        order = np.argsort(key, kind="stable")
        key = key[order]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        self.key, self.times = key[edge], np.add.reduceat(times[order], edge) if len(edge) else times
        self.fresh, self.n_fresh = [], 0

    def full(self) -> bool:
        return self.n_fresh + len(self.key) >= RUN_LINKS or len(self.docs) >= RUN_DOCS

    def blocks(self, codes: Codes) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(radix, first code, pairs, documents) of each block."""
        self.settle()
        code, doc = self.key >> DOC_BITS, self.key & ((1 << DOC_BITS) - 1)
        edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, dtype=np.int64)
        pair, count = code[edge], np.diff(np.r_[edge, len(code)])
        radix = codes.radix(pair)
        i = 0
        while i < len(pair):
            j = min(int(np.searchsorted(radix, radix[i], side="right")), i + BLOCK_PAIRS)
            j = max(i + 1, min(j, int(np.searchsorted(edge, edge[i] + BLOCK_RECORDS))))
            a, b = int(edge[i]), int(edge[j]) if j < len(edge) else len(code)
            yield int(radix[i]), int(pair[i]), _pack(pair[i:j] - pair[i], count[i:j]), _pack(count[i:j], doc[a:b], self.times[a:b])
            i = j


# --- one batch of documents ----------------------------------------------------------------------


def _link(run: Run, codes: Codes, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, doc: np.ndarray) -> None:
    """Add every link of every group: ``na`` tokens of ``a`` with ``nb`` tokens of ``b``, in document ``doc``."""
    first_a, first_b, n = np.cumsum(na) - na, np.cumsum(nb) - nb, na * nb
    upto = np.cumsum(n)
    g = 0
    while g < len(n):
        if n[g] > SLICE:  # one group of its own: pairs of distinct ids
            ua, ca = np.unique(a[first_a[g]:first_a[g] + na[g]], return_counts=True)
            ub, cb = np.unique(b[first_b[g]:first_b[g] + nb[g]], return_counts=True)
            step = max(1, SLICE // len(ub))
            for i in range(0, len(ua), step):
                code = codes.of(np.repeat(ua[i:i + step], len(ub)), np.tile(ub, len(ua[i:i + step])))
                run.add_counted(code << DOC_BITS | doc[g], np.outer(ca[i:i + step], cb).ravel())
            g += 1
            continue
        end = max(g + 1, int(np.searchsorted(upto, upto[g] - n[g] + SLICE, side="right")))
        k = n[g:end]
        of = np.repeat(np.arange(g, end), k)
        at = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
        i, j = np.divmod(at, nb[of])
        run.add(codes.of(a[first_a[of] + i], b[first_b[of] + j]) << DOC_BITS | doc[of])
        g = end


def align(both: Tokenizers, codes: Codes, raw: list[bytes], run: Run) -> list[tuple[int, int, int, int, str]]:
    """(n_a, n_b, n_groups, n_links, groups_sha256) of each text; links go to ``run``, whose next documents these are."""
    ids = both.encode(raw)
    good = [i for i, x in enumerate(ids) if x]
    out: list[tuple[int, int, int, int, str]] = [(0, 0, 0, 0, "")] * len(raw)
    if not good:
        return out
    size_a, size_b = (np.array([len(ids[i][s]) for i in good]) for s in (0, 1))
    a, b = (np.concatenate([ids[i][s] for i in good]) for s in (0, 1))
    ends_a, ends_b = np.cumsum(both.left_size[a]), np.cumsum(both.right_size[b])
    shut_a = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a
    shut_b = ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
    last_a, last_b = np.flatnonzero(shut_a), np.flatnonzero(shut_b)
    na, nb = np.diff(np.r_[-1, last_a]), np.diff(np.r_[-1, last_b])
    doc = np.searchsorted(np.cumsum(size_a), last_a, side="right")
    n_groups = np.bincount(doc, minlength=len(good))
    n_links = np.add.reduceat(na * nb, np.cumsum(n_groups) - n_groups)
    _link(run, codes, a, b, na, nb, len(run.docs) + np.array(good)[doc])

    group_a, group_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    order = np.empty(len(a) + len(b), dtype=np.int64)
    order[np.arange(len(a)) + (np.cumsum(nb) - nb)[group_a]] = 2 * a + shut_a
    order[np.arange(len(b)) + (last_a + 1)[group_b]] = both.second + 2 * b + shut_b
    stop = np.cumsum(size_a + size_b)
    for d, i in enumerate(good):
        line = b"".join(map(both.written.__getitem__, order[stop[d] - size_a[d] - size_b[d]:stop[d]].tolist()))
        out[i] = int(size_a[d]), int(size_b[d]), int(n_groups[d]), int(n_links[d]), hashlib.sha256(line[:-1]).hexdigest()
    return out


# --- the merge ------------------------------------------------------------------------------------


class _Open:
    """A block in the merge: what is left of its pairs, and the counts that come back."""

    def __init__(self, run: int, block: int, first: int, blob: bytes):
        offset, self.count = _unpack(blob)
        self.run, self.block, self.code, self.at = run, block, offset + first, 0
        self.total, self.best = np.zeros(len(offset), dtype=np.int64), np.zeros(len(offset), dtype=np.int64)


class Merge:
    """Blocks pushed by first code; ``upto`` counts all pairs below a code and yields the blocks that are done."""

    def __init__(self, right: int):
        self.right, self.heap, self.turn = right, [], 0

    def push(self, block: _Open) -> None:
        self.turn += 1
        heapq.heappush(self.heap, (int(block.code[0]), self.turn, block))

    def upto(self, bound: int | None) -> Iterator[_Open]:
        """``bound``: the next block's first code; pairs of its first id wait. None: all."""
        bound = None if bound is None else bound // self.right * self.right
        taken: list[tuple[_Open, int, int]] = []
        while self.heap and (bound is None or self.heap[0][0] < bound):
            _, turn, block = heapq.heappop(self.heap)
            end = len(block.code) if bound is None else int(np.searchsorted(block.code, bound))
            taken.append((block, block.at, end))
            block.at = end
            if end < len(block.code):
                heapq.heappush(self.heap, (int(block.code[end]), turn, block))
        if not taken:
            return
        code = np.concatenate([b.code[i:j] for b, i, j in taken])
        order = np.argsort(code, kind="stable")
        ranked = code[order]
        edge = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        total = np.add.reduceat(np.concatenate([b.count[i:j] for b, i, j in taken])[order], edge)
        left = ranked[edge] // self.right
        side = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
        most = np.repeat(np.maximum.reduceat(total, side), np.diff(np.r_[side, len(left)]))
        pair = np.empty(len(code), dtype=np.int64)
        pair[order] = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(code)]))
        at = 0
        for b, i, j in taken:
            here = pair[at:at + j - i]
            b.total[i:j], b.best[i:j] = total[here], total[here] == most[here]
            at += j - i
            if j == len(b.code):
                yield b


# --- Spark -----------------------------------------------------------------------------------------


_MAPPED = "kind int, row long, {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, run long, block long, radix int, first long, pairs binary, docs binary"


def _portions(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about ``BATCH_BYTES`` of text at a time."""
    size = np.array(list(map(len, texts(b.column("text")))), dtype=np.int64)
    at = np.r_[0, np.cumsum(size)]
    i = 0
    while i < b.num_rows:
        j = min(b.num_rows, max(i + 1, int(np.searchsorted(at, at[i] + BATCH_BYTES, side="right")) - 1))
        yield b.slice(i, j - i)
        i = j


def alignments(docs: DataFrame, byte_level: str, piece_model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    radices = max(RADICES, tasks)
    mapped = _MAPPED.format(id=f"doc_id {kind.simpleString()}")

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = tokenizers_of(byte_level, piece_model)
        codes = Codes(len(both.left_bytes), len(both.right_bytes), radices)
        part, row, n_run, run = TaskContext.get().partitionId() << 33, 0, 0, Run()
        id_type = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal run, n_run
            if not len(run.docs):
                return
            name = part + n_run
            yield _mapped(id_type, kind=[2], run=[name], block=[-1], docs=[_pack(np.array(run.docs))])
            for i, (radix, first, pairs, inside) in enumerate(run.blocks(codes)):
                yield _mapped(id_type, kind=[1], run=[name], block=[i], radix=[radix], first=[first], pairs=[pairs], docs=[inside])
            run, n_run = Run(), n_run + 1

        for b in (p for whole in batches for p in _portions(whole)):
            id_type = b.column("doc_id").type
            found = align(both, codes, texts(b.column("text")), run)
            names = [part + row + i for i in range(b.num_rows)]
            row += b.num_rows
            run.docs += names
            n_a, n_b, n_groups, n_links, sha = zip(*found)
            yield _mapped(id_type, kind=[0] * b.num_rows, row=names, doc_id=b.column("doc_id"), n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=sha)
            if run.full():
                yield from flush()
        yield from flush()

    spilled = stored(rows.mapInArrow(spill, mapped), "spilled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, radix, right = None, None, None
        for b in batches:
            for run, block, r, first, pairs in zip(*(b.column(c).to_pylist() for c in ("run", "block", "radix", "first", "pairs"))):
                if merge is None:
                    right = len(tokenizers_of(byte_level, piece_model).right_bytes)
                    merge = Merge(right)
                yield from map(_counted, merge.upto(first if r == radix else None))
                radix = r
                merge.push(_Open(run, block, first, pairs))
        if merge is not None:
            yield from map(_counted, merge.upto(None))

    blocks = spilled.where("kind = 1").select("run", "block", "radix", "first", "pairs")
    counted = blocks.repartition(radices, "radix").sortWithinPartitions("radix", "first").mapInArrow(count, "run long, block long, kind int, docs binary")
    back = spilled.where("kind > 0").select("run", "block", "kind", "docs").union(stored(counted, "counted"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, names, best, total, counts = None, None, None, None, None
        for b in batches:
            for r, _, k, blob in zip(*(b.column(c).to_pylist() for c in ("run", "block", "kind", "docs"))):
                if r != run:
                    if run is not None:
                        yield _summed(names, best, total)
                    run = r
                    names = _unpack(blob)[0]
                    best, total = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
                elif k == 0:
                    counts = _unpack(blob)
                else:
                    n, doc, times = _unpack(blob)
                    best += np.bincount(doc, np.repeat(counts[1], n) * times, len(names)).astype(np.int64)
                    total += np.bincount(doc, np.repeat(counts[0], n) * times, len(names)).astype(np.int64)
        if run is not None:
            yield _summed(names, best, total)

    sums = back.repartition(tasks, "run").sortWithinPartitions("run", "block", "kind").mapInArrow(add_up, "_row long, n_best long, count_sum long")
    base = spilled.where("kind = 0").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return base.join(sums, F.col("row") == F.col("_row"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def _mapped(id_type: pa.DataType, **given) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "row": pa.int64(), "doc_id": id_type, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
             "groups_sha256": pa.string(), "run": pa.int64(), "block": pa.int64(), "radix": pa.int32(), "first": pa.int64(), "pairs": pa.binary(), "docs": pa.binary()}
    n = len(given["kind"])
    return pa.RecordBatch.from_arrays([v if isinstance(v := given.get(c), pa.Array) else pa.nulls(n, t) if v is None else pa.array(v, t) for c, t in kinds.items()], list(kinds))


def _counted(block: _Open) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block.run]), pa.array([block.block]), pa.array([0], pa.int32()), pa.array([_pack(block.total, block.best)], pa.binary())],
                                      ["run", "block", "kind", "docs"])


def _summed(names: np.ndarray, best: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(best), pa.array(total)], ["_row", "n_best", "count_sum"])
