"""Token ids in files of fixed bit width.

Every id takes the least number of bits that holds the vocabulary. Layout of a file (little endian):

* ``TOKPACK1``, u32 bits, u32 ids per block
* blocks of packed ids, lowest bit first, each starting on a byte
* u64 offset of each block; i64 id of each document, u8 whether it has one, u64 its first id
  (of all documents, plus one past the last)
* u64 offset of the block table, u64 blocks, u64 documents, u64 ids, ``TOKPACK1``

So id n stands in block n // block at a known bit, any document can be read by itself, and a block
unpacks in a few numpy calls. A task writes one file under a name of its own attempt; only files
named in the manifest, which Spark collects from finished tasks, belong to the table.

Documents are encoded word by word with the tokenizer itself, each distinct word once per cache.
``by_words`` must hold for the tokenizer: it never joins what ASCII white space separates and its
result for a word does not depend on its neighbours, which holds for a normalizer that works on
characters, a splitter whose pieces contain no white space, and special strings without white space.

Defined results: null text counts as empty; an empty text has the end id alone; documents are in
ascending id order, null last, repeated ids in order of their texts.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.llm.common import attempt_name, open_store, scratch, stored, texts

MAGIC = b"TOKPACK1"
BLOCK = 8192
READ_BLOCKS = 128
CACHE = 600_000  # words; a full cache is emptied, which changes no result


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, :bits // 8].tobytes()
    spread = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits % 8 == 0:
        out = np.zeros((n, 4), dtype=np.uint8)
        out[:, :bits // 8] = np.frombuffer(data, dtype=np.uint8, count=n * bits // 8).reshape(n, bits // 8)
        return out.view("<u4").ravel()
    spread = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Appends documents to one file; holds at most one block of ids and 17 bytes per document."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.rest, self.waiting = [], 0
        self.offsets, self.ids, self.known, self.starts = [], [], [], [0]
        stream.write(MAGIC + struct.pack("<II", bits, block))
        self.at = len(MAGIC) + 8

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            flat = np.concatenate(self.rest)
            whole = len(flat) // self.block * self.block
            for i in range(0, whole, self.block):
                self._put(flat[i:i + self.block])
            self.rest, self.waiting = [flat[whole:]], len(flat) - whole

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.waiting:
            self._put(np.concatenate(self.rest))
        tables = [np.array(self.offsets, dtype="<u8"), np.array(self.ids, dtype="<i8"), np.array(self.known, dtype="u1"), np.array(self.starts, dtype="<u8")]
        for t in tables:
            self.stream.write(t.tobytes())
        self.stream.write(struct.pack("<QQQQ", self.at, len(self.offsets), len(self.ids), self.starts[-1]) + MAGIC)


class Reader:
    """Random access to one file."""

    def __init__(self, file):
        self.file, size = file, file.size()
        foot = file.read_at(40, size - 40)
        if foot[32:] != MAGIC or file.read_at(8, 0) != MAGIC:
            raise ValueError("not a complete file of packed ids")
        self.bits, self.block = struct.unpack("<II", file.read_at(8, 8))
        at, n_blocks, n_docs, self.n_ids = struct.unpack("<QQQQ", foot[:32])
        table = file.read_at(size - 40 - at, at)
        self.offsets = np.r_[np.frombuffer(table, "<u8", n_blocks), np.uint64(at)]
        self.doc_ids = np.frombuffer(table, "<i8", n_docs, 8 * n_blocks)
        self.known = np.frombuffer(table, "u1", n_docs, 8 * (n_blocks + n_docs)).astype(bool)
        self.starts = np.frombuffer(table, "<u8", n_docs + 1, 8 * (n_blocks + n_docs) + n_docs).astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last - 1."""
        start = int(self.offsets[first])
        data = self.file.read_at(int(self.offsets[last]) - start, start)
        out = []
        for i in range(first, last):
            n = min(self.block, self.n_ids - i * self.block)
            out.append(unpack(data[int(self.offsets[i]) - start:int(self.offsets[i + 1]) - start], n, self.bits))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def document(self, i: int) -> np.ndarray:
        a, b = int(self.starts[i]), int(self.starts[i + 1])
        if a == b:
            return np.zeros(0, dtype=np.uint32)
        first = a // self.block
        return self.blocks(first, -(-b // self.block))[a - first * self.block:b - first * self.block]

    def checksums(self) -> np.ndarray:
        """crc32 of each document's ids as little-endian u32, a fixed number of blocks at a time."""
        out = np.zeros(len(self.doc_ids), dtype=np.int64)
        n_blocks = len(self.offsets) - 1
        doc = 0
        for first in range(0, n_blocks, READ_BLOCKS):
            ids = self.blocks(first, min(n_blocks, first + READ_BLOCKS)).astype("<u4")
            low = first * self.block
            high = low + len(ids)
            while doc < len(out) and self.starts[doc] < high:
                a, b = max(low, int(self.starts[doc])), min(high, int(self.starts[doc + 1]))
                out[doc] = zlib.crc32(ids[a - low:b - low].tobytes(), int(out[doc]))
                if self.starts[doc + 1] > high:
                    break
                doc += 1
        return out


_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_STOPS = ".,;:!?"


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as they are, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


class _Words(dict):
    """Packed ids (u32) of words, found out at first use."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, _byte_letters()
        # words of small letters go straight to the model, if that gives what the whole tokenizer gives
        probes = [c for c in map(chr, range(0x61, 0x100)) if _LETTERS.fullmatch(c)]
        probes += [f"t{c}he{c}{c}r" for c in probes] + ["internationalization", "größenordnung", "désintéressé"]
        self.direct = all(self._by_model(w) == self._whole(w) for w in probes)
        # a word and the stops behind it are two pieces, if the tokenizer says so
        self.apart = all(self._whole(w + s) == self._whole(w) + self._whole(s) for w in probes for s in (*_STOPS, "...", "?!"))

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _by_model(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return struct.pack(f"<{len(got)}I", *[t.id for t in got]) if (got := self.model.tokenize(mapped)) else b""

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        core = text.rstrip(_STOPS) if self.apart else text
        if core != text and core and _LETTERS.fullmatch(core[-1]):
            ids = self[core.encode()] + self[text[len(core):].encode()]
        elif self.direct and _LETTERS.fullmatch(text):
            ids = self._by_model(text)
        else:
            ids = self._whole(text)
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids
        return ids


def by_words(tokenizer_file: str) -> Callable[[list[bytes]], Iterator[np.ndarray]]:
    """Encoder of UTF-8 texts; see the module's note on when words may be encoded one by one."""
    import os

    os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = "1", "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    known = _Words(tokenizer)
    special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
    # if case makes no difference, small letters need fewer entries
    folds = all(known._whole(w) == known._whole(w.lower()) for w in ("The", "HE", "McX", "ÉtÉ", "A1b"))

    def encode(batch: list[bytes]) -> Iterator[np.ndarray]:
        for text in batch:
            seen = text.lower() if folds else text
            if any(s in text or s.lower() in seen for s in special):
                yield np.array(tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4")
            else:
                yield np.frombuffer(b"".join(map(known.__getitem__, seen.split())), dtype="<u4")

    return encode


def vocabulary_size(tokenizer_file: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file).get_vocab_size(with_added_tokens=True)


def write_packed(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
                 bits: int | None = None) -> DataFrame:
    """Encode, order and write all documents; returns the manifest (part, path, n_docs, n_ids)."""
    spark = docs.sparkSession
    bits = bits or bits_for(max(vocabulary_size(tokenizer_file), end_id + 1))
    end = np.array([end_id], dtype="<u4")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("doc_id").asc_nulls_last()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        part, name = attempt_name("ids", ".tok")
        store.create_dir(base, recursive=True)
        encode, n_docs = by_words(tokenizer_file), 0
        path = f"{base}/{name}"
        with store.open_output_stream(path, compression=None) as stream:
            writer = Writer(stream, bits)
            for b in batches:
                for i, ids in zip(b.column("doc_id").to_pylist(), encode(texts(b.column("text")))):
                    writer.add(i, np.concatenate([ids, end]))
                    n_docs += 1
            writer.close()
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_ids": [writer.starts[-1]]})

    ordered = rows.repartitionByRange(tasks, key).sortWithinPartitions(key, "text")
    return stored(ordered.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "manifest")


def read_packed(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of the manifest.

    The driver adds up one number per file; each file is read by one task, a few blocks at a time."""
    parts, before = [], 0
    for r in manifest.orderBy("part").collect():
        parts.append((r.path, before))
        before += r.n_ids
    if not parts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist()):
                store, name = open_store(path)
                with store.open_input_file(name) as file:
                    r = Reader(file)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.doc_ids, mask=~r.known), pa.array(r.starts[:-1] + first), pa.array(np.diff(r.starts)), pa.array(r.checksums())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(parts, "path string, first long").repartition(len(parts))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_round_trip(docs: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Write all documents to the shared folder and read the files back."""
    spark = docs.sparkSession
    return read_packed(spark, write_packed(docs, scratch(spark, "packed"), tokenizer_file, end_id))
