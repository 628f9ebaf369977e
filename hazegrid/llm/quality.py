"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are compared with
those of its language by Jensen-Shannon distance (base 2, 0 to 1). The references come from the
whole corpus: a language's common words are all words that make up at least ``COMMON_SHARE`` of its
words, everything else is one bin. Languages with less than ``LANG_SHARE`` of the documents, null
included, share one pooled reference, so the references have a fixed bound.

Guards: a short document's histogram differs from any reference by chance. The squared distance of
``n`` words over ``k`` bins is about ``(k - 1) / (8 n ln 2)`` then, which is added to the limit
``NOISE`` times; documents under ``MIN_WORDS`` words are judged by the base rules alone.

Defined results: null or empty texts have no words and fail the base rule; repeated rows are
judged one by one; no row is dropped. Only the named id, text and language columns are read, so
other columns, of whatever name, do no harm.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import in_batches, stored, texts

HELD_WORDS = 300_000  # distinct words that a task holds before it passes them on
COMMON_SHARE = 0.003
LANG_SHARE = 0.001
MIN_WORDS = 50
CHAR_LIMIT = 0.30
WORD_LIMIT = 0.25
NOISE = 1.5
WINDOW = 8
SYMBOLS = "#*$%&|<>"
POOLED = ""

# character classes: lower, upper, digit, white space, punctuation, beyond ASCII, symbols
CLASSES = 7
_REST = 7  # continuation bytes of UTF-8, not counted


def _class_table() -> np.ndarray:
    table = np.full(256, 4, dtype=np.uint8)
    table[ord("a"):ord("z") + 1] = 0
    table[ord("A"):ord("Z") + 1] = 1
    table[ord("0"):ord("9") + 1] = 2
    table[[9, 10, 11, 12, 13, 32]] = 3
    table[[ord(c) for c in SYMBOLS]] = 6
    table[0x80:0xC0] = _REST
    table[0xC0:] = 5
    return table


_CLASS = _class_table()


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=CLASSES + 1)[:CLASSES]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[k:k + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    exact = [tuple(ids[i:i + window].tolist()) for i in at]  # equal hashes are checked word by word
    times = Counter(exact)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for i, key in zip(at.tolist(), exact):
        if times[key] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    words = text.split()
    kinds = class_counts(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = int(kinds.sum() - kinds[3])
    return len(words), chars, int(kinds[6]), len(lines) - len(set(lines)), repeated_words(words)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; an empty one is as far as can be."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def to_middle(a: np.ndarray) -> float:
        hit = a > 0
        return float((a[hit] * np.log2(a[hit] / m[hit])).sum())

    return math.sqrt(max(0.0, (to_middle(p) + to_middle(q)) / 2))


def _by_lang(batch: pa.RecordBatch, text: str, lang: str, own: set[str] | None) -> Iterator[tuple[str, bytes]]:
    names = batch.column(lang).cast(pa.string()).to_pylist()
    for name, t in zip(names, texts(batch.column(text))):
        yield (name if own is None or name in own else POOLED), t


def own_languages(docs: DataFrame, lang: str = "lang") -> set[str]:
    """Languages with their own reference: at most 1 / LANG_SHARE of them."""
    counts = docs.groupBy(F.col(lang).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r.l for r in counts.where(F.col("l").isNotNull() & (F.col("n") >= LANG_SHARE * total)).collect()}


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """Per language: class histogram, bin of each common word, word histogram (last bin: other words).

    Words are counted in the tasks and summed by shuffle; of these sums only the words that have ``COMMON_SHARE`` of
    their language, at most 1 / COMMON_SHARE of them, and a few totals reach the driver.
    """
    own = own_languages(docs, lang)
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))

    def give(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for name, c in words.items():
            keys, n = list(c), list(c.values())
            for i in range(0, len(keys), 50_000):
                yield _counted(name, "word", keys[i:i + 50_000], n[i:i + 50_000])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        totals: Counter = Counter()
        kinds: dict[str, np.ndarray] = {}
        for b in batches:
            for name, t in _by_lang(b, "text", "lang", own):
                found = t.lower().split()
                totals[name] += len(found)
                kinds[name] = kinds.get(name, np.zeros(CLASSES, dtype=np.int64)) + class_counts(t)
                words.setdefault(name, Counter()).update(found)
            if sum(map(len, words.values())) > HELD_WORDS:
                yield from give(words)
                words = {}
        yield from give(words)
        for name, n in totals.items():
            yield _counted(name, "total", [b"", *(str(i).encode() for i in range(CLASSES))], [n, *kinds[name].tolist()])

    counted = rows.mapInArrow(count, "lang string, what string, word binary, n long")
    counted = stored(counted.groupBy("lang", "what", "word").agg(F.sum("n").alias("n")), "words")
    got: dict[str, dict[bytes, int]] = {}
    for r in counted.where("what = 'total'").collect():
        got.setdefault(r.lang, {})[bytes(r.word)] = r.n
    least = F.create_map(*[F.lit(x) for name, g in got.items() for x in (name, float(COMMON_SHARE * g[b""]))]) if got else None
    common: dict[str, dict[bytes, int]] = {name: {} for name in got}
    if got:
        for r in counted.where((F.col("what") == "word") & (F.col("n") >= least[F.col("lang")])).collect():
            common[r.lang][bytes(r.word)] = r.n
    out = {}
    for name, g in got.items():
        words = sorted(common[name])
        hist = np.array([common[name][w] for w in words] + [0], dtype=np.float64)
        hist[-1] = g[b""] - hist.sum()
        out[name] = (np.array([g[str(i).encode()] for i in range(CLASSES)], dtype=np.float64), {w: i for i, w in enumerate(words)}, hist)
    return out


def _counted(name: str, what: str, words: list[bytes], n: list[int]) -> pa.RecordBatch:
    size = len(words)
    return pa.RecordBatch.from_arrays([pa.array([name] * size, pa.string()), pa.array([what] * size, pa.string()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["lang", "what", "word", "n"])


def _distances(text: bytes, ref) -> tuple[float, float, float]:
    """Distance of classes, distance of words, limit for the latter."""
    kinds, bins, hist = ref
    words = text.lower().split()
    found = np.zeros(len(hist))
    for w, n in Counter(filter(bins.__contains__, words)).items():
        found[bins[w]] = n
    found[-1] = len(words) - found.sum()
    noise = NOISE * (len(hist) - 1) / (8 * len(words) * math.log(2)) if words else 0.0
    return js_distance(class_counts(text).astype(np.float64), kinds), js_distance(found, hist), math.sqrt(WORD_LIMIT**2 + noise)


def _judge(text: bytes, ref) -> tuple:
    n, chars, symbols, dup, repeat = base_counts(text)
    failed = n < 20 or 100 * repeat > 30 * n
    by_class, by_word, limit = _distances(text, ref) if ref else (0.0, 0.0, 1.0)
    kept = not failed and (n < MIN_WORDS or (by_class <= CHAR_LIMIT and by_word <= limit))
    return n, chars, symbols, dup, repeat, failed, kept, by_class, by_word, limit


JUDGED = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
          ("base_failed", "boolean"), ("kept", "boolean"), ("class_distance", "double"), ("word_distance", "double"), ("word_limit", "double"))
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: id, base counts, distances with the limit, verdict."""
    refs = references(docs, text, lang)
    own = set(refs)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_judge(t, refs.get(name)) for name, t in _by_lang(b, "text", "lang", own)]
        columns = [pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(JUDGED)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *(c for c, _ in JUDGED)])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in JUDGED)
    return rows.mapInArrow(in_batches(one), schema)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, unchanged."""
    refs = references(docs, text, lang)
    own = set(refs)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        kept = [_judge(t, refs.get(name))[6] for name, t in _by_lang(b, text, lang, own)]
        return pa.RecordBatch.from_struct_array(pc.filter(b.to_struct_array(), pa.array(kept, pa.bool_()))) if len(kept) else b

    return docs.mapInArrow(in_batches(one), docs.schema)
