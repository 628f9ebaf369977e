"""Token counts with a whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded alone; those that come back as
the one id they stand for are *whole*. A text is cut at special strings, then by the tokenizer's
own pattern into pre-tokens; a whole pre-token counts one, the merges run only for the others, once
for each distinct string in a bounded cache.

The pattern runs in another engine than the tokenizer's. ``unsure_characters`` holds every code
point that the two classify differently (letter, number, white space, other); a text with one of
them is counted by the tokenizer itself. The same holds for special strings with options that look
at their surroundings.

Defined results: null text counts as empty, with no bytes and no tokens; one row per row.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import in_batches, texts

# the pattern of byte-level tokenizers whose ByteLevel step has use_regex: a fixed value of the format
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 500_000
LIMIT = 1024


def _load(tokenizer_file: str):
    os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = "1", "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache
def whole_tokens(tokenizer_file: str) -> tuple[str, ...]:
    """Vocabulary strings that are one pre-token and encode alone as their own id."""
    tokenizer = _load(tokenizer_file)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ids = [(i, tokenizer.decode([i], skip_special_tokens=False)) for i in range(tokenizer.get_vocab_size(with_added_tokens=False))]
    ids = [(i, s) for i, s in ids if s and "�" not in s and s not in special]
    cut = regex.compile(PATTERN)
    alone = tokenizer.encode_batch_fast([s for _, s in ids], add_special_tokens=False)
    return tuple(s for (i, s), e in zip(ids, alone) if e.ids == [i] and cut.findall(s) == [s])


@lru_cache
def unsure_characters(tokenizer_file: str) -> str:
    """Code points that the tokenizer's splitter and ours put into different classes."""
    split, cut = _load(tokenizer_file).pre_tokenizer, regex.compile(PATTERN)

    def agree(points: list[int]) -> bool:
        probe = "".join(f"a{chr(c)}1\n" for c in points)
        return [end for _, (_, end) in split.pre_tokenize_str(probe)] == [m.end() for m in cut.finditer(probe)]

    points, out = [*range(0xD800), *range(0xE000, 0x110000)], []
    for i in range(0, len(points), 512):
        part = points[i:i + 512]
        if not agree(part):
            out += [chr(c) for c in part if not agree([c])]
    return "".join(out)


def counter(tokenizer_file: str, whole: tuple[str, ...], unsure: str) -> Callable[[str], int]:
    tokenizer, cut = _load(tokenizer_file), regex.compile(PATTERN)
    special = list(tokenizer.get_added_tokens_decoder().values())
    plain = all(not (t.single_word or t.lstrip or t.rstrip or t.normalized) for t in special)
    contents = sorted((t.content for t in special), key=len, reverse=True)
    at_special = regex.compile("|".join(map(regex.escape, contents))) if contents else None
    doubtful = frozenset(unsure)

    class Counts(dict):
        def __missing__(self, piece: str) -> int:
            n = len(tokenizer.encode(piece, add_special_tokens=False).ids)
            if len(self) >= CACHE + len(whole):
                self.clear()
                self.update(dict.fromkeys(whole, 1))
            self[piece] = n
            return n

    known = Counts.fromkeys(whole, 1)

    def count(text: str) -> int:
        if not plain or not (text.isascii() or doubtful.isdisjoint(text)):
            return len(tokenizer.encode(text, add_special_tokens=False).ids)
        if at_special is None or not at_special.search(text):
            return sum(map(known.__getitem__, cut.findall(text)))
        parts = at_special.split(text)
        return len(parts) - 1 + sum(sum(map(known.__getitem__, cut.findall(p))) for p in parts)

    return count


def token_counts(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    from tokenizers import pre_tokenizers

    step = _load(tokenizer_file)
    if step.normalizer is not None or not isinstance(step.pre_tokenizer, pre_tokenizers.ByteLevel) or step.pre_tokenizer.add_prefix_space:
        raise ValueError("the shortcut is for byte-level tokenizers without normalizer or added space")
    whole, unsure = whole_tokens(tokenizer_file), unsure_characters(tokenizer_file)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    made: list[Callable[[str], int]] = []

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(counter(tokenizer_file, whole, unsure))
        raw = texts(b.column("text"))
        n = [made[0](t.decode()) for t in raw]
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return rows.mapInArrow(in_batches(one), schema)
