import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from hazegrid.llm import align

from .conftest import prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ZERO = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def sides():
    left = Tokenizer.from_file(A)
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=B)


def groups_of(sides, text):
    """[(A ids, B ids)] of one text, token by token."""
    left, right = sides
    if not text:
        return None
    alphabet = align.byte_alphabet()
    a = [(i, bytes(alphabet[c] for c in left.id_to_token(i))) for i in left.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in right.encode(text):
        piece = right.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if right.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    out, ga, gb, at_a, at_b = [], [], [], 0, 0
    a, b = list(a), list(b)
    while a or b:
        if at_a <= at_b:
            i, x = a.pop(0)
            ga.append(i)
            at_a += len(x)
        else:
            i, x = b.pop(0)
            gb.append(i)
            at_b += len(x)
        if at_a == at_b:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def brute(sides, texts):
    docs = [groups_of(sides, t) for t in texts]
    links = [Counter((x, y) for ga, gb in d or [] for x in ga for y in gb) for d in docs]
    count = Counter(p for c in links for p in c)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for d, c in zip(docs, links):
        if not d:
            out.append(ZERO)
            continue
        line = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in d)
        out.append((sum(len(g[0]) for g in d), sum(len(g[1]) for g in d), len(d), sum(c.values()), sum(n for p, n in c.items() if count[p] == most[p[0]]),
                    sum(n * count[p] for p, n in c.items()), hashlib.sha256(line.encode()).hexdigest()))
    return out


ODD = [None, "", " ", "  two  spaces ", "a\n\nb\tc\r\n", "<s>hello</s> <unk> <|endoftext|>", "<0x41> ▁ low line", "Ünïcödé ß žluťoučký 漢字 \U0001F600 мир", "é ﬁ ㍿",
       "\x00zero", "aaaa" * 300, "　wide", "x", "​zero width", "ÿþ\x7f\x80"]


def test_equals_brute_force(spark, sides, monkeypatch):
    """Small runs, slices and blocks: many spills to merge, and groups that are cut into slices."""
    for name, value in (("RUN_LINKS", 300), ("BLOCK_PAIRS", 16), ("BLOCK_RECORDS", 40), ("SLICE", 32), ("BATCH_BYTES", 2000), ("RADICES", 3)):
        monkeypatch.setattr(align, name, value)
    texts = ODD + [prose(30 + i, i % 9) for i in range(40)] + [prose(4000, 3)]
    rows = [(i // 2 if i % 5 else None, t, 1, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, kind string").repartition(3)
    got = align.alignments(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(r[0], *x) for r, x in zip(rows, brute(sides, texts))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_both_libraries_cut_alike(sides):
    """The vocabulary by ranks, over every code point between letters, digits and spaces, and over odd texts."""
    fast = align._by_ranks(sides[0])
    assert fast is not None
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    probes = ["".join(f"a{chr(c)}1 {chr(c)}" for c in points[i:i + 2048]) for i in range(0, len(points), 2048)]
    probes += [t for t in ODD if t] + ["it's we'll 's ' S 12 345 a1b2 --x-- (y) \u00a0z \x1fq \u2028r  ", "a\u0301 e\u0300 \u0301x", "x" * 20_000 + " y", " \n\n \t x\n"]
    for e, p in zip(sides[0].encode_batch_fast(probes, add_special_tokens=False), probes):
        assert e.ids == fast.encode_ordinary(p)


def test_other_tokenizers_are_left_to_their_library():
    assert align.ranks_of(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))) is None


def test_merge_holds_no_pair_back():
    """Blocks of many runs in order of their first pairs give the counts of all records."""
    rng = np.random.default_rng(4)
    codes = align.Codes(50, 40, 4)
    everything, pushed = [], []
    for r in range(9):
        run = align.Run()
        run.docs = list(range(30))
        code = codes.of(rng.integers(0, 50, 800), (rng.zipf(1.5, 800) - 1) % 40)
        key = code << align.DOC_BITS | rng.integers(0, 30, 800)
        run.add(key)
        everything.append(np.unique(key) >> align.DOC_BITS)
        for i, (radix, first, pairs, docs) in enumerate(run.blocks(codes)):
            pushed.append((radix, first, r, i, pairs, docs))
    count = Counter(np.concatenate(everything).tolist())
    most = {}
    for c, n in count.items():
        most[c // 40] = max(most.get(c // 40, 0), n)
    done = []
    for radix in range(4):
        merge = align.Merge(40)
        for _, first, r, i, pairs, _ in sorted(x for x in pushed if x[0] == radix):
            done += merge.upto(first)
            merge.push(align._Open(r, i, first, pairs))
        done += merge.upto(None)
    assert len(done) == len(pushed)
    for block in done:
        assert block.total.tolist() == [count[c] for c in block.code.tolist()]
        assert block.best.tolist() == [int(count[c] == most[c // 40]) for c in block.code.tolist()]


def test_packed_numbers_come_back():
    for columns in ([np.array([0, 5, 2**32, 2**62])], [np.arange(7), np.zeros(0, dtype=np.int64), np.array([2**32 - 1])]):
        assert [x.tolist() for x in align._unpack(align._pack(*columns))] == [x.tolist() for x in columns]


def test_empty(no_docs):
    assert align.alignments(no_docs, A, B).count() == 0
