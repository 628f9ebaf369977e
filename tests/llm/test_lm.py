import math
import zlib
from collections import Counter

import numpy as np
import pytest

from hazegrid.llm import lm

from .conftest import prose


def test_code_lengths_are_huffman():
    assert sorted(lm.code_lengths(np.array([8, 4, 2, 1, 1]))) == [1, 2, 3, 4, 4]


def test_tree_probabilities_are_counts():
    counts = np.array([5, 1, 9, 30, 2, 2, 7, 1], dtype=float)
    tree = lm.Tree(counts)
    assert tree.nodes == 7 and sum(2.0 ** -tree.length) == 1
    for s in range(8):
        p = 1.0
        for d in range(tree.length[s]):
            node, bit = divmod(int(tree.path[tree.start[s] + d]), 2)
            one = tree.ones[node] / tree.visits[node]
            p *= one if bit else 1 - one
        assert p == pytest.approx(counts[s] / counts.sum())


@pytest.fixture
def model():
    words = [b"a", b"b", b"c"]
    v = lm.Vocabulary(words, np.array([2.0, 3, 9, 5, 1]))
    tables = np.zeros((2, 2, v.layout.size), dtype=np.int64)
    lm.context_counts(v, [b"a b a b a b c".split(), b"a a".split()] * 5, tables)
    return v, lm.Mixer(v, *lm.predictors(v, tables))


def test_token_probabilities_add_up(model):
    """After any beginning, the probabilities of all next tokens sum to one, online learning included."""
    v, mixer = model
    for start in ([], [b"a", b"b"], [b"a", b"b"] * 100):
        # the end's own probability: bits of the text minus those of its tokens, taken from texts that differ in the last token
        docs = [[*start, w] for w in (b"a", b"b", b"c", b"?")]
        ids = [np.r_[v.encode(d)[:-1]] for d in docs]
        real = v.encode
        v.encode = lambda d: real(d)[:-1]
        try:
            before = mixer.score([start])[0] if start else 0.0
            p = [2 ** -(x - before) for x in mixer.score(docs)]
            v.encode = lambda d: np.r_[real(d)[:-1], v.END]
            p.append(2 ** -(mixer.score([start])[0] - before))
        finally:
            v.encode = real
        assert len(ids) == 4 and sum(p) == pytest.approx(1.0, abs=1e-6)


def plain_bits(v, logit, lift, words):
    """The mixer written out bit by bit for one text: codes, gates, damped Newton steps after each block."""
    ids = [v.ids.get(w, 0) for w in words] + [v.END]
    edges = [0, 4, 8, 16, 32, *range(64, 1024, 64), *range(1024, 1 << 20, 512)]
    weight, force = [[lm.START_WEIGHT] * lm.GATES for _ in range(2)], [[lm.DAMPING] * lm.GATES for _ in range(2)]
    shift, grip, total = [0.0] * lm.LEVELS, [lm.DAMPING] * lm.LEVELS, 0.0
    flat = np.array(ids)
    h = lm._contexts(flat, np.array([0]))
    for a, b in zip(edges, edges[1:]):
        seen = []
        for i in range(a, min(b, len(ids))):
            start = v.tree.start[ids[i]]
            for depth in range(v.tree.length[ids[i]]):
                node, bit = divmod(int(v.tree.path[start + depth]), 2)
                g = min(depth, lm.GATES - 1)
                x = [float(lift[t][int(v.layout.start[node]) + (int(h[t][i]) * int(v.layout.width[node]) >> 32)]) for t in range(2)]
                z = float(logit[node]) + weight[0][g] * x[0] + weight[1][g] * x[1]
                level = int(min(max((z + 8) * 0.5, 0), lm.LEVELS - 1))
                p = 1 / (1 + math.exp(-(z + shift[level])))
                total -= math.log2(p if bit else 1 - p)
                seen.append((g, x, level, bit - p, p * (1 - p)))
        for t in range(2):
            for g in range(lm.GATES):
                mine = [(x[t], wrong, sure) for g_, x, _, wrong, sure in seen if g_ == g]
                force[t][g] += sum(sure * c * c for c, _, sure in mine)
                weight[t][g] += sum(wrong * c for c, wrong, _ in mine) / force[t][g]
        for level in range(lm.LEVELS):
            mine = [(wrong, sure) for _, _, lv, wrong, sure in seen if lv == level]
            grip[level] += sum(sure for _, sure in mine)
            shift[level] += sum(wrong for wrong, _ in mine) / grip[level]
        if b >= len(ids):
            return total


def test_score_equals_a_plain_mixer(model):
    """Short texts and long ones, alone and among others; weights move from the first tokens on."""
    v, mixer = model
    docs = [[], [b"a"], b"a b a b a b c".split(), b"b a ? c".split() * 30, b"a b".split() * 700, [b"c"] * 9]
    want = [plain_bits(v, mixer.logit, mixer.lift, d) for d in docs]
    assert mixer.score(docs) == pytest.approx(want, rel=2e-4, abs=1e-4)
    assert [float(mixer.score([d])[0]) for d in docs] == pytest.approx(want, rel=2e-4, abs=1e-4)
    still = sum(plain_bits(v, mixer.logit, mixer.lift, [w]) for w in (b"a",))
    assert mixer.score([[b"a"] * 40])[0] < 40 * still


def test_spelling_is_a_distribution():
    tables = [np.zeros((2, s), dtype=np.int64) for s in lm._SPELL_SIZES]
    lm.spell_counts([b"ab", b"abc", b"b"], tables)
    one = [t.astype(np.float32) for t in tables]
    ends = {w: lm.spell_bits([w], one)[0] for w in (b"ab", b"zz")}
    assert ends[b"ab"] < ends[b"zz"]
    first = [2 ** -lm.spell_bits([bytes([c])], one)[0] for c in range(256) if c != lm.END_BYTE]
    assert sum(first) < 1


def brute_base(rows):
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    c = Counter(w for i, ws in words if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((str(i), out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in words), key=str)


def test_rows(edge_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 0.2)  # most words are looked up by the join
    got = lm.score_documents(edge_docs).collect()
    assert sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute_base([r[:2] for r in edge_rows])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    again = sorted(lm.score_documents(edge_docs.repartition(5)).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    first = sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens))
    assert [r.doc_id for r in again] == [r.doc_id for r in first]
    assert [r.score for r in again] == pytest.approx([r.score for r in first], rel=1e-4)


def test_learns_what_the_base_cannot(spark):
    docs = [(i, prose(300, i % 5)) for i in range(120)]
    out = lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).where("held_out").collect()
    assert out and sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)
    assert all(0 < r.bits_per_byte < 8 for r in out)


def test_no_training_documents(spark, no_docs):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    out = lm.score_documents(spark.createDataFrame([(held[0], "a b"), (held[1], None)], "doc_id long, text string")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in out)
    assert lm.score_documents(no_docs).count() == 0


def test_bits_are_expanded_once_for_both_contexts():
    """Steps, slots and ids against their definitions, token by token; the context hashes stay as they are."""
    v = lm.Vocabulary([b"a", b"b", b"c"], np.array([3.0, 2.0, 9.0, 5.0, 1.0]), 64)
    ids = v.encode([b"b", b"x", b"a", b"c"])
    assert ids.tolist() == [3, 0, 2, 4, 1]
    n, first, step = v.tree.steps(ids)
    assert n.tolist() == [int(v.tree.length[i]) for i in ids] and first.tolist() == np.r_[0, np.cumsum(n)[:-1]].tolist()
    assert step.tolist() == [int(v.tree.path[v.tree.start[i] + d]) for i in ids for d in range(v.tree.length[i])]
    node = step >> 1
    contexts = [np.arange(len(node), dtype=np.uint64) * np.uint64(f) for f in (0x07000001, 0x0B000003)]
    kept = [c.copy() for c in contexts]
    for c, k, got in zip(contexts, kept, v.layout.slots(node, contexts)):
        assert c.tolist() == k.tolist()
        assert got.tolist() == [int(v.layout.start[b]) + (int(x) * int(v.layout.width[b]) >> 32) for b, x in zip(node, c)]
