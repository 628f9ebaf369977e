import hashlib
import re
import zlib

import numpy as np
import pytest

from hazegrid.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, key int, path string, words int"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute(rows):
    """The contract, node by node, with dictionaries."""
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            digest = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            turns.setdefault(c, []).append(((t is not None, t or 0), role or "", digest, text or ""))
    turns = {c: [(x[1], x[3]) for x in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        yield node
        for c in children.get(node, []):
            yield from below(c)

    out = []
    for node, ms in members.items():
        sub = list(below(node))
        ends = ",".join(map(str, sorted(c for c in ms if len(rebuilt[c]) == len(node))))
        out.append((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), len(children.get(node, [])), sum(n not in children for n in sub),
                    sum((len(members[n]) - 1) * words(n[-1][1]) for n in sub if n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA)
    got = trie.prefix_trie(trie.with_shared_heads(trie.turns_of(frame)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(90):
        common = int(rng.integers(0, 4))
        for t in range(int(rng.integers(1, 7))):
            text = f"same words {t}" if t < common else f"{rng.integers(0, 3)} of\t{t}"
            rows.append((c, t, "user" if t % 2 else "system", text))
    rows += [(200 + i, 0, "user", "hello there") for i in range(40)] + [(300 + i, t, "u", f"copy {t}") for i in range(30) for t in range(4)]
    check(spark, rows)


def test_nulls_ties_repeats_and_long_conversations(spark):
    rows = [(None, 0, "user", "nobody's"), (1, None, None, None), (1, 0, "a", "x y"), (1, 0, "a", "x y"), (1, 0, "b", "tie"), (1, 0, "b", "tie two"),
            (2, 0, "", ""), (21, 0, "q", "only one turn"), (5, 3, "u", "w " * 3000), (-3, 0, "u", "negative"), (-3, 1, "u", "below")]
    rows += [(40, t, "u", f"turn {t % 7}") for t in range(1500)] + [(41, t, "u", f"turn {t % 7}") for t in range(1400)]
    import sys

    sys.setrecursionlimit(10_000)
    check(spark, [r for r in rows if r[0] not in (40, 41)])
    frame = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA)
    got = trie.prefix_trie(trie.with_shared_heads(trie.turns_of(frame)))
    assert got.count() == len({seq for seq in _prefixes(rows)})


def _prefixes(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((t is not None, t or 0), role or "", hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()))
    turns = {c: [x[1:] for x in sorted(ts)] for c, ts in turns.items()}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        key = b""
        yield key
        for x in turns.get(c - c % 20, [])[:h] + turns[c][h:]:
            key = hashlib.md5(key + str(x).encode()).digest()
            yield key


def test_empty(spark):
    assert trie.prefix_trie(trie.with_shared_heads(trie.turns_of(spark.createDataFrame([], SCHEMA)))).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_shards_give_what_one_gives(seed):
    """Any cut of the sorted paths into shards, merged by digest, gives the nodes of the whole."""
    rng = np.random.default_rng(seed)
    turn = [hashlib.md5(bytes([i])).digest() for i in range(3)]
    paths = sorted({b"".join(turn[i] for i in rng.integers(0, 3, rng.integers(0, 9))) for _ in range(200)})
    w = [rng.integers(0, 9, len(p) // 16) * 0 + np.frombuffer(p, dtype=np.uint8)[::16] % 7 for p in paths]
    n, first, ends = rng.integers(1, 5, len(paths)), rng.permutation(len(paths)), [f"e{i}" for i in range(len(paths))]

    def rows(cuts):
        out = {}
        for i, j in zip(cuts, cuts[1:]):
            before = trie.shared_turns(paths[i - 1], paths[i]) if i else -1
            after = trie.shared_turns(paths[j - 1], paths[j]) if j < len(paths) else -1
            got = trie.build(paths[i:j], np.concatenate([*w[i:j], []]).astype(int), n[i:j], first[i:j], ends[i:j], before, after, after == len(paths[j - 1]) // 16)
            for name, depth, least, *sums, end in zip(*(got[c] for c in ("node", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"))):
                key = name or (int(depth), int(least))
                old = out.setdefault(key, [int(depth), int(least), np.zeros(4, dtype=int), ""])
                out[key] = [old[0], min(old[1], int(least)), old[2] + np.array(sums), max(old[3], end)]
        return sorted((d, least, *map(int, s), e) for d, least, s, e in out.values())

    whole = rows([0, len(paths)])
    assert whole == rows(list(range(len(paths) + 1))) == rows([0, 1, 7, 50, len(paths)])


def test_findclose_equals_a_stack():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 3000):
        bits, depth = [1], 1
        while len(bits) < 2 * n:
            up = depth == 1 or (rng.random() < 0.5 and bits.count(1) < n) if n < 100 else (depth == 1 or rng.random() < 0.55)
            up = up and sum(bits) < n
            if not up and depth == 1:
                break
            bits.append(int(up))
            depth += 1 if up else -1
        bits += [0] * depth
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opens = np.flatnonzero(bits)
        assert trie.Parens(np.array(bits, dtype=np.int8)).findclose(opens).tolist() == [close[i] for i in opens]
