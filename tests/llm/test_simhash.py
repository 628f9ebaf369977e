import numpy as np
import xxhash

from hazegrid.llm import graph, simhash

from .conftest import prose


def brute_groups(prints, radius):
    """Smallest id reachable, by comparing all pairs."""
    n = len(prints)
    f = np.array([p for _, p in prints], dtype=np.uint64)
    group = list(range(n))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= radius):
            group[find(i)] = find(int(j))
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(n)]


def by_definition(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check(rows, found, radius=3):
    prints = [(r[0], by_definition(r[1])) for r in rows]
    want = sorted((str(d), f"{p:016x}", str(c)) for (d, p), c in zip(prints, brute_groups(prints, radius)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == want


def test_groups_equal_brute_force(edge_docs, edge_rows):
    check(edge_rows, simhash.simhash_groups(edge_docs).collect())


def test_many_near_copies_walked_in_chunks(spark, monkeypatch):
    """A large bucket, dealt out in chunks and walked, links what all pairs link."""
    monkeypatch.setattr(simhash, "SMALL", 4)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    base = prose(900, 1).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[i * 13 % 900] = f"changed{i}"
        w[i * 31 % 900] = "other"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(40, i + 5)) for i in range(20)] + [(7, rows[7][1]), (None, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, simhash.simhash_groups(docs).collect())


def test_short_segments_collide_often(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5, dtype=np.int64)
    f = [int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 62, (40, 2))]
    prints = spark.createDataFrame([(x,) for x in set(f)], "f0 long")
    got = graph.components(simhash.links(prints, 3, (32, 32), 4).selectExpr("a0 AS a", "b0 AS b")).collect()
    want = brute_groups([(x, np.int64(x).view(np.uint64)) for x in sorted(set(f))], 3)
    root = {r.node: r.root for r in got}
    assert [root.get(x, x) for x in sorted(set(f))] == want


def test_components_follow_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (50, 50)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_one_of_each_group_stays(spark):
    a, b = prose(200, 1), prose(200, 2)
    rows = [(5, a), (3, a), (8, a.upper()), (1, b), (2, b.replace(" ", "\t")), (20, prose(200, 3)), (21, prose(150, 4)),
            (40, None), (41, ""), (42, "a"), (43, "a"), (44, prose(120, 9)), (44, prose(120, 9)), (None, prose(120, 10)), (None, prose(120, 10)), (50, " ")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    kept = simhash.keep_one_of_each(docs)
    assert kept.schema == docs.schema
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([3, 1, 20, 21, 40, 42, 44, None], key=str)


def test_kept_rows_are_the_first_of_their_groups(edge_docs, edge_rows):
    """One row of each group of ``simhash_groups``: the smallest id, null last."""
    groups = brute_groups([(i, by_definition(r[1])) for i, r in enumerate(edge_rows)], 3)
    best = {}
    for i, g in enumerate(groups):
        if g not in best or (edge_rows[i][0] is None, edge_rows[i][0] or 0) < (edge_rows[best[g]][0] is None, edge_rows[best[g]][0] or 0):
            best[g] = i
    got = simhash.keep_one_of_each(edge_docs)
    assert got.schema == edge_docs.schema
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(edge_rows[i])) for i in best.values())


def test_clashing_names_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5, 6, 7), (2, "a b c d", 5, 6, 8), (3, None, 1, 2, 3)], "doc_id long, text string, _PRINT long, _row int, _gone int")
    assert sorted(map(tuple, simhash.keep_one_of_each(docs).collect())) == [(1, "a b c d", 5, 6, 7), (3, None, 1, 2, 3)]


def test_empty(no_docs):
    assert simhash.simhash_groups(no_docs).count() == 0
    assert simhash.keep_one_of_each(no_docs).count() == 0
