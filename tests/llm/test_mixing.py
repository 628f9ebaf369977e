import numpy as np

from hazegrid.llm import mixing

from .conftest import prose


def brute_targets(sizes, cap=3):
    """Share by weight, cut what is above, share the rest again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, shares = total - sum(cap * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        goal = {s: cap * sizes[s] if s in capped else rest * weight[s] / shares for s in names}
        above = {s for s in names if s not in capped and goal[s] > cap * sizes[s]}
        if not above:
            return goal
        capped |= above


def test_targets_equal_brute_force(spark):
    sizes = {"b": 10_000, "a": 3, "é": 500, "Z": 70, None: 5, "c": 1, "d": 0, "e": 9000}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: round(r.target, 6) for r in got} == {k: round(v, 6) for k, v in brute_targets(sizes).items()}


def _mix_by_hand(rows, goal):
    """Send every document in virtual-time order; stop where the budget is passed."""
    order, times = {}, []
    for r in sorted(rows, key=lambda r: r.key):
        order.setdefault(r.source, []).append(r)
    for s, docs in order.items():
        sent = 0
        for e in range(3):
            for r in docs:
                sent += r.size
                if r.size and goal[s]:
                    times.append((sent / goal[s], r.doc_id, r.size))
    budget, taken = sum(r.size for r in rows), {}
    for t, words in sorted({t: sum(x[2] for x in times if x[0] == t) for t, _, _ in times}.items()):
        if words > budget:
            break
        budget -= words
        for x in times:
            if x[0] == t:
                taken[x[1]] = taken.get(x[1], 0) + x[2]
    return taken


def test_mix_equals_simulation(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 5)
    monkeypatch.setattr(mixing, "BINS", 4)
    rng = np.random.default_rng(1)
    docs = [(i, prose(int(rng.integers(1, 60)), i), "hot" if i % 3 else f"s{i % 7}") for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mix = mixing.plan(d)
    rows = mix.rows.collect()
    goal = {r.source: r.target for r in rows}
    got = {r.doc_id: r.taken for r in mixing.shares_taken(d).collect() if r.taken}
    assert got == _mix_by_hand(rows, goal)
    assert got == {r.doc_id: r.taken for r in mixing.shares_taken(d.repartition(3)).collect() if r.taken}
    sent = mixing.mixture(d).groupBy("doc_id").count().collect()
    size = {r.doc_id: r.size for r in rows}
    assert {r.doc_id: r["count"] * size[r.doc_id] for r in sent} == got


def test_edges(edge_docs, edge_rows, no_docs):
    out = mixing.shares_taken(edge_docs).collect()
    assert len(out) == len(edge_rows)
    assert all(r.taken <= 3 * r.size for r in out)
    assert {r.doc_id: r.taken for r in out if r.doc_id in (30, 31, 32)} == {30: 0, 31: 0, 32: 0}
    near = {}
    for r in out:
        near.setdefault(r.source, [r.target, 0])[1] += r.taken
    longest = max(r.size for r in out)
    assert all(abs(t - got) <= longest + 1 for t, got in near.values())
    assert mixing.mixture(edge_docs).schema == edge_docs.schema
    assert mixing.shares_taken(no_docs).count() == 0 and mixing.mixture(no_docs).count() == 0
