import random

from framewise.llm import packing


def test_packing_holds_every_document_within_capacity(spark):
    rng = random.Random(2)
    sizes = [(k, rng.choice([0, 7, 7, 7, rng.randrange(1, 300), rng.randrange(1, 3000), None])) for k in range(1500)]
    plan = spark.createDataFrame([(1, 100), (2, 512), (3, 4000), (4, None)], "plan_id int, capacity_tokens int")
    rows = packing.packing(spark.createDataFrame(sizes, "doc_id long, n_tokens int"), plan).collect()
    want = {k: n for k, n in sizes if n}
    for p, capacity in ((1, 100), (2, 512), (3, 4000)):
        own = [r for r in rows if r.plan_id == p]
        held, spans = {}, {}
        for r in own:
            held[r.container] = held.get(r.container, 0) + r.n_tokens
            spans.setdefault(r.doc_id, []).append((r.from_token, r.n_tokens))
        assert max(held.values()) <= capacity and set(spans) == set(want)
        for d, pieces in spans.items():
            pieces.sort()
            assert sum(n for _, n in pieces) == want[d] and len(pieces) == -(-want[d] // capacity)
            assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0
        assert len(held) <= 1.02 * -(-sum(want.values()) // capacity) + 1
    assert {r.plan_id for r in rows} == {1, 2, 3}


def one_by_one(items, capacity):
    """Containers of best fit by decreasing size."""
    gaps = []
    for s in sorted(items, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(fit)] = fit - s
    return len(gaps)


def check(placements, opened, want):
    """Every rank of every size in one place, nothing over capacity."""
    for plan, (capacity, items) in want.items():
        used, ranks = {}, {}
        for r in (x for x in placements if x.plan_id == plan):
            for k in range(r.n):
                c = r.container + k // r.each
                used[c] = used.get(c, 0) + r.size
                ranks.setdefault(r.size, []).append(r.start + k)
        assert max(used.values()) <= capacity and len(used) == opened[plan] and max(used) == opened[plan] - 1
        assert {s: sorted(x) for s, x in ranks.items()} == {s: list(range(items.count(s))) for s in set(items)}


def test_rounds_are_near_one_by_one_best_fit(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(packing, "RANGE_SIZES", 8)
    want = {1: (50, [rng.randrange(1, 51) for _ in range(900)]), 2: (64, [33] * 40 + [31] * 50 + [1] * 90), 3: (500, [int(rng.lognormvariate(3.5, 1)) % 500 + 1 for _ in range(2000)]), 4: (7, [7] * 5), 5: (100, [100, 1])}
    rows = [(p, c, s, items.count(s)) for p, (c, items) in want.items() for s in set(items)]
    placements, opened = packing.best_fit_rounds(spark.createDataFrame(rows, "plan_id int, capacity long, size int, n long"))
    check(placements.collect(), opened, want)
    for p, (capacity, items) in want.items():
        assert opened[p] <= 1.02 * one_by_one(items, capacity) + 1


def test_carry_over_goes_up_to_the_nearest_places():
    flows, beyond = packing.carry([(0, 5, 0), (1, 2, 0), (2, 3, 3), (5, 0, 4)])
    assert flows == [(1, 0, 2, 0, 2), (0, 0, 2, 2, 1), (2, 0, 5, 0, 3), (0, 1, 5, 3, 1)]
    assert beyond == [(0, 2, 3)]


def test_report_counts_what_packing_fills(spark):
    rng = random.Random(5)
    sizes = spark.createDataFrame([(k, rng.choice([11, 11, rng.randrange(1, 900)])) for k in range(800)], "doc_id long, n_tokens int")
    plan = spark.createDataFrame([(1, 100), (1, 300), (2, 512)], "plan_id int, capacity_tokens int")
    filled = {p: set() for p in (1, 2)}
    for r in packing.packing(sizes, plan).collect():
        filled[r.plan_id].add(r.container)
    report = {r.plan_id: r for r in packing.packing_report(sizes, plan).collect()}
    assert {p: report[p].containers for p in report} == {p: len(c) for p, c in filled.items()}
    assert (report[1].capacity, report[2].capacity) == (100, 512) and all(r.least <= r.containers for r in report.values())


def test_many_plans_and_one_size_for_all(spark):
    plan = spark.createDataFrame([(k, 40 + k % 7) for k in range(1100)], "plan_id int, capacity_tokens int")
    sizes = spark.createDataFrame([(k, 20) for k in range(4)], "doc_id long, n_tokens int")
    rows = packing.packing(sizes, plan).collect()
    assert len(rows) == 4400 and {(r.plan_id, r.container) for r in rows} == {(k, c) for k in range(1100) for c in (0, 1)}


def test_empty(spark):
    plan = spark.createDataFrame([(1, 100)], "plan_id int, capacity_tokens int")
    empty = spark.createDataFrame([], "doc_id long, n_tokens int")
    assert packing.packing(empty, plan).collect() == [] and packing.packing_report(empty, plan).collect() == []
