import random

from framewise.llm import components

SCHEMA = "entry_id long, video_id string, question string, note string"


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for v in list(root):
        groups.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def as_sets(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], set()).add(r[0])
    return {frozenset(g) for g in groups.values()}


def test_random_graphs_match_union_find(spark):
    rng = random.Random(3)
    edges = [(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for _ in range(45)]
    got = components.components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert as_sets(got) == brute([e for e in edges if e[0] != e[1]])


def test_long_chain_and_star(spark):
    chain = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(40)]
    star = [("hub", f"s{k}") for k in range(30)]
    got = components.components(spark.createDataFrame(chain + star, "a string, b string")).collect()
    assert as_sets(got) == brute(chain + star)


def test_pairs_ignore_notation_nulls_and_follow_chains(spark):
    rows = [
        (1, "v000000001", "Where is the cup?", "x"), (2, "videos/v000000002.mp4", "WHERE is <b>the</b> cup", None), (3, "2", "Who left?", ""), (4, " V000000003 ", "who​ left?!", ""),
        (5, None, "Who left?", ""), (6, "v000000004", None, ""), (7, "v000000004", "???", ""), (8, "v000000005", "???", ""), (9, "v000000006", "Where is the cap?", ""), (9, "v000000006", "Where is the cap?", ""),
    ]
    got = {tuple(r) for r in components.tied_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    a, b, c = "v000000001", "v000000002", "v000000003"
    assert got == {(a, b), (a, c), (b, c)}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert components.tied_pairs(empty).collect() == []
    plan = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split string, share double")
    assert components.grouped_splits(empty, plan).collect() == []


def test_splits_keep_units_together_and_shares(spark):
    rng = random.Random(5)
    rows = [(k, f"v{rng.randrange(1200):09d}" if rng.random() > 0.05 else None, f"question {rng.randrange(2500)}" if rng.random() > 0.05 else None, "") for k in range(3000)]
    plan = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double")
    got = {r.entry_id: r for r in components.grouped_splits(spark.createDataFrame(rows, SCHEMA), plan).collect()}
    assert set(got) == set(range(3000))
    by = {}
    for k, v, q, _ in rows:
        for key in (("v", v), ("q", q)):
            if key[1]:
                by.setdefault(key, set()).add(got[k].split)
    assert all(len(s) == 1 for s in by.values())


def test_a_round_moves_the_frontier_and_not_the_edges(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = components.adjacency(spark.createDataFrame([(f"v{k}", f"v{k * 7 % 90}") for k in range(300)], "a string, b string"))
        frontier = spark.createDataFrame([("v1", "v1")], "v string, label string")
        lines = components.reach(edges, frontier)._jdf.queryExecution().executedPlan().toString().splitlines()
        # Two exchanges: of the frontier, and of what it reached; none lies over the scan of the edges.
        assert sum("Exchange" in line for line in lines) == 2
        scan = next(k for k, line in enumerate(lines) if "Scan ExistingRDD[src" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        over = [k for k in range(scan) if depth(lines[k]) < depth(lines[scan]) and "Exchange" in lines[k]]
        join = next(k for k, line in enumerate(lines) if "Join" in line)
        assert all(k < join for k in over)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
