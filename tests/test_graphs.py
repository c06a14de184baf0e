"""Golden graphs, brute force on random ones, and invariants."""

import random
from collections import Counter
from itertools import combinations
from math import comb

import pytest
from pyspark.sql import functions as F

from lattiq.operators import basic, cliques, nucleus, paths, splits
from lattiq.sources import graphs, runlog

GOLDEN = {
    "readme5": ([(1, 2), (2, 3), (2, 4), (3, 4), (4, 5)], {1: 5, 2: 5, 3: 1}, {(1, 2): {1: 2, 2: 3}, (2, 3): {0: 2, 1: 3}, (3, 4): {0: 1}}),
    "k5_k4_edge": ([*combinations(range(5), 2), (3, 5), (3, 6), (4, 5), (4, 6), (5, 6)], {1: 7, 2: 15, 3: 14, 4: 6, 5: 1}, {(1, 2): {3: 2, 4: 5}, (2, 3): {2: 5, 3: 10}, (3, 4): {1: 4, 2: 10}}),
    "c5": ([(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)], {1: 5, 2: 5}, {(1, 2): {2: 5}, (2, 3): {0: 5}, (3, 4): {}}),
}


def table(spark, edges):
    return spark.createDataFrame(sorted(edges), "src long, dst long")


def listed(edges, k):
    e, v = set(edges), sorted({x for p in edges for x in p})
    return [c for c in combinations(v, k) if all(p in e for p in combinations(c, 2))]


def naive_cores(edges, r, s):
    family = set(listed(edges, s))
    alive = set(listed(edges, r)) if r > 1 else {(v,) for p in edges for v in p}
    core, level = {}, 0
    while alive:
        support = Counter(x for c in family for x in combinations(c, r))
        level = max(level, min(support[x] for x in alive))
        out = {x for x in alive if support[x] <= level}
        core |= dict.fromkeys(out, level)
        alive -= out
        family = {c for c in family if not out & set(combinations(c, r))}
    return core


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(spark, name):
    edges, sizes, cores = GOLDEN[name]
    e = table(spark, edges)
    assert {r["k"]: int(r["n"]) for r in paths.counts(paths.clique_paths(e)).collect()} == sizes
    for (r, s), want in cores.items():
        got = nucleus.nucleus(e, r=r, s=s, include_zero=True).collect()
        assert Counter(int(x["core"]) for x in got) == want


def test_random_graphs_against_brute_force(spark):
    rnd = random.Random(3)
    edges = [p for p in combinations(range(12), 2) if rnd.random() < 0.55]
    e = table(spark, edges)
    p = paths.clique_paths(e).cache()
    vertex = {(r["id"], r["k"]): int(r["n"]) for r in paths.vertex_counts(p).collect()}
    pair = {(r["src"], r["dst"], r["k"]): int(r["n"]) for r in paths.edge_counts(p).collect()}
    for k in range(2, 6):
        c = listed(edges, k)
        assert {x: n for x, n in vertex.items() if x[1] == k} == {(v, k): n for v, n in Counter(v for x in c for v in x).items()}
        assert {x: n for x, n in pair.items() if x[2] == k} == {(*q, k): n for q, n in Counter(q for x in c for q in combinations(x, 2)).items()}
        assert sum(pair.get((*q, k), 0) for q in edges) == comb(k, 2) * len(c)
    for r, s in ((1, 3), (2, 3), (2, 4), (3, 4)):
        got = {tuple(x["rc"]): int(x["core"]) for x in nucleus.nucleus(e, r=r, s=s, include_zero=True).collect()}
        assert got == naive_cores(edges, r, s)
    assert {(x["id"],): int(x["core"]) for x in nucleus.vertex_nucleus(e, s=4).collect()} == naive_cores(edges, 1, 4)
    cut = {frozenset(q) for q in edges[::3]}
    left = splits.split_paths(p, 2, cut)
    rest = [q for q in edges if frozenset(q) not in cut]
    assert {r["k"]: int(r["n"]) for r in paths.counts(left).collect() if r["k"] > 2} == {k: n for k in range(3, 7) if (n := len(listed(rest, k)))}
    every = {frozenset(c) for k in range(1, 9) for c in listed(edges, k)}
    assert {frozenset(r["c"]) for r in paths.maximal_cliques(e).collect()} == {c for c in every if not any(c < d for d in every)}


def test_summary_of_long_paths(spark):
    rows = [(0, [0], list(range(1, n))) for n in (3, 400, 401, 1200)] + [(7, [7], [])]
    p = spark.createDataFrame(rows, "root long, hold array<long>, pivot array<long>")
    for r in (2, 3, 12):
        got = paths.summary(p, r).first()
        assert (got["paths"], got["max_clique"], int(got["pairs"])) == (5, 1200, sum(comb(n, r) for n in (1, 3, 400, 401, 1200)))
    with pytest.raises(OverflowError):
        paths.summary(p, 20)
    with pytest.raises(OverflowError):
        paths.counts(p)
    some = {r["k"]: int(r["n"]) for r in paths.counts(p, 4, empty=True).collect()}
    assert some == {0: 1, **{k: sum(comb(n - 1, k - 1) for n in (1, 3, 400, 401, 1200)) for k in (1, 2, 3, 4)}}
    every = {r["k"]: int(r["n"]) for r in paths.exact_counts(p).collect()}
    assert every == {k: n for k in range(1, 1201) if (n := sum(comb(x - 1, k - 1) for x in (1, 3, 400, 401, 1200)))}
    assert paths.summary(p.limit(0)).first()["paths"] == 0


def test_hierarchy(spark):
    edges = GOLDEN["k5_k4_edge"][0]
    got = nucleus.hierarchy(table(spark, edges), r=2, s=3).groupBy("level", "level_value", "component").count().collect()
    assert {(r["level"], r["level_value"], tuple(r["component"]), r["count"]) for r in got} == {(1, 2, (0, 1), 15), (2, 3, (0, 1), 10)}
    levels = nucleus.hierarchy(table(spark, [*combinations(range(4), 2), *combinations(range(10, 14), 2), (0, 10), (1, 10)]), r=2, s=3).cache()
    tree = {(r["level"], tuple(r["component"])): (r["members"], r["parent"] and tuple(r["parent"])) for r in nucleus.hierarchy_tree(levels).collect()}
    assert tree == {(1, (0, 1)): (8, None), (1, (10, 11)): (6, None), (2, (0, 1)): (6, (0, 1)), (2, (10, 11)): (6, (10, 11))}
    assert len(nucleus.hierarchy_tree(levels, least=7).collect()) == 1
    lines = [r["value"] for r in nucleus.hierarchy_lines(levels).orderBy("level", "n", "value").collect()]
    assert lines[0] == "K = 1: 2 components" and lines[1].startswith("  Component (0, 1): [(0, 1) (0, 2)") and len(lines) == 6
    assert nucleus.hierarchy(table(spark, [(0, 1)]), r=2, s=3).count() == 0


def naive_diversity(edges, k):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v), near.setdefault(v, set()).add(u)
    out = {}
    for v, around in near.items():
        net = {x: near[x] & around for x in around}
        while weak := [x for x in net if len(net[x]) < k]:
            net = {x: s - set(weak) for x, s in net.items() if x not in weak}
        n, left = 0, set(net)
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                new = net[todo.pop()] & left
                left -= new
                todo += new
        out[v] = n
    return out


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_diversity(spark, k):
    rnd = random.Random(k)
    for edges in ([(0, 1), (0, 2), (1, 2), (2, 3), (2, 4), (3, 4)], [p for p in combinations(range(14), 2) if rnd.random() < 0.4]):
        got = {r["id"]: r["tau"] for r in nucleus.structural_diversity(table(spark, edges), k).collect()}
        assert got == naive_diversity(edges, k)


def test_counts_over_paths_against_brute_force(spark):
    rnd = random.Random(9)
    edges = [p for p in combinations(range(13), 2) if rnd.random() < 0.5]
    e = table(spark, edges)
    p = paths.clique_paths(e).cache()
    rows = [(list(r["hold"]), list(r["pivot"])) for r in p.collect()]
    for k in (2, 3, 4):
        got = [tuple(r["c"]) for r in paths.cliques_of(p, k).collect()]
        assert len(got) == len(set(got)) and set(got) == set(listed(edges, k))
    support = Counter(t for c in listed(edges, 4) for t in combinations(c, 3))
    assert {tuple(r["rc"]): int(r["n"]) for r in paths.subset_support(p, 3, 4).collect()} == support
    joint = {(r["src"], r["dst"]): (int(r["n_r"]), int(r["support"])) for r in paths.joint_counts(p, 3, 4).collect()}
    on = lambda q: [t for t in listed(edges, 3) if set(q) <= set(t)]
    assert joint == {q: (len(on(q)), sum(support[t] for t in on(q))) for q in edges if on(q)}
    cover = {(r["src"], r["dst"]): r["paths"] for r in paths.edge_cover(p).collect()}
    assert cover == {q: n for q in edges if (n := sum(set(q) <= {*h, *v} for h, v in rows))}
    values = spark.createDataFrame([(u, v, u * 100 + v) for u, v in edges], "src long, dst long, value long")
    least = Counter((tuple(r["hold"]), tuple(r["pivot"]), r["value"]) for r in paths.path_minima(p, values).collect())
    assert least == Counter((tuple(h), tuple(v), min((a * 100 + b for a, b in combinations(sorted([*h, *v]), 2)), default=None)) for h, v in rows)
    cores = spark.createDataFrame([(i, i * i) for i in range(13)], "id long, core long")
    assert all(r["core"] == r["hold"][0] ** 2 for r in paths.hold_cores(p, cores).collect())
    for r in paths.core_bounds(p, 2, 3).collect():
        n = len(r["hold"]) + len(r["pivot"])
        assert int(r["bound"]) == (comb(n - 2, 1) if n >= 3 else 0)
    shared = sorted(n for x, y in combinations(rows, 2) if (n := len({*x[0], *x[1]} & {*y[0], *y[1]})) >= 3)
    assert sorted(r["shared"] for r in paths.overlaps(p, 3).collect()) == shared
    times = Counter(v for h, x in rows for v in (*h, *x))
    kept = [(h, [v for v in x if times[v] > 1]) for h, x in rows if all(times[v] > 1 for v in h)]
    want = sum(comb(len(x), 3 - len(h)) for h, x in kept if len(h) <= 3)
    assert sum(int(r["n"]) for r in paths.union_counts(p, 3).collect()) == want
    where = {r["id"]: len(r["hold"]) + len(r["pivot"]) for r in paths.vertex_paths(p).collect()}
    assert where == times
    stats = paths.search_stats(e).first()
    assert stats["calls"] >= len(rows) and stats["squares"] >= stats["open"] > 0


def test_splits_against_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        n, r, least = rnd.randint(2, 8), rnd.randint(2, 3), rnd.randint(0, 5)
        members = list(range(n))
        h = rnd.randint(1, n)
        gone = rnd.sample(list(combinations(members, r)), rnd.randint(0, comb(n, r))) if n >= r else []
        got = []
        for hold, pivot in splits.without_cliques(members[:h], members[h:], gone, least):
            got += [frozenset((*hold, *c)) for k in range(len(pivot) + 1) for c in combinations(pivot, k)]
        want = {frozenset((*members[:h], *c)) for k in range(n - h + 1) for c in combinations(members[h:], k)}
        want = {c for c in want if not any(set(g) <= c for g in gone)}
        assert len(got) == len(set(got)) and set(got) <= want
        assert {c for c in want if len(c) >= least} <= set(got)


def test_cores_over_paths(spark):
    rnd = random.Random(7)
    edges = [p for p in combinations(range(11), 2) if rnd.random() < 0.6]
    for r, s in ((2, 3), (3, 4), (2, 5), (3, 5)):
        found, rounds = nucleus.path_nucleus(table(spark, edges), r=r, s=s)
        want = naive_cores(edges, r, s)
        inside = {x for c in listed(edges, s) for x in combinations(c, r)}
        assert {tuple(x["rc"]): int(x["core"]) for x in found.collect()} == {x: want[x] for x in inside}
        log = rounds.orderBy("round").collect()
        assert int(log[0]["s_cliques"]) == len(listed(edges, s)) and sum(x["gone"] for x in log) == len(inside)


def test_cores_of_a_large_clique_without_listing(spark):
    edges = [*combinations(range(60), 2), *combinations(range(55, 64), 2), (60, 70)]
    got = Counter(int(x["core"]) for x in nucleus.nucleus(table(spark, set(edges)), r=2, s=8).collect())
    # edges of the other clique of nine: 7 choose 6 s-cliques each; those of the large one have them within it
    assert got == {comb(58, 6): comb(60, 2), comb(7, 6): comb(9, 2) - comb(5, 2), 0: 1}


def test_generators(spark):
    for n, m in ((1, 5), (2, 1), (30, 435), (30, 434), (50, 100)):
        rows = [tuple(r) for r in graphs.uniform_graph(spark, n, m).collect()]
        assert len(set(rows)) == len(rows) == min(m, n * (n - 1) // 2) and all(0 <= u < v < n for u, v in rows)
    for n, m in ((8, 1000), (40, 100)):
        rows = [tuple(r) for r in graphs.weighted_graph(spark, n, m).collect()]
        assert len(set(rows)) == len(rows) and all(0 <= u < v < n for u, v in rows)
        assert len(rows) == n * (n - 1) // 2 or 0.9 * m <= len(rows) + 1 <= 1.2 * m + 1


def test_numbers_in_order(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 5)) for i in range(500)]
    got = graphs.numbered(spark.createDataFrame(rows, "id long, x int"), ["x", "id"]).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert sorted(r["rank"] for r in got) == list(range(500))


@pytest.mark.parametrize("lines", [["5 2", "1 2", "", "# x", "2\t3", "3 2", "4 4"], ["5", "1 2 9", "2,3"]])
def test_edge_text(spark, lines):
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted(map(tuple, graphs.parse_edges(rows, header=True).collect())) == [(1, 2), (2, 3)]
    with pytest.raises(Exception, match="not an edge"):
        graphs.parse_edges(spark.createDataFrame([("1 x",)], "value string"), strict=True).collect()


def test_header_is_one_line(spark):
    lines = spark.createDataFrame([("5 2",), ("1 2",), ("5 2",)], "value string").coalesce(1)
    assert sorted(map(tuple, graphs.parse_edges(lines, header=True).collect())) == [(1, 2), (2, 5)]
    for bad in ("1 5", "1 1", "-1 2", "1", "a b"):
        rows = spark.createDataFrame([("5 2",), ("1 2",), (bad,)], "value string").coalesce(1)
        with pytest.raises(Exception, match="not an edge"):
            graphs.parse_edges(rows, header=True, strict=True).collect()
    names = graphs.parse_named(spark.createDataFrame([("x y 3",), ("# c",), ("z",), ("x y",)], "value string"))
    assert [tuple(r) for r in names.collect()] == [("x", "y"), ("x", "y")]
    assert graphs.parse_edges(lines.limit(0), header=True, strict=True).count() == 0


def test_isolated_vertices_and_empty_tables(spark):
    e = table(spark, [(0, 1)])
    assert sorted(map(tuple, basic.degrees(e, graphs.vertices(e, 3)).collect())) == [(0, 1), (1, 1), (2, 0)]
    none = spark.createDataFrame([], "src long, dst long")
    assert nucleus.core_numbers(none).count() == 0
    assert paths.counts(paths.clique_paths(none)).count() == 0
    assert cliques.k_cliques(none, 3).count() == 0


#: Lines as programs of this kind and ``time -v`` print them.
PRINTED = """noise
================== RUN ==================
dataset   : cut/off.edges
================== RUN ==================
timestamp : 2024-05-06 07:08:09
dataset   : d/dblp.edges
s         : 3
r         : 13
time_bin  : /bin/time -v
cmd       : bin/x   d/dblp.edges  3 13
Node Size: 317080
Edge Size: 1049866
Tree Build took: 285.565 ms
max clique: 114
nun Leaf: 3636
Clique Index: 3537 cliques, 1049866 vertices.
clique Index build took: 11.814 ms
countingPerRClique took: 1.835 ms
minCore: 1 heap size: 9961 num Leaf: 3636 13-Clique count: 5.2703e+16
minCore: 4.94169e+15 heap size: 114 num Leaf: 102 13-Clique count: 4.33348e+16
minCore: 0.50, heap size: 5402
time: 21 ms
countingRClique updates time: 1.0775 ms
NucleusCoreDecomposition took: 27.137 ms
\tMaximum resident set size (kbytes): 2048
\tExit status: 0
exit_status: 0
================ END OF RUN ==================
================== RUN ==================
cut off
"""


def test_run_logs(spark):
    runs = runlog.blocks(spark.createDataFrame([("f", PRINTED), ("g", None), ("h", "")], "file string, value string"))
    rows = runlog.measured(runlog.normalised(runlog.records(runs))).collect()
    assert len(rows) == 1
    want = {
        "file": "f", "dataset": "d/dblp.edges", "r": 3, "s": 13, "n": 317080, "m": 1049866, "max_clique": 114, "tree_build_ms": 285.565, "clique_index_ms": 11.814, "prog_time_ms": 21.0,
        "num_leaves": 3636, "max_rss_kb": 2048, "exit_status": 0, "cmd": "bin/x d/dblp.edges 3 13", "timestamp": "2024-05-06 07:08:09", "mb": 2.0, "max_degree": None,
    }
    assert {k: rows[0][k] for k in want} == want and abs(rows[0]["ms"] - 318.379) < 1e-9
    assert [tuple(x) for x in rows[0]["heap_series"]] == [(0.5, 5402)]
    assert [(r["level"], r["heap"], r["cliques"]) for r in runlog.rounds(runs).orderBy("round").collect()] == [(1.0, 9961, 5.2703e16), (4.94169e15, 114, 4.33348e16)]
    killed = runs.withColumn("block", F.concat("block", F.lit("Command terminated by signal 9")))
    assert runlog.records(killed).first()["exit_status"] == -1
    t = spark.createDataFrame([("1:02:03",), ("2:03",), ("4.5",)], "e string").select(runlog.seconds("e").alias("s"))
    assert [r["s"] for r in t.collect()] == [3723.0, 123.0, 4.5]
    names = ["x-20", "x_40", "x(60)", "x-80%", "x.p20", "x", "x-20.edges"]
    sizes = spark.createDataFrame([(i, v) for i, v in enumerate(names)], "i int, e string").orderBy("i")
    assert [(r["s"], r["b"]) for r in sizes.select(runlog.size_suffix("e").alias("s"), runlog.base_name("e").alias("b")).collect()] == [(20, "x"), (40, "x"), (60, "x"), (80, "x"), (20, "x"), (100, "x"), (100, "x-20")]
    codes = spark.createDataFrame([("34",), ("114",), ("3",), ("x4",), (None,)], "e string").select(runlog.pair_code("e").alias("x"))
    assert [tuple(r["x"]) for r in codes.collect()] == [(3, 4), (1, 14), (None, None), (None, None), (None, None)]
