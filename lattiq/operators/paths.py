"""Clique paths: (hold, pivot) pairs that stand for each clique exactly once, and counts on them."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import chain, combinations, islice
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattiq import scratch
from lattiq.sources.graphs import symmetric

from .basic import oriented


def paths_of(root: int, near: dict[int, set[int]], most: int | None = None, least: int = 0, calls: list[int] | None = None) -> Iterator[tuple[list[int], list[int]]]:
    """Paths of the cliques whose first vertex is ``root``; ``near``: its forward neighbours, each
    with its neighbours among them.  A path (H, P) stands for H with any part of P.

    ``most`` (a clique size): a path whose hold has that many members keeps no pivots, larger
    ones are left out; ``least``: shorter paths are left out.  ``calls`` gets the number of open
    vertices of each step of the search.
    """
    names = sorted(near)
    at = {v: i for i, v in enumerate(names)}
    mask = [sum(1 << at[w] for w in near[v] if w in at) for v in names]

    todo = [((1 << len(names)) - 1, [root], [])]
    while todo:
        open_, hold, pivot = todo.pop()
        if calls is not None:
            calls.append(open_.bit_count())
        if most is not None and len(hold) == most:
            yield hold, []
            continue
        if len(hold) + len(pivot) + open_.bit_count() < least:
            continue
        if not open_:
            yield hold, pivot
            continue
        bits = list(_bits(open_))
        u = max(bits, key=lambda i: ((mask[i] & open_).bit_count(), -i))
        rest = open_ & ~mask[u]
        todo.append((open_ & mask[u], hold, [*pivot, names[u]]))
        left = open_ & ~(1 << u)
        for x in _bits(rest & ~(1 << u)):
            left &= ~(1 << x)
            todo.append((left & mask[x], [*hold, names[x]], pivot))


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def ego_nets(edges: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """``root, near array<struct<v, adj>>``: forward neighbours and the edges among them.  Without
    an order vertices come by degree, then id, which bounds a net by the square root of 2 m."""
    dag = oriented(edges, order)
    adj = dag.groupBy("u").agg(F.collect_list("v").alias("adj"))
    pairs = dag.join(adj, "u").select(F.col("u").alias("root"), F.col("v"), F.col("adj").alias("own"))
    pairs = pairs.join(adj.select(F.col("u").alias("v"), "adj"), "v", "left")
    common = F.array_intersect("own", F.coalesce("adj", F.array().cast("array<long>")))
    return pairs.groupBy("root").agg(F.collect_list(F.struct("v", common.alias("adj"))).alias("near"))


def _nets(edges: DataFrame, order: DataFrame | None) -> DataFrame:
    """Nets of all vertices, also of those without a forward neighbour."""
    nets = ego_nets(edges, order)
    lone = symmetric(edges).select("u").distinct().join(nets.select("root"), F.col("u") == F.col("root"), "left_anti")
    none = F.array().cast("array<struct<v:bigint,adj:array<bigint>>>")
    return nets.unionByName(lone.select(F.col("u").alias("root"), none.alias("near")))


def _loaded(near: list[dict]) -> dict[int, set[int]]:
    net = {x["v"]: set(x["adj"]) for x in near}
    return {v: s | {w for w in net if v in net[w]} for v, s in net.items()}


def clique_paths(edges: DataFrame, most: int | None = None, least: int = 0, order: DataFrame | None = None) -> DataFrame:
    """``root, hold array<long>, pivot array<long>`` (G4-G6).  Each root is worked on alone."""

    def run(batches):
        for b in batches:
            out = ([], [], [])
            for root, near in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for hold, pivot in paths_of(root, _loaded(near), most, least):
                    for c, x in zip(out, (root, hold, pivot), strict=True):
                        c.append(x)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], kind), pa.array(out[2], kind)], ["root", "hold", "pivot"])

    return _nets(edges, order).mapInArrow(run, "root long, hold array<long>, pivot array<long>")


def search_stats(edges: DataFrame, most: int | None = None, least: int = 0, order: DataFrame | None = None) -> DataFrame:
    """One row: steps of the search for paths, and the sums of their open vertices and of their
    squares (A19).  They tell how well an order bounds the work."""

    def run(batches):
        for b in batches:
            out = []
            for root, near in zip(*(c.to_pylist() for c in b.columns), strict=True):
                calls: list[int] = []
                for _ in paths_of(root, _loaded(near), most, least, calls):
                    pass
                out.append((len(calls), sum(calls), sum(x * x for x in calls)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out, strict=True)) or [()] * 3)], ["calls", "open", "squares"])

    return _nets(edges, order).mapInArrow(run, "calls long, open long, squares long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "open", "squares")])


def write_paths(paths: DataFrame, path: str) -> None:
    """Save a table of paths."""
    paths.select("root", "hold", "pivot").write.mode("overwrite").parquet(path)


def read_paths(spark, path: str) -> DataFrame:
    """Load a saved table of paths."""
    return spark.read.schema("root long, hold array<long>, pivot array<long>").parquet(path)


def cliques_of(paths: DataFrame, k: int) -> DataFrame:
    """``c array<long>``: each ``k``-clique of the paths once, sorted (F5, G16): the hold with each
    choice of as many pivots as are missing.  Listed in parts, so a long path needs no memory."""
    kind = pa.list_(pa.int64())

    def run(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            every = chain.from_iterable(([*hold, *x] for x in combinations(pivot, k - len(hold))) for hold, pivot in rows if len(hold) <= k)
            while part := [sorted(c) for c in islice(every, 10_000)]:
                yield pa.RecordBatch.from_arrays([pa.array(part, kind)], ["c"])

    return paths.select("hold", "pivot").mapInArrow(run, "c array<long>")


def _sized(paths: DataFrame) -> DataFrame:
    return paths.select("hold", "pivot", F.size("hold").alias("h"), F.size("pivot").alias("p"))


def _binomials(sized: DataFrame, max_k: int | None = None) -> DataFrame:
    """``n, k, c``: the binomials that counts up to ``max_k`` take, for pivots up to the widest ``p``.
    What does not fit 38 digits raises; :func:`exact_counts` has no such bound."""
    widest = sized.agg(F.max("p")).first()[0] or 0
    top = widest if max_k is None else min(widest, max_k)
    if comb(widest, min(top, widest // 2)) >= 10**38:
        raise OverflowError(f"counts over 38 digits: C({widest}, {min(top, widest // 2)}); ask for fewer sizes or exact_counts")
    rows = ((n, k, str(comb(n, k))) for n in range(widest + 1) for k in range(min(n, top) + 1))
    spark = sized.sparkSession
    table = spark.createDataFrame(list(rows), "n int, k int, c string").select("n", "k", F.col("c").cast("decimal(38,0)").alias("c"))
    return F.broadcast(table)  # (widest + 1) times (top + 1) rows at most, and both are lengths of cliques


def counts(paths: DataFrame, max_k: int | None = None, empty: bool = False) -> DataFrame:
    """``k, n decimal``: cliques of each size (A4, A5); a path gives C(p, k - h).  ``empty``: also
    the one clique of no vertices, if there are paths."""
    sized = scratch.written(_sized(paths).groupBy("h", "p").agg(F.count("*").alias("times")), "sizes")
    joined = sized.join(_binomials(sized, max_k), F.col("n") == F.col("p"))
    out = joined.select((F.col("h") + F.col("k")).alias("k"), (F.col("times") * F.col("c")).alias("x"))
    out = out if max_k is None else out.where(F.col("k") <= max_k)
    found = out.groupBy("k").agg(F.sum("x").cast("decimal(38,0)").alias("n"))
    if empty:
        none = sized.limit(1).select(F.lit(0).alias("k"), F.lit(1).cast("decimal(38,0)").alias("n"))
        found = found.unionByName(none)
    return found


LIMB = 10**18


def exact_counts(paths: DataFrame, max_k: int | None = None) -> DataFrame:
    """``k, n string``: as :func:`counts`, for any number of digits.  Terms are cut into limbs of
    18 digits, whose sums stay in decimals; carries are settled per size at the end."""

    def terms(batches):
        for b in batches:
            for h, p, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = []
                for q in range(p + 1 if max_k is None else max(0, min(p, max_k - h) + 1)):
                    value, i = times * comb(p, q), 0
                    while value:
                        value, limb = divmod(value, LIMB)
                        out.append((h + q, i, limb))
                        i += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["k", "i", "limb"])

    def joined(batches):
        for b in batches:
            lists = b.column(1).to_pylist()
            totals = [str(sum(int(x["limb"]) * LIMB ** x["i"] for x in own)) for own in lists]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array(totals, pa.string())], ["k", "n"])

    sized = _sized(paths).groupBy("h", "p").agg(F.count("*").alias("times"))
    limbs = sized.mapInArrow(terms, "k long, i long, limb long").groupBy("k", "i").agg(F.sum(F.col("limb").cast("decimal(38,0)")).cast("decimal(38,0)").alias("limb"))
    return limbs.groupBy("k").agg(F.collect_list(F.struct("i", "limb")).alias("l")).mapInArrow(joined, "k int, n string")


def _roles(paths: DataFrame) -> DataFrame:
    tag = lambda c, x: F.transform(c, lambda v: F.struct(v.alias("v"), F.lit(x).alias("j")))
    return _sized(paths).withColumn("nodes", F.concat(tag("hold", 0), tag("pivot", 1)))


def _spread(rows: DataFrame, keys: list[str], max_k: int | None) -> DataFrame:
    """Counts per key from members' roles; equal roles are counted first, and written, so the paths
    are searched once."""
    grouped = scratch.written(rows.groupBy(*keys, "h", "p", "j").agg(F.count("*").alias("times")), "roles")
    joined = grouped.join(_binomials(grouped, max_k), F.col("n") == F.col("p") - F.col("j"))
    out = joined.select(*keys, (F.col("h") + F.col("j") + F.col("k")).alias("k"), (F.col("times") * F.col("c")).alias("x"))
    out = out if max_k is None else out.where(F.col("k") <= max_k)
    return out.groupBy(*keys, "k").agg(F.sum("x").cast("decimal(38,0)").alias("n"))


def vertex_counts(paths: DataFrame, max_k: int | None = None) -> DataFrame:
    """``id, k, n``."""
    rows = _roles(paths).select("h", "p", F.explode("nodes").alias("x")).select("h", "p", F.col("x.v").alias("id"), F.col("x.j").alias("j"))
    return _spread(rows, ["id"], max_k)


def _edge_roles(paths: DataFrame) -> DataFrame:
    one = _roles(paths).select("h", "p", "nodes", F.posexplode("nodes").alias("i", "x"))
    two = one.select("h", "p", "x", F.explode(F.expr("slice(nodes, i + 2, size(nodes))")).alias("y"))
    return two.select("h", "p", F.least("x.v", "y.v").alias("src"), F.greatest("x.v", "y.v").alias("dst"), (F.col("x.j") + F.col("y.j")).alias("j"))


def edge_counts(paths: DataFrame, max_k: int | None = None) -> DataFrame:
    """``src, dst, k, n``."""
    return _spread(_edge_roles(paths), ["src", "dst"], max_k)


def edge_cover(paths: DataFrame) -> DataFrame:
    """``src, dst, paths``: how many paths have both ends of an edge."""
    return _edge_roles(paths).groupBy("src", "dst").agg(F.count("*").alias("paths"))


def subset_support(paths: DataFrame, r: int, s: int) -> DataFrame:
    """``rc array<long>, n decimal``: how many ``s``-cliques are around each ``r``-clique (A10),
    counted over paths: a subset with j pivots has C(p - j, s - h - j) of its path.  ``s``-cliques
    are not listed."""

    def run(batches):
        for b in batches:
            for hold, pivot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, p = len(hold), len(pivot)
                values = [comb(p - j, s - h - j) if 0 <= s - h - j else 0 for j in range(min(r, p) + 1)]
                if max(values, default=0) >= 10**38:
                    raise OverflowError("counts over 38 digits")
                values = [Decimal(v) for v in values]
                inside = set(pivot)
                every = (c for c in combinations(sorted([*hold, *pivot]), r))
                while part := list(islice(every, 10_000)):
                    n = [values[sum(v in inside for v in c)] for c in part]
                    keep = [i for i, x in enumerate(n) if x]
                    yield pa.RecordBatch.from_arrays([pa.array([part[i] for i in keep], pa.list_(pa.int64())), pa.array([n[i] for i in keep], pa.decimal128(38, 0))], ["rc", "n"])

    each = paths.where(F.size("hold") + F.size("pivot") >= s).select("hold", "pivot").mapInArrow(run, "rc array<long>, n decimal(38,0)")
    return each.groupBy("rc").agg(F.sum("n").cast("decimal(38,0)").alias("n"))


def joint_counts(paths: DataFrame, r: int, s: int) -> DataFrame:
    """``src, dst, n_r, support``: per edge the ``r``-cliques on it, and the sum of their supports
    by ``s``-cliques, from one table of paths (A11); edges in no ``r``-clique are left out."""
    support = subset_support(paths, r, s).withColumnRenamed("n", "support")
    every = edge_counts(paths, r).where(F.col("k") == r).select("src", "dst", F.col("n").alias("n_r"))
    pair = F.explode(F.flatten(F.transform("rc", lambda x, i: F.transform(F.slice("rc", i + 2, r), lambda y: F.struct(x.alias("src"), y.alias("dst"))))))
    on_edge = support.select(pair.alias("e"), "support").groupBy("e.src", "e.dst").agg(F.sum("support").cast("decimal(38,0)").alias("support"))
    return every.join(on_edge, ["src", "dst"], "left").select("src", "dst", "n_r", F.coalesce("support", F.lit(0).cast("decimal(38,0)")).alias("support"))


def path_minima(paths: DataFrame, edge_values: DataFrame) -> DataFrame:
    """``root, hold, pivot, value``: the least value (``src, dst, value``) of the edges within each
    path (A17); null for a path of one vertex."""
    named = scratch.written(paths.select("root", "hold", "pivot").withColumn("path", F.monotonically_increasing_id()), "paths")
    nodes = named.select("path", F.posexplode(F.concat("hold", "pivot")).alias("i", "x"), F.concat("hold", "pivot").alias("all"))
    pairs = nodes.select("path", "x", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("y"))
    pairs = pairs.select("path", F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
    least = pairs.join(edge_values, ["src", "dst"]).groupBy("path").agg(F.min("value").alias("value"))
    return named.join(least, "path", "left").drop("path")


def hold_cores(paths: DataFrame, cores: DataFrame) -> DataFrame:
    """``root, hold, pivot, core``: the core (``id, core``) of each path's first hold vertex."""
    first = F.element_at("hold", 1)
    return paths.join(cores.select(F.col("id").alias("_id"), "core"), first == F.col("_id"), "left").drop("_id")


def core_bounds(paths: DataFrame, r: int, s: int) -> DataFrame:
    """``root, hold, pivot, bound string``: C(length - r, s - r), the core that the path's
    ``r``-cliques have within the path alone (F3); 0 for paths under ``s``.  Exact for any length."""

    def run(batches):
        for b in batches:
            n = [len(h) + len(p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            bound = pa.array([str(comb(x - r, s - r)) if x >= s else "0" for x in n], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, bound], ["root", "hold", "pivot", "bound"])

    return paths.select("root", "hold", "pivot").mapInArrow(run, "root long, hold array<long>, pivot array<long>, bound string")


def vertex_paths(paths: DataFrame) -> DataFrame:
    """``id, hold array, pivot array``: the numbers of the paths that hold a vertex, and of those
    that have it as a pivot (J7); paths are numbered as in the written table they are read from."""
    nodes = _numbered_nodes(paths)[1]
    of = lambda j: F.sort_array(F.collect_list(F.when(F.col("j") == j, F.col("path"))))
    return nodes.groupBy(F.col("v").alias("id")).agg(of(0).alias("hold"), of(1).alias("pivot"))


def _numbered_nodes(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written paths with a number each, and ``path, v, j`` (1: a pivot)."""
    named = scratch.written(paths.withColumn("path", F.monotonically_increasing_id()), "paths")
    tag = lambda c, x: F.transform(c, lambda v: F.struct(v.alias("v"), F.lit(x).alias("j")))
    return named, named.select("path", F.explode(F.concat(tag("hold", 0), tag("pivot", 1))).alias("x")).select("path", "x.v", "x.j")


def summary(paths: DataFrame, r: int = 2) -> DataFrame:
    """Paths, the largest clique, and how many (path, ``r``-subset) pairs there are."""
    length = F.size("hold") + F.size("pivot")
    longest = paths.agg(F.max(length)).first()[0] or 0
    if comb(longest, r) >= 10**38:
        raise OverflowError(f"counts over 38 digits: C({longest}, {r})")
    chosen = [(n, str(comb(n, r))) for n in range(r, longest + 1)]
    b = F.broadcast(paths.sparkSession.createDataFrame(chosen, "n int, c string").select("n", F.col("c").cast("decimal(38,0)").alias("c")))
    sized = paths.select(length.alias("len"))
    return sized.join(b, F.col("n") == F.col("len"), "left").agg(F.count("*").alias("paths"), F.max("len").alias("max_clique"), F.sum("c").cast("decimal(38,0)").alias("pairs"))


def union_counts(paths: DataFrame, k: int) -> DataFrame:
    """``k``-cliques without the vertices that occur in one path only (A15): pivots of that kind are
    dropped, and paths that hold one."""
    named, nodes = _numbered_nodes(paths)
    single = nodes.groupBy("v").agg(F.count("*").alias("t")).where("t = 1")
    lone = nodes.join(single, "v").groupBy("path").agg(F.collect_list("v").alias("lone"))
    rows = named.join(lone, "path", "left").withColumn("lone", F.coalesce("lone", F.array().cast("array<long>")))
    rows = rows.where(~F.arrays_overlap("hold", "lone")).select("root", "hold", F.array_except("pivot", "lone").alias("pivot"))
    return counts(rows, k).where(F.col("k") == k)


def overlaps(paths: DataFrame, r: int) -> DataFrame:
    """``a, b, shared``: pairs of paths with at least ``r`` common vertices (J6), named by a number.

    Members are ranked by how few paths have them.  Two paths with ``r`` in common meet in one of
    the ``length - r + 1`` rarest of each, so only those are joined, and a vertex of very many
    paths drops out; the pairs that meet are then compared whole.
    """
    named, nodes = _numbered_nodes(paths.select("root", "hold", "pivot"))
    freq = nodes.groupBy("v").agg(F.count("*").alias("f"))
    ranked = nodes.join(freq, "v").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("m"))
    some = ranked.where(F.size("m") >= r).select("path", F.explode(F.slice("m", F.lit(1), F.size("m") - r + 1)).alias("x")).select("path", "x.v")
    x, y = some.withColumnRenamed("path", "a"), some.withColumnRenamed("path", "b")
    met = x.join(y, "v").where("a < b").select("a", "b").distinct()
    members = named.select("path", F.concat("hold", "pivot").alias("c"))
    both = met.join(members.select(F.col("path").alias("a"), F.col("c").alias("ca")), "a").join(members.select(F.col("path").alias("b"), F.col("c").alias("cb")), "b")
    return both.select("a", "b", F.size(F.array_intersect("ca", "cb")).cast("long").alias("shared")).where(F.col("shared") >= r)


def maximal_cliques(edges: DataFrame) -> DataFrame:
    """``c array<long>``: every maximal clique once.

    Root by root the cliques that no later vertex extends are listed, by the pivot rule, within the
    forward neighbours, of which a vertex has at most the square root of 2 m.  A clique that an
    earlier vertex extends lies within another of the list: it is met at its rarest member.
    """

    def run(batches):
        for b in batches:
            out = []
            for root, near in zip(*(c.to_pylist() for c in b.columns), strict=True):
                net = _loaded(near)
                todo = [([root], set(net), set())]
                while todo:
                    clique, open_, out_of = todo.pop()
                    if not open_:
                        if not out_of:
                            out.append(sorted(clique))
                        continue
                    u = max(open_ | out_of, key=lambda x: (len(net[x] & open_), -x))
                    for v in sorted(open_ - net[u]):
                        todo.append(([*clique, v], open_ & net[v], out_of & net[v]))
                        open_, out_of = open_ - {v}, out_of | {v}
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["c"])

    listed = scratch.written(_nets(edges, None).mapInArrow(run, "c array<long>"), "cliques")
    nodes = listed.select("c", F.explode("c").alias("v"))
    freq = nodes.groupBy("v").agg(F.count("*").alias("f"))
    rarest = nodes.join(freq, "v").groupBy("c").agg(F.min(F.struct("f", "v"))["v"].alias("v"))
    others = nodes.select("v", F.col("c").alias("d"))
    within = rarest.join(others, "v").where((F.size("d") > F.size("c")) & (F.size(F.array_except("c", "d")) == 0))
    return listed.join(within.select("c").distinct(), "c", "left_anti")
