"""Registered queries of the library, one per operator, with equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lattiq import functions, scratch
from lattiq.operators import basic, cliques, nucleus, paths, splits
from lattiq.sources import graphs, runlog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The edges of the graph of parts returned in one order.
EDGES = """e as materialized (select distinct a.l_partkey src, b.l_partkey dst from lineitem a join lineitem b
 on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey where a.l_returnflag = 'R' and b.l_returnflag = 'R')"""
BOTH = EDGES + ", t as materialized (select src u, dst v from e union all select dst, src from e)"
DEGREES = BOTH + ", d as (select u id, count(*)::bigint degree from t group by u)"
TRIANGLES = EDGES + ", k3 as materialized (select x.src a, x.dst b, y.dst c from e x join e y on x.dst = y.src join e z on z.src = x.src and z.dst = y.dst)"
FOURS = TRIANGLES + """, k4 as materialized (select k.a, k.b, k.c, w.dst d from k3 k join e w on w.src = k.c join e x on x.src = k.a and x.dst = w.dst
 join e y on y.src = k.b and y.dst = w.dst)"""
FIVES = FOURS + """, k5 as materialized (select k.*, v.dst f from k4 k join e v on v.src = k.d join e w on w.src = k.a and w.dst = v.dst
 join e x on x.src = k.b and x.dst = v.dst join e y on y.src = k.c and y.dst = v.dst)"""


def _cliques_sql(last: int) -> str:
    """Tables ``q1 .. q<last>`` of cliques as sorted lists ``c``, with the larger vertices that have
    an edge from all members (``w``): each is grown by one of those."""
    out = [EDGES, "g as materialized (select src u, list(dst) n from e group by src)"]
    out.append("q1 as materialized (select [x] c, coalesce(n, []) w from (select src x from e union select dst from e) left join g on u = x)")
    for k in range(2, last + 1):
        out.append(f"q{k} as materialized (select list_append(c, v) c, list_intersect(w, coalesce(n, [])) w from (select c, w, unnest(w) v from q{k - 1}) left join g on u = v)")
    return ", ".join(out)


#: An order has at most seven lines, but orders meet: sizes up to eight are counted.
TOP = 8
ALL_SIZES = _cliques_sql(TOP)
IDS = "(select src x from e union select dst from e)"
EVERY = "q as materialized (" + " union all ".join(f"select c from q{k}" for k in range(1, TOP + 1)) + "), m as materialized (select c, unnest(c) x from q)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounds(n: int, start: str, step: str) -> str:
    """Chained tables ``c0 .. cn``; rounds past the fixpoint change nothing."""
    out = [f"c0 as materialized ({start})"]
    out += [f"c{i + 1} as materialized ({step.replace('@', f'c{i}')})" for i in range(n)]
    return ", ".join(out)


CORES = BOTH + ", " + _rounds(24, "select u id, count(*) c from t group by u", "select id, max(least(c, rn)) c from (select t.u id, k.c, row_number() over (partition by t.u order by k.c desc) rn from t join @ k on k.id = t.v) group by id")


def _nucleus_sql(base: str, members: str, n: int) -> str:
    """h-index rounds over ``i(s, m)``."""
    start = "select m, count(*) c from i group by m"
    step = """select m, max(least(o, rn)) c from (select m, o, row_number() over (partition by m order by o desc) rn from
 (select x.m, min(k.c) o from i x join i y on x.s = y.s and x.m <> y.m join @ k on k.m = y.m group by x.s, x.m)) group by m"""
    return "with " + base + f", i as materialized ({members}), " + _rounds(n, start, step)


EDGES_OF_3 = "select [a,b,c] s, unnest([[a,b],[a,c],[b,c]]) m from k3"
EDGES_OF_4 = "select [a,b,c,d] s, unnest([[a,b],[a,c],[a,d],[b,c],[b,d],[c,d]]) m from k4"
TRIANGLES_OF_4 = "select [a,b,c,d] s, unnest([[a,b,c],[a,b,d],[a,c,d],[b,c,d]]) m from k4"
part = graphs.part_coorder


@query(f"with {EDGES} select src, dst from e")
def s1_edge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part(spark, sf_dir)
    lines = e.select(F.concat(F.col("dst"), F.lit("\t"), F.col("src"), F.lit(" x")).alias("value"))
    return graphs.parse_edges(lines.unionByName(lines).unionByName(spark.createDataFrame([("# c",), ("",), ("3 3",)], "value string")))


@query("""with l as (select l_orderkey * 8 + l_linenumber pos, 'p' || l_partkey a, 's' || l_suppkey b from lineitem),
 f as (select n, min(pos * 2 + side) p from (select pos, a n, 0 side from l union all select pos, b, 1 from l) group by n),
 i as (select n, row_number() over (order by p, n) - 1 id from f)
 select distinct least(x.id, y.id)::bigint src, greatest(x.id, y.id)::bigint dst from l join i x on x.n = l.a join i y on y.n = l.b where x.id <> y.id""")
def s5_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    names = line.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    return graphs.dense_ids(names, "pos")[1]


@query("""select sum(k)::bigint n_rows, sum(case when u = v then k else 0 end)::bigint n_loops, sum(case when u <> v then k - 1 else 0 end)::bigint n_repeats
 from (select least(l_partkey, l_suppkey) u, greatest(l_partkey, l_suppkey) v, count(*) k from lineitem group by all)""")
def s6_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.defects(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


def _folder(spark: SparkSession) -> str:
    return f"{scratch.shared_dir(spark)}/lattiq/text-{uuid.uuid4().hex}"


@query(f"with {EDGES} select src, dst from e")
def s2_strict_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    graphs.write_edges(part(spark, sf_dir), at, ",")
    return graphs.read_edges(spark, at, separator=",", strict=True)


@query(f"with {EDGES} select src, dst from e")
def s3_strict_with_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part(spark, sf_dir)
    n, m = e.agg(F.max("dst") + 1, F.count("*")).first()
    lines = e.select(F.lit(1).alias("at"), F.concat_ws(" ", "src", "dst").alias("value"))
    head, at = spark.createDataFrame([(0, f"{n} {m}")], "at int, value string"), _folder(spark)
    head.unionByName(lines).coalesce(1).sortWithinPartitions("at", "value").select("value").write.text(at)  # the header first
    return graphs.read_edges(spark, at, header=True, strict=True)


@query("select 'p' || l_partkey a, 's' || l_suppkey b from lineitem")
def s4_named_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = line.select(F.concat(F.lit("p"), "l_partkey", F.lit("|s"), "l_suppkey", F.lit("|x")).alias("value"))
    return graphs.parse_named(lines.unionByName(spark.createDataFrame([("# a|b",), ("",), ("one",)], "value string")), r"\|")


def _sound(edges: DataFrame, n: int) -> DataFrame:
    """One row on a generated graph: edges, different ones, and those out of order or range."""
    bad = (F.col("src") < 0) | (F.col("src") >= F.col("dst")) | (F.col("dst") >= n)
    return edges.agg(F.count("*").alias("edges"), F.countDistinct("src", "dst").alias("different"), F.sum(bad.cast("long")).alias("bad"))


@query("select 11::bigint edges, 11::bigint different, 0::bigint bad")
def s7_weighted_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sound(graphs.weighted_graph(spark, 8, 12), 8)


@query()
def s8_random_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.random_graph(spark, 1000, 0.1)


@query("select true enough, true simple")
def s8_random_graph_is_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges within six deviations of their mean, each once and in range."""
    mean, deviation = 0.1 * 499_500, (499_500 * 0.1 * 0.9) ** 0.5
    enough = F.abs(F.col("edges") - mean) < 6 * deviation
    return _sound(s8_random_graph(spark, sf_dir), 1000).select(enough.alias("enough"), ((F.col("edges") == F.col("different")) & (F.col("bad") == 0)).alias("simple"))


@query("select 5000::bigint edges, 5000::bigint different, 0::bigint bad")
def s9_uniform_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sound(graphs.uniform_graph(spark, 1000, 5000), 1000)


@query(f"with {FOURS} select a, b, c, d from k4")
def s10_saved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4-cliques of paths that were saved and loaded."""
    at = _folder(spark)
    paths.write_paths(paths.clique_paths(part(spark, sf_dir), most=4, least=4), at)
    return paths.cliques_of(paths.read_paths(spark, at), 4).select(*[F.col("c")[i].alias(x) for i, x in enumerate("abcd")])


@query(f"with {ALL_SIZES}, {EVERY}, n as (select x id, len(c) k, count(*) n from m group by all) select '(' || id || ', ' || k || '): ' || n as value from n")
def s11_count_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.count_lines(paths.vertex_counts(paths.clique_paths(part(spark, sf_dir)))).select("value")


@query(f"with {FOURS} select (select count(*) from k4) s_cliques, (select count(distinct m) from ({EDGES_OF_4})) alive, (select count(distinct m) from ({EDGES_OF_4})) gone, 0::bigint rising")
def s12_peel_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rounds of a peel say: the first counts all, in the end all are gone, levels never fall."""
    log = nucleus.path_nucleus(part(spark, sf_dir), r=2, s=4)[1]
    falls = F.sum((F.col("level") < F.col("before")).cast("long"))
    log = log.withColumn("before", F.lag("level", 1, 0).over(Window.orderBy("round")))
    return log.agg(F.max("s_cliques").cast("long").alias("s_cliques"), F.max("alive").alias("alive"), F.sum("gone").alias("gone"), falls.alias("rising"))


@query(f"with {ALL_SIZES}, {EVERY} select len(c)::int k, count(*) n from q group by 1")
def s14_count_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by size, written as text and read again."""
    at = graphs.write_counts(paths.counts(paths.clique_paths(part(spark, sf_dir))), _folder(spark), "parts")
    return graphs.read_counts(spark, at).select("k", F.col("n").cast("long").alias("n"))


@query(f"with {DEGREES}, h as (select degree, count(*) n from d group by degree) select g degree, coalesce(n, 0)::varchar as value from generate_series(0, (select max(degree) from d)) s(g) left join h on h.degree = g")
def s15_degree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.degree_lines(basic.degree_histogram(part(spark, sf_dir)))


@query(f"with {BOTH} select u || ': ' || string_agg(v::varchar, ' ' order by v) as value from t group by u")
def s15_adjacency_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.adjacency_lines(part(spark, sf_dir))


@query("""with recursive b(n, k, c) as (select 0, 0, 1::bigint union all
 select n + 1, j, c * (n + 1) // (case when j > k then j else n + 1 - k end) from b, lateral (select unnest(case when k = n then [k, k + 1] else [k] end) j) where n < 30)
 select n, k, c from b""")
def s16_binomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.binomials(spark, 30).select("n", "k", F.col("c").cast("long").alias("c"))


@query("""with x as (select distinct date_trunc('minute', ts) m, user_id from events)
 select distinct a.user_id src, b.user_id dst from x a join x b on a.m = b.m and a.user_id < b.user_id""")
def user_minute_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.user_minute(spark, sf_dir)


@query(f"with {DEGREES} select id, degree from d")
def a1_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basic.degrees(part(spark, sf_dir))


@query(f"with {DEGREES} select count(*) n, (sum(degree) // 2)::bigint m, max(degree) max_degree, 2 * (sum(degree) // 2)::bigint / count(*) avg_degree from d")
def a1_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basic.graph_stats(part(spark, sf_dir))


@query(f"with {DEGREES} select degree, count(*) n from d group by degree")
def a2_degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basic.degree_histogram(part(spark, sf_dir))


@query(f"with {DEGREES} select count(*) n, sum(degree)::bigint ends, sum(degree * (degree - 1) // 2)::bigint wedges from d")
def a3_size_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basic.size_triple(part(spark, sf_dir))


@query(f"with {DEGREES} select count(*) filter (degree > 10) n from d")
def p9_over_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basic.over_degree(part(spark, sf_dir), 10)


@query(f"with {EDGES}, p as (select distinct l_partkey src, l_suppkey dst from lineitem where l_partkey <> l_suppkey) select p.src, p.dst, exists (select 1 from e where e.src = least(p.src, p.dst) and e.dst = greatest(p.src, p.dst)) is_edge from p")
def p7_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return basic.contains(part(spark, sf_dir), pairs)


@query(f"with {DEGREES}, o as (select id, row_number() over (order by degree, id) - 1 rank from d) select distinct least(x.rank, y.rank) src, greatest(x.rank, y.rank) dst from e join o x on x.id = e.src join o y on y.id = e.dst")
def p4_relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part(spark, sf_dir)
    return basic.relabelled(e, basic.degree_order(e))


@query(f"with {DEGREES} select id, row_number() over (order by degree desc, id) - 1 rank from d")
def o1_degree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basic.degree_order(part(spark, sf_dir), ascending=False)


@query(f"with {CORES}, d as (select u id, count(*) degree from t group by u) select d.id, row_number() over (order by c, degree, d.id) - 1 rank from d join c24 k on k.id = d.id")
def o3_degeneracy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part(spark, sf_dir)
    return basic.degeneracy_order(e, nucleus.core_numbers(e))


@query()
def o4_random_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basic.random_order(part(spark, sf_dir))


@query(f"with {DEGREES} select count(*) n, count(*) ranks, 0::bigint first, count(*) - 1 as last, sum(id)::bigint ids from d")
def o4_random_order_is_an_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = o4_random_order(spark, sf_dir)
    return o.agg(F.count("*").alias("n"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.sum("id").alias("ids"))


@query(f"""with recursive {BOTH}, c0 as materialized (select u id, least(u, min(v)) r from t group by u),
 w(id, root) as (select id, id from c0 union select t.v, w.root from w join t on t.u = w.id where t.v > w.root),
 r as (select id, min(root) root from w group by id), b(id, depth) as (select id, 0 from r where id = root union select t.v, depth + 1 from b join t on t.u = b.id where depth < 15)
 select b.id, r.root, min(depth)::int depth, (row_number() over (order by r.root desc, min(depth) desc, b.id desc) - 1)::bigint rank from b join r on r.id = b.id group by b.id, r.root""")
def o2_bfs_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basic.bfs_order(part(spark, sf_dir))


@query(f"""with {DEGREES}, g as (select case when (x.degree, x.id) < (y.degree, y.id) then src else dst end u, case when (x.degree, x.id) < (y.degree, y.id) then dst else src end v
 from e join d x on x.id = src join d y on y.id = dst) select id, sum(i)::bigint n_in, sum(o)::bigint n_out from (select u id, 0 i, 1 o from g union all select v, 1, 0 from g) group by id""")
def o5_dag_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basic.dag_degrees(basic.oriented(part(spark, sf_dir)))


@query(f"""with {EDGES}, g as (select distinct least(l_partkey, l_suppkey) src, greatest(l_partkey, l_suppkey) dst from lineitem where l_partkey <> l_suppkey)
 select *, 'left' side from (select * from e except all select * from g) union all select *, 'right' from (select * from g except all select * from e)""")
def j11_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of parts by orders against those of parts and suppliers."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return basic.difference(part(spark, sf_dir), graphs.canonical(line, "l_partkey", "l_suppkey"))


@query(f"with {DEGREES} select src, dst, least(x.degree, y.degree) as value from e join d x on x.id = src join d y on y.id = dst")
def a16_edge_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part(spark, sf_dir)
    return basic.end_minima(e, basic.degrees(e).withColumnRenamed("degree", "value"))


@query(f"with {DEGREES}, m as (select src, dst, least(x.degree, y.degree) w from e join d x on x.id = src join d y on y.id = dst) select id, max(w) as value from (select src id, w from m union all select dst, w from m) group by id")
def a16_vertex_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basic.vertex_maxima(a16_edge_minima(spark, sf_dir))


@query(f"with {TRIANGLES} select a, b, c from k3")
def j1_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cliques.k_cliques(part(spark, sf_dir), 3).select(*[F.col("c")[i].alias(x) for i, x in enumerate("abc")])


@query(f"with {FOURS} select 4 k, count(*) n from k4")
def a4_count_4_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cliques.count_cliques(part(spark, sf_dir), 4)


@query(f"with {ALL_SIZES}, {EVERY} select len(c)::int k, count(*) n from q group by 1 union all select 0, 1")
def a5_counts_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths.counts(paths.clique_paths(part(spark, sf_dir)), empty=True)
    return p.select("k", F.col("n").cast("long").alias("n"))


@query(f"with {ALL_SIZES}, {EVERY} select len(c)::int k, count(*)::varchar n from q group by 1")
def a5_exact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.exact_counts(paths.clique_paths(part(spark, sf_dir)))


@query(f"with {TRIANGLES} select unnest([a,b,c]) id, count(*) n from k3 group by 1")
def a6_vertex_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cliques.per_subset(part(spark, sf_dir), 3, 1).select(F.col("rc")[0].alias("id"), "n")


@query(f"with {ALL_SIZES}, {EVERY} select x id, len(c)::int k, count(*) n from m group by all")
def a7_vertex_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths.vertex_counts(paths.clique_paths(part(spark, sf_dir)))
    return p.select("id", "k", F.col("n").cast("long").alias("n"))


@query(f"with {TRIANGLES} select p[1] src, p[2] dst, count(*) n from (select unnest([[a,b],[a,c],[b,c]]) p from k3) group by all")
def a8_edge_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cliques.per_subset(part(spark, sf_dir), 3, 2).select(F.col("rc")[0].alias("src"), F.col("rc")[1].alias("dst"), "n")


@query(f"""with {ALL_SIZES}, {EVERY}, j as (select c, x src, unnest(c) dst from m)
 select src, dst, len(c)::int k, count(*) n from j where src < dst group by all""")
def a9_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths.edge_counts(paths.clique_paths(part(spark, sf_dir)))
    return p.select("src", "dst", "k", F.col("n").cast("long").alias("n"))


@query(f"with {FOURS} select m[1] a, m[2] b, m[3] c, count(*) n from ({TRIANGLES_OF_4}) group by all")
def a10_support_over_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paths.subset_support(paths.clique_paths(part(spark, sf_dir), most=4, least=4), 3, 4)
    return rows.select(*[F.col("rc")[i].alias(x) for i, x in enumerate("abc")], F.col("n").cast("long").alias("n"))


@query(f"""with {FOURS}, w as (select m, count(*) n from ({TRIANGLES_OF_4}) group by m), x as (select [a,b,c] t, unnest([[a,b],[a,c],[b,c]]) p from k3)
 select p[1] src, p[2] dst, count(*) n_r, coalesce(sum(n), 0)::bigint support from x left join w on w.m = x.t group by p""")
def a11_joint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paths.joint_counts(paths.clique_paths(part(spark, sf_dir)), 3, 4)
    return rows.select("src", "dst", F.col("n_r").cast("long").alias("n_r"), F.col("support").cast("long").alias("support"))


@query(f"with {FOURS} select m[1] a, m[2] b, m[3] c, count(*) n from ({TRIANGLES_OF_4}) group by all")
def a10_triangle_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cliques.per_subset(part(spark, sf_dir), 4, 3)
    return rows.select(*[F.col("rc")[i].alias(x) for i, x in enumerate("abc")], "n")


@query()
def a12_path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.summary(paths.clique_paths(part(spark, sf_dir)))


@query(f"with {ALL_SIZES}, {EVERY} select max(len(c))::int max_clique from q")
def a13_max_clique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.summary(paths.clique_paths(part(spark, sf_dir))).select("max_clique")


@query()
def a17_path_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path with the least number of triangles on one of its edges."""
    e = part(spark, sf_dir)
    values = cliques.per_subset(e, 3, 2).select(F.col("rc")[0].alias("src"), F.col("rc")[1].alias("dst"), F.col("n").alias("value"))
    return paths.path_minima(paths.clique_paths(e, least=3), values)


@query()
def a17_hold_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part(spark, sf_dir)
    return paths.hold_cores(paths.clique_paths(e, least=3), nucleus.core_numbers(e))


@query()
def a19_search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.search_stats(part(spark, sf_dir))


@query()
def f3_core_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.core_bounds(paths.clique_paths(part(spark, sf_dir), least=3), 2, 3)


@query(f"with {TRIANGLES}, x as (select [a,b,c] t, unnest([[a,b],[a,c],[b,c]]) p from k3) select t[1] a, t[2] b, t[3] c, p[1] x, p[2] y from x where p[1] % 5 = 0 or p[2] % 5 = 0")
def f7_subsets_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of triangles with an end that five divides."""
    k = cliques.k_cliques(part(spark, sf_dir), 3).withColumn("must", F.filter("c", lambda v: v % 5 == 0))
    sides = k.select("c", F.explode(functions.subsets_with("c", 3, 2, "must")).alias("p"))
    return sides.select(*[F.col("c")[i].alias(x) for i, x in enumerate("abc")], F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query(f"with {TRIANGLES} select count(*) cliques, count(*) numbers, 0::bigint shared from k3")
def f9_numbering_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cliques.numbering_faults(cliques.k_cliques(part(spark, sf_dir), 3), "c", 3)


@query()
def j7_vertex_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.vertex_paths(paths.clique_paths(part(spark, sf_dir), least=3))


@query(f"with {FOURS} select a, b, c, d from k4")
def g16_cliques_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 4-clique of the paths: all of the graph's, each once."""
    rows = paths.cliques_of(paths.clique_paths(part(spark, sf_dir)), 4)
    return rows.select(*[F.col("c")[i].alias(x) for i, x in enumerate("abcd")])


@query()
def a15_union_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.union_counts(paths.clique_paths(part(spark, sf_dir)), 3)


@query()
def j6_path_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.overlaps(paths.clique_paths(part(spark, sf_dir), least=3), 3)


@query(f"with {TRIANGLES} select a, b, c, (a + b * (b - 1) // 2 + c * (c - 1) * (c - 2) // 6)::bigint as rank from k3")
def f4_clique_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = cliques.k_cliques(part(spark, sf_dir), 3)
    return k.select(*[F.col("c")[i].alias(x) for i, x in enumerate("abc")], functions.rank("c", 3).cast("long").alias("rank"))


@query(f"with {CORES} select id, c core from c24")
def g1_core_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nucleus.core_numbers(part(spark, sf_dir))


@query(f"with {CORES} select max(c) degeneracy from c24")
def g2_degeneracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nucleus.degeneracy(part(spark, sf_dir))


@query()
def g4_clique_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.clique_paths(part(spark, sf_dir))


@query(f"with {ALL_SIZES}, {EVERY}, under as (select list_filter(c, lambda v: v <> x) c from m where len(c) > 1) select array_to_string(c, ' ') clique from (select c from q except select c from under)")
def g8_maximal_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.maximal_cliques(part(spark, sf_dir)).select(F.array_join("c", " ").alias("clique"))


#: Components of the neighbourhoods' 1-cores: labels of (vertex, end) run along triangles.
EGO = TRIANGLES + """, i as materialized (select unnest([a, b, c]) id, [a, b, c] s from k3), j as materialized (select id, s, unnest(list_filter(s, lambda v: v <> id)) x from i), """ + _rounds(
    24, "select distinct id, x, x l from j", "select id, x, min(m) l from (select j.id, j.x, min(k.l) over (partition by j.id, j.s) m from j join @ k on k.id = j.id and k.x = j.x) group by id, x"
)


@query(f"with {EGO}, n as (select id, count(*) tau from c24 where x = l group by id) select u.x id, coalesce(tau, 0)::bigint tau from {IDS} u left join n on n.id = u.x")
def g17_structural_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nucleus.structural_diversity(part(spark, sf_dir), 1)


@query(_nucleus_sql(TRIANGLES, "select [a,b,c] s, unnest([a,b,c]) m from k3", 16) + " select x id, coalesce(c, 0)::bigint core from (select distinct unnest([src,dst]) x from e) left join c16 on m = x")
def n1_vertex_core_1_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nucleus.nucleus(part(spark, sf_dir), r=1, s=3).select(F.col("rc")[0].alias("id"), F.col("core").cast("long").alias("core"))


@query(_nucleus_sql(TRIANGLES, EDGES_OF_3, 9) + " select src, dst, coalesce(c, 0)::bigint core from e left join c9 on m = [src, dst]")
def n2_edge_core_2_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nucleus.nucleus(part(spark, sf_dir), r=2, s=3).select(F.col("rc")[0].alias("src"), F.col("rc")[1].alias("dst"), F.col("core").cast("long").alias("core"))


@query(_nucleus_sql(FOURS, TRIANGLES_OF_4, 9) + " select m[1] a, m[2] b, m[3] c, c::bigint core from c9")
def n3_triangle_core_3_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nucleus.nucleus(part(spark, sf_dir), r=3, s=4)
    return rows.select(*[F.col("rc")[i].alias(x) for i, x in enumerate("abc")], F.col("core").cast("long").alias("core"))


@query(_nucleus_sql(FOURS, EDGES_OF_4, 12) + " select src, dst, coalesce(c, 0)::bigint core from e left join c12 on m = [src, dst]")
def n2_edge_core_2_4_over_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nucleus.nucleus(part(spark, sf_dir), r=2, s=4).select(F.col("rc")[0].alias("src"), F.col("rc")[1].alias("dst"), F.col("core").cast("long").alias("core"))


@query(_nucleus_sql(FOURS, TRIANGLES_OF_4, 9) + " select m[1] a, m[2] b, m[3] c, c::bigint core from c9")
def n3_triangle_core_over_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nucleus.nucleus(part(spark, sf_dir), r=3, s=4, over_paths=True)
    return rows.select(*[F.col("rc")[i].alias(x) for i, x in enumerate("abc")], F.col("core").cast("long").alias("core"))


@query(_nucleus_sql(FOURS, "select [a,b,c,d] s, unnest([a,b,c,d]) m from k4", 16) + " select x id, coalesce(c, 0)::bigint core from (select distinct unnest([src,dst]) x from e) left join c16 on m = x")
def n7_vertex_core_over_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nucleus.vertex_nucleus(part(spark, sf_dir), s=4).select("id", F.col("core").cast("long").alias("core"))


def _levels_sql(rounds: int = 80) -> str:
    """Levels of the (2, 3) hierarchy (``l``) with the component (``z``) of each edge (``m``): labels run
    along the triangles that have the level's value, ``rounds`` times."""
    steps = [
        "h0 as materialized (select v.l, k.m, k.m as z from c9 k join v on k.c >= v.c)",
        *[
            f"h{i + 1} as materialized (select l, m, min(z) z from (select l, m, z from h{i} union all select j.l, j.m, min(k.z) over (partition by j.l, j.s) z from j join h{i} k on k.l = j.l and k.m = j.m) group by l, m)"
            for i in range(rounds)
        ],
    ]
    return f"""{_nucleus_sql(TRIANGLES, EDGES_OF_3, 9)}, v as materialized (select c, row_number() over (order by c)::int l from (select distinct c from c9 where c > 0)),
 t as materialized (select s, min(k.c) c from i join c9 k on k.m = i.m group by s), j as materialized (select v.l, i.m, i.s from t join v on v.c <= t.c join i on i.s = t.s),
 {", ".join(steps)}, h as (select * from h{rounds})"""


@query(_levels_sql() + """ select h.l as level, v.c::bigint level_value, h.z[1] comp_src, h.z[2] comp_dst, count(*) members, p.z[1] parent_src, p.z[2] parent_dst
 from h join v on v.l = h.l left join h p on p.l = h.l - 1 and p.m = h.z group by all""")
def n4_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all levels, their sizes and parents."""
    tree = nucleus.hierarchy_tree(nucleus.hierarchy(part(spark, sf_dir), r=2, s=3))
    ends = [F.col(c)[i].alias(f"{name}_{end}") for c, name in (("component", "comp"), ("parent", "parent")) for i, end in enumerate(("src", "dst"))]
    return tree.select("level", F.col("level_value").cast("long").alias("level_value"), *ends, "members")


@query(_levels_sql() + """, x as (select l, z, count(*) n, list_sort(list(m)) a from h group by all)
 select l as level, 0 n, 'K = ' || l || ': ' || count(*) || ' components' as value from x group by l union all
 select l, 1, '  Component (' || z[1] || ', ' || z[2] || '): [' || array_to_string(list_transform(a, lambda m: '(' || m[1] || ', ' || m[2] || ')'), ' ') || ']' from x where n >= 2""")
def s13_hierarchy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nucleus.hierarchy_lines(nucleus.hierarchy(part(spark, sf_dir), r=2, s=3))


@query(f"with {FOURS}, g as (select c[1] a, c[2] b from (select [src, dst] c from e) where c[1] % 5 = 0 and c[2] % 5 = 0) select count(*) n from k4 where not exists (select 1 from g where g.a in (k4.a,k4.b,k4.c,k4.d) and g.b in (k4.a,k4.b,k4.c,k4.d))")
def g12_split_by_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-cliques left after the edges between multiples of five are deleted from the paths."""
    e = part(spark, sf_dir)
    gone = e.where("src % 5 = 0 and dst % 5 = 0").select(F.array("src", "dst").alias("c"))
    left = splits.split_paths(paths.clique_paths(e, least=4), 2, gone, 4)
    return paths.counts(left).where("k = 4").select(F.col("n").cast("long").alias("n"))


@query(f"with {FOURS} select count(*) n from k4 where (a + b + c) % 7 <> 0 and (a + b + d) % 7 <> 0 and (a + c + d) % 7 <> 0 and (b + c + d) % 7 <> 0")
def g13_split_by_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-cliques left after the triangles whose ids sum to a multiple of seven are deleted."""
    e = part(spark, sf_dir)
    gone = cliques.k_cliques(e, 3).where("aggregate(c, 0L, (s, x) -> s + x) % 7 = 0")
    left = splits.split_paths(paths.clique_paths(e, least=4), 3, gone, 4)
    return paths.counts(left).where("k = 4").select(F.col("n").cast("long").alias("n"))


LOG = (
    "================== RUN ==================\ntimestamp : 2024-01-", "day", " 00:00:00\ndataset   : /data/nation", "nation", "-", "size", ".edges\ns         : 3\nr         : ", "r",
    "\ncmd       : bin/run   data  3 ", "r", "\n---------------- PROGRAM OUTPUT ----------------\nGraph Info:\nNode Size: ", "k", "\nEdge Size: ", "m", "\nMax Degree: 7\nAvg Degree: 2.5\n\nTree Build took: ",
    "k", ".5 ms\n13-Clique count: 9\nmax clique: 6\nnun Leaf: ", "m", "\nClique Index: 4 cliques, 5 vertices.\n", "index", "countingPerRClique took: 1.5 ms\n==========begin==========\nminCore: 1 heap size: ",
    "k", " num Leaf: ", "m", " 13-Clique count: 5.5e+16\nminCore: 4.5e+15 heap size: 3 num Leaf: 2 13-Clique count: ", "k", "\ntime: ", "m", " ms\ncountingRClique updates time: 1.25 ms\nNucleusCoreDecomposition took: 99.5 ms\n",
    "---------------- /bin/time -v ----------------\n", "killed", "\tMaximum resident set size (kbytes): ", "kb", "\n\tExit status: ", "status", "\n----------------   STATUS   ------------------\nexit_status: ", "status",
    "\n================ END OF RUN ==================\n",
)


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of two runs by supplier, as they are printed, and a run that was cut off between them."""
    k = F.col("s_suppkey")
    made = {
        "k": k, "m": k * 2, "day": F.lpad((k % 28 + 1).cast("string"), 2, "0"), "nation": F.col("s_nationkey"), "size": k % 5 * 20 + 20, "r": k % 2 + 4, "kb": k * 1024,
        "index": F.when(k % 4 > 0, F.concat(F.lit("clique Index build took: "), k, F.lit(".25 ms\n"))).otherwise(""),
        "killed": F.when(k % 7 == 0, "Command terminated by signal 9\n").otherwise(""), "status": F.when(k % 3 == 0, 1).otherwise(0),
    }
    one = F.concat(*[made[p].cast("string") if p in made else F.lit(p) for p in LOG])
    cut = F.lit("================== RUN ==================\ndataset   : cut\ntime: 1 ms\n")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("file"), F.concat(F.lit("noise\n"), one, cut, one).alias("value"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runlog.normalised(runlog.records(runlog.blocks(_logs(spark, sf_dir))))
    return rows.withColumns({"name": runlog.nice_name("dataset"), "size": runlog.size_suffix(runlog.nice_name("dataset")), "base": runlog.base_name(runlog.nice_name("dataset"))})


#: The same runs without the text between.
RUNS = """x as (select s_suppkey k, s_nationkey n, unnest([0, 1]) i from supplier), runs as (select k as file, i, 'nation' || n || '-' || (k % 5 * 20 + 20) as name, 'nation' || n as base,
 (k % 5 * 20 + 20)::int size, 3 r, (k % 2 + 4)::int s, k + 0.5 as tree, case when k % 4 > 0 then k + 0.25 end as idx, k * 2.0 as prog, k * 2 leaves, k * 1024 kb,
 case when k % 7 = 0 then -1 when k % 3 = 0 then 1 else 0 end status, '2024-01-' || lpad((k % 28 + 1)::varchar, 2, '0') || ' 00:00:00' as started from x),
 timed as (select *, case when status = 0 then tree + coalesce(idx, 0) + prog end ms, kb / 1024.0 mb from runs)"""


@query(f"with {RUNS} select file, i as n, name, r, s, file as nodes, tree::double tree_build_ms, idx::double clique_index_ms, prog::double prog_time_ms, leaves num_leaves, kb max_rss_kb, status exit_status, started as timestamp, 'bin/run data 3 ' || s cmd from runs")
def e2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumnsRenamed({"n": "nodes", "run": "n"})
    return rows.select("file", "n", "name", "r", "s", "nodes", "tree_build_ms", "clique_index_ms", "prog_time_ms", "num_leaves", "max_rss_kb", "exit_status", "timestamp", "cmd")


@query(f"with {RUNS} select base, r, s, file from (select *, row_number() over (partition by base, r, s order by (idx is not null)::int desc, started, file) o from runs) where o = 1")
def e3_most_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumn("timestamp", F.concat("timestamp", F.lpad("file", 12, "0")))
    return runlog.most_complete(rows, ["base", "r", "s"]).select("base", "r", "s", "file")


@query(f"with {RUNS} select base, s, count(*) runs from runs where r = 3 group by all having count(*) > 1")
def e5_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.repeated(runlog.of_parameter(_records(spark, sf_dir), 3), ["base", "s"])


@query(f"with {RUNS} select file, i as run, 0 round, 1::double as level, file heap, leaves, 13 size, 5.5e16::double cliques from runs union all select file, i, 1, 4.5e15::double, 3, 2, 13, file::double from runs")
def e6_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.rounds(runlog.blocks(_logs(spark, sf_dir)))


@query("""select l_orderkey, l_linenumber, (l_orderkey % 9 * 3600 + l_linenumber * 60 + l_partkey % 60 + 0.5)::double as seconds from lineitem""")
def e7_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat((F.col("l_orderkey") % 9).cast("string"), F.lit(":"), two(F.col("l_linenumber")), F.lit(":"), two(F.col("l_partkey") % 60), F.lit(".5"))
    return line.select("l_orderkey", "l_linenumber", clock.alias("clock")).select("l_orderkey", "l_linenumber", runlog.seconds("clock").alias("seconds"))


@query("select p_partkey, case when p_partkey > 9 then (p_partkey::varchar)[1:1]::int end r, case when p_partkey > 9 then (p_partkey::varchar)[2:]::int end s from part")
def e8_pair_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_partkey").cast("string").alias("code"))
    return rows.select("p_partkey", runlog.pair_code("code").alias("x")).select("p_partkey", "x.r", "x.s")


@query(f"with {RUNS} select base, r, s, min(prog) filter (status = 0)::double ms, min(kb) filter (status = 0) kb, count(*) runs from runs group by all")
def e9_best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.best(_records(spark, sf_dir), ["base", "r", "s"])


@query(f"with {RUNS} select file, i as run, ms::double ms, mb::double mb from timed")
def e10_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.measured(_records(spark, sf_dir)).select("file", "run", "ms", "mb")


@query(f"with {RUNS}, b as (select base, s, min(ms) filter (size < 60) a, min(ms) filter (size >= 60) z from timed group by all) select base, s, a::double as small, z::double as large, (100 * (z - a) / z)::double saved_percent from b")
def e11_speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runlog.measured(_records(spark, sf_dir)).withColumn("source", F.when(F.col("size") < 60, "small").otherwise("large"))
    return runlog.speedups(rows, ["base", "s"], "small", "large")


@query(f"with {RUNS} select base, s, size, ms::double ms, mb::double mb from (select *, row_number() over (partition by base, s, size order by ms nulls last, mb) o from timed) where o = 1")
def e12_best_per_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.best_per_size(runlog.measured(_records(spark, sf_dir)), ["base", "s"])


@query(f"""with {RUNS}, t as (select distinct base, size, case when size = 100 then null else s end s from runs), g as (select distinct base, s from t where s is not null)
 select base, size, s from t where s is not null union all select g.base, 100, g.s from g join (select distinct base from t where size = 100 and s is null) u on u.base = g.base""")
def j12_filled_at_full_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).select("base", "size", F.when(F.col("size") < 100, F.col("s")).alias("s")).distinct()
    return runlog.filled_at_full_size(rows, ["base"]).select("base", "size", "s")
