"""Queries over the driver's tables, one for each operator, with their DuckDB SQL.

Programs are bound to whole tables. Recursive ones run over ``parent(x, y)``: customer x = y div 2 is the parent of
customer y, a tree over all customers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semilog import api
from semilog.asp import choice, frames, solve
from semilog.asp import ground as asp_ground
from semilog.lang import tree as t
from semilog.lang.checker import check
from semilog.lang.reader import read
from semilog.functions import circuits
from semilog.operators import graphs, neural, terms
from semilog.plans import distributed, local, magic, planner
from semilog.sources import text
from semilog.storage import scratch
from semilog.streaming.maintain import Maintained, follow
from semilog.streaming.proofs import MaintainedProofs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Relations that programs are bound to, as Spark SQL over the tables, and the same for DuckDB where it differs.
RELATIONS = {
    "parent": "select c_custkey div 2 as x, c_custkey as y from customer where c_custkey div 2 > 0",
    "cust_nation": "select c_custkey as c, cast(c_nationkey as bigint) as n from customer",
    "supp_nation": "select s_suppkey as s, cast(s_nationkey as bigint) as n from supplier",
    "nation_region": "select cast(n_nationkey as bigint) as n, cast(n_regionkey as bigint) as r from nation",
    "nation_name": "select cast(n_nationkey as bigint) as n, n_name as name from nation",
    "region_name": "select cast(r_regionkey as bigint) as r, r_name as name from region",
    "supplies": "select distinct l_suppkey as s, l_partkey as p from lineitem",
    "item": "select distinct l_orderkey as o, l_partkey as p from lineitem",
    "placed": "select o_custkey as c, o_orderkey as o from orders",
    "part_size": "select p_partkey as p, cast(p_size as bigint) as z from part",
    "part_brand": "select p_partkey as p, p_brand as b from part",
    "edge": "select distinct l_partkey as u, l_suppkey as v from lineitem",
    "weighted": "select c_custkey div 2 as x, c_custkey as y, cast(c_nationkey as bigint) + 1 as w from customer where c_custkey div 2 > 0",
    "seen": "select distinct user_id as u, event_type as e from events",
    "labelled": "select doc_id as d, cast(quality as bigint) as q from labels",
}


def duck(name: str) -> str:
    return RELATIONS[name].replace(" div ", " // ")


def with_(*names: str, recursive: str = "") -> str:
    """A WITH clause that defines relations, and recursive views behind them."""
    parts = [f"{n} as ({duck(n)})" for n in names]
    return f"with {'recursive ' if recursive else ''}{', '.join(parts + ([recursive] if recursive else []))} "


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = RELATIONS[name]
    table = sql.partition(" from ")[2].split()[0]
    return spark.sql(sql.replace(f" from {table}", " from {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def program(source: str, spark: SparkSession, sf_dir: str, *names: str) -> api.Program:
    p = api.compile(source)
    for n in names:
        p.bind(n, relation(spark, sf_dir, n))
    return p


def named(df: DataFrame, *names: str) -> DataFrame:
    return df.toDF(*names)


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def answer(source: str, binds: tuple[str, ...], pred: str, names: tuple[str, ...], sql: str, name: str) -> None:
    """Registers a query that is one program's predicate."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return named(program(source, spark, sf_dir, *binds).frames(spark)[pred], *names)

    f.__name__ = name
    query(sql)(f)


DOMAINS = "domain d. pred parent(int, int): Bool. pred cust_nation(int, int): Bool. pred supp_nation(int, int): Bool. pred nation_region(int, int): Bool. pred nation_name(int, d): Bool. pred region_name(int, d): Bool. pred supplies(int, int): Bool. pred item(int, int): Bool. pred placed(int, int): Bool. pred part_size(int, int): Bool. pred part_brand(int, d): Bool. pred edge(int, int): Bool. pred seen(int, d): Bool.\n"
CLOSURE = "anc(x, y) as (select x, y from parent union select a.x, p.y from anc a join parent p on a.y = p.x)"

# --- joins, selections, negation, set operations

for spec in (
    ("join_two", "pred q(int, int): Bool. q(C, R) :- cust_nation(C, N), nation_region(N, R).", ("cust_nation", "nation_region"), ("c", "r"), with_("cust_nation", "nation_region") + "select distinct c, r from cust_nation join nation_region using (n)"),
    ("join_three", "pred q(int, d): Bool. q(C, M) :- cust_nation(C, N), nation_region(N, R), region_name(R, M).", ("cust_nation", "nation_region", "region_name"), ("c", "m"), with_("cust_nation", "nation_region", "region_name") + "select distinct c, name as m from cust_nation join nation_region using (n) join region_name using (r)"),
    ("self_join", "pred q(int, int): Bool. q(X, Z) :- parent(X, Y), parent(Y, Z).", ("parent",), ("x", "z"), with_("parent") + "select distinct a.x, b.y as z from parent a join parent b on a.y = b.x"),
    ("cross_small", "pred q(d, d): Bool. q(A, B) :- nation_name(_N, A), region_name(_R, B).", ("nation_name", "region_name"), ("a", "b"), with_("nation_name", "region_name") + "select distinct x.name as a, y.name as b from nation_name x, region_name y"),
    ("const_filter", "pred q(int): Bool. q(C) :- cust_nation(C, 7).", ("cust_nation",), ("c",), with_("cust_nation") + "select distinct c from cust_nation where n = 7"),
    ("head_constant", "pred q(int, d, int): Bool. q(C, seven, 7) :- cust_nation(C, 7).", ("cust_nation",), ("c", "word", "n"), with_("cust_nation") + "select distinct c, 'seven' as word, cast(7 as bigint) as n from cust_nation where n = 7"),
    ("repeat_var", "pred q(int): Bool. q(X) :- edge(X, X).", ("edge",), ("x",), with_("edge") + "select distinct u as x from edge where u = v"),
    ("underscore_join", "pred q(int, int): Bool. q(C, S) :- cust_nation(C, _), nation_region(_, R), nation_region(_, R), supp_nation(S, _).", ("cust_nation", "nation_region", "supp_nation"), ("c", "s"), with_("cust_nation", "nation_region", "supp_nation") + "select distinct c, s from cust_nation join nation_region using (n) join supp_nation using (n)"),
    ("semi_join", "pred q(int): Bool. q(C) :- cust_nation(C, _N), placed(C, _O).", ("cust_nation", "placed"), ("c",), with_("cust_nation", "placed") + "select distinct c from cust_nation where c in (select c from placed)"),
    ("neg_anti", "pred ordered(int): Bool. pred q(int, int): Bool. ordered(C) :- placed(C, _O). q(C, N) :- cust_nation(C, N), not ordered(C).", ("cust_nation", "placed"), ("c", "n"), with_("cust_nation", "placed") + "select c, n from cust_nation where not exists (select 1 from placed where placed.c = cust_nation.c)"),
    ("neg_two_layers", "pred inner_(int): Bool. pred leaf(int): Bool. pred q(int): Bool. inner_(X) :- parent(X, _Y). leaf(Y) :- parent(_X, Y), not inner_(Y). q(X) :- parent(X, _Y), not leaf(X).", ("parent",), ("x",), with_("parent") + "select distinct x from parent where x not in (select y from parent where y not in (select x from parent))"),
    ("neg_nullary", "pred any_size(): Bool. pred none(): Bool. pred q(int): Bool. any_size() :- part_size(_P, 99999). q(P) :- part_brand(P, _B), not any_size().", ("part_size", "part_brand"), ("p",), with_("part_size", "part_brand") + "select distinct p from part_brand where not exists (select 1 from part_size where z = 99999)"),
    ("union_rules", "pred q(int): Bool. q(N) :- cust_nation(_C, N). q(N) :- supp_nation(_S, N).", ("cust_nation", "supp_nation"), ("n",), with_("cust_nation", "supp_nation") + "select n from cust_nation union select n from supp_nation"),
    ("intersect_atoms", "pred q(int): Bool. q(X) :- edge(X, _V), edge(_U, X).", ("edge",), ("x",), with_("edge") + "select u as x from edge intersect select v from edge"),
    ("difference", "pred right(int): Bool. pred q(int): Bool. right(V) :- edge(_U, V). q(X) :- edge(X, _V), not right(X).", ("edge",), ("x",), with_("edge") + "select u as x from edge except select v from edge"),
    # --- aggregates
    ("agg_count", "pred q(int, int): Bool. q(N, count<C>) :- cust_nation(C, N).", ("cust_nation",), ("n", "k"), with_("cust_nation") + "select n, count(distinct c) as k from cust_nation group by n"),
    ("agg_count_bindings", "pred q(int, int): Bool. q(S, count<N>) :- supplies(S, P), item(_O, P), supp_nation(S, N).", ("supplies", "item", "supp_nation"), ("s", "k"), with_("supplies", "item", "supp_nation") + "select s, count(*) as k from (select distinct s, p, o, n from supplies join item using (p) join supp_nation using (s)) group by s"),
    ("agg_sum", "pred q(int, int): Bool. q(S, sum<Z>) :- supplies(S, P), part_size(P, Z).", ("supplies", "part_size"), ("s", "z"), with_("supplies", "part_size") + "select s, cast(sum(z) as bigint) as z from supplies join part_size using (p) group by s"),
    ("agg_min", "pred q(d, int): Bool. q(B, min<Z>) :- part_brand(P, B), part_size(P, Z).", ("part_brand", "part_size"), ("b", "z"), with_("part_brand", "part_size") + "select b, min(z) as z from part_brand join part_size using (p) group by b"),
    ("agg_max", "pred q(d, int): Bool. q(B, max<Z>) :- part_brand(P, B), part_size(P, Z).", ("part_brand", "part_size"), ("b", "z"), with_("part_brand", "part_size") + "select b, max(z) as z from part_brand join part_size using (p) group by b"),
    ("agg_global", "pred q(int): Bool. q(sum<Z>) :- part_size(_P, Z).", ("part_size",), ("z",), with_("part_size") + "select cast(sum(z) as bigint) as z from part_size having count(*) > 0"),
    ("agg_global_empty", "pred q(int): Bool. q(count<P>) :- part_size(P, 99999).", ("part_size",), ("k",), with_("part_size") + "select count(*) as k from part_size where z = 99999 having count(*) > 0"),
    ("agg_two_rules", "pred q(int, int): Bool. q(N, count<C>) :- cust_nation(C, N). q(N, count<S>) :- supp_nation(S, N).", ("cust_nation", "supp_nation"), ("n", "k"), with_("cust_nation", "supp_nation") + "select n, count(*) as k from cust_nation group by n union select n, count(*) from supp_nation group by n"),
    ("agg_over_recursion", "pred anc(int, int): Bool. pred q(int, int): Bool. anc(X, Y) :- parent(X, Y). anc(X, Z) :- anc(X, Y), parent(Y, Z). q(X, count<Y>) :- anc(X, Y).", ("parent",), ("x", "k"), with_("parent", recursive=CLOSURE) + "select x, count(*) as k from anc group by x"),
    # --- recursion
    ("tc_bool", "pred q(int, int): Bool. q(X, Y) :- parent(X, Y). q(X, Z) :- parent(X, Y), q(Y, Z).", ("parent",), ("x", "y"), with_("parent", recursive=CLOSURE) + "select x, y from anc"),
    ("tc_nonlinear", "pred q(int, int): Bool. q(X, Y) :- parent(X, Y). q(X, Z) :- q(X, Y), q(Y, Z).", ("parent",), ("x", "y"), with_("parent", recursive=CLOSURE) + "select x, y from anc"),
    ("tc_semi_naive", "pred q(int, int): Bool. q(X, Y) :- parent(X, Y). q(X, Z) :- parent(X, Y), q(Y, Z), parent(_W, Z).", ("parent",), ("x", "y"), with_("parent", recursive=CLOSURE) + "select x, y from anc"),
    ("reachable", "pred q(int): Bool. q(1) :- parent(1, _Y). q(Y) :- q(X), parent(X, Y).", ("parent",), ("x",), with_("parent", recursive="r(x) as (select distinct x from parent where x = 1 union select y from r join parent using (x))") + "select x from r"),
    ("grandparent", "pred up(int, int): Bool. up(X, A) :- parent(P, X), parent(A, P). pred q(int, int): Bool. q(X, A) :- up(X, A).", ("parent",), ("x", "a"), with_("parent") + "select distinct p.y as x, a.x as a from parent p join parent a on a.y = p.x"),
    ("same_generation", "pred q(int, int): Bool. q(X, Y) :- parent(P, X), parent(P, Y). q(X, Y) :- parent(A, X), q(A, B), parent(B, Y).", ("parent",), ("x", "y"), with_("parent", recursive="sg(x, y) as (select a.y as x, b.y as y from parent a join parent b on a.x = b.x union select a.y, b.y from sg join parent a on a.x = sg.x join parent b on b.x = sg.y)") + "select x, y from sg"),
    ("mutual_even_odd", "pred even(int): Bool. pred odd(int): Bool. even(1) :- parent(1, _Y). odd(Y) :- even(X), parent(X, Y). even(Y) :- odd(X), parent(X, Y). pred q(int): Bool. q(X) :- even(X).", ("parent",), ("x",), with_("parent", recursive="r(x, d) as (select distinct x, 0 from parent where x = 1 union select p.y, 1 - d from r join parent p on p.x = r.x)") + "select distinct x from r where d = 0"),
):
    answer(DOMAINS + spec[1], spec[2], "q", spec[3], spec[4], spec[0])

# --- weights

TROP = "domain d. pred weighted(int, int): Trop. pred parent(int, int): Bool. pred cust_nation(int, int): Bool.\n"
for spec in (
    ("trop_join_min", "pred q(int, int): Trop. q(X, N) :- weighted(X, Y), cust_nation(Y, N).", ("weighted", "cust_nation"), ("x", "n", "w"), with_("weighted", "cust_nation") + "select x, n, min(w) as w from weighted join cust_nation on c = y group by x, n"),
    ("trop_sssp", "pred q(int): Trop. q(Y) :- weighted(1, Y). q(Y) :- q(X), weighted(X, Y).", ("weighted",), ("y", "w"), with_("weighted", recursive="r(y, w) as (select y, w from weighted where x = 1 union all select e.y, r.w + e.w from r join weighted e on e.x = r.y)") + "select y, min(w) as w from r group by y"),
    ("trop_apsp", "pred q(int, int): Trop. q(X, Y) :- weighted(X, Y). q(X, Z) :- q(X, Y), weighted(Y, Z).", ("weighted",), ("x", "y", "w"), with_("weighted", recursive="r(x, y, w) as (select x, y, w from weighted union all select r.x, e.y, r.w + e.w from r join weighted e on e.x = r.y)") + "select x, y, min(w) as w from r group by x, y"),
    ("trop_bool_body", "pred q(int): Trop. q(Y) :- parent(1, X), weighted(X, Y).", ("parent", "weighted"), ("y", "w"), with_("parent", "weighted") + "select e.y, min(e.w) as w from parent p join weighted e on e.x = p.y where p.x = 1 group by e.y"),
    ("trop_negation", "pred q(int): Bool. q(C) :- cust_nation(C, _N), not weighted(0, C), not light(C). pred light(int): Trop. light(Y) :- weighted(1, Y).", ("weighted", "cust_nation"), ("c",), with_("weighted", "cust_nation") + "select distinct c from cust_nation where c not in (select y from weighted where x in (0, 1))"),
):
    answer(TROP + spec[1], spec[2], "q", spec[3], spec[4], spec[0])


@query(with_("cust_nation") + "select c, n from cust_nation where n = 3 or c = 5")
def plain_query_union(spark, sf_dir):
    p = program(DOMAINS + "?cust_nation(_, 3). ?cust_nation(5, _).", spark, sf_dir, "cust_nation")
    df, keep = p.frames(spark)["cust_nation"], F.lit(False)
    for _, _, pattern in p.queries():
        own = F.lit(True)
        for c, v in zip(df.columns, pattern):
            own = own if v is None else own & (F.col(c) == v)
        keep = keep | own
    return named(df.where(keep), "c", "n")


@query(with_("parent", recursive="r(y) as (select y from parent where x = 5 union select p.y from r join parent p on p.x = r.y)") + "select y from r")
def tc_magic(spark, sf_dir):
    source = DOMAINS + "pred q(int, int): Bool. q(X, Y) :- parent(X, Y). q(X, Z) :- q(X, Y), parent(Y, Z)."
    tree, _ = read(source)
    rewritten, name = magic.rewritten(tree, t.Atom("q", (t.Int(5), t.Var("Y"))))
    p = api.Program(check(rewritten)).bind("parent", relation(spark, sf_dir, "parent"))
    return named(p.frames(spark)[name].where("c0 = 5").select("c1"), "y")


@query(with_("weighted", recursive="r(x, y, w) as (select x, y, w from weighted union all select r.x, e.y, r.w + e.w from r join weighted e on e.x = r.y)") + "select x as u, y as v, min(w) as w from r group by x, y")
def shortest_paths(spark, sf_dir):
    return graphs.shortest_paths(relation(spark, sf_dir, "weighted"))


@query(with_("parent", recursive=CLOSURE) + "select x as u, y as v from anc")
def transitive_closure(spark, sf_dir):
    return graphs.transitive_closure(relation(spark, sf_dir, "parent"))


# --- probabilities: nations are trouble with chances of their own, customers are hit by their nation

SOFT = DOMAINS + "pred risky(int): Bool. 0.25 :: risky(3). 0.5 :: risky(7). 0.125 :: risky(11). 0.5 :: risky(7).\n"
RISK = "risk as (select * from (values (3, 0.25), (7, 0.5), (11, 0.125), (7, 0.5)) v(n, p)), "


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return named(df, *names).withColumn("p", F.round("p", 9))


@query(f"with {RISK} cust_nation as ({duck('cust_nation')}) select c, round(cast(p as double), 9) as p from cust_nation join (select n, case n when 7 then 0.75 else min(p) end as p from risk group by n) using (n)")
def prob_noisy_or(spark, sf_dir):
    p = program(SOFT + "pred q(int): Bool. q(C) :- cust_nation(C, N), risky(N).", spark, sf_dir, "cust_nation")
    return rounded(p.marginal_frame(spark, "q"), "c", "p")


@query(f"with nation_region as ({duck('nation_region')}), risk as (select * from (values (3, 0.25), (7, 0.75), (11, 0.125)) v(n, p)) select r, round(cast(1 - product(1 - p) as double), 9) as p from nation_region join risk using (n) group by r")
def prob_independent(spark, sf_dir):
    p = program(SOFT + "pred q(int): Bool. q(R) :- nation_region(N, R), risky(N).", spark, sf_dir, "nation_region")
    return rounded(p.marginal_frame(spark, "q"), "r", "p")


@query(f"with cust_nation as ({duck('cust_nation')}), supp_nation as ({duck('supp_nation')}), risk as (select * from (values (3, 0.25), (7, 0.75), (11, 0.125)) v(n, p)) select c, s, round(cast(p as double), 9) as p from (select distinct c, s, n from cust_nation join supp_nation using (n)) join risk using (n)")
def prob_shared(spark, sf_dir):
    p = program(SOFT + "pred q(int, int): Bool. q(C, S) :- cust_nation(C, N), supp_nation(S, N), risky(N), risky(N).", spark, sf_dir, "cust_nation", "supp_nation")
    return rounded(p.marginal_frame(spark, "q"), "c", "s", "p")


@query(f"with cust_nation as ({duck('cust_nation')}), risk as (select * from (values (3, 0.25), (7, 0.75), (11, 0.125)) v(n, p)) select c, round(cast(1 - coalesce(p, 0) as double), 9) as p from cust_nation left join risk using (n)")
def prob_negation(spark, sf_dir):
    p = program(SOFT + "pred q(int): Bool. q(C) :- cust_nation(C, N), not risky(N).", spark, sf_dir, "cust_nation")
    return rounded(p.marginal_frame(spark, "q"), "c", "p")


@query(f"with cust_nation as ({duck('cust_nation')}) select c, case n when 3 then '1.0,0.0,0.0,0.0' when 7 then '0.0,0.5,0.0,0.5' else '0.0,0.0,1.0,0.0' end as grad from cust_nation where n in (3, 7, 11)")
def grad_customers(spark, sf_dir):
    p = program(SOFT + "pred q(int): Prov. q(C) :- cust_nation(C, N), risky(N).", spark, sf_dir, "cust_nation")
    found = distributed.gradients(p.run(spark, "proofs"), "q")
    return found.select(F.col("c0").alias("c"), F.array_join(F.transform("grad", lambda g: F.round(g, 9).cast("string")), ",").alias("grad"))


@query(f"with cust_nation as ({duck('cust_nation')}) select c, case n when 3 then '[[1]]' when 7 then '[[2],[4]]' else '[[3]]' end as proofs from cust_nation where n in (3, 7, 11)")
def prov_proofs(spark, sf_dir):
    p = program(SOFT + "pred q(int): Prov. q(C) :- cust_nation(C, N), risky(N).", spark, sf_dir, "cust_nation")
    return distributed.proof_lists(p.run(spark, "proofs"), "q").select(F.col("c0").alias("c"), F.to_json("proofs").alias("proofs"))


@query(f"with cust_nation as ({duck('cust_nation')}) select c, case n when 3 then 0.25 when 7 then 0.5 else 0.125 end as p from cust_nation where n in (3, 7, 11)".replace("case n", "cast(case n").replace("0.125 end", "0.125 end as double)"))
def provk_lower_bound(spark, sf_dir):
    p = program(SOFT + "pred q(int): Prov_k(1). q(C) :- cust_nation(C, N), risky(N).", spark, sf_dir, "cust_nation")
    return rounded(p.marginal_frame(spark, "q"), "c", "p")


@query(f"with cust_nation as ({duck('cust_nation')}) select c, case n when 3 then '[[-1]]' when 7 then '[[-4,-2]]' when 11 then '[[-3]]' else '[[]]' end as proofs from cust_nation")
def prov_negation(spark, sf_dir):
    p = program(SOFT + "pred q(int): Prov. q(C) :- cust_nation(C, N), not risky(N).", spark, sf_dir, "cust_nation")
    return distributed.proof_lists(p.run(spark, "proofs"), "q").select(F.col("c0").alias("c"), F.to_json("proofs").alias("proofs"))


@query(f"with cust_nation as ({duck('cust_nation')}) select n, cast(round(sum(w * k), 6) as double) as expected from (select n, k, case n when 3 then 0.25 when 7 then 0.75 else 0.125 end as w from (select n, count(*) as k from cust_nation where n in (3, 7, 11) group by n)) group by n")
def prob_soft_aggregate(spark, sf_dir):
    """An aggregate over soft tuples, by worlds; its expectation is the sum over outcomes."""
    p = program(SOFT + "pred hit(int, int): Bool. pred q(int, int): Bool. hit(N, C) :- cust_nation(C, N), risky(N). q(N, count<C>) :- hit(N, C).", spark, sf_dir, "cust_nation")
    found = distributed.marginals(p.run(spark, "worlds"), "q")
    return found.groupBy(F.col("c0").alias("n")).agg(F.round(F.sum(F.col("c1") * F.col("p")), 6).alias("expected"))


@query(f"with nation_region as ({duck('nation_region')}), leaf as (select * from (values (1, 3, 0.25), (2, 7, 0.5), (3, 11, 0.125), (4, 7, 0.5)) v(i, n, p)), own as (select r, i, p from nation_region join leaf using (n)) select g.r, cast(l.i as bigint) as leaf, round(cast(case when exists (select 1 from own o where o.r = g.r and o.i = l.i) then coalesce((select product(1 - o.p) from own o where o.r = g.r and o.i <> l.i), 1) else 0 end as double), 9) as slope from (select distinct r from own) g, leaf l")
def grad_worlds(spark, sf_dir):
    """Gradients of a predicate without captured proofs, by worlds over a bound table."""
    p = program(SOFT + "pred q(int): Bool. q(R) :- nation_region(N, R), risky(N).", spark, sf_dir, "nation_region")
    rows = [(r, i + 1, round(g, 9)) for (r,), _, grad in p.grad_query("q") for i, g in enumerate(grad)]
    return spark.createDataFrame(rows, "r long, leaf long, slope double")


@query(f"with nation_region as ({duck('nation_region')}) select r, round(cast(1 - product(1 - (n + 1) / 50.0) as double), 9) as p from nation_region group by r")
def soft_table(spark, sf_dir):
    """A table's rows as soft facts with a probability each."""
    p = program(DOMAINS + "pred shaky(int): Bool. pred q(int): Bool. q(R) :- nation_region(N, R), shaky(N).", spark, sf_dir, "nation_region")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint"), ((F.col("n_nationkey") + 1) / 50).alias("p"))
    return rounded(p.bind("shaky", nations).marginal_frame(spark, "q"), "r", "p")


@query(f"with cust_nation as ({duck('cust_nation')}) select c, round(cast(case n when 3 then 0.25 when 7 then 0.75 else 0.125 end as double), 9) as p from cust_nation where n in (3, 7, 11) and c <= 50")
def prob_bound(spark, sf_dir):
    """Probabilities asked of a program over a bound table."""
    p = program(SOFT + "pred few(int): Bool. pred q(int): Prov. q(C) :- cust_nation(C, N), risky(N).", spark, sf_dir, "cust_nation")
    rows = [(c, round(x, 9)) for (c,), x in p.prob_query("q") if c <= 50]
    return spark.createDataFrame(rows, "c long, p double")


# --- terms

TERMS = "@terms. domain d. pred nation_name(int, d): Bool. pred nation_region(int, int): Bool.\n"


@query("select i as depth from range(0, 65) r(i)")
def terms_nat(spark, sf_dir):
    frames = api.compile("@terms. domain d. pred nat(d): Bool. nat(zero). nat(succ(N)) :- nat(N).").frames(spark)
    return frames["nat"].select((F.length("c0") - F.length(F.replace(F.col("c0"), F.lit("succ"), F.lit("")))).alias("n")).select((F.col("n") / 4).cast("bigint").alias("depth"))


@query(with_("nation_name", "nation_region") + "select name, r from nation_name join nation_region using (n)")
def terms_decompose(spark, sf_dir):
    source = TERMS + "pred tree(term d): Bool. pred q(d, int): Bool. tree(node(leaf(M), N, at(R))) :- nation_name(N, M), nation_region(N, R). q(M, R) :- tree(node(leaf(M), _N, at(R)))."
    found = program(source, spark, sf_dir, "nation_name", "nation_region").frames(spark)["q"]
    return found.select(F.variant_get(F.parse_json("c0"), "$", "string").alias("name"), F.col("c1").cast("bigint").alias("r"))


@query("with own as (select c_custkey as v, cast(c_nationkey as bigint) as o from customer), fpt as (select distinct a.o, p.o as v from own a join own p on p.v = a.v // 2), x as (select s_suppkey as s, o from supplier join own on v = s_suppkey) select v, o from own union select 1000000 + s, o from x union select 3000000 + s, f.v from x join fpt f on f.o = x.o")
def points_to(spark, sf_dir):
    """Customers point at their nation, store their parent customer in its field 1, and suppliers copy the customer of
    their number (plus 1,000,000) and load its field (plus 3,000,000)."""
    at = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    one, long = F.lit(1).cast("bigint"), lambda c: F.col(c).cast("bigint")
    addr = at("customer").select(long("c_custkey"), long("c_nationkey"))
    copy = at("supplier").select((long("s_suppkey") + 1_000_000).alias("p"), long("s_suppkey"))
    store = relation(spark, sf_dir, "parent").select("y", one.alias("f"), "x")
    load = at("supplier").select((long("s_suppkey") + 3_000_000).alias("p"), long("s_suppkey"), one.alias("f"))
    return named(terms.points_to(addr, copy, store, load)["pt"], "v", "o")


@query(with_("part_brand") + "select b as value, cast(dense_rank() over (order by b) - 1 as bigint) as id from (select distinct b from part_brand)")
def intern_dense(spark, sf_dir):
    return terms.intern_dense(relation(spark, sf_dir, "part_brand"), "b")


# --- stable models

ASP = "@asp. pred nat(n): Bool. pred in(n): Bool. pred out(n): Bool.\nnat(a). nat(b). nat(c).\nin(N) :- nat(N), not out(N). out(N) :- nat(N), not in(N).\n"


def models_frame(spark: SparkSession, models) -> DataFrame:
    return spark.createDataFrame([(",".join(sorted(v for p, (v,) in m if p == "in")),) for m in models], "chosen string")


@query("select concat_ws(',', case when i & 1 = 1 then 'a' end, case when i & 2 = 2 then 'b' end, case when i & 4 = 4 then 'c' end) as chosen from range(0, 8) r(i)")
def asp_choice(spark, sf_dir):
    return models_frame(spark, api.asp_models(ASP))


@query("select concat_ws(',', case when i & 1 = 1 then 'a' end, case when i & 2 = 2 then 'b' end, case when i & 4 = 4 then 'c' end) as chosen from range(0, 8) r(i) where not (i & 3 = 3)")
def asp_constraint(spark, sf_dir):
    both = asp_ground.Constraint((t.Literal(t.Atom("in", (t.Const("a"),))), t.Literal(t.Atom("in", (t.Const("b"),)))))
    return models_frame(spark, api.asp_models(ASP, [both]))


@query("select concat_ws(',', case when i & 1 = 1 then 'a' end, case when i & 2 = 2 then 'b' end, case when i & 4 = 4 then 'c' end) as chosen from range(0, 8) r(i) where bit_count(i) between 1 and 2")
def asp_cardinality(spark, sf_dir):
    atoms = tuple(t.Atom("in", (t.Const(x),)) for x in "abc")
    rules, constraints = choice.normalize(choice.Choice(atoms, (), 1, 2), choice.Fresh())
    models = solve.solve(rules, [], constraints)
    return models_frame(spark, [[a for a in m if a[0] == "in"] for m in models])


@query("select * from (values ('rules_before', 9), ('rules_after', 9), ('literals_before', 12), ('literals_after', 6)) v(what, n)")
def asp_simplify(spark, sf_dir):
    tree, _ = read(ASP)
    g = asp_ground.ground(tree.nodes(t.Rule), [f.atom for f in tree.nodes(t.Fact)])
    return spark.createDataFrame(list(solve.reduction(g).items()), "what string, n int")


# --- cyclic patterns, over parts and suppliers as one space of nodes

UNDIRECTED = f"e as (select distinct least(u, v) as a, greatest(u, v) as b from ({duck('edge')}) where u <> v)"


@query(f"with {UNDIRECTED} select count(*) as n from e x join e y on y.a = x.b join e z on z.a = x.a and z.b = y.b")
def triangles(spark, sf_dir):
    return graphs.count_triangles(relation(spark, sf_dir, "edge"))


@query(f"with {UNDIRECTED} select count(*) as n from e x join e y on y.a = x.b join e z on z.a = x.a and z.b = y.b join e p on p.a = x.a join e q on q.a = x.b and q.b = p.b join e r on r.a = y.b and r.b = p.b")
def k4(spark, sf_dir):
    return graphs.count_4cliques(relation(spark, sf_dir, "edge"))


@query(f"with {UNDIRECTED} select cast(sum(d * d) as bigint) as n from (select count(*) as d from (select a from e union all select b from e) group by a)")
def binary_plan_size(spark, sf_dir):
    return graphs.binary_plan_intermediate(relation(spark, sf_dir, "edge"))


DIRECTED = with_("edge") + "select count(*) as n from edge x join edge y on y.u = x.v join edge z on z.u = x.u and z.v = y.v"


@query(DIRECTED)
def directed_triangles(spark, sf_dir):
    return graphs.directed_triangles(relation(spark, sf_dir, "edge"))


@query(DIRECTED)
def hcube_triangles(spark, sf_dir):
    return graphs.hcube_triangles(relation(spark, sf_dir, "edge"))


@query("select count(*) as n from lineitem a join orders o on a.l_orderkey = o.o_orderkey join customer c on c.c_custkey = o.o_custkey join supplier s on s.s_suppkey = a.l_suppkey and s.s_nationkey = c.c_nationkey")
def contract_count(spark, sf_dir):
    at = lambda name, *cols: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*(F.col(c).cast("bigint") for c in cols))
    body = [("l", ("o", "s")), ("o", ("o", "c")), ("c", ("c", "n")), ("s", ("s", "n"))]
    return planner.contract_count(body, {"l": at("lineitem", "l_orderkey", "l_suppkey"), "o": at("orders", "o_orderkey", "o_custkey"), "c": at("customer", "c_custkey", "c_nationkey"), "s": at("supplier", "s_suppkey", "s_nationkey")})


@query("select o_custkey as c, l_partkey as p, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by all")
def partitioned_join(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), "l_partkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("o"), "o_custkey")
    joined = graphs.partitioned_join(lines, orders, ["o"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    return joined.groupBy(F.col("o_custkey").alias("c"), F.col("l_partkey").alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query("with d as (select cast(c_nationkey % 10 as bigint) as digit, count(*) / (select count(*) from customer) as p from customer group by 1), e as (select cast(s_nationkey % 10 as bigint) as digit, count(*) / (select count(*) from supplier) as p from supplier group by 1) select d.digit + e.digit as s, round(sum(d.p * e.p), 9) as p from d, e group by 1")
def mnist_sum_conv(spark, sf_dir):
    def digits(name, column):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        n = df.groupBy((F.col(column) % 10).cast("bigint").alias("digit")).agg(F.count(F.lit(1)).alias("k"))
        return n.crossJoin(n.agg(F.sum("k").alias("all"))).select("digit", (F.col("k") / F.col("all")).alias("p"))

    return neural.sum_distribution(digits("customer", "c_nationkey"), digits("supplier", "s_nationkey")).withColumn("p", F.round("p", 9))


# --- maintenance

ANC = DOMAINS + "pred anc(int, int): Bool. anc(X, Y) :- parent(X, Y). anc(X, Z) :- parent(X, Y), anc(Y, Z)."


@query(f"with recursive parent as (select * from ({duck('parent')}) where y <> 2), {CLOSURE} select x, y from anc")
def dred_delete(spark, sf_dir):
    """The closure after the edge to customer 2 went."""
    kept = Maintained(spark, api.compile(ANC).checked, {"parent": relation(spark, sf_dir, "parent")})
    kept.delete("parent", spark.createDataFrame([(1, 2)], "x long, y long"))
    return named(kept.relations["anc"], "x", "y")


@query(f"with recursive parent as ({duck('parent')} union all select 0, 1), {CLOSURE} select x, y from anc")
def dred_insert(spark, sf_dir):
    """The closure after a new root came."""
    kept = Maintained(spark, api.compile(ANC).checked, {"parent": relation(spark, sf_dir, "parent")})
    kept.insert("parent", spark.createDataFrame([(0, 1)], "x long, y long"))
    return named(kept.relations["anc"], "x", "y")


@query("select * from (values ('a', 'b', '[[1]]'), ('a', 'c', '[[1,2],[3]]'), ('b', 'c', '[[2]]')) v(x, y, proofs)")
def incprov_insert(spark, sf_dir):
    kept = MaintainedProofs(api.compile("domain d. pred edge(d, d): Bool. pred path(d, d): Prov_k(5). path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z). 0.5 :: edge(a, b). 0.5 :: edge(b, c).").checked)
    kept.insert_soft("edge", ("a", "c"), 0.25)
    rows = [(*row, str(sorted(sorted(p) for p in own)).replace(" ", "")) for row, own in kept.proofs("path").items()]
    return spark.createDataFrame(rows, "x string, y string, proofs string")


@query(with_("seen") + "select distinct a.u as a, b.e as b from seen a join seen b using (u)")
def stream_maintain(spark, sf_dir):
    """Events as a stream of micro-batches that maintain a program's relations."""
    from semilog.storage import shared_dir

    source = DOMAINS + "pred q(int, d): Bool. q(U, E) :- seen(U, E)."
    empty = spark.createDataFrame([], "u long, e string")
    kept = Maintained(spark, api.compile(source).checked, {"seen": empty})
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not path.endswith(".parquet") else f"{sf_dir}/events*.parquet").select("user_id", "event_type")
    import uuid

    follow(kept, "seen", stream, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}").awaitTermination()
    return named(kept.relations["q"], "a", "b")


@query(with_("parent", recursive=CLOSURE) + "select x, y from anc")
def stream_tc(spark, sf_dir):
    """Edges as a stream of several micro-batches that maintain a recursive relation."""
    edges = relation(spark, sf_dir, "parent")
    path, schema = scratch(spark, "edges"), edges.schema
    edges.repartition(4).write.parquet(path)
    kept = Maintained(spark, api.compile(ANC).checked, {"parent": edges.limit(0)})
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    follow(kept, "parent", stream, scratch(spark, "stream")).awaitTermination()
    return named(kept.relations["anc"], "x", "y")


@query(f"with nation_region as ({duck('nation_region')}), left_ as (select * from nation_region where n % 3 <> 0) select r, cast(count(*) as bigint) as proofs, round(cast(1 - product(1 - (n + 1) / 50.0) as double), 9) as p from left_ group by r")
def incprov_regions(spark, sf_dir):
    """Proofs of regions after a nation's soft fact came for every row, and every third went again."""
    rows = sorted(map(tuple, relation(spark, sf_dir, "nation_region").collect()))
    facts = " ".join(f"place({n}, {r})." for n, r in rows)
    kept = MaintainedProofs(api.compile(f"pred place(int, int): Bool. pred shaky(int): Bool. pred hit(int): Prov. hit(R) :- place(N, R), shaky(N). {facts}").checked)
    leaves = {n: kept.insert_soft("shaky", (n,), (n + 1) / 50) for n, _ in rows}
    for n, leaf in leaves.items():
        if n % 3 == 0:
            kept.delete_soft(leaf)
    p = [s.p for s in kept.checked.soft]
    found = [(r, len(own), round(circuits.compile_exact(own).count(p), 9)) for (r,), own in kept.proofs("hit").items()]
    return spark.createDataFrame(found, "r long, proofs long, p double")


# --- files and text

FILES = "domain d. pred nation_name(int, d): Bool. pred weighted(int, int): Trop. pred q(int): Trop. q(X) :- weighted(X, _Y)."


def text_file(df: DataFrame, kind: str) -> str:
    """A new folder of text files in one of the formats, by Spark's writer of lines."""
    path = f"{scratch(df.sparkSession, 'facts')}.{kind}"
    cells = [F.col(c).cast("string") for c in df.columns]
    if kind == "json":
        cells = [F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2) for c in df.columns]
    line = F.concat_ws({"tsv": "\t", "csv": ",", "json": ","}[kind], *cells)
    df.select(F.concat(F.lit("["), line, F.lit("]")) if kind == "json" else line).write.text(path)
    return path


@query(with_("nation_name") + "select kind, n, name from nation_name, (values ('tsv'), ('csv'), ('json')) k(kind)")
def source_files(spark, sf_dir):
    """Typed facts read from each of the file formats."""
    parts = []
    for kind in ("tsv", "csv", "json"):
        p = api.compile(FILES).bind_file(spark, "nation_name", text_file(relation(spark, sf_dir, "nation_name"), kind))
        parts.append(named(p.frames(spark)["nation_name"], "n", "name").withColumn("kind", F.lit(kind)))
    return parts[0].union(parts[1]).union(parts[2])


@query(with_("weighted") + "select x, min(w) as w from weighted group by x")
def source_weights(spark, sf_dir):
    """A Trop predicate's facts with their weights from a file."""
    p = api.compile(FILES).bind_file(spark, "weighted", text_file(relation(spark, sf_dir, "weighted"), "tsv"))
    return named(p.frames(spark)["q"], "x", "w")


@query(with_("nation_region") + "select r, round(cast(1 - product(1 - (n + 1) / 50.0) as double), 9) as p from nation_region group by r")
def source_neural(spark, sf_dir):
    """A neural predicate's facts with their probabilities from a file."""
    p = program('domain d. pred nation_name(int, d): Bool. pred nation_region(int, int): Bool. neural shaky(d) from model "m". pred hit(int): Bool. hit(R) :- nation_region(N, R), nation_name(N, M), shaky(M).', spark, sf_dir, "nation_region", "nation_name")
    chances = relation(spark, sf_dir, "nation_name").select("name", ((F.col("n") + 1) / 50).alias("p"))
    return rounded(p.bind_file(spark, "shaky", text_file(chances, "csv")).marginal_frame(spark, "hit"), "r", "p")


@query(with_("nation_region") + "select 'place(' || n || ', ' || r || ')' as line from nation_region union all select 'dear(' || r || ') = ' || min(n) from nation_region group by r")
def sink_relations(spark, sf_dir):
    """A small program's relations as text, weights behind Trop rows; facts with weights are part of the program."""
    rows = sorted(map(tuple, relation(spark, sf_dir, "nation_region").collect()))
    p = api.compile("pred place(int, int): Bool. pred dear(int): Trop. " + " ".join(f"place({n}, {r}). {n} :: dear({r})." for n, r in rows))
    lines = text.relations(p.checked, local.plain(p.checked)).splitlines()
    return spark.createDataFrame([(x,) for x in lines], "line string")


# --- negation with rows on both sides

for spec in (
    ("neg_anti_rows", "pred has(int): Bool. pred q(int, int): Bool. has(X) :- parent(X, _Y). q(C, N) :- cust_nation(C, N), not has(C).", ("parent", "cust_nation"), ("c", "n"), with_("parent", "cust_nation") + "select c, n from cust_nation where c not in (select x from parent)"),
    ("neg_nullary_held", "pred any_size(): Bool. pred no_size(): Bool. pred q(int, int): Bool. any_size() :- part_size(_P, _Z). no_size() :- part_size(_P, 99999). q(P, 1) :- part_brand(P, _B), not any_size(). q(P, 2) :- part_brand(P, _B), not no_size().", ("part_size", "part_brand"), ("p", "side"), with_("part_size", "part_brand") + "select p, cast(2 as bigint) as side from part_brand"),
):
    answer(DOMAINS + spec[1], spec[2], "q", spec[3], spec[4], spec[0])


# --- ground rules as tables: customers follow from their parent, unless their nation is 7; 2,000,000 + nation are facts


def ground_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules ``y :- x, not y's nation = 7``, the root and the nation as facts, and customers of nation 5 that hold each
    other up in a circle (3,000,000 + customer)."""
    edges = relation(spark, sf_dir, "parent").join(relation(spark, sf_dir, "cust_nation").withColumnRenamed("c", "y"), "y")
    none, one = F.array().cast("array<bigint>"), lambda c: F.array(c.cast("bigint"))
    nation = F.col("n") + 2_000_000
    steps = edges.select("y", F.col("y").alias("head"), one(F.col("x")).alias("pos"), one(nation).alias("neg"))
    loops = edges.where("n = 5").select(F.col("y") + 3_000_000, F.col("y") + 3_000_000, one(F.col("y") + 3_000_000), none)
    facts = spark.createDataFrame([(1, 1), (2_000_007, 2_000_007)], "rule long, head long").select("rule", "head", none, none)
    return steps.union(loops).union(facts).toDF("rule", "head", "pos", "neg")


STEPS = f"parent as ({duck('parent')}), cust_nation as ({duck('cust_nation')}), steps as (select x, y, n from parent join cust_nation on c = y), atoms as (select y as atom from steps union select 1 union select 2000007 union select 3000000 + y from steps where n = 5), reach(y) as (select 1 union select s.y from reach r join steps s on s.x = r.y where s.n <> 7)"


@query(f"with recursive {STEPS} select atom, atom = 2000007 or atom in (select y from reach) as founded from atoms")
def asp_founded(spark, sf_dir):
    """Founded and unfounded atoms of a model with all atoms."""
    rules = ground_rules(spark, sf_dir)
    model = rules.select(F.col("head").alias("atom")).distinct()
    loose = frames.greatest_unfounded_set(rules, model)
    return frames.founded_set(rules, model).withColumn("founded", F.lit(True)).union(loose.withColumn("founded", F.lit(False)))


@query(f"with recursive {STEPS}, sure as (select y as atom from reach union select 2000007) select cast(y as bigint) as rule, n = 7 as dead, case when n = 7 or x in (select atom from sure) then '' else cast(x as varchar) end as pos, '' as neg from steps union all select 3000000 + y, true, '', '' from steps where n = 5 union all select atom, false, '', '' from (values (1), (2000007)) v(atom)")
def asp_filter(spark, sf_dir):
    """Rules simplified by what is possible and what is certain."""
    rules = ground_rules(spark, sf_dir)
    can = frames.possible_atoms(rules)
    found = frames.filter_rules(rules, can, frames.certain(rules, can))
    return found.select("rule", "dead", F.array_join("pos", ",").alias("pos"), F.array_join("neg", ",").alias("neg"))


# --- terms and circuits over a table's rows


@query(with_("nation_region") + "select 'terms' as what, cast((select count(*) from (select n from nation_region union select r from nation_region)) + 2 * count(distinct (n, r)) as bigint) as k from nation_region union all select 'deepest', cast(2 as bigint)")
def terms_interned(spark, sf_dir):
    """Terms ``up(at(n, r))`` of all rows, interned twice: equal ones share a number."""
    table = terms.TermTable()
    rows = sorted(map(tuple, relation(spark, sf_dir, "nation_region").collect()))
    numbers = [table.intern(("up", ("at", n, r))) for n, r in rows * 2]
    return spark.createDataFrame([("terms", table.stats()["terms"]), ("deepest", max(map(table.depth, numbers)))], "what string, k long")


@query(with_("nation_region") + "select case when r = 0 then null else n end as n, r from nation_region group by all")
def terms_maximal(spark, sf_dir):
    """The most general of the terms ``at(n, r)`` and ``at(_, 0)``."""
    store: list = []
    for n, r in sorted(map(tuple, relation(spark, sf_dir, "nation_region").collect())):
        terms.insert_maximal(store, ("at", n, r))
    terms.insert_maximal(store, ("at", ("?", "X"), 0))
    return spark.createDataFrame([(None if type(n) is tuple else n, r) for _, n, r in store], "n long, r long")


@query(with_("nation_region") + ", own as (select r, (n + 1) / 50.0 as p, row_number() over (partition by r order by n desc) as place from nation_region) select r, round(cast(1 - product(1 - p) as double), 9) as exact, round(cast(1 - product(case when place <= 2 then 1 - p else 1 end) as double), 9) as best, round(cast(sum(case when place <= 2 then p else 0 end) as double), 9) as total from own group by r")
def circuits_regions(spark, sf_dir):
    """Regions' proofs by one nation each: the exact count, the count of the two likeliest, and their sum."""
    by_region: dict[int, list[int]] = {}
    for n, r in sorted(map(tuple, relation(spark, sf_dir, "nation_region").collect())):
        by_region.setdefault(r, []).append(n)
    rows = []
    for r, nations in by_region.items():
        p, own = [(n + 1) / 50 for n in nations], [[i + 1] for i in range(len(nations))]
        rows.append((r, *(round(x, 9) for x in (circuits.count(list(map(frozenset, own)), p), circuits.top_circuit(own, 2, p).count(p), circuits.top_sum(list(map(frozenset, own)), 2, p)))))
    return spark.createDataFrame(rows, "r long, exact double, best double, total double")
