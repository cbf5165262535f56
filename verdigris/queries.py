"""Queries over the driver's tables. The tables hold no crates or tests, so fixed rules derive each relation from them;
these rules are adapters for checking, not features. ORACLE_SQL says the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import bayes, stats
from verdigris.operators import attribution, dashboard, fingerprint, flaky, fnselect, graph, history, hybrid, ordering, refgraph, selection, tune
from verdigris.plans import flows
from verdigris.sources import diff, reports, rust
from verdigris.sources.store import Store
from verdigris.storage import work_dir

Z = 1.959963986120195
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _user_runs(spark, sf_dir) -> DataFrame:
    return flaky.counts(_t(spark, sf_dir, "events"), "user_id", "event_type = 'error'")


USER_RUNS = "r as (select cast(user_id as varchar) as id, count(*) filter (event_type <> 'error') as passes, count(*) filter (event_type = 'error') as fails from events group by 1)"
PART_RUNS = "r as (select cast(l_partkey as varchar) as id, count(*) filter (l_returnflag <> 'R') as passes, count(*) filter (l_returnflag = 'R') as fails from lineitem group by 1)"


def _scores_sql(runs: str) -> str:
    z2 = Z * Z
    return f"""with {runs},
s as (select *, passes + fails as n, fails / cast(passes + fails as double) as p from r),
w as (select *, greatest(0.0, (p + {z2} / (2 * n)) / (1 + {z2} / n) - {Z} / (1 + {z2} / n) * sqrt(p * (1 - p) / n + {z2} / (4.0 * n * n))) as lo,
  least(1.0, (p + {z2} / (2 * n)) / (1 + {z2} / n) + {Z} / (1 + {z2} / n) * sqrt(p * (1 - p) / n + {z2} / (4.0 * n * n))) as hi,
  case when fails = 0 then 'stable_pass' when passes = 0 then 'stable_fail' else 'flaky' end as verdict from s)
select id, passes, fails, n as runs, round(p, 9) as flake_rate, round(lo, 9) as ci_low, round(hi, 9) as ci_high, round(hi, 9) as proven_below, verdict,
  cast(case when verdict = 'flaky' then greatest(1, ceil(ln(1 - 0.95) / ln(1 - p))) end as bigint) as reruns_to_reproduce_95 from w"""


def _scores(runs: DataFrame) -> DataFrame:
    return _rounded(flaky.flat(flaky.score(runs)), "flake_rate", "ci_low", "ci_high", "proven_below").select("id", "passes", "fails", "runs", "flake_rate", "ci_low", "ci_high", "proven_below", "verdict", "reruns_to_reproduce_95")


@query(_scores_sql(USER_RUNS))
def flaky_wilson(spark, sf_dir):
    return _scores(_user_runs(spark, sf_dir))


@query(_scores_sql(PART_RUNS))
def flaky_by_part(spark, sf_dir):
    return _scores(flaky.counts(_t(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag = 'R'"))


@query(f"with {USER_RUNS} select count(*) as tests, count(*) filter (passes > 0 and fails > 0) as flaky_count, count(*) filter (passes = 0 and fails > 0) as always_fail_count from r")
def flaky_summary(spark, sf_dir):
    return flaky.summary(flaky.score(_user_runs(spark, sf_dir)))


@query(f"with {PART_RUNS} select id, verdict, section from (select id, case when passes > 0 and fails > 0 then 'flaky' when fails > 0 then 'stable_fail' end as verdict, case when passes > 0 and fails > 0 then 0 when fails > 0 then 1 end as section from r) where section is not null")
def flaky_shown(spark, sf_dir):
    return flaky.shown(flaky.score(flaky.counts(_t(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag = 'R'")), "id").select("id", "verdict", "section")


@query(f"with {USER_RUNS} select id, passes, fails, round((fails + 0.5) / (passes + fails + 1), 9) as post_mean from r")
def flaky_posterior_mean(spark, sf_dir):
    return _rounded(bayes.jeffreys(_user_runs(spark, sf_dir)), "post_mean").select("id", "passes", "fails", "post_mean")


def _bounds_sql(terms: int = 240, steps: int = 54) -> str:
    """The beta quantiles by bisection; the distribution function by its continued fraction, folded from the inmost of a
    fixed number of terms, which is enough for the counts of these tables."""
    d = "case when j % 2 = 1 then -(u + (j - 1) / 2) * (u + v + (j - 1) / 2) * z / ((u + j - 1) * (u + j)) else j / 2 * (v - j / 2) * z / ((u + j - 1) * (u + j)) end"
    return f"""with recursive {USER_RUNS},
k as (select passes, fails, t.p, fails + 0.5::double as a, passes + 0.5::double as b, lgamma(passes + fails + 1) - lgamma(fails + 0.5) - lgamma(passes + 0.5) as g from (select distinct passes, fails from r), (values (0.025::double), (0.975::double)) t(p)),
s(passes, fails, p, a, b, g, low, high, i) as (select *, 0.0::double, 1.0::double, 0 from k union all
  select passes, fails, p, a, b, g, case when f < p then x else low end, case when f < p then high else x end, i + 1 from (
    select *, case when swap then 1 - c else c end as f from (
      select *, exp(g + a * ln(x) + b * ln(1 - x)) / u / list_reduce(list_transform(range({terms}, 0, -1), lambda j: j::double), lambda acc, j: 1 + ({d}) / acc, 1.0::double) as c from (
        select *, case when swap then b else a end as u, case when swap then a else b end as v, case when swap then 1 - x else x end as z from (
          select *, (low + high) / 2 as x, (low + high) / 2 > (a + 1) / (a + b + 2) as swap from s where i < {steps}))))),
e as (select passes, fails, p, (low + high) / 2 as q from s where i = {steps})
select id, passes, fails, round((fails + 0.5) / (passes + fails + 1), 9) as post_mean, round(l.q, 9) as post_low, round(h.q, 9) as post_high from r
join e l using (passes, fails) join e h using (passes, fails) where l.p < 0.5 and h.p > 0.5"""


@query(_bounds_sql())
def flaky_posterior_bounds(spark, sf_dir):
    return _rounded(bayes.jeffreys(_user_runs(spark, sf_dir)), "post_mean", "post_low", "post_high").select("id", "passes", "fails", "post_mean", "post_low", "post_high")


@query("""with d as (select distinct l_discount as p, 0.5 + 0.1 * cast(left(o_orderpriority, 1) as integer) as gamma from lineitem join orders on l_orderkey = o_orderkey)
select round(p, 9) as p, round(cast(gamma as double), 9) as gamma, cast(case when p <= 0 then null when p >= 1 then 1 else greatest(1, ceil(ln(1 - least(greatest(cast(gamma as double), 0.0), 0.999999)) / ln(1 - p))) end as bigint) as reruns from d""")
def rerun_budget(spark, sf_dir):
    both = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = both.select(F.col("l_discount").alias("p"), F.substring("o_orderpriority", 1, 1).cast("int").alias("k")).distinct()
    gamma = F.lit(0.5) + F.lit(0.1) * F.col("k")
    return d.select(F.round("p", 9).alias("p"), F.round(gamma, 9).alias("gamma"), stats.required_reruns(F.col("p"), gamma).alias("reruns"))


def _observed(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("ord"), F.unix_timestamp("ts").alias("at"), (F.col("event_type") != "error").alias("passed"), F.when(F.col("event_type") != "view", F.round("value").cast("bigint")).alias("duration_ms"))


OBSERVED = "o as (select cast(user_id as varchar) as id, event_id as ord, cast(floor(epoch(ts)) as bigint) as seen, event_type <> 'error' as passed, case when event_type <> 'view' then cast(round(value) as bigint) end as duration_ms from events)"
FOLDED = "f as (select id, count(*) filter (passed) as passes, count(*) filter (not passed) as fails, arg_max(seen, ord) filter (not passed) as last_fail, arg_max(duration_ms, ord) filter (duration_ms is not null) as last_duration_ms from o group by id)"
RECENTS = "n as (select id, count(*) as n_recent, count(*) filter (not passed) as recent_fails from (select id, passed, row_number() over (partition by id order by ord desc) as rn from o) where rn <= 50 group by id)"


@query(f"with {OBSERVED}, {FOLDED} select * from f")
def history_fold(spark, sf_dir):
    return history.fold(_observed(spark, sf_dir)).drop("recent")


@query(f"with {OBSERVED}, {RECENTS} select id, n_recent, recent_fails, recent_fails > 0 as recently_failed from n")
def history_recent50(spark, sf_dir):
    r = history.recent(_observed(spark, sf_dir))
    return r.select("id", F.size("recent").cast("bigint").alias("n_recent"), F.size(F.filter("recent", lambda x: ~x)).cast("bigint").alias("recent_fails"), history.recently_failed(F.col("recent")).alias("recently_failed"))


@query(f"with {OBSERVED}, {FOLDED}, {RECENTS} select f.id, row_number() over (order by recent_fails > 0 desc, last_fail desc nulls last, coalesce(last_duration_ms, 0), f.id) as rank from f join n using (id)")
def fail_fast_order(spark, sf_dir):
    h = history.fold(_observed(spark, sf_dir))
    return ordering.fail_fast_rank(h.select("id"), h).select("id", F.col("rank").cast("bigint").alias("rank"))


@query("select min(p_partkey) filter (p_partkey * 3 >= 500) as first from part")
def first_failing(spark, sf_dir):
    return ordering.first_failing(_t(spark, sf_dir, "part"), "p_partkey", "p_partkey * 3 >= 500")


@query("select cast(min(o_orderkey) filter (o_orderkey * 7 >= 90001) as bigint) as first from orders")
def first_failing_search(spark, sf_dir):
    return ordering.search_failing(_t(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey * 7 >= 90001", ways=16)


def _halves(nodes: DataFrame) -> DataFrame:
    """Edges (crate, dep) of numbered nodes k: to k div 2 and k div 3."""
    two, three = (F.when(F.col("k") >= n, F.expr(f"k div {n}")) for n in (2, 3))
    return nodes.select(F.col("k").alias("crate"), F.explode(F.array_compact(F.array(two, three))).alias("dep")).distinct()


@query("""with recursive e as (select p_partkey as crate, p_partkey // 2 as dep from part where p_partkey >= 2 union select p_partkey, p_partkey // 3 from part where p_partkey >= 3),
a(node) as (select p_partkey from part where p_partkey % 97 = 5 union select e.crate from a join e on e.dep = a.node) select node as crate from a""")
def affected_closure(spark, sf_dir):
    k = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return graph.affected(_halves(k), k.where("k % 97 = 5"))


def _nations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = _t(spark, sf_dir, "nation")
    k = n.select(F.col("n_nationkey").cast("bigint").alias("k"))
    name = n.select(F.col("n_nationkey").cast("bigint").alias("key"), "n_name")
    e = _halves(k.where("k >= 1")).where("crate <> dep")
    e = e.join(name.select(F.col("key").alias("crate"), F.col("n_name").alias("c")), "crate").join(name.select(F.col("key").alias("dep"), F.col("n_name").alias("d")), "dep")
    return n.select(F.col("n_name").alias("name"), F.concat(F.lit("crates/"), F.col("n_name")).alias("manifest_dir")), e.select(F.col("c").alias("crate"), F.col("d").alias("dep"))


def _nation_changes(spark, sf_dir, least: float = -900.0) -> DataFrame:
    c = _t(spark, sf_dir, "customer").where(F.col("c_acctbal") < least).join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    mine = c.select(F.concat(F.lit("crates/"), "n_name", F.lit("/src/"), F.col("c_custkey").cast("string"), F.lit(".rs")).alias("path"))
    return mine.union(_t(spark, sf_dir, "region").select(F.concat(F.lit("docs/"), "r_name").alias("path")))


NATIONS = """e as (select distinct c.n_name as crate, d.n_name as dep from (select n_nationkey as k, n_nationkey // 2 as j from nation where n_nationkey >= 2 union select n_nationkey, n_nationkey // 3 from nation where n_nationkey >= 3) x
  join nation c on c.n_nationkey = x.k join nation d on d.n_nationkey = x.j),
s as (select distinct n_name as crate from customer join nation on c_nationkey = n_nationkey where c_acctbal < -900),
a as (select crate from s union select e.crate from a join e on e.dep = a.crate),
p as (select n_name as crate, case when n_name in (select crate from s) then 'changed' when n_name in (select crate from a) then 'affected' else 'skipped' end as status from nation)"""


@query(f"with recursive {NATIONS} select * from p")
def selection_plan(spark, sf_dir):
    return selection.plan(*_nations(spark, sf_dir), _nation_changes(spark, sf_dir)).crates


@query(f"with recursive {NATIONS} select count(*) filter (status = 'changed') as changed, count(*) filter (status = 'affected') as affected, count(*) filter (status = 'skipped') as skipped, false as select_all, (select count(*) from region) as ignored_files, concat(count(*) filter (status = 'changed'), ' changed, ', count(*) filter (status <> 'skipped'), ' affected of ', count(*), ' crates; ', (select count(*) from region), ' files ignored') as reason from p")
def selection_summary(spark, sf_dir):
    return selection.plan(*_nations(spark, sf_dir), _nation_changes(spark, sf_dir)).summary


@query("select n_name as crate, 'affected' as status from nation")
def selection_force_all(spark, sf_dir):
    changed = _nation_changes(spark, sf_dir).union(spark.createDataFrame([("Cargo.lock",)], "path string"))
    return selection.plan(*_nations(spark, sf_dir), changed).crates


@query(r"""with u as (select page_id, regexp_replace(url, '^[a-z]+://', '') as path from pages),
d as (select distinct split_part(path, '/', 1) as dir from u union select distinct concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) from u where path like '%/%')
select page_id, path, dir as owner from (select page_id, path, dir, row_number() over (partition by page_id order by length(dir) desc) as rn from u left join d on path = dir or starts_with(path, concat(dir, '/'))) where rn = 1""")
def longest_prefix_owner(spark, sf_dir):
    u = _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    part = F.split("path", "/")
    two = u.where("path like '%/%'").select(F.concat_ws("/", part[0], part[1]).alias("name"))
    d = u.select(part[0].alias("name")).union(two).distinct().withColumn("manifest_dir", F.col("name"))
    return graph.owned_paths(u, d).select("page_id", "path", "owner")


@query("select concat(p_brand, '::', p_name) as id, p_brand as owner from part")
def owning_name(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return graph.owned_tests(p.select(F.concat_ws("::", "p_brand", "p_name").alias("id")), p.select(F.col("p_brand").alias("crate")).distinct()).select("id", "owner")


@query("select p_brand as crate, bool_and(p_size > 1) as passed from part group by 1 union all select 'Brand#none', null")
def attribution_three_valued(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    crates = p.select(F.col("p_brand").alias("crate")).distinct().union(spark.createDataFrame([("Brand#none",)], "crate string"))
    return attribution.crate_results(crates, p.select(F.concat_ws("::", "p_brand", "p_name").alias("id"), (F.col("p_size") > 1).alias("passed")))


ITEMS = """i as (select l_orderkey * 8 + l_linenumber as item_id, cast(l_suppkey as varchar) as file, l_partkey as s, l_partkey + cast(l_quantity as bigint) as e,
  case when l_linestatus = 'O' then 'fn' else 'const' end as kind from lineitem),
q as (select distinct cast(1 + p_partkey % (select max(s_suppkey) from supplier) as varchar) as file, p_partkey as line from part)"""


def _span_items(spark, sf_dir) -> DataFrame:
    """Items of a file are the lines of a supplier, numbered by order and line, which is their place too."""
    li, number = _t(spark, sf_dir, "lineitem"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint")
    kind = F.when(F.col("l_linestatus") == "O", "fn").otherwise("const")
    return li.select(number.alias("item_id"), number.alias("pos"), F.lit("").alias("name"), kind.alias("kind"), F.col("l_suppkey").cast("string").alias("file"), F.col("l_partkey").cast("int").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).cast("int").alias("end"), F.array().cast("array<string>").alias("refs"))


def _span_lines(spark, sf_dir) -> DataFrame:
    most = _t(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0]
    return _t(spark, sf_dir, "part").select((1 + F.col("p_partkey") % most).cast("string").alias("file"), F.col("p_partkey").cast("int").alias("line")).distinct()


@query(f"""with {ITEMS} select file, line, arg_min(item_id, (e - s, item_id)) filter (kind = 'fn') as fn_item, arg_min(item_id, (e - s, item_id)) filter (kind <> 'fn') as other_item
from (select q.file, q.line, i.* exclude (file) from q left join i on i.file = q.file and q.line between i.s and i.e) group by 1, 2""")
def interval_enclosure(spark, sf_dir):
    """The smallest item around each line; of equally small ones the first."""
    items, out = _span_items(spark, sf_dir), _span_lines(spark, sf_dir)
    for name, fn in (("fn_item", True), ("other_item", False)):
        out = refgraph.enclosing(out, items, fn).withColumnRenamed("item_id", name)
    return out.select("file", F.col("line").cast("bigint").alias("line"), "fn_item", "other_item")


def _coverage(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    li, part, orders = (_t(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    coverage = li.select(F.col("l_orderkey").cast("string").alias("test_id"), F.col("l_suppkey").cast("string").alias("file"), F.col("l_partkey").cast("int").alias("line"), F.lit("b0").alias("base"))
    hot = part.where("p_size < 5").select(F.col("p_partkey").cast("int").alias("line"))
    impacts = coverage.select("file", "line").distinct().join(hot, "line").select("file", F.lit(False).alias("whole"), "line")
    return impacts, coverage, orders.select(F.col("o_orderkey").cast("string").alias("test_id"))


COVERED = "cast(o_orderkey as varchar) as test_id, not exists (select 1 from lineitem where l_orderkey = o_orderkey) as uncovered, exists (select 1 from lineitem join part on l_partkey = p_partkey where l_orderkey = o_orderkey and p_size < 5) as hit from orders"


@query(f"select test_id from (select {COVERED}) where hit")
def coverage_semi(spark, sf_dir):
    impacts, coverage, tests = _coverage(spark, sf_dir)
    return fnselect.covered_by(coverage, impacts).join(tests.distinct(), "test_id", "left_semi")


@query("""with c as (select l_orderkey as k, l_suppkey as f, l_partkey as a, l_partkey + l_linenumber * 40 as b from lineitem), i as (select p_size % 10 as f, p_partkey * 3 as a, p_partkey * 3 + p_size * p_size as b from part where p_size % 25 = 1)
select distinct cast(c.k as varchar) as test_id from c join i on c.f % 10 = i.f and c.a <= i.b and i.a <= c.b""")
def coverage_overlap(spark, sf_dir):
    """Ranges of lines that tests cover, held against impacted ranges, none of them listed line by line."""
    c = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("test_id"), (F.col("l_suppkey") % 10).cast("string").alias("file"), F.col("l_partkey").alias("first"), (F.col("l_partkey") + F.col("l_linenumber") * 40).alias("last"))
    i = _t(spark, sf_dir, "part").where("p_size % 25 = 1").select((F.col("p_size") % 10).cast("string").alias("file"), (F.col("p_partkey") * 3).alias("first"), (F.col("p_partkey") * 3 + F.col("p_size") * F.col("p_size")).alias("last"))
    return fnselect.covered_by(c, i)


@query(f"select test_id from (select {COVERED}) where uncovered")
def coverage_anti(spark, sf_dir):
    _, coverage, tests = _coverage(spark, sf_dir)
    return tests.join(coverage, "test_id", "left_anti")


@query(f"select test_id, hit or uncovered as must_run from (select {COVERED})")
def function_selection(spark, sf_dir):
    return fnselect.select(*_coverage(spark, sf_dir), base="b0")


@query(f"select test_id, hit or uncovered or (select count(distinct l_returnflag = 'R') from lineitem where cast(l_orderkey as varchar) = test_id) > 1 as must_run from (select {COVERED})")
def function_selection_with_flaky(spark, sf_dir):
    past = flaky.counts(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag = 'R'")
    return fnselect.with_flaky(fnselect.select(*_coverage(spark, sf_dir)), past)


def _named_items(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Items are parts; an item's name is its key, it refers to keys div 3 and div 7, the latter through an alias."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    name = F.concat(F.lit("n"), F.col("k").cast("string"))
    refs = F.array_distinct(F.array(F.concat(F.lit("n"), F.expr("k div 3")), F.concat(F.lit("a"), F.expr("k div 7")), name))
    items = p.select(F.col("k").alias("item_id"), name.alias("name"), F.when(F.col("p_size") % 2 == 0, "fn").otherwise("const").alias("kind"), F.lit("f").alias("file"), F.col("k").cast("int").alias("start"), F.col("k").cast("int").alias("end"), refs.alias("refs"))
    return items, p.select(F.concat(F.lit("a"), F.col("k").cast("string")).alias("alias"), name.alias("original"), F.lit("f").alias("file"))


REFS = "e as (select * from (select p_partkey as src_item, p_partkey // 3 as dst_item from part union select p_partkey, p_partkey // 7 from part) where src_item <> dst_item and dst_item in (select p_partkey from part))"


@query(f"with {REFS} select * from e")
def ref_edges(spark, sf_dir):
    return refgraph.reference_edges(*_named_items(spark, sf_dir))


@query(f"with recursive {REFS}, a(node) as (select p_partkey from part where p_partkey between 2 and 4 union select e.src_item from a join e on e.dst_item = a.node) select node as item_id from a join part on p_partkey = node where p_size % 2 = 0")
def ref_reach(spark, sf_dir):
    items, aliases = _named_items(spark, sf_dir)
    return refgraph.users(items, refgraph.reference_edges(items, aliases), items.where("item_id between 2 and 4").select("item_id")).select("item_id")


@query("""with recursive h as (select p_partkey as line from part where p_size = 1), i as (select p_partkey as k, p_size % 2 = 0 as fn from part),
e as (select * from (select p_partkey as src_item, p_partkey // 3 as dst_item from part union select p_partkey, p_partkey // 7 from part) where src_item <> dst_item and dst_item in (select p_partkey from part)),
a(node) as (select k from i join h on line = k where not fn union select e.src_item from a join e on e.dst_item = a.node)
select 'f' as file, false as whole, cast(k as integer) as line from i where fn and (k in (select line from h) or k in (select node from a))""")
def hybrid_impact(spark, sf_dir):
    items, aliases = _named_items(spark, sf_dir)
    hunks = _t(spark, sf_dir, "part").where("p_size = 1").select(F.lit("f").alias("file"), F.col("p_partkey").cast("int").alias("old_start"), F.lit(1).alias("old_count"))
    return hybrid.analyze(items, aliases, hunks).lines


@query("""select o_orderkey as doc_id, case when o_orderkey % 5 = 0 then concat('src/old', o_custkey, '.rs') else concat('src/f', o_custkey, '.rs') end as file, cast(o_orderkey % 90 as integer) as old_start, cast(case when o_orderkey % 4 = 0 then 1 else o_orderkey % 4 - 1 end as integer) as old_count from orders
union all select o_orderkey, 'lib/x.rs', cast(7 as integer), cast(2 as integer) from orders where o_orderkey % 3 = 0""")
def diff_parse(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    head = F.when(key % 5 == 0, F.concat(F.lit("--- a/src/old"), cust, F.lit(".rs\n+++ /dev/null\n"))).otherwise(F.concat(F.lit("--- a/x\n+++ b/src/f"), cust, F.lit(".rs\t2024\n")))
    count = F.when(key % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(","), (key % 4 - 1).cast("string")))
    n = F.when(key % 4 == 0, 1).otherwise((key % 4 - 1).cast("int"))
    more = F.when(key % 3 == 0, F.lit("--- /dev/null\n+++ b/lib/x.rs\n@@ -7,2 +9 @@ fn x() { a - b }\n a\n--- b\n")).otherwise(F.lit("@@ malformed @@\n"))
    body = F.concat(F.repeat(F.lit("--- gone\n"), n), F.lit("+let y = 1;\n+++ two\n"))
    text = F.concat(F.lit("diff --git a b\n@@ -1 +1 @@\n-p\n+q\n"), head, F.lit("@@ -"), (key % 90).cast("string"), count, F.lit(" +1,2 @@ tail\n"), body, more)
    return diff.hunks(o.select(key.alias("doc_id"), text.alias("text")))


@query("select distinct cast(l_suppkey as varchar) as file, cast(l_partkey + k as integer) as line from (select l_suppkey, l_partkey, unnest(case when l_linenumber = 1 then [0, 1] else range(0, cast(l_linenumber as bigint)) end) as k from lineitem)")
def touched_lines(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    n = F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_linenumber")).cast("int")
    return diff.touched_lines(li.select(F.col("l_suppkey").cast("string").alias("file"), F.col("l_partkey").cast("int").alias("old_start"), n.alias("old_count")))


@query("""select case when event_id % 3 = 0 then concat('deep', user_id, '::') when user_id % 4 = 0 then '' else concat('suite', user_id, '::') end || concat('t', event_id) as id, event_type <> 'error' as passed, event_type = 'view' as flaky,
  case when event_type <> 'click' then cast(event_id % 5000 as bigint) end as duration_ms from events""")
def junit_parse(spark, sf_dir):
    """A suite a user, with a nested one (in one without a name) for every third event."""
    e = _t(spark, sf_dir, "events")
    child = F.when(F.col("event_type") == "error", F.lit('><failure type="x">boom</failure><flakyFailure/></testcase>')).when(F.col("event_type") == "view", F.lit("><flakyFailure>again</flakyFailure></testcase>")).when(F.col("event_type") == "purchase", F.lit("><skipped/></testcase>")).otherwise(F.lit("/>"))
    ms = F.col("event_id") % 5000
    time = F.when(F.col("event_type") != "click", F.concat(F.lit(' time="'), F.format_string("%d.%03d", F.expr("(event_id % 5000) div 1000"), ms % 1000), F.lit('"'))).otherwise(F.lit(""))
    case = F.concat(F.lit('<testcase name="t'), F.col("event_id").cast("string"), F.lit('"'), time, child)
    deep = F.col("event_id") % 3 == 0
    suite = e.groupBy("user_id").agg(F.array_join(F.collect_list(F.when(~deep, case)), "").alias("c"), F.array_join(F.collect_list(F.when(deep, case)), "").alias("d"))
    key = F.col("user_id").cast("string")
    name = F.when(F.col("user_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(' name="suite'), key, F.lit('"')))
    inner = F.concat(F.lit('<testsuite name="deep'), key, F.lit('"><testsuite>'), "d", F.lit("</testsuite></testsuite>"))
    xml = F.concat(F.lit("<testsuites><testsuite"), name, F.lit(">"), inner, "c", F.lit("</testsuite></testsuites>"))
    return reports.outcomes(suite.select(xml.alias("text")))


@query("select distinct cast(l_orderkey as varchar) as test_id, concat('f', l_suppkey) as file, cast(l_partkey + k as integer) as line from (select l_orderkey, l_suppkey, l_partkey, unnest(range(0, cast(l_linenumber as bigint))) as k from lineitem where l_returnflag = 'N')")
def coverage_parse(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    last = F.col("l_partkey") + F.col("l_linenumber") - 1
    count = F.when(F.col("l_returnflag") == "A", 0).otherwise(3)
    kind = F.when(F.col("l_returnflag") == "R", 2).otherwise(0)
    region = F.array(*(x.cast("bigint") for x in (F.col("l_partkey"), F.lit(1), last, F.lit(9), count, F.lit(1), F.lit(0), kind)))
    f = F.struct(F.array(F.lit("unused"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string"))).alias("filenames"), F.array(region).alias("regions"))
    docs = li.groupBy(F.col("l_orderkey").cast("string").alias("test_id")).agg(F.to_json(F.struct(F.array(F.struct(F.collect_list(f).alias("functions"))).alias("data"))).alias("text"))
    r = reports.covered_ranges(docs, ["test_id"])
    return r.select("test_id", "file", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("line"))


@query(f"with {USER_RUNS} select * from r")
def runs_json(spark, sf_dir):
    r = _user_runs(spark, sf_dir)
    line = F.to_json(F.struct("id", "passes", "fails"))
    texts = r.groupBy(F.col("id").cast("bigint") % 4).agg(F.when(F.max(F.col("id").cast("bigint") % 4) < 2, F.concat(F.lit(" ["), F.array_join(F.collect_list(line), ","), F.lit("]\n"))).otherwise(F.concat(F.lit("\n"), F.array_join(F.collect_list(line), "\n\n"))).alias("text"))
    return reports.runs(texts)


@query("select distinct c.n_name as crate, d.n_name as dep from nation c join nation d on d.n_regionkey = c.n_regionkey and d.n_nationkey < c.n_nationkey where d.n_nationkey % 7 <> 3 and c.n_nationkey % 7 <> 3")
def metadata_parse(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    other = n.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("dep"))
    deps = n.join(other, (F.col("r") == F.col("n_regionkey")) & (F.col("k") < F.col("n_nationkey")), "left").groupBy("n_nationkey", "n_name").agg(F.collect_list(F.struct(F.col("dep").alias("name"))).alias("d"))
    deps = deps.withColumn("d", F.concat(F.filter("d", lambda x: x["name"].isNotNull()), F.array(F.struct(F.lit("serde").alias("name")))))
    package = F.struct(F.concat(F.lit("id "), "n_name").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("/ws/"), "n_name", F.lit("/Cargo.toml")).alias("manifest_path"), F.col("d").alias("dependencies"))
    doc = deps.agg(F.collect_list(package).alias("packages"), F.collect_list(F.when(F.col("n_nationkey") % 7 != 3, F.concat(F.lit("id "), "n_name"))).alias("workspace_members"), F.lit("/ws").alias("workspace_root"))
    return reports.metadata(doc.select(F.to_json(F.struct("*")).alias("text")))[1]


@query("select source as crate, sha256(string_agg(concat(doc_id, chr(0), sha256(text)), chr(10) order by concat(doc_id, chr(0), sha256(text)))) as digest from documents group by 1")
def own_digest(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return fingerprint.own_digests(d.select(F.col("source").alias("crate"), F.col("doc_id").cast("string").alias("rel"), fingerprint.digest(F.col("text")).alias("digest")))


def _nation_prints(spark, sf_dir) -> DataFrame:
    members, edges = _nations(spark, sf_dir)
    return fingerprint.fingerprints(members.select(F.col("name").alias("crate"), F.sha2("name", 256).alias("digest")), edges, "v1")


PRINTS = """c as (select n_name as crate, n_name as member from nation union select c.crate, e.dep from c join e on e.crate = c.member),
fp as (select crate, sha256(concat('v1', chr(0), string_agg(concat(member, '=', sha256(member)), chr(10) order by concat(member, '=', sha256(member))))) as fingerprint from c group by crate)"""


@query(f"with recursive {NATIONS}, {PRINTS} select * from fp")
def closure_fingerprint(spark, sf_dir):
    return _nation_prints(spark, sf_dir)


def _merkle_sql(levels: int = 6) -> str:
    """Nations refer to lower numbers by division, so a few levels hold them all."""
    level = "select n.crate, sha256(concat('v1', chr(0), sha256(n.crate), chr(0), coalesce(string_agg(concat(e.dep, '=', m.fingerprint), chr(10) order by concat(e.dep, '=', m.fingerprint)) filter (e.dep is not null), ''))) as fingerprint from n left join e on e.crate = n.crate left join {} m on m.crate = e.dep group by n.crate having count(e.dep) = count(m.fingerprint)"
    steps = ["m0 as (select crate, null as fingerprint from n where false)", *(f"m{k} as ({level.format(f'm{k - 1}')})" for k in range(1, levels + 1))]
    return f"with {NATIONS[: NATIONS.index('s as (select distinct')]}n as (select n_name as crate from nation), {', '.join(steps)} select crate, fingerprint from m{levels}"


@query(_merkle_sql())
def merkle_fingerprint(spark, sf_dir):
    members, edges = _nations(spark, sf_dir)
    return fingerprint.merkle(members.select(F.col("name").alias("crate"), F.sha2("name", 256).alias("digest")), edges, "v1")


def _part_sql(levels: int = 18) -> str:
    """The way down by halves and thirds ends after so many levels for any number of parts below 2**17."""
    level = "select n.k, sha256(concat('v1', chr(0), n.d, chr(0), coalesce(string_agg(concat(e.name, '=', m.f), chr(10) order by concat(e.name, '=', m.f)) filter (e.name is not null), ''))) as f from n left join e on e.k = n.k left join {} m on m.k = e.dep group by n.k, n.d having count(e.name) = count(m.f)"
    steps = ["m0 as materialized (select k, null as f from n where false)", *(f"m{i} as materialized ({level.format(f'm{i - 1}')})" for i in range(1, levels + 1))]
    agg = "sha256(string_agg(h, chr(10) order by h)) as h"
    return f"""with p as (select cast(p_partkey as bigint) as k, p_partkey % 40 = 8 and p_partkey - 1 in (select p_partkey from part) as second from part),
o as (select k, case when second then k - 1 else k end as top from p),
l as (select top, sha256(concat('p', k, '=', sha256(concat('p', k)))) as h from o where top in (select top from o group by 1 having count(*) > 1)),
s1 as (select top, left(h, 4) as key, {agg} from l group by 1, 2), s2 as (select top, left(key, 2) as key, {agg} from s1 group by 1, 2), s3 as (select top, {agg} from s2 group by 1),
n as materialized (select o.k, coalesce(s3.h, sha256(concat('p', o.k))) as d from o left join s3 on s3.top = o.k where o.k = o.top),
x as (select k as a, k // 2 as b from p where k >= 2 union select k, k // 3 from p where k >= 3),
e as materialized (select distinct o.top as k, concat('p', x.b) as name, w.top as dep from x join o on o.k = x.a join o w on w.k = x.b where o.top <> w.top), {', '.join(steps)}
select concat('p', o.k) as crate, m.f as fingerprint from o join m{levels} m on m.k = o.top"""


@query(_part_sql())
def part_fingerprint(spark, sf_dir):
    """Parts depend on their halves and thirds; every fortieth and the one behind it depend on each other."""
    k = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("k"))
    pair = k.where("k % 40 = 7").select(F.explode(F.array(F.struct(F.col("k").alias("crate"), (F.col("k") + 1).alias("dep")), F.struct((F.col("k") + 1).alias("crate"), F.col("k").alias("dep")))).alias("x")).select("x.*")
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias(c)
    own = k.select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("crate"))
    return fingerprint.merkle(own.withColumn("digest", F.sha2("crate", 256)), _halves(k).union(pair).select(name("crate"), name("dep")), "v1")


def _greens(spark, sf_dir) -> DataFrame:
    """Even nations are green at their present fingerprint, the others at an older one."""
    even = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("crate"), (F.col("n_nationkey") % 2 == 0).alias("even"))
    fp = F.when(F.col("even"), F.col("fingerprint")).otherwise("old")
    return _nation_prints(spark, sf_dir).join(even, "crate").select("crate", fp.alias("fingerprint"), F.lit(1).cast("bigint").alias("at"))


@query("select n_name as crate, n_nationkey % 2 = 1 as run from nation")
def cache_partition(spark, sf_dir):
    return attribution.to_run(_nations(spark, sf_dir)[0].select(F.col("name").alias("crate")), _nation_prints(spark, sf_dir), _greens(spark, sf_dir))


@query("select n_name as crate, case when n_nationkey % 3 = 0 then cast(9 as bigint) else cast(1 as bigint) end as at from nation where n_nationkey % 3 <> 1")
def greens_update(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    r = n.select(F.col("n_name").alias("crate"), F.when(F.col("n_nationkey") % 3 == 0, True).when(F.col("n_nationkey") % 3 == 1, False).alias("passed"))
    return history.with_greens(_greens(spark, sf_dir), r, _nation_prints(spark, sf_dir), 9).select("crate", "at")


def _dashboard(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Tests of a nation are its suppliers; their times, outcomes and failures follow from balance and key."""
    status = selection.plan(*_nations(spark, sf_dir), _nation_changes(spark, sf_dir)).crates
    s = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    past = s.select(F.concat_ws("::", "n_name", "s_name").alias("id"), (F.col("s_suppkey") % 3).alias("passes"), (F.col("s_suppkey") % 2).alias("fails"), F.lit(None).cast("bigint").alias("last_fail"), F.when(F.col("s_acctbal") > 0, F.floor("s_acctbal").cast("bigint")).alias("last_duration_ms"), F.array().cast("array<boolean>").alias("recent"))
    return dashboard.crates(status, _nation_prints(spark, sf_dir), _greens(spark, sf_dir), past), past


BOARD = f"""{NATIONS}, {PRINTS},
t as (select n_name as crate, count(*) as tests, cast(sum(case when s_acctbal > 0 then cast(floor(s_acctbal) as bigint) else 0 end) as bigint) as total_ms from supplier join nation on s_nationkey = n_nationkey group by 1),
b as (select p.crate, status, substring(fingerprint, 1, 12) as short_fp, n_nationkey % 2 = 0 as cached_green, coalesce(tests, 0) as tests, coalesce(total_ms, 0) as total_ms from p join fp on fp.crate = p.crate join nation on n_name = p.crate left join t on t.crate = p.crate)"""


@query(f"with recursive {BOARD} select * from b")
def dashboard_crates(spark, sf_dir):
    return _dashboard(spark, sf_dir)[0]


@query(f"""with recursive {BOARD} select count(*) as crate_count, count(*) filter (status <> 'skipped') as affected_count, count(*) filter (status <> 'skipped' and cached_green) as cached_count,
round(case when count(*) filter (status <> 'skipped') = 0 then 1.0 else count(*) filter (status <> 'skipped' and cached_green) / cast(count(*) filter (status <> 'skipped') as double) end, 9) as hit_ratio,
(select count(*) from supplier where s_suppkey % 3 > 0 and s_suppkey % 2 > 0) as flaky_count, (select count(*) from supplier where s_suppkey % 3 = 0 and s_suppkey % 2 > 0) as always_fail_count from b""")
def dashboard_header(spark, sf_dir):
    return _rounded(dashboard.header(*_dashboard(spark, sf_dir)), "hit_ratio")


@query("select p_partkey, repeat('█', cast(round(least(greatest(p_size / 40.0, 0.0), 1.0) * 10) as integer)) || repeat('░', 10 - cast(round(least(greatest(p_size / 40.0, 0.0), 1.0) * 10) as integer)) as bar from part")
def gauge_bar(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", dashboard.bar(F.col("p_size") / 40.0).alias("bar"))


@query("select url as path from pages union select regexp_replace(url, '/[^/]*$', '') from pages")
def changed_files_union(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    blank = _t(spark, sf_dir, "region").select(F.lit("  ").alias("path"))
    return diff.changed_files(p.select(F.col("url").alias("path")), p.select(F.regexp_replace("url", "/[^/]*$", "").alias("path")).union(blank))


@query("""select p_partkey, case when p_partkey % 10 > 0 then cast(1 as integer) end as major, case when p_partkey % 10 > 0 then cast(80 + p_size % 20 as integer) end as minor, case when p_partkey % 10 > 0 then cast(case when p_partkey % 2 = 0 then p_size else 0 end as integer) end as patch,
case when p_partkey % 10 > 0 then 80 + p_size % 20 >= 90 end as fast_linker from part""")
def semver_parse(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    line = F.when(F.col("p_partkey") % 10 == 0, F.lit("commit: x\n")).otherwise(F.concat(F.lit("rustc 1.0.0\nhost: x86_64-unknown-linux-gnu\nrelease: 1."), (80 + F.col("p_size") % 20).cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("."), F.col("p_size").cast("string"), F.lit("-nightly"))).otherwise(F.lit("")), F.lit("\n")))
    v = p.select("p_partkey", line.alias("line")).select("p_partkey", tune.release(F.col("line")).alias("v"), tune.host(F.col("line")).alias("host"))
    return v.select("p_partkey", "v.major", "v.minor", "v.patch", F.when(F.col("v").isNotNull(), tune.fast_linker_default(F.col("host"), F.col("v"))).alias("fast_linker"))


@query("select concat('mod', p_size, '::', p_name) as test from part where p_partkey % 2 = 0")
def test_listing(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return reports.test_names(p.select(F.concat(F.lit("mod"), F.col("p_size").cast("string"), F.lit("::"), "p_name", F.when(F.col("p_partkey") % 2 == 0, F.lit(": test")).otherwise(F.lit(": benchmark"))).alias("line")))


@query("select concat('/t/', p_partkey) as executable from part where p_partkey % 3 = 0")
def artifact_listing(spark, sf_dir):
    k = F.col("p_partkey")
    v = F.struct(F.when(k % 6 == 1, F.lit("build-finished")).otherwise(F.lit("compiler-artifact")).alias("reason"), F.struct((k % 3 == 0).alias("test")).alias("profile"), F.concat(F.lit("/t/"), k.cast("string")).alias("executable"))
    return reports.test_binaries(_t(spark, sf_dir, "part").select(F.when(k % 6 == 5, F.lit("warning: x")).otherwise(F.to_json(v)).alias("line")))


@query("select count(*) >= 4 and not bool_or(n_name = 'workspace-hack' or n_name like '%-workspace-hack') as advise from nation")
def hack_advice(spark, sf_dir):
    return tune.hack_advice(_t(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


SUMMARY = "concat(count(*) filter (status = 'changed'), ' changed, ', count(*) filter (status <> 'skipped'), ' affected of ', count(*), ' crates; ', (select count(*) from region), ' files ignored')"


def _names_sql(condition: str) -> str:
    return f"coalesce(to_json(list(crate order by crate) filter ({condition})), '[]')"


@query(f"""with recursive {NATIONS} select concat('{{"changed_crates":', {_names_sql("status = 'changed'")}, ',"affected":', {_names_sql("status <> 'skipped'")}, ',"skipped":', {_names_sql("status = 'skipped'")},
  ',"select_all":false,"reason":"', {SUMMARY}, '","ignored_files":', (select count(*) from region), '}}') as json from p""")
def plan_json(spark, sf_dir):
    return selection.plan(*_nations(spark, sf_dir), _nation_changes(spark, sf_dir)).as_json()


@query(f"""with recursive {NATIONS} select null as status, null as crate, {SUMMARY} as line from p
union all select status, crate, concat('  ', case when status = 'skipped' then '-' else '+' end, ' ', crate, ' (', status, ')') from p""")
def plan_text(spark, sf_dir):
    return selection.plan(*_nations(spark, sf_dir), _nation_changes(spark, sf_dir)).as_lines()


@query("select 'crates' as changed, not exists (select 1 from customer where c_acctbal < -900) as empty union all select 'docs', true")
def plan_empty(spark, sf_dir):
    """Of a plan for the changes of selection_plan, and for those outside all crates."""
    members, edges = _nations(spark, sf_dir)
    changes = _nation_changes(spark, sf_dir)
    plans = {"crates": changes, "docs": changes.where("path like 'docs/%'")}
    return spark.createDataFrame([(k, selection.plan(members, edges, c).is_empty()) for k, c in plans.items()], "changed string, empty boolean")


@query("""select event_id, not (event_type = 'click' or event_id % 5 = 0 and event_type <> 'view') as exhaustive from events""")
def exhaustive_args(spark, sf_dir):
    """Arguments of a run an event: a filter, or a word, or only flags and an empty one."""
    kind, fifth = F.col("event_type"), F.col("event_id") % 5 == 0
    args = F.array(F.lit("--nocapture"), F.when(kind == "click", "--skip").otherwise("-q"), F.when(fifth & (kind != "view"), F.col("event_type")).otherwise(""))
    return _t(spark, sf_dir, "events").select("event_id", attribution.exhaustive(args).alias("exhaustive"))


@query("select l_orderkey, l_linenumber, case when l_discount * l_linenumber * 5 - 0.2 between 0 and 1 then round(l_discount * l_linenumber * 5 - 0.2, 9) end as share from lineitem")
def unit_interval(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(stats.within_unit(F.col("l_discount") * F.col("l_linenumber") * 5 - 0.2), 9).alias("share"))


@query("""with s as (select s_suppkey as k, case s_suppkey % 3 when 0 then 'linux' when 1 then 'macos' else 'windows' end as system, case when s_suppkey % 2 = 0 then 'x86_64-unknown-linux-gnu' else 'aarch64-apple-darwin' end as host,
  s_suppkey % 5 > 0 as mold, s_suppkey % 7 > 0 as clang, 85 + s_suppkey % 11 as minor from supplier)
select k, concat('[profile.dev]', chr(10), 'debug = "line-tables-only"', chr(10), case when system <> 'windows' then concat('split-debuginfo = "unpacked"', chr(10)) else '' end,
  case when system = 'linux' and mold and clang then concat(case when host like 'x86%' and minor >= 90 then concat('# The default linker is fast here; this helps only where linking dominates.', chr(10)) else '' end,
    '[target.', host, ']', chr(10), 'linker = "clang"', chr(10), 'rustflags = ["-C", "link-arg=-fuse-ld=mold"]', chr(10)) else '' end) as config from s""")
def build_config(spark, sf_dir):
    k = F.col("s_suppkey")
    system = F.when(k % 3 == 0, "linux").when(k % 3 == 1, "macos").otherwise("windows")
    host = F.when(k % 2 == 0, "x86_64-unknown-linux-gnu").otherwise("aarch64-apple-darwin")
    version = tune.release(F.concat(F.lit("release: 1."), (85 + k % 11).cast("string"), F.lit(".0")))
    return _t(spark, sf_dir, "supplier").select(k.alias("k"), tune.build_config(host, system, version, k % 5 > 0, k % 7 > 0).alias("config"))


@query("select concat('n', n_nationkey) as file, concat('const C', n_nationkey, ': u8 = 1;') as src from nation")
def source_tree(spark, sf_dir):
    """Sources of an exported tree, a folder a nation."""
    path = work_dir(spark, "tree")
    n = F.col("n_nationkey").cast("string")
    _t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), n).alias("of"), F.concat(F.lit("const C"), n, F.lit(": u8 = 1;")).alias("value")).write.partitionBy("of").text(path)
    return rust.read_sources(spark, path, ".txt").select(F.regexp_extract("file", "^of=([^/]+)/", 1).alias("file"), F.rtrim("src", F.lit("\n")).alias("src"))


@query("select concat('of=n', n_nationkey) as folder, sha256(concat('const C', n_nationkey, ': u8 = 1;', chr(10))) as digest from nation")
def tree_digests(spark, sf_dir):
    """Files of a tree on a mounted folder, without those that the writer keeps for itself."""
    path = work_dir(spark, "tree-of")
    n = F.col("n_nationkey").cast("string")
    _t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), n).alias("of"), F.concat(F.lit("const C"), n, F.lit(": u8 = 1;")).alias("value")).write.partitionBy("of").text(path)
    files = rust.tree_files(spark, "/" + path.removeprefix("file:").lstrip("/"))
    return files.where(F.col("rel").rlike("^of=[^/]+/part-[^/]+$")).select(F.split("rel", "/")[0].alias("folder"), "digest")


@query(f"with recursive {NATIONS} select crate from p where status <> 'skipped'")
def plan_candidates(spark, sf_dir):
    members, edges = _nations(spark, sf_dir)
    return selection.candidates(selection.plan(members, edges, _nation_changes(spark, sf_dir)), members)


@query(f"""with {USER_RUNS} select concat('{{"id":"', id, '","passes":', passes, ',"fails":', fails, ',"verdict":"', case when fails = 0 then 'stable_pass' when passes = 0 then 'stable_fail' else 'flaky' end, '"}}') as json from r""")
def flaky_json(spark, sf_dir):
    return flaky.as_json(flaky.score(_user_runs(spark, sf_dir)).select("id", "passes", "fails", "verdict"))


@query(f"select id, round((ci_high - ci_low) / 2, 7) as margin from ({_scores_sql(USER_RUNS)})")
def flaky_margin(spark, sf_dir):
    return flaky.score(_user_runs(spark, sf_dir)).select("id", F.round(stats.margin(F.col("ci")), 7).alias("margin"))


@query("select p_partkey, case when p_partkey % 3 = 0 then true when p_partkey % 3 = 1 then false else p_size <= 32 end as is_id from part")
def object_ids(spark, sf_dir):
    """Hexadecimal names, names with another letter, and names of twice p_size digits."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.lower(F.hex(k))).when(k % 3 == 1, F.concat(F.hex(k), F.lit("g"))).otherwise(F.repeat(F.lit("0f"), F.col("p_size")))
    return _t(spark, sf_dir, "part").select("p_partkey", reports.is_object_id(text).alias("is_id"))


@query("select page_id, case when starts_with(url, 'https:/') then substring(url, 8) else url end as path, case when page_id % 2 = 0 then concat('src/', page_id, '.rs') end as inside from pages")
def relative_paths(spark, sf_dir):
    """Paths without their root, and of coverage files those under a root."""
    p = _t(spark, sf_dir, "pages").select("page_id", reports.relative_path(F.col("url"), "https:/").alias("path"), F.concat(F.when(F.col("page_id") % 2 == 0, F.lit("/ws/src/")).otherwise(F.lit("/wsx/")), F.col("page_id").cast("string"), F.lit(".rs")).alias("file"))
    return p.select("page_id", "path").join(reports.relative(p.select("page_id", "file"), "/ws/").withColumnRenamed("file", "inside"), "page_id", "left")


def _sources(spark, sf_dir) -> DataFrame:
    """A file a part: an alias, a constant, a function or a struct by p_size, and an implementation with a method."""
    fill = lambda text: F.replace(F.replace(F.lit(text), F.lit("#"), F.col("p_partkey").cast("string")), F.lit("@"), F.expr("p_partkey div 2").cast("string"))
    head = fill("use crate::k@ as a#;\nconst C#: u32 = a#; // fn no() { \" '\n")
    body = F.when(F.col("p_size") % 2 == 0, fill('fn f#() -> u32 {\n    "}"; C#\n}\n')).otherwise(fill("pub struct S# {\n    x: u8,\n}\n"))
    return _t(spark, sf_dir, "part").select(fill("f#.rs").alias("file"), F.concat(head, body, fill("impl S# { fn m(&self) { f#(); } }\n")).alias("src"))


@query("""with k as (select p_partkey as k, p_partkey // 2 as h, p_size % 2 = 0 as even from part),
i as (select k, 0 as pos, '' as name, 'opaque' as kind, 1 as a, 1 as b, concat('a', k, ' as crate k', h, ' use') as refs from k
union all select k, 1, concat('C', k), 'const', 2, 2, concat('C', k, ' a', k, ' const u32') from k
union all select k, 2, case when even then concat('f', k) else concat('S', k) end, case when even then 'fn' else 'opaque' end, 3, 5, case when even then concat('C', k, ' f', k, ' fn u32') else concat('S', k, ' pub struct u8 x') end from k
union all select k, 3, concat('S', k), 'opaque', 6, 6, concat('S', k, ' f', k, ' fn impl m self') from k
union all select k, 4, 'm', 'fn', 6, 6, concat('f', k, ' fn m self') from k)
select concat('f', k, '.rs') as file, cast(pos as integer) as pos, name, kind, cast(a as integer) as first_line, cast(b as integer) as last_line, refs from i""")
def source_items(spark, sf_dir):
    items, _ = rust.items_and_aliases(_sources(spark, sf_dir))
    return items.select("file", "pos", "name", "kind", F.col("start").alias("first_line"), F.col("end").alias("last_line"), F.array_join("refs", " ").alias("refs"))


@query("select concat('a', p_partkey) as alias, concat('k', p_partkey // 2) as original, concat('f', p_partkey, '.rs') as file from part")
def source_aliases(spark, sf_dir):
    return rust.items_and_aliases(_sources(spark, sf_dir))[1].select("alias", "original", "file")


def _ingested(spark, sf_dir) -> Store:
    """A store after two runs of each nation's suppliers: even ones pass first; every third runs again the other way."""
    s = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    even = F.col("s_suppkey") % 2 == 0
    run = s.select(F.concat_ws("::", "n_name", "s_name").alias("id"), "s_suppkey", even.alias("passed"), F.lit(False).alias("flaky"), F.when(even, F.col("s_suppkey")).alias("duration_ms"))
    crates, prints = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("crate")), _nation_prints(spark, sf_dir)
    store = Store(spark, work_dir(spark, "store"))
    flows.ingest(store, crates, run.drop("s_suppkey"), prints, 1)
    flows.ingest(store, crates, run.where("s_suppkey % 3 = 0").withColumn("passed", ~F.col("passed")).drop("s_suppkey"), prints, 2)
    return store


RUNS_OF = "t as (select n_name as crate, concat(n_name, '::', s_name) as id, s_suppkey % 2 = 0 as even, s_suppkey % 3 = 0 as again, s_suppkey as k from supplier join nation on s_nationkey = n_nationkey)"


@query(f"""with {RUNS_OF} select id, cast(even as bigint) + cast(again and not even as bigint) as passes, cast(not even as bigint) + cast(again and even as bigint) as fails,
  cast(case when again and even then 2 when not even then 1 end as bigint) as last_fail, cast(case when even then k end as bigint) as last_duration_ms, case when again then [even, not even] else [even] end as recent from t""")
def stored_history(spark, sf_dir):
    return _ingested(spark, sf_dir).load("history")


@query(f"""with {RUNS_OF}, c as (select crate, bool_and(even) as first, bool_and(not even) filter (again) as second from t group by 1)
select crate, cast(case when second then 2 else 1 end as bigint) as at from c where coalesce(second, first)""")
def stored_greens(spark, sf_dir):
    return _ingested(spark, sf_dir).load("greens").select("crate", "at")


RUN_SET = """with recursive h as (select p_partkey as line from part where p_size = 1), i as (select p_partkey as k, p_size % 2 = 0 as fn from part),
e as (select * from (select p_partkey as src_item, p_partkey // 3 as dst_item from part union select p_partkey, p_partkey // 7 from part) where src_item <> dst_item and dst_item in (select p_partkey from part)),
a(node) as (select k from i join h on line = k where not fn union select e.src_item from a join e on e.dst_item = a.node),
l as (select k from i where fn and (k in (select line from h) or k in (select node from a))),
c as (select l_orderkey, bool_or(l_partkey in (select k from l)) as hit, count(distinct l_returnflag = 'R') > 1 as risky from lineitem group by 1)
"""


@query(f"{RUN_SET} select cast(o_orderkey as varchar) as test_id, coalesce(hit or risky, true) as must_run from orders left join c on l_orderkey = o_orderkey")
def functions_to_run(spark, sf_dir):
    """The impact of a diff, held against coverage and history from a store."""
    li, part = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    store = Store(spark, work_dir(spark, "store"))
    flows.ingest_coverage(store, li.select(F.col("l_orderkey").cast("string").alias("test_id"), F.lit("f").alias("file"), F.col("l_partkey").cast("int").alias("line")), "b0")
    past = flaky.counts(li, "l_orderkey", "l_returnflag = 'R'")
    store.save(history=past.select("*", F.lit(None).cast("bigint").alias("last_fail"), F.lit(None).cast("bigint").alias("last_duration_ms"), F.array().cast("array<boolean>").alias("recent")))
    hunks = part.where("p_size = 1").select(F.lit("f").alias("file"), F.col("p_partkey").cast("int").alias("old_start"), F.lit(1).alias("old_count"))
    return flows.functions_to_run(*_named_items(spark, sf_dir), hunks, _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("test_id")), store, "b0")


@query("select distinct cast(l_orderkey as varchar) as test_id, 'f' as file, cast(l_partkey as integer) as line from lineitem join orders on o_orderkey = l_orderkey where o_orderpriority like '1%'")
def stored_coverage(spark, sf_dir):
    store = Store(spark, work_dir(spark, "store"))
    li = _t(spark, sf_dir, "lineitem")
    flows.ingest_coverage(store, li.select(F.col("l_orderkey").cast("string").alias("test_id"), F.lit("f").alias("file"), F.col("l_partkey").cast("int").alias("line")).distinct(), "b0")
    some = _t(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").cast("string").alias("test_id"))
    return flows.covered_of(some, store).select("test_id", "file", "line")
