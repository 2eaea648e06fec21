"""The driver's queries over the engine's own operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import agg, aggs, describe, dim, dims, hints, register_classifier, register_op, trusted
from .sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

MONTH = "strftime(o_orderdate, '%Y%m')"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def simple(name: str, frame: str, columns: str, chain, keep: str, sql: str, digits: int | None = None, verb=dim, **options) -> None:
    """A query of one verb: ``keep`` names the result's columns; doubles among ``x`` columns are rounded."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = verb(table(spark, folder, frame, *columns.split()), chain, **options)
        out = out.select(*keep.split())
        if digits is not None:
            out = out.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in out.schema))
        return out

    QUERIES[name], ORACLE_SQL[name] = run, sql


# -- window dimensions

simple("dim_share", "orders", "o_orderkey o_orderstatus o_totalprice", ["o_orderstatus", ("share", "o_totalprice / sum(o_totalprice)")], "o_orderkey o_orderstatus share",
       "SELECT o_orderkey, o_orderstatus, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderstatus), 8) AS share FROM orders", 8)
simple("dim_share_of_all", "orders", "o_orderkey o_totalprice", ("share", "o_totalprice / sum(o_totalprice)"), "o_orderkey share",
       "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (), 8) AS share FROM orders", 8)
simple("dim_zscore", "customer", "c_custkey c_mktsegment c_acctbal", ["c_mktsegment", ("z", "(c_acctbal - mean(c_acctbal)) / std(c_acctbal)")], "c_custkey z",
       "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 6) AS z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)", 6)

@query("dim_reductions", """
SELECT c_custkey, min(c_acctbal) OVER w AS lo, max(c_acctbal) OVER w AS hi, round(quantile_cont(c_acctbal, 0.5) OVER w, 4) AS mid, round(quantile_cont(c_acctbal, 0.9) OVER w, 4) AS q9,
  round(var_samp(c_acctbal) OVER w, 2) AS v, count(*) OVER w AS n, count(DISTINCT c_mktsegment) OVER w AS k, bool_or(c_acctbal < 0) OVER w AS neg, count(*) FILTER (c_acctbal < 1000) OVER w AS few,
  count(DISTINCT c_mktsegment) OVER w = 1 AS u
FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def dim_reductions(spark, folder):
    df = table(spark, folder, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    specs = {"lo": "minimum(c_acctbal)", "hi": "maximum(c_acctbal)", "mid": "median(c_acctbal)", "q9": "quantile(c_acctbal, 0.9)", "v": "var(c_acctbal)", "n": "length(c_acctbal)", "k": "countuniq(c_mktsegment)", "neg": "any(c_acctbal < 0)", "few": "count(c_acctbal < 1000)", "u": "isuniform(c_mktsegment)"}
    out = dim(df, *(["c_nationkey", (k, s)] for k, s in specs.items()))
    return out.select("c_custkey", "lo", "hi", F.round("mid", 4).alias("mid"), F.round("q9", 4).alias("q9"), F.round("v", 2).alias("v"), "n", "k", "neg", "few", "u")


simple("dim_cumsum_orderby", "orders", "o_orderkey o_custkey o_orderdate o_totalprice", ["o_custkey", ("run", "cumsum(o_totalprice) |> orderby(o_orderdate, o_orderkey)")], "o_orderkey run",
       "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS run FROM orders", 2)
simple("dim_cumsum_desc", "orders", "o_orderkey o_custkey o_orderdate o_totalprice", ["o_custkey", ("run", "cumsum(o_totalprice) ∘ orderby(o_orderdate => :desc, o_orderkey)")], "o_orderkey run",
       "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS run FROM orders", 2)
simple("dim_cumprod", "customer", "c_custkey c_nationkey", ["c_nationkey", ("p", "cumprod(1 + 1 / c_custkey) |> orderby(c_custkey)")], "c_custkey p",
       "SELECT c_custkey, round(product(1 + 1.0 / c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING), 6) AS p FROM customer", 6)
simple("dim_lag", "orders", "o_orderkey o_custkey o_orderdate o_totalprice", ["o_custkey", ("prev", "lag(o_totalprice) |> orderby(o_orderdate, o_orderkey)"), ], "o_orderkey prev",
       "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders")
simple("dim_lead_default", "orders", "o_orderkey o_custkey o_orderdate o_totalprice", ["o_custkey", ("nxt", "lead(o_totalprice, 2, default = 0) |> orderby(o_orderdate, o_orderkey)")], "o_orderkey nxt",
       "SELECT o_orderkey, lead(o_totalprice, 2, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders")
for _rev in (False, True):
    _tail, _opt, _way = ("_rev", ", rev = true", "DESC") if _rev else ("", "", "ASC")
    for _name, _sql in (("rank", "rank() OVER w"), ("denserank", "dense_rank() OVER w"), ("tiedrank", "rank() OVER w + (count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) - 1) / 2.0")):
        simple(f"dim_{_name}{_tail}", "customer", "c_custkey c_nationkey c_mktsegment", ["c_nationkey", ("r", f"{_name}(c_mktsegment{_opt})")], "c_custkey r",
               f"SELECT c_custkey, {_sql} AS r FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment {_way})")
    simple(f"dim_ordinalrank{_tail}", "customer", "c_custkey c_nationkey c_mktsegment", ["c_nationkey", ("r", f"ordinalrank(c_mktsegment{_opt}) |> orderby(c_custkey)")], "c_custkey r",
           f"SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment {_way}, c_custkey) AS r FROM customer")

# -- elementwise

simple("dim_where", "customer", "c_custkey c_acctbal", ("w", "where(c_acctbal > 5000)"), "c_custkey w", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'c_acctbal > 5000' ELSE 'Not c_acctbal > 5000' END AS w FROM customer")
simple("dim_where_labels", "customer", "c_custkey c_acctbal", ("w", 'where(c_acctbal < 0 || c_acctbal > 9000, true_label = "edge", false_label = "middle")'), "c_custkey w", "SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 'edge' ELSE 'middle' END AS w FROM customer")
simple("dim_onlyif", "customer", "c_custkey c_acctbal", ("w", "onlyif(c_acctbal > 0, c_acctbal * 2)"), "c_custkey w", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal * 2 END AS w FROM customer")
simple("dim_in", "events", "event_id event_type user_id", ("w", 'event_type in ["click", "view"] && user_id ∉ [1, 2, 3]'), "event_id w", "SELECT event_id, event_type IN ('click', 'view') AND user_id NOT IN (1, 2, 3) AS w FROM events")
simple("dim_in_column", "customer", "c_custkey c_nationkey", ("w", "c_custkey in c_nationkey"), "c_custkey w", "SELECT c_custkey, c_custkey IN (SELECT c_nationkey FROM customer) AS w FROM customer")


@query("dim_kleene", """
WITH l AS (SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, o_totalprice AS x FROM orders)
SELECT o_orderkey, prev > 100000 AND x > 100000 AS a, prev > 100000 OR x > 100000 AS o, NOT (prev > 100000) AS n, prev IS NULL AS m, coalesce(prev, x) AS c FROM l""")
def dim_kleene(spark, folder):
    df = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    df = dim(df, ["o_custkey", ("prev", "lag(o_totalprice) |> orderby(o_orderdate, o_orderkey)")])
    return dim(df, ("a", "prev > 100000 && o_totalprice > 100000"), ("o", "prev > 100000 || o_totalprice > 100000"), ("n", "!(prev > 100000)"), ("m", "ismissing(prev)"), ("c", "coalesce(prev, o_totalprice)")).select("o_orderkey", "a", "o", "n", "m", "c")


@query("dim_math", """
SELECT s_suppkey, abs(s_acctbal) AS a, round(CASE WHEN abs(s_acctbal) = 0 THEN '-inf'::DOUBLE ELSE ln(abs(s_acctbal)) END, 8) AS l, round(log2(s_suppkey), 8) AS l2, round(log10(s_suppkey), 8) AS l10, round(exp(s_nationkey), 4) AS e, round(sqrt(abs(s_acctbal)), 8) AS q,
  round_even(s_acctbal, 0) AS r, floor(s_acctbal) AS f, ceil(s_acctbal) AS c, least(s_acctbal, 0) AS mn, greatest(s_acctbal, s_suppkey) AS mx, s_nationkey ** 2 AS p, round(2 * s_acctbal - s_suppkey / (1.0 + s_nationkey), 6) AS k
FROM supplier""")
def dim_math(spark, folder):
    df = table(spark, folder, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    specs = {"a": "abs(s_acctbal)", "l": "log(abs(s_acctbal))", "l2": "log2(s_suppkey)", "l10": "log10(s_suppkey)", "e": "exp(s_nationkey)", "q": "sqrt(abs(s_acctbal))", "r": "round(s_acctbal)", "f": "floor(s_acctbal)", "c": "ceil(s_acctbal)", "mn": "min(s_acctbal, 0)", "mx": "max(s_acctbal, s_suppkey)", "p": "s_nationkey^2", "k": "2s_acctbal - s_suppkey / (1 + s_nationkey)"}
    out = dim(df, *specs.items())
    digits = {"l": 8, "l2": 8, "l10": 8, "e": 4, "q": 8, "k": 6}
    return out.select("s_suppkey", *(F.round(n, digits[n]).alias(n) if n in digits else F.col(n).cast("double").alias(n) for n in specs))


@query("dim_datebuckets", f"""
SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) AS q, strftime(o_orderdate, '%y') || 'Q' || quarter(o_orderdate) AS yq, {MONTH} AS m, strftime(o_orderdate, '%Y/%m') AS md, strftime(o_orderdate, '%y%m') AS ym
FROM orders""")
def dim_datebuckets(spark, folder):
    specs = {"y": "yyyy(o_orderdate)", "q": "yyyyq(o_orderdate)", "yq": "yyq(o_orderdate)", "m": "yyyymm(o_orderdate)", "md": 'yyyymm(o_orderdate, "/")', "ym": "yymm(o_orderdate)"}
    return dim(table(spark, folder, "orders", "o_orderkey", "o_orderdate"), *specs.items()).select("o_orderkey", *specs)


# -- classifiers

_QUARTERS = "CASE WHEN {x} < t[1] THEN '1. [0%, 25%)' WHEN {x} < t[2] THEN '2. [25%, 50%)' WHEN {x} < t[3] THEN '3. [50%, 75%)' ELSE '4. [75%, 100%]' END"
simple("dim_quantiles_row", "part", "p_partkey p_brand p_retailprice", ["p_brand", ("q", "quantiles(p_retailprice, ngroups = 4)")], "p_partkey q",
       f"WITH g AS (SELECT p_brand, quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS t FROM part GROUP BY 1) SELECT p_partkey, {_QUARTERS.format(x='p_retailprice')} AS q FROM part JOIN g USING (p_brand)")
simple("dim_quantiles_groupby", "part", "p_partkey p_brand p_retailprice", ("q", "quantiles(p_retailprice, [.25, .5, .75]) |> groupby(p_brand)"), "p_partkey q",
       f"WITH g AS (SELECT p_brand, sum(p_retailprice) AS s FROM part GROUP BY 1), h AS (SELECT quantile_cont(s, [0.25, 0.5, 0.75]) AS t FROM g) SELECT p_partkey, {_QUARTERS.format(x='s')} AS q FROM part JOIN g USING (p_brand), h")
simple("dim_discretize_int", "part", "p_partkey p_size", ("d", "discretize(p_size, [10, 11, 30])"), "p_partkey d",
       "SELECT p_partkey, CASE WHEN p_size < 10 THEN '1. ≤9' WHEN p_size < 11 THEN '2. 10' WHEN p_size < 30 THEN '3. 11…29' ELSE '4. 30+' END AS d FROM part")
simple("dim_discretize_real", "part", "p_partkey p_retailprice", ("d", "discretize(p_retailprice, [1000, 1250.5, 1500])"), "p_partkey d",
       "SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN '1. <1000' WHEN p_retailprice < 1250.5 THEN '2. [1000,1250.5)' WHEN p_retailprice < 1500 THEN '3. [1250.5,1500)' ELSE '4. ≥1500' END AS d FROM part")
simple("dim_discretize_label", "supplier", "s_suppkey s_acctbal", ("d", 'discretize(s_acctbal, [100, 5000], label = "bal", absolute = true, leftequal = false)'), "s_suppkey d",
       "SELECT s_suppkey, CASE WHEN abs(s_acctbal) <= 100 THEN '1. |bal| ≤ 100' WHEN abs(s_acctbal) <= 5000 THEN '2. 100 < |bal| ≤ 5000' ELSE '3. 5000 < |bal|' END AS d FROM supplier")
simple("dim_discretize_bounded", "part", "p_partkey p_retailprice", ("d", "discretize(p_retailprice, [950, 1100, 1300], boundedness = :bounded)"), "p_partkey d",
       "SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN NULL WHEN p_retailprice < 1100 THEN '1. [950,1100)' WHEN p_retailprice <= 1300 THEN '2. [1100,1300]' END AS d FROM part")
simple("dim_discretize_quantiles", "part", "p_partkey p_retailprice", ("d", 'discretize(p_retailprice, ngroups = 2, scale = 100.0, suffix = "%")'), "p_partkey d",
       "SELECT p_partkey, CASE WHEN p_retailprice < (SELECT quantile_cont(p_retailprice, 0.5) FROM part) THEN '1. [0%,50%)' ELSE '2. [50%,100%]' END AS d FROM part")
simple("dim_discretize_moving", "customer", "c_custkey c_mktsegment c_acctbal", ["c_mktsegment", ("d", "discretize(c_acctbal, [0, floor(mean(c_acctbal))])")], "c_custkey d",
       "WITH g AS (SELECT c_mktsegment, floor(avg(c_acctbal))::BIGINT AS m FROM customer GROUP BY 1) SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '1. <0' WHEN c_acctbal < m THEN '2. [0,' || m || ')' ELSE '3. ≥' || m END AS d FROM customer JOIN g USING (c_mktsegment)")
simple("dim_topnames", "orders", "o_orderkey o_orderpriority o_totalprice", ("t", "topnames(o_orderpriority, o_totalprice, 2)"), "o_orderkey t", """
WITH g AS (SELECT o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY 1), r AS (SELECT *, dense_rank() OVER (ORDER BY s DESC) AS k FROM g)
SELECT o_orderkey, CASE WHEN k <= 2 THEN k || '. ' || o_orderpriority ELSE 'Others' END AS t FROM orders JOIN r USING (o_orderpriority)""")
simple("dim_topnames_context", "supplier", "s_suppkey s_nationkey s_name s_acctbal", ["s_nationkey", ("t", 'topnames(s_name, s_acctbal, 1, dense = false, others = "rest")')], "s_suppkey t", """
WITH g AS (SELECT s_nationkey, s_name, sum(s_acctbal) AS s FROM supplier GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY s_nationkey ORDER BY s DESC) AS k FROM g)
SELECT s_suppkey, CASE WHEN k <= 1 THEN k || '. ' || s_name ELSE 'rest' END AS t FROM supplier JOIN r USING (s_nationkey, s_name)""")
simple("dim_topnames_absolute", "supplier", "s_suppkey s_nationkey s_acctbal", ("t", "topnames(s_nationkey, s_acctbal, 12, absolute = true, parens = true, tol = 10)"), "s_suppkey t", """
WITH g AS (SELECT s_nationkey, sum(s_acctbal) AS s FROM supplier GROUP BY 1), f AS (SELECT *, dense_rank() OVER (ORDER BY abs(s) DESC, s DESC) AS k FROM g WHERE abs(s) >= 10), r AS (SELECT *, dense_rank() OVER (ORDER BY s DESC) AS p FROM f WHERE k <= 12)
SELECT s_suppkey, CASE WHEN p <= 12 THEN lpad(p::VARCHAR, 2, ' ') || '. ' || CASE WHEN s < 0 THEN '(' || s_nationkey || ')' ELSE s_nationkey::VARCHAR END ELSE 'Others' END AS t FROM supplier LEFT JOIN r USING (s_nationkey)""")
simple("dim_pareto", "lineitem", "l_suppkey l_extendedprice", ("run", "cumsum(l_extendedprice) |> groupby(l_suppkey) |> orderby(l_extendedprice => :desc)"), "l_suppkey run", """
WITH g AS (SELECT l_suppkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1), r AS (SELECT l_suppkey, round(sum(s) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING), 1) AS run FROM g)
SELECT l_suppkey, run FROM lineitem JOIN r USING (l_suppkey)""", 1)
simple("dim_groupby_computed", "orders", "o_orderkey o_orderdate o_totalprice", ("r", "rank(o_totalprice, rev = true) |> groupby(yyyymm(o_orderdate))"), "o_orderkey r", f"""
WITH g AS (SELECT {MONTH} AS m, sum(o_totalprice) AS s FROM orders GROUP BY 1), r AS (SELECT m, rank() OVER (ORDER BY s DESC) AS r FROM g) SELECT o_orderkey, r FROM orders JOIN r ON m = {MONTH}""")
simple("dim_nested_groupby", "orders", "o_orderkey o_orderstatus o_orderdate o_totalprice", ["o_orderstatus", ("x", "mean(sum(o_totalprice) |> groupby(yyyy(o_orderdate)))")], "o_orderkey x", """
WITH g AS (SELECT o_orderstatus, year(o_orderdate) AS y, sum(o_totalprice) AS s FROM orders GROUP BY ALL), h AS (SELECT o_orderstatus, round(avg(s), 2) AS x FROM g GROUP BY 1) SELECT o_orderkey, x FROM orders JOIN h USING (o_orderstatus)""", 2)

_GAPS = "WITH e AS (SELECT *, date_diff('second', lag(ts) OVER w, ts) / 60.0 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(CASE WHEN gap > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM e)"


def _gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Durations are the host's business: minutes since the user's event before."""
    e = table(spark, folder, "events", "event_id", "user_id", "ts", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_timestamp(F.date_trunc("second", "ts")) - F.unix_timestamp(F.date_trunc("second", F.lag("ts").over(w)))
    return e.withColumn("gap", seconds / 60.0)


_SESSION = ["user_id", ("session", "cumsum(coalesce(gap > 30, false)) |> orderby(ts, event_id)")]


@query("dim_sessions", f"{_GAPS} SELECT event_id, session FROM s")
def dim_sessions(spark, folder):
    return dim(_gaps(spark, folder), _SESSION).select("event_id", "session")


@query("agg_sessions", f"{_GAPS} SELECT user_id, session, round(sum(value), 4) AS total, count(*) AS n FROM s GROUP BY ALL")
def agg_sessions(spark, folder):
    out = agg(_gaps(spark, folder), _SESSION, cols=[("value", "sum", "total"), ("value", "length(_)", "n")])
    return out.withColumn("total", F.round("total", 4))


@query("dim_chain_left_context", """
WITH g AS (SELECT o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY 1), r AS (SELECT *, dense_rank() OVER (ORDER BY s DESC) AS k FROM g),
a AS (SELECT o_orderkey, o_totalprice, CASE WHEN k <= 2 THEN k || '. ' || o_orderpriority ELSE 'Others' END AS top FROM orders JOIN r USING (o_orderpriority)),
m AS (SELECT top, quantile_cont(o_totalprice, [0.5]) AS t FROM a GROUP BY 1)
SELECT o_orderkey, top, CASE WHEN o_totalprice < t[1] THEN '1. [0%, 50%)' ELSE '2. [50%, 100%]' END AS half, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY top, CASE WHEN o_totalprice < t[1] THEN 1 ELSE 2 END), 8) AS share FROM a JOIN m USING (top)""")
def dim_chain_left_context(spark, folder):
    df = table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    chain = [("top", "topnames(o_orderpriority, o_totalprice, 2)"), ("half", "quantiles(o_totalprice, [.5])"), ("share", "o_totalprice / sum(o_totalprice)")]
    return dim(df, chain).select("o_orderkey", "top", "half", F.round("share", 8).alias("share"))


# -- aggregations


@query("agg_default_hints", """
SELECT o_orderstatus, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS o_orderpriority, sum(o_custkey)::BIGINT AS o_custkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1""")
def agg_default_hints(spark, folder):
    out = agg(table(spark, folder, "orders", "o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice"), "o_orderstatus")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("agg_type_hints", "SELECT c_mktsegment, max(c_nationkey) AS c_nationkey, round(avg(c_acctbal), 4) AS c_acctbal, count(DISTINCT c_name) AS c_name FROM customer GROUP BY 1")
def agg_type_hints(spark, folder):
    h = hints({"c_name": "countuniq", "type:Integer": "maximum", "type:Real": "mean(_)"})
    out = agg(table(spark, folder, "customer", "c_mktsegment", "c_nationkey", "c_acctbal", "c_name"), "c_mktsegment", hints=h)
    return out.withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("agg_named_measures", "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS avg_q, max(l_quantity) AS max_q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem GROUP BY 1, 2")
def agg_named_measures(spark, folder):
    df = table(spark, folder, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")
    out = agg(df, ["l_returnflag", "l_linestatus"], cols=[("l_quantity", "mean", "avg_q"), ("l_quantity", "maximum", "max_q"), ("l_extendedprice", "sum(_ * (1 - l_discount))", "net")])
    return out.withColumns({"avg_q": F.round("avg_q", 6), "net": F.round("net", 2)})


@query("agg_allbut", "SELECT o_orderpriority, sum(o_custkey)::BIGINT AS o_custkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def agg_allbut(spark, folder):
    out = agg(table(spark, folder, "orders"), ["o_orderpriority"], allbut=["o_orderkey", "o_orderstatus", "o_orderdate"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("agg_distinct_keys", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def agg_distinct_keys(spark, folder):
    return agg(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], cols=[])


@query("agg_reductions", """
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS s, round(avg(l_extendedprice), 4) AS m, quantile_cont(l_quantity, 0.5) AS md, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS v, round(quantile_cont(l_extendedprice, 0.9), 4) AS q9,
  min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_tax) AS elo, max(l_tax) AS ehi, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS c, bool_or(l_tax > 0.07) AS a, bool_and(l_quantity > 0) AS b, round(product(1 + l_tax / 1000000), 8) AS p
FROM lineitem GROUP BY 1, 2""")
def agg_reductions(spark, folder):
    x, q, t, d = "l_extendedprice", "l_quantity", "l_tax", "l_discount"
    cols = [(x, "sum", "s"), (x, "mean", "m"), (q, "median", "md"), (q, "std", "sd"), (q, "var", "v"), (x, "quantile(_, 0.9)", "q9"), (q, "minimum", "lo"), (q, "maximum", "hi"), (t, "extrema", "e"), (x, "nrow", "n"), (d, "count(_ > 0.05)", "c"), (t, "any(_ > 0.07)", "a"), (q, "all(_ > 0)", "b"), (t, "prod(1 + _ / 1000000)", "p")]
    out = agg(table(spark, folder, "lineitem", "l_returnflag", "l_linestatus", x, q, t, d), ["l_returnflag", "l_linestatus"], cols=cols)
    digits = {"s": 2, "m": 4, "sd": 6, "v": 6, "q9": 4, "p": 8}
    return out.select("l_returnflag", "l_linestatus", *(F.round(n, k).alias(n) for n, k in digits.items()), "md", "lo", "hi", F.col("e.min").alias("elo"), F.col("e.max").alias("ehi"), "n", "c", "a", "b")


@query("agg_first_last_orderby", """
SELECT o_custkey, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS f, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS l, first(o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS top FROM orders GROUP BY 1""")
def agg_first_last_orderby(spark, folder):
    df = table(spark, folder, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    return agg(df, "o_custkey", cols=[("o_totalprice", "first(_) |> orderby(o_orderdate, o_orderkey)", "f"), ("o_totalprice", "last(_) |> orderby(o_orderdate, o_orderkey)", "l"), ("o_orderpriority", "first(_) |> orderby(o_totalprice => :desc, o_orderkey)", "top")])


@query("agg_uniqvalue_countuniq", """
SELECT n_regionkey, CASE WHEN count(DISTINCT n_name) = 1 THEN min(n_name) END AS u, count(DISTINCT n_name) AS k, count(DISTINCT left(n_name, 1)) > 1 AS mixed FROM nation GROUP BY 1""")
def agg_uniqvalue_countuniq(spark, folder):
    df = table(spark, folder, "nation").withColumn("letter", F.left("n_name", F.lit(1)))
    return agg(df, "n_regionkey", cols=[("n_name", "uniqvalue", "u"), ("n_name", "countuniq", "k"), ("letter", "countuniq(_) > 1", "mixed")])


@query("agg_strjoinuniq", "SELECT n_regionkey, CASE WHEN length(s) > 40 THEN left(s, 39) || '…' ELSE s END AS names FROM (SELECT n_regionkey, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS s FROM nation GROUP BY 1)")
def agg_strjoinuniq(spark, folder):
    return agg(table(spark, folder, "nation"), "n_regionkey", cols=[("n_name", 'strjoinuniq(_, "; ", 40)', "names")])


@query("agg_unionall", "SELECT lang, array_to_string(list_sort(list_distinct(flatten(list(string_split(source, 'c'))))), ',') AS parts FROM documents GROUP BY 1")
def agg_unionall(spark, folder):
    df = table(spark, folder, "documents", "lang", "source").select("lang", F.split("source", "c").alias("parts"))
    return agg(df, "lang").withColumn("parts", F.array_join("parts", ","))


@query("agg_isuniform_onlyif", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN round(sum(o_totalprice), 2) END AS x FROM orders GROUP BY 1")
def agg_isuniform_onlyif(spark, folder):
    out = agg(table(spark, folder, "orders", "o_custkey", "o_orderstatus", "o_totalprice"), "o_custkey", cols=[("o_totalprice", "onlyif(isuniform(o_orderstatus), sum(_))", "x")])
    return out.withColumn("x", F.round("x", 2))


@query("agg_wmean", "SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS w FROM lineitem GROUP BY 1")
def agg_wmean(spark, folder):
    out = agg(table(spark, folder, "lineitem", "l_suppkey", "l_extendedprice", "l_quantity"), "l_suppkey", cols=[("l_extendedprice", "sum(_ * l_quantity) / sum(l_quantity)", "w")])
    return out.withColumn("w", F.round("w", 4))


@query("agg_wmeanfallback", """
SELECT l_suppkey, l_linenumber, round(CASE WHEN sum(l_discount) <> 0 THEN sum(l_extendedprice * l_discount) / sum(l_discount) WHEN sum(l_tax) <> 0 THEN sum(l_extendedprice * l_tax) / sum(l_tax) ELSE avg(l_extendedprice) END, 4) AS w FROM lineitem GROUP BY 1, 2""")
def agg_wmeanfallback(spark, folder):
    df = table(spark, folder, "lineitem", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return agg(df, ["l_suppkey", "l_linenumber"], cols=[("l_extendedprice", "wmeanfallback(_, [l_discount, l_tax, 1])", "w")]).withColumn("w", F.round("w", 4))


@query("agg_hhi", "SELECT o_orderstatus, round(10000 * sum(o_totalprice * o_totalprice) / pow(sum(o_totalprice), 2), 8) AS h FROM orders GROUP BY 1")
def agg_hhi(spark, folder):
    return agg(table(spark, folder, "orders", "o_orderstatus", "o_totalprice"), "o_orderstatus", cols=[("o_totalprice", "hhi(_, scale = 10000)", "h")]).withColumn("h", F.round("h", 8))


@query("agg_hhi_composite", "WITH g AS (SELECT l_returnflag, l_suppkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, round(sum(s * s) / pow(sum(s), 2), 8) AS h FROM g GROUP BY 1")
def agg_hhi_composite(spark, folder):
    return agg(table(spark, folder, "lineitem", "l_returnflag", "l_suppkey", "l_extendedprice"), "l_returnflag", cols=[("l_extendedprice", "hhi(sum(_) |> groupby(l_suppkey))", "h")]).withColumn("h", F.round("h", 8))


@query("agg_composite", """
WITH g AS (SELECT o_orderpriority, year(o_orderdate) AS y, sum(o_totalprice) AS s FROM orders GROUP BY ALL),
c AS (SELECT o_orderpriority, year(o_orderdate) AS y, o_orderstatus, sum(o_totalprice) AS s FROM orders GROUP BY ALL), d AS (SELECT o_orderpriority, y, avg(s) AS m FROM c GROUP BY ALL), e AS (SELECT o_orderpriority, max(m) AS dd FROM d GROUP BY 1)
SELECT o_orderpriority, round(avg(s), 2) AS m, round(max(s), 2) AS hi, round(last(s ORDER BY y), 2) AS l, round(stddev_samp(s), 2) AS sd, count(*) AS n, round(min(dd), 2) AS dd FROM g JOIN e USING (o_orderpriority) GROUP BY 1""")
def agg_composite(spark, folder):
    x, y = "o_totalprice", "sum(_) |> groupby(yyyy(o_orderdate))"
    cols = [(x, f"mean({y})", "m"), (x, f"maximum({y})", "hi"), (x, f"last({y})", "l"), (x, f"std({y})", "sd"), (x, f"length({y})", "n"), (x, "maximum(mean(sum(_) |> groupby(o_orderstatus)) |> groupby(yyyy(o_orderdate)))", "dd")]
    out = agg(table(spark, folder, "orders", "o_orderpriority", "o_orderstatus", "o_orderdate", x), "o_orderpriority", cols=cols)
    return out.select("o_orderpriority", *(F.round(n, 2).alias(n) for n in ("m", "hi", "l", "sd", "dd")), "n")


@query("agg_nested_reduction", "SELECT o_orderstatus, round(sum(pow(o_totalprice / t, 2)), 8) AS h FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_orderstatus) AS t FROM orders) GROUP BY 1")
def agg_nested_reduction(spark, folder):
    return agg(table(spark, folder, "orders", "o_orderstatus", "o_totalprice"), "o_orderstatus", cols=[("o_totalprice", "sum((_ / sum(_))^2)", "h")]).withColumn("h", F.round("h", 8))


@query("agg_skipmissing", """
WITH l AS (SELECT o_custkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)
SELECT o_custkey, CASE WHEN count(*) = count(prev) THEN round(sum(prev), 2) END AS strict, round(coalesce(sum(prev), 0), 2) AS skipped, max(prev) AS hi FROM l GROUP BY 1""")
def agg_skipmissing(spark, folder):
    df = dim(table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), ["o_custkey", ("prev", "lag(o_totalprice) |> orderby(o_orderdate, o_orderkey)")])
    out = agg(df, "o_custkey", cols=[("prev", "sum", "strict"), ("prev", "sum(skipmissing(_))", "skipped"), ("prev", "maximum(skipmissing(_))", "hi")])
    return out.withColumns({"strict": F.round("strict", 2), "skipped": F.round("skipped", 2)})


@query("agg_price_quartiles", f"""
WITH g AS (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS t FROM lineitem GROUP BY 1), a AS (SELECT lineitem.*, {_QUARTERS.format(x='l_extendedprice')} AS q FROM lineitem JOIN g USING (l_returnflag))
SELECT l_returnflag, q, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS qty, count(*) AS n FROM a GROUP BY 1, 2""")
def agg_price_quartiles(spark, folder):
    """The flagship: price quartiles within each return flag, and their totals."""
    df = table(spark, folder, "lineitem", "l_returnflag", "l_extendedprice", "l_quantity")
    out = agg(df, ["l_returnflag", ("q", "quantiles(l_extendedprice, ngroups = 4)")], cols=[("l_extendedprice", "sum", "total"), ("l_quantity", "mean", "qty"), ("l_quantity", "length(_)", "n")])
    return out.withColumns({"total": F.round("total", 2), "qty": F.round("qty", 6)})


@query("transform_pipeline", """
WITH a AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS r FROM orders) SELECT o_orderpriority, CASE WHEN r <= 10 THEN 'top' ELSE 'rest' END AS place, round(sum(o_totalprice), 2) AS total FROM a GROUP BY 1, 2""")
def transform_pipeline(spark, folder):
    df = table(spark, folder, "orders", "o_orderpriority", "o_totalprice")
    ranked = dims(["o_orderpriority", ("r", "rank(o_totalprice, rev = true)")])
    labelled = dims(("place", 'where(r <= 10, true_label = "top", false_label = "rest")'))
    out = df.transform(aggs(["o_orderpriority", "place"], cols=[("o_totalprice", "sum", "total")]) @ labelled @ ranked)
    return out.withColumn("total", F.round("total", 2))


# -- further forms

simple("dim_replace", "orders", "o_orderkey o_orderstatus o_totalprice", ["o_orderstatus", ("o_totalprice", "o_totalprice - minimum(o_totalprice)")], "o_orderkey o_totalprice",
       "SELECT o_orderkey, round(o_totalprice - min(o_totalprice) OVER (PARTITION BY o_orderstatus), 4) AS o_totalprice FROM orders", 4, replace=True)
simple("dim_dotted_juxtaposed", "lineitem", "l_orderkey l_linenumber l_quantity l_discount l_extendedprice", ("x", "2l_quantity .+ l_extendedprice .* (1 .- l_discount)"), "l_orderkey l_linenumber x",
       "SELECT l_orderkey, l_linenumber, round(2 * l_quantity + l_extendedprice * (1 - l_discount), 4) AS x FROM lineitem", 4)
simple("dim_countuniq_of_all", "orders", "o_orderkey o_custkey", ("k", "countuniq(o_custkey)"), "o_orderkey k",
       "SELECT o_orderkey, (SELECT count(DISTINCT o_custkey) FROM orders) AS k FROM orders")
simple("dim_in_group", "lineitem", "l_orderkey l_linenumber l_suppkey l_partkey l_returnflag", ["l_returnflag", ("hit", "l_suppkey in l_partkey")], "l_orderkey l_linenumber hit",
       "SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem) p WHERE p.l_returnflag = l.l_returnflag AND p.l_partkey = l.l_suppkey) AS hit FROM lineitem l")
simple("dim_discretize_moving_labels", "customer", "c_custkey c_mktsegment c_acctbal", ["c_mktsegment", ("d", 'discretize(c_acctbal, [0, mean(c_acctbal)], label = "Balance", reverse = true, precision = 1, commas = true)')], "c_custkey d", """
WITH a AS (SELECT *, format('{:,.1f}', round(avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 1)) AS m, avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS mean FROM customer)
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '3. Balance < 0.0' WHEN c_acctbal < mean THEN '2. 0.0 ≤ Balance < ' || m ELSE '1. ' || m || ' ≤ Balance' END AS d FROM a""")
simple("dim_discretize_moving_buckets", "customer", "c_custkey c_nationkey c_acctbal", ["c_nationkey", ("d", 'discretize(c_acctbal, [median(c_acctbal), maximum(c_acctbal)], bucketstrs = ["low", "high"], boundedness = :boundedabove)')], "c_custkey d",
       "SELECT c_custkey, CASE WHEN c_acctbal < quantile_cont(c_acctbal, 0.5) OVER (PARTITION BY c_nationkey) THEN 'low' ELSE 'high' END AS d FROM customer")
simple("dim_integer_power", "nation", "n_nationkey n_regionkey", ["n_regionkey", ("p", "n_nationkey^11 + cumprod(n_nationkey + 1) |> orderby(n_nationkey)")], "n_nationkey p",
       "SELECT n_nationkey, (CAST(n_nationkey AS HUGEINT) ** 11)::BIGINT + product(n_nationkey + 1) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING)::BIGINT AS p FROM nation")
simple("dim_sigdigits", "orders", "o_orderkey o_totalprice", ("r", "round(o_totalprice, sigdigits = 3, ties = :away)"), "o_orderkey r",
       "SELECT o_orderkey, round(o_totalprice / pow(10, floor(log10(o_totalprice)) - 2)) * pow(10, floor(log10(o_totalprice)) - 2) AS r FROM orders")


@query("agg_integer_product", "SELECT n_regionkey, product(n_nationkey + 1)::BIGINT AS p, (product(2 * n_nationkey - 7))::BIGINT AS q FROM nation GROUP BY 1")
def agg_integer_product(spark, folder):
    return agg(table(spark, folder, "nation", "n_nationkey", "n_regionkey"), "n_regionkey", cols=[("n_nationkey", "prod(_ + 1)", "p"), ("n_nationkey", "prod(2_ - 7)", "q")])


@query("describe_column", """
SELECT 'double' AS type, count(*) AS rows, count(*) - count(c_acctbal) AS missing, count(DISTINCT c_acctbal) AS distincts, min(c_acctbal) AS minimum, max(c_acctbal) AS maximum, round(avg(c_acctbal), 6) AS mean, round(quantile_cont(c_acctbal, 0.5), 4) AS mid FROM customer""")
def describe_column(spark, folder):
    out = describe(table(spark, folder, "customer", "c_acctbal"), "c_acctbal")
    return out.select("type", "rows", "missing", F.col("distinct").alias("distincts"), "minimum", "maximum", F.round("mean", 6).alias("mean"), F.round(F.col("quartiles")[1], 4).alias("mid"))


# -- host operators


def _host_ops() -> None:
    register_op("geomean", lambda x: F.exp(F.avg(F.log(x))), "reduce", 1, 1, ())
    register_op("hilo", lambda x, window: F.when(x > F.lag(x).over(window), "up").when(x < F.lag(x).over(window), "down"), "map", 1, 1, ())
    register_op("tophalf", lambda name, x, window: F.when(F.percent_rank().over(Window.partitionBy(F.lit(1)).orderBy(x.desc())) < 0.5, "top half").otherwise("bottom half"), "map", 2, 2, ())
    register_classifier("tophalf", 0)


@query("host_op_reduce", "SELECT o_orderstatus, round(exp(avg(ln(o_totalprice))), 4) AS g FROM orders GROUP BY 1")
def host_op_reduce(spark, folder):
    _host_ops()
    return agg(table(spark, folder, "orders", "o_orderstatus", "o_totalprice"), "o_orderstatus", cols=[("o_totalprice", "geomean", "g")]).withColumn("g", F.round("g", 4))


@query("host_op_map", """
WITH l AS (SELECT o_orderkey, o_totalprice AS x, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) SELECT o_orderkey, CASE WHEN x > p THEN 'up' WHEN x < p THEN 'down' END AS way FROM l""")
def host_op_map(spark, folder):
    _host_ops()
    df = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return dim(df, ["o_custkey", ("way", "hilo(o_totalprice) |> orderby(o_orderdate, o_orderkey)")]).select("o_orderkey", "way")


@query("host_classifier", """
WITH g AS (SELECT o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY 1), r AS (SELECT *, percent_rank() OVER (ORDER BY s DESC) AS p FROM g) SELECT o_orderkey, CASE WHEN p < 0.5 THEN 'top half' ELSE 'bottom half' END AS half FROM orders JOIN r USING (o_orderpriority)""")
def host_classifier(spark, folder):
    _host_ops()
    return dim(table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_totalprice"), ("half", "tophalf(o_orderpriority, o_totalprice)")).select("o_orderkey", "half")


@query("host_trusted", "SELECT c_mktsegment, round(avg(c_acctbal) FILTER (c_acctbal > 0), 4) AS pos, round(kurtosis_pop(c_acctbal), 6) AS kurt FROM customer GROUP BY 1")
def host_trusted(spark, folder):
    cols = [("c_acctbal", lambda x: F.avg(F.when(x > 0, x)), "pos"), ("c_acctbal", trusted("kurtosis(c_acctbal)"), "kurt")]
    out = agg(table(spark, folder, "customer", "c_mktsegment", "c_acctbal"), "c_mktsegment", cols=cols)
    return out.withColumns({"pos": F.round("pos", 4), "kurt": F.round("kurt", 6)})
