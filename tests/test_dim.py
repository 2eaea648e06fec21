import math
import random

import pytest
from pyspark.sql import functions as F

from stratachain import SpecError, agg, dim, dimspec, hints, parse_dim

from .frames import district, numbered, values

CASES = [
    (("x", "topnames(District, TestScr, 2)"), ["Others", "Others", "1. d2", "Others", "2. d4", "Others"]),
    (["County", ("x", "topnames(District, TestScr, 2)")], ["2. d1", "2. d1", "1. d2", "2. d3", "1. d4", "2. d5"]),
    (["County", ("x", "topnames(District, TestScr, 1)")], ["Others", "Others", "1. d2", "Others", "1. d4", "Others"]),
    (("x", "discretize(EnrlTot, [35, 60]) |> groupby(District)"), ["3. 60+", "3. 60+", "2. 35…59", "1. ≤34", "3. 60+", "1. ≤34"]),
    (("x", "quantiles(TestScr, [.25,.5,.75]) |> groupby(District)"), ["3. [50%, 75%)", "3. [50%, 75%)", "4. [75%, 100%]", "3. [50%, 75%)", "4. [75%, 100%]", "1. [0%, 25%)"]),
    (["County", ("x", "quantiles(TestScr, [.5])")], ["1. [0%, 50%)", "1. [0%, 50%)", "2. [50%, 100%]", "2. [50%, 100%]", "2. [50%, 100%]", "1. [0%, 50%)"]),
    (["County", ("x", "where(TestScr > 35) |> groupby(District)")], ["Not TestScr > 35", "Not TestScr > 35", "TestScr > 35", "Not TestScr > 35", "TestScr > 35", "Not TestScr > 35"]),
    (["County", ("x", "rank(TestScr, rev = true)")], [4, 3, 1, 2, 1, 2]),
    (["County", ("x", "ordinalrank(EnrlTot)")], [3, 4, 2, 1, 2, 1]),
    (["County", ("x", "ordinalrank(EnrlTot) |> orderby(TestScr => :desc)")], [4, 3, 2, 1, 2, 1]),
    (["County", ("x", "cumsum(TestScr) |> orderby(EnrlTot)")], [90, 110, 80, 30, 50, 10]),
    (["County", ("x", "lag(TestScr) |> orderby(EnrlTot)")], [50, 10, 30, None, 10, None]),
    (["County", ("x", "cumsum(TestScr) |> groupby(District) |> orderby(TestScr => :desc)")], [80, 80, 50, 110, 40, 50]),
    (["County", ("x", "cumsum(TestScr) |> orderby(TestScr => :desc) |> groupby(District)")], [80, 80, 50, 110, 40, 50]),
    (["County", ("x", "length(sum(TestScr) |> groupby(District))")], [3, 3, 3, 3, 2, 2]),
    (("x", "length(TestScr)"), [6] * 6),
    (("x", "TestScr == maximum(TestScr)"), [False, False, True, False, False, False]),
    (("x", "District in [\"d1\", \"d5\"]"), [True, True, False, False, False, True]),
]


@pytest.mark.parametrize("chain,want", CASES, ids=lambda c: str(c)[:60])
def test_district(spark, chain, want):
    assert values(dim(district(spark), chain)) == want


def test_classifier_over_classifier(spark):
    out = dim(district(spark), ("ctop", "topnames(County, TestScr, 2)"), ("x", "topnames(ctop, TestScr, 1)"))
    assert values(out) == ["1. 1. C1"] * 4 + ["Others"] * 2
    assert out.columns == ["i", "County", "District", "TestScr", "EnrlTot", "ctop", "x"]


V = [
    ("rank(x)", [10, 20, 20, 30], [1, 2, 2, 4]),
    ("rank(x, rev = true)", [10, 20, 20, 30], [4, 2, 2, 1]),
    ("denserank(x)", [10, 20, 20, 30], [1, 2, 2, 3]),
    ("ordinalrank(x, rev = true)", [10, 20, 20, 30], [4, 2, 3, 1]),
    ("tiedrank(x)", [10, 20, 20, 30], [1, 2.5, 2.5, 4]),
    ("tiedrank(x)", [10, None, 20, 20], [1, None, 2.5, 2.5]),
    ("rank(x)", [10, None, 20, 20], [1, None, 2, 2]),
    ("ordinalrank(x)", [10, None, 20, 20], [1, None, 2, 3]),
    ("lag(x)", [1, 2, 3], [None, 1, 2]),
    ("lead(x)", [1, 2, 3], [2, 3, None]),
    ("lag(x, -1)", [1, 2, 3], [2, 3, None]),
    ("lag(x, 2, default = 0)", [1, 2, 3], [0, 0, 1]),
    ("lag(x, default = 9)", [None, 2, 3], [9, None, 2]),
    ("cumsum(x)", [1, 2, None, 3], [1, 3, None, None]),
    ("cumprod(x)", [1, 2, 3], [1, 2, 6]),
    ("discretize(x, [0,1,2,3])", [1, 2, 3, None], ["3. 1", "4. 2", "5. 3+", None]),
    ("sum(x)", [1, None, 2], [None] * 3),
    ("sum(skipmissing(x))", [1, None, 2], [3] * 3),
    ("coalesce(x, 0)", [1, None], [1, 0]),
    ("ismissing(x)", [1, None], [False, True]),
    ("x > 1", [2, None], [True, None]),
    ("x in [1, 2]", [1, 3, None], [True, False, None]),
    ("x ∉ [1, 2]", [1, 3, None], [False, True, None]),
    ("max(x, 2)", [1, 3, None], [2, 3, None]),
    ("where(x > 1, true_label = \"big\", false_label = \"small\")", [1, 2, None], ["small", "big", None]),
    ("onlyif(x > 1, x)", [1, 2, None], [None, 2, None]),
    ("x / 0", [1, -1], [math.inf, -math.inf]),
    ("-x^2 + 2x", [3], [-3]),
    ("round(x / 2)", [1, 3, 5], [0.0, 2.0, 2.0]),
    ("any(x > 2)", [1, 2, None], [None] * 3),
    ("any(x > 1)", [1, 2, None], [True] * 3),
    ("all(x > 1)", [1, 2, None], [False] * 3),
    ("all(x > 0)", [1, 2, None], [None] * 3),
    ("isuniform(x)", [1, 1, None], [False] * 3),
    ("countuniq(x, skipna = false)", [1, 1, None], [2] * 3),
    ("uniqvalue(x)", [1, 1, None], [1] * 3),
    ("uniqvalue(x, skipna = false)", [1, 1, None], [None] * 3),
    ("hhi(x)", [50, 30, 20], [0.38] * 3),
    ("hhi(x)", [-1, 2], [None] * 2),
    ("x .+ 1", [1], [2]),
    ("first(x)", [3, 1, 2], [3] * 3),
    ("last(skipmissing(x))", [3, 1, None], [1] * 3),
    ("log(x)", [1, 0], [0.0, -math.inf]),
]


@pytest.mark.parametrize("spec,xs,want", V, ids=lambda v: str(v)[:40])
def test_vectors(spark, spec, xs, want):
    got = values(dim(numbered(spark, [(x,) for x in xs], "x long"), ("y", spec)), "y")
    assert got == pytest.approx(want) if all(isinstance(w, float) for w in want) else got == want


def test_real_intervals(spark):
    df = numbered(spark, [(x,) for x in (-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0)], "x double")
    run = lambda s: values(dim(df, ("y", s)), "y")
    assert run("discretize(x, [0,1,2])") == ["1. <0", "2. [0,1)", "2. [0,1)", "3. [1,2)", "3. [1,2)", "4. ≥2", "4. ≥2"]
    assert run("discretize(x, [2,1,0], boundedness = :bounded)") == [None, "1. [0,1)", "1. [0,1)", "2. [1,2]", "2. [1,2]", "2. [1,2]", None]
    assert run("discretize(x, [0,1,2], boundedness = :boundedbelow)") == [None, "1. [0,1)", "1. [0,1)", "2. [1,2)", "2. [1,2)", "3. ≥2", "3. ≥2"]
    assert run("discretize(x, [0,1,2], boundedness = :boundedabove)") == ["1. <0", "2. [0,1)", "2. [0,1)", "3. [1,2]", "3. [1,2]", "3. [1,2]", None]
    assert run("discretize(x, [0,1,2], boundedness = :bounded, leftequal = false)") == [None, "1. [0,1]", "1. [0,1]", "1. [0,1]", "2. (1,2]", "2. (1,2]", None]
    assert run('discretize(x, [1,2], label="x", absolute=true)') == ["2. 1 ≤ |x| < 2", "1. |x| < 1", "1. |x| < 1", "2. 1 ≤ |x| < 2", "2. 1 ≤ |x| < 2", "3. 2 ≤ |x|", "3. 2 ≤ |x|"]
    assert run("discretize(x, [0, minimum(x) + 2])") == ["1. <0", "2. [0,1)", "2. [0,1)", "3. ≥1", "3. ≥1", "3. ≥1", "3. ≥1"]


def test_topnames_ties_and_missing(spark):
    def run(scores, spec, names=("Alice", "Bob", "Jane", "Joe")):
        return values(dim(numbered(spark, list(zip(names, scores, strict=True)), "name string, score long"), ("x", spec)))

    assert run((7, 8, 9, 5), "topnames(name, score, 2)") == ["Others", "2. Bob", "1. Jane", "Others"]
    assert run((7, 9, 9, 5), "topnames(name, score, 2)") == ["2. Alice", "1. Bob", "1. Jane", "Others"]
    assert run((7, 9, 9, 5), "topnames(name, score, 2, dense=false)") == ["Others", "1. Bob", "1. Jane", "Others"]
    assert run((7, 8, -9, 5), "topnames(name, score, 2, absolute=true)") == ["Others", "1. Bob", "2. Jane", "Others"]
    assert run((7, 8, -9, 5), "topnames(name, score, 2, absolute=true, parens=true)") == ["Others", "1. Bob", "2. (Jane)", "Others"]
    assert run((7, None, 9, 5), "topnames(name, score, 2)") == ["2. Alice", "Others", "1. Jane", "Others"]
    assert run((7, None, -9, 5), "topnames(name, score, 2, absolute=true, tol=1)") == ["1. Alice", "Others", "2. Jane", "Others"]
    assert run((7, 8, 9, 5), "topnames(name, score, 2)", ("Alice", None, "Jane", "Joe")) == ["2. Alice", "Others", "1. Jane", "Others"]


def test_missing_keys_are_a_group(spark):
    df = numbered(spark, [("a", 1.0), (None, 2.0), ("a", 3.0), (None, 4.0)], "g string, v double")
    assert values(dim(df, ["g", ("x", "sum(v)")])) == [4, 6, 4, 6]
    assert values(dim(df, ("x", "rank(v) |> groupby(g)"))) == [1, 2, 1, 2]


def test_dates(spark):
    rows = [("2024-01-01", 10.0), ("2024-01-01", 20.0), ("2024-02-01", 5.0), ("2024-02-01", 15.0), ("2024-03-01", 100.0)]
    df = numbered(spark, rows, "d string, sales double").withColumn("date", F.to_date("d"))
    assert values(dim(df, ("x", "cumsum(sales) |> groupby(yyyymm(date)) |> orderby(sales => :desc)"))) == [130, 130, 150, 150, 100]
    assert values(dim(df, ("x", 'yyyymm(date, "/")')))[0] == "2024/01"


def test_topnames_of_a_computed_key(spark):
    rows = [("2024-01-01", 10.0), ("2024-02-01", 5.0), ("2024-02-05", 15.0)]
    df = numbered(spark, rows, "d string, sales double").withColumn("date", F.to_date("d"))
    assert values(dim(df, ("x", "topnames(yyyymm(date), sales, 1)"))) == ["Others", "1. 202402", "1. 202402"]


def test_collisions_and_contexts(spark):
    df = district(spark)
    with pytest.raises(ValueError, match="already has"):
        dim(df, ("EnrlTot", "sum(TestScr)"))
    assert values(dim(df, ("EnrlTot", "sum(TestScr)"), replace=True), "EnrlTot") == [160.0] * 6
    with pytest.raises(SpecError, match="did you mean 'TestScr'"):
        dim(df, ("x", "sum(TestScore)"))
    with pytest.raises(SpecError) as e:
        dim(df, ["Nope", ("x", "sum(TestScr)")])
    assert e.value.code == "unknown_column"
    with pytest.raises(ValueError, match="declares no dimension"):
        dim(df, ["County"])
    with pytest.raises(ValueError, match="twice"):
        dim(df, ["County", "County", ("x", "sum(TestScr)")])


def test_rows_and_columns_stay(spark):
    df = district(spark)
    out = dim(df, ["County", ("a", "topnames(District, TestScr, 1)"), ("b", "cumsum(TestScr) |> orderby(i)")])
    assert out.drop("a", "b").exceptAll(df).count() == 0 and out.count() == df.count()
    assert out.columns == [*df.columns, "a", "b"]


def test_host_dimensions(spark):
    df = district(spark)
    assert values(dim(df, ["County", ("x", lambda w: F.sum("TestScr").over(w))])) == [110] * 4 + [50] * 2
    made = dimspec("cumsum(TestScr)", by="District", order=["TestScr => :desc"])
    assert values(dim(df, ["County", ("x", made)])) == [80, 80, 50, 110, 40, 50]
    with pytest.raises(SpecError, match="twice"):
        dimspec("cumsum(TestScr) |> orderby(i)", order="i")


def test_decomposition(spark):
    """agg of a chain is dim of its dimensions, then a plain reduction."""
    rng = random.Random(5)
    df = numbered(spark, [(rng.choice("abc"), rng.choice("xy"), float(rng.randrange(50))) for _ in range(60)], "g string, h string, v double")
    chain = ["g", ("q", "quantiles(v, ngroups = 3)"), ("t", "topnames(h, v, 1)")]
    left = agg(df, chain, cols=[("v", "sum", "s")])
    right = dim(df, chain).groupBy("g", "q", "t").agg(F.sum("v").alias("s"))
    assert sorted(left.collect()) == sorted(right.collect())


def test_value_ranks_do_not_depend_on_row_order(spark):
    rng = random.Random(1)
    xs = [rng.randrange(8) for _ in range(40)]
    for spec in ("rank(x)", "denserank(x)", "tiedrank(x)"):
        ranks = []
        for order in (xs, xs[::-1]):
            out = dim(numbered(spark, [(x,) for x in order], "x long"), ("r", spec))
            ranks.append(sorted((r.x, r.r) for r in out.collect()))
        assert ranks[0] == ranks[1]
    assert sum(r for _, r in ranks[0]) == 40 * 41 / 2


def test_plan_of_a_window_dimension_prunes_columns(spark, tmp_path):
    district(spark).write.parquet(str(tmp_path / "d"))
    out = dim(spark.read.parquet(str(tmp_path / "d")), ["County", ("x", "sum(TestScr)")]).select("County", "x")
    plan = out._jdf.queryExecution().toString()
    assert "ReadSchema: struct<County:string,TestScr:double>" in plan and plan.count("Exchange hashpartitioning") <= 2


def test_pivot_uses_hints(spark):
    df = district(spark)
    out = dim(df, ("x", "rank(EnrlTot) |> groupby(County)"), hints=hints({"EnrlTot": "maximum"}))
    assert values(out) == [2, 2, 2, 2, 1, 1]
    assert parse_dim("rank(EnrlTot) |> groupby(County)").kind == "pivot"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_computed_contexts_have_no_task_of_their_own(spark):
    import re

    odd = {"a": [1.0, 2.0, 3.0, 4.0], "b": [math.nan, math.inf, -math.inf, 0.0, -0.0, None, 5.5], "c": [None, None], "d": [7.0] * 9 + [8.0], None: [(-1) ** k * 10.0 ** (5 * k % 600 - 300) for k in range(120)]}
    odd |= {"e": [1e6 + k % 97 * 1e-9 for k in range(300)] + [1e6 + 900.0], "f": [5e-324, 1e-323, 1.7976931348623157e308], "g": [math.nan] * 3, "h": [float(k * k % 11) for k in range(200)]}
    rows = [(g, v) for g, values in odd.items() for v in values]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, g string, x double").repartition(3).cache()
    key = ("t", 'coalesce(g, "none")')
    levels = "[.1, .5, .99]"
    got = dim(df, [key, ("h", f"quantiles(x, {levels})")])
    plain = dim(df.withColumn("t", F.coalesce("g", F.lit("none"))), ["t", ("h", f"quantiles(x, {levels})")])
    assert "percentile" not in plan(got) and "percentile" in plan(plain)
    assert {r.i: r.h for r in got.collect()} == {r.i: r.h for r in plain.collect()}
    own = dim(df, [key, ("q", f"quantile(skipmissing(x), {levels})")]).select("t", "q").distinct()
    want = df.groupBy(F.coalesce("g", F.lit("none")).alias("t")).agg(F.percentile("x", F.array(*map(F.lit, (0.1, 0.5, 0.99)))).alias("q"))
    text = lambda frame: {r.t: repr(r.q).replace("-0.0", "0.0") for r in frame.collect()}
    assert text(own) == text(want) and own.count() == len(odd)
    middle = dim(df, [key, ("m", "median(skipmissing(x))")]).where("t = 'a' or t = 'd'").select("t", "m").distinct()
    assert {r.t: r.m for r in middle.collect()} == {"a": 2.5, "d": 7.0}
    whole = dim(df, [key, ("s", "length(x) + maximum(skipmissing(x))")])
    assert "Window" not in plan(whole) and {r.s for r in whole.where("t = 'a'").collect()} == {8.0}
    chain = plan(dim(df, [("t", "topnames(g, i, 2)"), ("h", "quantiles(x, [.5])"), ("s", "sum(skipmissing(x))")]))
    assert "percentile" not in chain and not re.search(r"Window \[(sum|count)\(x", chain)


def test_contexts_that_depend_on_the_order_of_rows_stay_windows(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(9)], "i long, x double").coalesce(1)
    out = dim(df, [("t", "cumsum(x) |> orderby(i)"), ("m", "median(x)")])
    assert "Window" in plan(out) and "Join" not in plan(out)
    assert sum(r.m is not None for r in out.collect()) == 9
