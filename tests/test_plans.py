"""What plans look like, and the edges of keyed reductions, nested groups, membership and whole-number products."""

import math

import pytest

from pyspark.sql import functions as F

from stratachain import agg, aggs, describe, dim, dims, register_op, suggest
from stratachain.errors import SpecError
from stratachain.functions.registry import unregister
from stratachain.streaming.batches import each_batch
from stratachain.suggest import spec_templates

SCHEMA = "k string, d double, g int, x long, y double"
ROWS = [("a", 1.0, 1, 2, 0.5), ("a", float("nan"), 1, 3, 1.5), (None, float("nan"), 2, 5, None), (None, -0.0, None, 7, 2.5), ("b", 0.0, 1, None, 3.5), ("b", None, 2, 11, 4.5)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_x(df, name):
    return {r.x: r[name] for r in df.collect()}


def test_keyed_reductions_keep_missing_and_odd_keys(frame):
    out = dim(frame, ["k", ("n", "length(x)")], ["d", ("m", "length(x)")], ["k", ("s", "sum(skipmissing(x)) + sum(skipmissing(y))")])
    assert by_x(out, "n") == {2: 2, 3: 2, 5: 2, 7: 2, None: 2, 11: 2}
    assert by_x(out, "m") == {2: 1, 3: 2, 5: 2, 7: 2, None: 2, 11: 1}  # NaN is one key, so is zero of any sign, so is missing
    assert by_x(out, "s") == {2: 7.0, 3: 7.0, 5: 14.5, 7: 14.5, None: 19.0, 11: 19.0}
    assert len(out.collect()) == len(ROWS)


def test_keyed_reductions_aggregate_before_the_shuffle(frame):
    text = plan(dim(frame, ["k", ("z", "x / sum(x) - mean(y)")]))
    assert "Window" not in text and "HashAggregate" in text


def test_nested_groups_are_two_aggregations(frame):
    out = agg(frame, "k", cols=[("x", "maximum(sum(skipmissing(_)) |> groupby(g))", "hi"), ("x", "length(sum(_) |> groupby(g)) + 0", "n"), ("x", "last(sum(skipmissing(_)) |> groupby(g))", "l"), ("x", "maximum(cumsum(sum(skipmissing(_)) |> groupby(g)))", "c")])
    assert {r.k: (r.hi, r.n, r.l, r.c) for r in out.collect()} == {"a": (5, 1, 5, 5), None: (7, 2, 7, 12), "b": (11, 2, 11, 11)}
    assert "row_number" not in plan(agg(frame, "k", cols=[("x", "mean(sum(_) |> groupby(g))", "m")]))
    whole = dim(frame, ("m", "mean(sum(skipmissing(x)) |> groupby(k))"))
    assert {r.m for r in whole.collect()} == {(5 + 12 + 11) / 3}
    mixed = dim(frame, ["k", ("m", "maximum(sum(skipmissing(x)) |> groupby(g)) / sum(skipmissing(x))")])
    assert by_x(mixed, "m") == {2: 1.0, 3: 1.0, 5: 7 / 12, 7: 7 / 12, None: 1.0, 11: 1.0}


def test_membership_gathers_no_column(frame):
    out = dim(frame, ("a", "x in g"), ["k", ("b", "(x - 1) in g")], ("c", "x ∉ skipmissing(g)"))
    assert by_x(out, "a") == {2: True, 3: None, 5: None, 7: None, None: None, 11: None}
    assert by_x(out, "b") == {2: True, 3: False, 5: None, 7: None, None: None, 11: False}
    assert by_x(out, "c") == {2: False, 3: True, 5: True, 7: True, None: None, 11: True}
    text = plan(dim(frame, ("a", "x in g"), ("n", "countuniq(x)")))
    assert "collect_set" not in text


def test_whole_number_products(frame, spark):
    big = spark.createDataFrame([(2**31, 0), (2**31, 1), (5, 2)], "a long, i long")
    assert agg(big.where("i > 0"), [], cols=[("a", "prod", "p")]).first().p == 5 * 2**31
    with pytest.raises(Exception, match="beyond 2\\^53"):
        agg(big, [], cols=[("a", "prod", "p")]).collect()
    assert agg(big.union(spark.createDataFrame([(0, 3)], big.schema)), [], cols=[("a", "prod", "p")]).first().p == 0
    assert dim(big.where("i < 2"), ("p", "a^2 - 1")).first().p == 2**62 - 1
    assert dim(big.where("a = 5"), ("p", "a^27")).first().p == 5**27
    with pytest.raises(Exception, match="(?i)overflow"):
        dim(big, ("p", "a^3")).collect()
    assert [r.p for r in dim(big.where("a = 5"), ("p", "cumprod(a)")).collect()] == [5]


def test_rounding_to_significant_digits(spark):
    df = spark.createDataFrame([(1234.5,), (-0.0012345,), (0.0,), (float("inf"),), (None,)], "x double")
    got = [r.r for r in dim(df, ("r", "round(x, sigdigits = 2)")).collect()]
    assert got == [1200.0, -0.0012, 0.0, math.inf, None]
    assert [r.r for r in dim(df.limit(1), ("r", "floor(x, digits = 2, base = 2)")).collect()] == [1234.5]
    with pytest.raises(SpecError, match="mutually exclusive"):
        dim(df, ("r", "round(x, sigdigits = 2, digits = 1)"))


def test_computed_breaks_take_all_options(spark):
    df = spark.createDataFrame([(float(v),) for v in (-2500, 0, 10, 1000, 4000)], "x double")
    label = lambda spec: [r.d for r in dim(df, ("d", spec)).orderBy("x").collect()]
    for options in ('label = "L"', 'label = "L", reverse = true', "precision = 2, commas = true", "compact = false", "autoscale = :metric, parens = true", 'prefix = "US ", suffix = "!", rank = false', "scale = 0.001", "leftequal = false", "boundedness = :bounded", 'boundedness = :boundedbelow, label = "L"', "absolute = true", "stripzeros = false"):
        literal = label(f"discretize(x, [-2000.5, 10.0, 1000.0], {options})")
        computed = label(f"discretize(x, [minimum(x) + 499.5, 10.0, 1000.0 + 0 * mean(x)], {options})")
        assert literal == computed, options
    assert label('discretize(x, [0, mean(x)], bucketstrs = ["p", "q", "r"])') == ["p", "q", "q", "r", "r"]
    with pytest.raises(SpecError, match="3 labels"):
        label('discretize(x, [0, mean(x)], bucketstrs = ["p"])')
    with pytest.raises(SpecError, match="literal breaks"):
        label("discretize(x, [0, mean(x)], mixedfraction = true)")


def test_placeholder_after_a_number(frame):
    out = agg(frame.where("x is not null"), [], cols=[("x", "sum(2_ + 1_000)", "s")])
    assert out.first().s == 2 * 28 + 5000


def test_verbs_on_micro_batches(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([("a", k + 1), ("a", 3), ("b", 5)], "k string, x long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, x long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    both = aggs("k", cols=[("share", "maximum", "m")]) @ dims(["k", ("share", "x / sum(x)")])
    each_batch(stream, both, lambda df, number: got.append((number, {r.k: r.m for r in df.collect()}))).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert [n for n, _ in got] == [0, 1] and sorted(m["a"] for _, m in got) == [0.6, 0.75] and all(m["b"] == 1 for _, m in got)


def test_templates_run_on_the_frame(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1, None, [1]), (None, 2, 0.5, None)], "k string, x int, y double, odd array<int>")
    for target in ("k", "x", "y"):
        for t in spec_templates("aggr", df, target):
            agg(df, [], cols=[(target, t.spec, "v")]).collect()
        for t in spec_templates("dim", df, target):
            dim(df, ("v", t.spec)).collect()
    assert "sum(skipmissing(_))" in [t.spec for t in spec_templates("aggr", df, "y")] and spec_templates("dim", df)
    register_op("broken", lambda x: x + F.col("no_such_column"), "reduce", 1, 1, ())
    try:
        kept = suggest._running("aggr", df, "x", [suggest.Template("sum(_)", ""), suggest.Template("broken(_)", ""), suggest.Template("length(_)", "")])
    finally:
        unregister("broken")
    assert [t.spec for t in kept] == ["sum(_)", "length(_)"]


def test_plans_of_chains_grow_with_their_length(spark, tmp_path):
    spark.createDataFrame([(k % 3, k % 5, float(k)) for k in range(30)], "g int, h int, x double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    scans = lambda n: plan(dim(df, ["g", *((f"v{i}", f"x - mean(x) + {'0' if i == 0 else f'sum(v{i - 1})'}") for i in range(n))])).count("FileScan")
    one, two, four = scans(1), scans(2), scans(4)
    assert two <= one + 1 and four <= one + 3
    side = plan(dim(df, ["g", ("a", "mean(x)")], ["h", ("b", "mean(x)")], ["g", "h", ("c", "mean(x)")]))
    assert side.count("FileScan") == 4 and "Window" not in side


def test_replaced_columns_are_read_as_replaced(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, x double")
    out = dim(df, ("x", "x * 10"), ["k", ("s", "sum(x)")], replace=True)
    assert sorted(map(tuple, out.collect())) == [("a", 10.0, 40.0), ("a", 30.0, 40.0), ("b", 50.0, 50.0)]


def test_describe(frame):
    got = describe(frame, "x").first()
    assert (got.type, got["rows"], got.missing, got.distinct, got.minimum, got.maximum, got.mean, got.quartiles) == ("bigint", 6, 1, 5, 2, 11, 5.6, [3, 5, 7])
    assert describe(frame, "k").first().distinct == 2 and "mean" not in describe(frame, "k").columns


def test_ties_are_rounded_to_even_or_away(spark, tmp_path):
    df = spark.createDataFrame([(198500.0,), (-198500.0,), (9725.0,), (65450.5,), (2.5,), (None,)], "x double").coalesce(1)
    got = lambda options: [r.r for r in dim(df, ("r", f"round(x, {options})")).collect()]
    assert got("sigdigits = 3") == got("sigdigits = 3, ties = :even") == [198000.0, -198000.0, 9720.0, 65500.0, 2.5, None]
    assert got("sigdigits = 3, ties = :away") == [199000.0, -199000.0, 9730.0, 65500.0, 2.5, None]
    assert got("digits = 0, ties = :away")[4] == 3.0 and got("digits = 0")[4] == 2.0
    with pytest.raises(SpecError, match="ties"):
        dim(df, ("r", "round(x, ties = :up)"))
    with pytest.raises(SpecError, match="ties"):
        dim(df, ("r", "floor(x, ties = :away)"))


def test_query_of_significant_digits_rounds_ties_as_its_sql(spark, tmp_path):
    import duckdb

    from stratachain.queries import ORACLE_SQL, QUERIES

    path = f"{tmp_path}/orders.parquet"
    spark.createDataFrame([(1, 198500.0), (2, 65450.0), (3, 9725.0), (4, 1234.5)], "o_orderkey long, o_totalprice double").write.parquet(path)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{path}/*.parquet')")
        assert sorted(map(tuple, QUERIES["dim_sigdigits"](spark, str(tmp_path)).collect())) == sorted(db.sql(ORACLE_SQL["dim_sigdigits"]).fetchall())
