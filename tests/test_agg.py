import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratachain import SpecError, agg, aggs, clear_caches, default_aggr, dims, hints, list_ops, op_shape, register_classifier, register_op, trusted
from stratachain.functions import registry

from .frames import district, numbered


def one(df, key="g"):
    return {r[key]: tuple(v for k, v in r.asDict().items() if k != key) for r in df.collect()}


def test_topnames_chain(spark):
    out = agg(district(spark).drop("i"), ["County", ("t", "topnames(District, TestScr, 1)")])
    assert out.columns == ["County", "t", "District", "TestScr", "EnrlTot"]
    rows = {(r.County, r.t): (r.District, r.TestScr, r.EnrlTot) for r in out.collect()}
    assert rows["C1", "Others"] == (None, 60, 230) and len(rows) == 4


def test_hints(spark):
    rows = [("E", "ny", 1, 1.0, 10.0), ("E", "ny", 2, 3.0, 20.0), ("W", "sf", 3, 1.0, 30.0), ("W", "sf", 4, 1.0, 60.0), ("W", "sf", 5, 2.0, 30.0)]
    df = numbered(spark, rows, "region string, city string, qty long, wt double, score double").drop("i")
    assert one(agg(df, "region"), "region") == {"E": ("ny", 3, 4, 30), "W": ("sf", 12, 4, 120)}
    h = hints({"score": "sum(_ * wt) / sum(wt)", T.LongType: "maximum"}, default="length(_)")
    assert one(agg(df, "region", hints=h), "region") == {"E": (2, 2, 2, 17.5), "W": (3, 5, 3, 37.5)}
    named = agg(df, "region", cols=[("score", "mean", "m"), ("score", "maximum", "hi")])
    assert named.columns == ["region", "m", "hi"] and one(named, "region") == {"E": (15, 20), "W": (40, 60)}
    assert agg(df, "region", allbut=["city", "wt"]).columns == ["region", "qty", "score"]
    with pytest.raises(ValueError, match="mutually exclusive"):
        agg(df, "region", cols=[], allbut=[])
    with pytest.raises(ValueError, match="is a key"):
        agg(df, "region", allbut="region")
    with pytest.raises(ValueError, match="two measures"):
        agg(df, "region", cols=["qty", "qty"])
    with pytest.raises(ValueError, match="name of a key"):
        agg(df, "region", cols=[("qty", "sum", "region")])
    assert sorted(r.region for r in agg(df, "region", cols=[]).collect()) == ["E", "W"]
    assert default_aggr(T.BooleanType()) == "sum" and default_aggr(T.ArrayType(T.StringType())) == "unionall" and default_aggr(T.DateType()) == "uniqvalue"


def test_missing_values(spark):
    df = numbered(spark, [("E", 1.0), ("E", 2.0), ("W", 3.0), ("W", None), ("W", 5.0)], "g string, v double").drop("i")
    assert one(agg(df, "g")) == {"E": (3,), "W": (None,)}
    assert one(agg(df, "g", cols=[("v", "mean(skipmissing(_))", "m"), ("v", "length(_)", "n"), ("v", "length(skipmissing(_))", "k")])) == {"E": (1.5, 2, 2), "W": (4, 3, 2)}


def test_spread_of_one_row_is_nan(spark):
    out = one(agg(numbered(spark, [("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, v double"), "g", cols=[("v", "std", "s"), ("v", "var", "q")]))
    assert math.isnan(out["a"][0]) and math.isnan(out["a"][1]) and out["b"] == pytest.approx((math.sqrt(2), 2))


def test_order(spark):
    df = numbered(spark, [("E", 2, 20.0), ("E", 1, 10.0), ("W", 3, 30.0), ("W", 1, 5.0), ("W", 2, 15.0)], "g string, date long, v double")
    cols = [("v", "first(_) |> orderby(date)", "f"), ("v", "last(_) |> orderby(date)", "l"), ("v", "first(_) |> orderby(date => :desc)", "d"), ("v", "first", "e")]
    assert one(agg(df, "g", cols=cols)) == {"E": (10, 20, 20, 20), "W": (5, 30, 30, 30)}


def test_composite(spark):
    rows = [("c1", 2020, 10.0), ("c1", 2020, 20.0), ("c1", 2021, 40.0), ("c2", 2020, 5.0), ("c2", 2021, 15.0)]
    df = numbered(spark, rows, "g string, year long, pop double")
    assert one(agg(df, "g", cols=[("pop", "mean(sum(_) |> groupby(year))", "m"), ("pop", "last(sum(_) |> groupby(year))", "l")])) == {"c1": (35, 40), "c2": (10, 15)}
    rows = list(zip(["c1", "c1", "c2", "c1", "c2", "c2"], [2020] * 3 + [2021] * 3, [1, 2, 9, 4, 3, 3], strict=True))
    deep = numbered(spark, [("all", *r) for r in rows], "g string, county string, year long, v long")
    assert one(agg(deep, "g", cols=[("v", "maximum(mean(sum(_) |> groupby(county)) |> groupby(year))", "m")])) == {"all": (6,)}
    gap = numbered(spark, [("a", 1, 2020), ("a", 2, 2020), ("a", 4, None)], "g string, x long, year long")
    assert one(agg(gap, "g", cols=[("x", "length(sum(_) |> groupby(year))", "n"), ("x", "last(sum(_) |> groupby(year))", "l")])) == {"a": (2, 4)}


def test_guards_and_weights(spark):
    rows = [("E", "USD", 10), ("E", "USD", 20), ("W", "USD", 30), ("W", "EUR", 40), ("X", "USD", 50), ("X", None, 60)]
    df = numbered(spark, rows, "g string, unit string, sales long")
    cols = [("sales", "onlyif(isuniform(unit), sum(_))", "a"), ("sales", "onlyif(countuniq(unit) == 1, sum(_))", "b")]
    assert one(agg(df, "g", cols=cols)) == {"E": (30, 30), "W": (None, None), "X": (None, 110)}
    w = numbered(spark, [("a", 1.0, 0.0, 2.0), ("a", 2.0, 0.0, 4.0), ("b", 10.0, 1.0, 5.0), ("b", 20.0, 3.0, 5.0)], "g string, v double, Size double, Suit double")
    assert one(agg(w, "g", cols=[("v", "wmeanfallback(_, [Size, Suit, 1])", "m")])) == {"a": (pytest.approx(10 / 6),), "b": (17.5,)}
    stores = numbered(spark, [("E", "a", 30.0), ("E", "a", 20.0), ("E", "b", 50.0), ("W", "c", 40.0), ("W", "c", 20.0), ("W", "d", 20.0), ("W", "e", 20.0)], "g string, store string, v double")
    assert one(agg(stores, "g", cols=[("v", "hhi(sum(_) |> groupby(store))", "h")])) == {"E": (0.5,), "W": (pytest.approx(0.44),)}


def test_texts_and_arrays(spark):
    df = numbered(spark, [("A", "x", ["p", "q"]), ("A", "y", ["q"]), ("P", None, None), ("P", "z", ["r"])], "g string, d string, t array<string>")
    out = one(agg(df, "g", cols=[("d", "strjoinuniq", "j"), ("t", "unionall", "u"), ("d", "uniqvalue", "v")]))
    assert out == {"A": ("x,y", ["p", "q"], None), "P": ("z", ["r"], "z")}
    long = numbered(spark, [("a", f"name{k:02d}") for k in range(9)], "g string, d string")
    assert one(agg(long, "g", cols=[("d", 'strjoinuniq(_, ",", 20)', "j")]))["a"][0] == "name00,name01,name0…"


def test_sessions(spark):
    rows = [("u1", 0, 0, 1.0), ("u1", 5, 5, 2.0), ("u1", 60, 55, 4.0), ("u1", 62, 2, 8.0), ("u2", 0, 0, 16.0), ("u2", 90, 90, 32.0)]
    df = numbered(spark, rows, "user string, t long, gap long, spend double")
    out = agg(df, ["user", ("s", "cumsum(gap > 30) |> orderby(t)")], cols=["spend"])
    assert sorted(r.spend for r in out.collect()) == [3, 12, 16, 32]


def test_transforms(spark):
    df = district(spark)
    t = aggs("top", cols=[("TestScr", "sum", "s")]) @ dims(("top", "topnames(County, TestScr, 1)"))
    assert one(df.transform(t), "top") == {"1. C1": (110,), "Others": (50,)}


def test_host_operators(spark):
    df = district(spark)
    try:
        register_op("geomean", lambda x: F.exp(F.avg(F.log(x))), "reduce", 1, 1, ())
        register_op("half", lambda x: x / 2, "elementwise", 1, 1, ())
        assert one(agg(df, "County", cols=[("TestScr", "geomean(half(_))", "m")]), "County")["C2"] == (pytest.approx(10),)
        assert "geomean" in list_ops() and op_shape("geomean") == "reduce"
        register_op("hi", lambda n, x, window: F.when(x > 60, "hi").otherwise("lo"), "map", 2, 2, ())
        register_classifier("hi", 0)
        out = dims(("x", "hi(County, TestScr)"))(df)
        assert {r.x for r in out.where("County = 'C1'").collect()} == {"hi"}
    finally:
        for n in ("geomean", "half", "hi"):
            registry.unregister(n)
        clear_caches()
    out = agg(df, "County", cols=[("TestScr", lambda x: F.max(x) - F.min(x), "r"), ("EnrlTot", trusted("bit_or(EnrlTot)"), "b")])
    assert one(out, "County")["C2"] == (30, 84)


@pytest.mark.parametrize("bad", ["__import__('os').system('x')", "run(`ls`)", "eval(\"1\")", "x -> x", "Main.exit()", "sum(_); rm(_)", "open(\"f\")"])
def test_hostile_text_is_rejected_everywhere(spark, bad):
    df = district(spark)
    for door in (lambda: agg(df, "County", cols=[("TestScr", bad)]), lambda: dims(("x", bad))(df), lambda: hints({"TestScr": bad}), lambda: hints({}, default=bad)):
        with pytest.raises(SpecError):
            door()
