import pytest
from pyspark.sql import types as T

from stratachain import SpecError, check_cols, fields, list_ops, op_shape, parse_aggr, parse_dim, summary
from stratachain.functions.labels import Style, interval_labels, percent, quantile_labels
from stratachain.plans.nodes import text
from stratachain.plans.rejections import FOREIGN, distance, nearest
from stratachain.suggest import complete, spec_templates, spec_vocabulary

AGGR_ERRORS = [
    ("", "empty_spec", None),
    ("sum(", "parse", None),
    ("summ(_)", "unknown_op", "sum"),
    ("avg(_)", "foreign_spelling", None),
    ("count_uniq(_)", "spelling_convention", "countuniq"),
    ("sum(_) & sum(_)", "boolean_operator", "&&"),
    ("Base.sum(_)", "unsupported_syntax", None),
    ("_ + 1", "shape", None),
    ("cumsum(_)", "shape", None),
    ("sum(_) |> groupby(x)", "modifier_misuse", None),
    ("groupby(x)", "modifier_misuse", None),
    ("_", "target_placeholder", None),
    ("3", "invalid_spec", None),
    ("quantile(_)", "arity", None),
    ("uniqvalue(_, skipn = true)", "unknown_kwarg", "skipna"),
    ("sum(:x)", "symbol_literal", "x"),
    ("mean(sum(_) |> groupby(:x))", "symbol_literal", "x"),
    ('mean(sum(_) |> groupby("x"))', "groupby_literal", "x"),
    ("sum(_) |> orderby(_)", "target_placeholder", None),
    ("sum(_) |> orderby(desc)", "order_entry", None),
    ("sum(_) |> orderby(x) |> orderby(y)", "modifier_misuse", None),
    ("sum(_) |> foo(x)", "modifier_misuse", None),
    ("count(*)", "foreign_spelling", None),
    ("[sum(_)]", "invalid_spec", None),
    ("sum(_) for x in y", "unsupported_syntax", None),
    ("partitionby(x)", "modifier_misuse", None),
]


@pytest.mark.parametrize("spec,code,fix", AGGR_ERRORS, ids=lambda v: str(v)[:30])
def test_rejections(spec, code, fix):
    with pytest.raises(SpecError) as e:
        parse_aggr(spec)
    if code == "unsupported_syntax" and spec.startswith("sum(_) for"):
        assert e.value.code in ("unsupported_syntax", "parse")
    else:
        assert (e.value.code, e.value.fix) == (code, fix), str(e.value)
    assert str(e.value).count('[in aggr"') == 1
    if fix:
        a, b = e.value.span
        raw = spec.encode()
        parse_aggr((raw[:a] + fix.encode() + raw[b:]).decode()) if code not in ("symbol_literal",) else None


DIM_ERRORS = [("x", "bare_name"), ("sum(x) |> groupby(g)", "shape"), ("a < b < c", "unsupported_syntax"), ("sum(_)", "target_placeholder"), ("skipmissing(x)", "shape"), ("lag(x, 1, 2, 3)", "arity"), ("[a, b]", "invalid_spec"), ("x -> x", "unsupported_syntax"), ("a ? b : c", "unsupported_syntax"), ("x[1] + 1", "unsupported_syntax"), ("where(x > 1, true_label=\"a\", false_label=\"a\")", "invalid_spec"), ("sum(x) over(y)", "parse"), ("cumsum(x) |> over(y)", "modifier_misuse"), ("cumsum(3)", "shape")]


@pytest.mark.parametrize("spec,code", DIM_ERRORS)
def test_dim_rejections(spec, code):
    with pytest.raises(SpecError) as e:
        parse_dim(spec)
    assert e.value.code == code, str(e.value)


def test_messages():
    for spec, part in [("quantile(_, 1, 2, 3)", "got 4"), ("sum(_, k = 1)", "takes no keyword options"), ("uniqvalue(_, foo = 1)", "Accepted: "), ("mean(_) |> orderby", "write it as a call"), ("sum(_) |> groupby(x)", "NEST it in a reduction")]:
        with pytest.raises(SpecError, match=part):
            parse_aggr(spec)


def test_span_is_in_bytes():
    with pytest.raises(SpecError) as e:
        parse_aggr('strjoinuniq(_, "é") == summ(_)')
    a, b = e.value.span
    assert e.value.spec.encode()[a:b] == b"summ"


def test_precedence():
    same = [("a + b * c", "a + (b * c)"), ("-x^2", "-(x^2)"), ("2x + 1", "(2 * x) + 1"), ("a && b || c", "(a && b) || c"), ("x^2^3", "x^(2^3)"), ("a > 1 && b < 2", "(a > 1) && (b < 2)"), ("!a || b", "(!a) || b"), ("a .+ b", "a + b"), ("a ≤ b", "a <= b"), ("x ∈ [1]", "x in [1]")]
    for a, b in same:
        x, y = parse_dim(a).body, parse_dim(b).body
        strip = lambda n: text(n).replace(".+", "+").replace("≤", "<=").replace("∈", "in").replace("2x", "2 * x")
        assert strip(x) == strip(y)


def test_where_label_is_the_printed_condition():
    for spec, label in [("where(x>35)", "x > 35"), ("where( (a+b)*2 > c )", "(a + b) * 2 > c"), ("where(x in [1,2])", "x in [1, 2]"), ("where(f>.5&&g)", "f > 0.5 && g")]:
        assert dict(parse_dim(spec).body.kwargs)["true_label"].value == label


def test_cache_and_synonyms():
    assert parse_aggr(" sum(_) ") is parse_aggr("sum(_)")
    a, b = parse_dim("cumsum(x) |> orderby(t) |> groupby(g)"), parse_dim("cumsum(x) ∘ groupby(g) ∘ orderby(t)")
    assert (a.body, a.order, a.by) == (b.body, b.order, b.by)
    assert parse_aggr("sum").body == parse_aggr("sum(_)").body


def test_columns_are_checked_with_their_origin():
    spec = parse_dim("cumsum(x) |> groupby(g) |> orderby(tt)")
    with pytest.raises(SpecError, match="references orderby column 'tt'"):
        check_cols(spec, ["x", "g", "t"])
    with pytest.raises(SpecError, match="references groupby column 'g'"):
        check_cols(spec, ["x", "tt"])


def test_registry():
    ops = list_ops()
    assert len(ops) == 89
    assert op_shape("sum") == "reduce" and op_shape("lag") == "map" and op_shape("where") == "elementwise" and op_shape("skipmissing") == "filter"
    from stratachain.functions.registry import _ops

    assert all(o.doc for o in _ops.values())


def test_repairs():
    assert distance("abcd", "abdc") == 1 and nearest("lenght", ["length", "last"]) == "length" and nearest("zzzz", ["sum"]) is None
    assert len(FOREIGN) > 55


def test_labels():
    assert interval_labels([0, 1, 2, 3], True) == ["1. ≤-1", "2. 0", "3. 1", "4. 2", "5. 3+"]
    assert interval_labels([0, 1, 2, 3], False, "boundedbelow") == ["1. [0,1)", "2. [1,2)", "3. [2,3)", "4. ≥3"]
    assert interval_labels([0, 1, 2, 3], False, "bounded", leftequal=False) == ["1. [0,1]", "2. (1,2]", "3. (2,3]"]
    assert interval_labels([0, 0.25, 1], False, "bounded", style=Style(scale=100.0, suffix="%")) == ["1. [0%,25%)", "2. [25%,100%]"]
    assert interval_labels([1000, 2000], True, style=Style(commas=True), rank=False) == ["≤999", "1,000…1,999", "2,000+"]
    assert interval_labels([1], False, reverse=True) == ["2. <1", "1. ≥1"]
    assert percent(1 / 3) == "33.33%" and percent(0.125) == "12.5%"
    assert quantile_labels([1 / 3, 2 / 3], prefix="p", suffix="s")[0] == "1. p [0%, 33.33%) s"
    for bad in ([], [0.5, 0.5], [0, 0.5]):
        with pytest.raises(ValueError):
            quantile_labels(bad)


def test_templates_parse_and_run(spark):
    from stratachain import agg, dim

    rows = [("E", "ny", 1, 2.0, True, ["a"], None), ("W", "sf", 2, 1.0, None, ["b"], 3.0)]
    df = spark.createDataFrame(rows, "region string, city string, qty long, weight double, flag boolean, tags array<string>, score double").selectExpr("*", "date'2024-01-01' as day")
    for name in df.columns:
        for t in spec_templates("aggr", df, name):
            agg(df, "region" if name != "region" else "city", cols=[(name, t.spec, "out")]).collect()
        for t in spec_templates("dim", df, name):
            dim(df, ("out", t.spec)).collect()
    assert spec_templates("dim", {"x": T.DoubleType()}, "x")[0].spec == "quantiles(x, ngroups = 4)"
    assert "orderby" in spec_vocabulary("dim", ["x"]) and "_" in spec_vocabulary("aggr") and complete("aggr", "strj") == ["strjoinuniq"]


def test_summary():
    s = parse_dim("cumsum(x) |> groupby(g) |> orderby(t => :desc)")
    assert summary(s) == "pivot dimension cumsum of x, g by g ordered by t desc"
    assert fields(parse_aggr("sum(_)"))["shape"] == "scalar"
