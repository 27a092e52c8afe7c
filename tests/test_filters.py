import itertools
import math

import pytest
from pyspark.sql import functions as F

from vectaria.operators.filters import And, ColumnLayout, Contains, Eq, Exists, Gt, Gte, In, Lt, Lte, MapLayout, Ne, Not, Or, compile_filter, condition, parse_filter
from vectaria.sources import payloads
from vectaria.types import PAYLOAD, InvalidArgument, NonFiniteValue, payload, plain_payload, tag_of

PAYLOADS = [
    None, {}, {"k": "a"}, {"k": "b"}, {"k": 1}, {"k": 1.0}, {"k": 3}, {"k": 2.5}, {"k": 0.0}, {"k": -0.0}, {"k": True}, {"k": False},
    {"k": ["a", 1, True]}, {"k": []}, {"other": 5}, {"k": 2**53 + 1}, {"k": float(2**53)},
]
LITERALS = ["a", "b", 1, 3, 2**53, 2**53 + 1, 1.0, 2.5, 0.0, float("nan"), True, False]


def same(a, b):
    return tag_of(a) == tag_of(b) and a == b


def order(a, b):
    x, y = tag_of(a), tag_of(b)
    if x == y and x in ("text", "int"):
        return (a > b) - (a < b)
    if {x, y} <= {"int", "float"}:
        a, b = float(a), float(b)
        return None if math.isnan(a) or math.isnan(b) else (a > b) - (a < b)
    return None


def truth(node, p):
    match node:
        case And(parts):
            return all(truth(x, p) for x in parts)
        case Or(parts):
            return any(truth(x, p) for x in parts)
        case Not(x):
            return not truth(x, p)
        case Exists(f):
            return f in p
    v = p.get(node.field)
    scalar = v is not None and not isinstance(v, list)
    match node:
        case Eq(_, x):
            return scalar and same(v, x)
        case Ne(_, x):
            return scalar and not same(v, x)
        case In(_, xs):
            return scalar and any(same(v, x) for x in xs)
        case Contains(_, x):
            return isinstance(v, list) and any(same(y, x) for y in v)
    tests = {Lt: (-1,), Lte: (-1, 0), Gt: (1,), Gte: (1, 0)}
    return scalar and order(v, node.value) in tests[type(node)]


def test_truth_table(spark):
    leaves = [c("k", v) for c in (Eq, Ne, Lt, Lte, Gt, Gte, Contains) for v in LITERALS]
    leaves += [In("k", ()), In("k", ("a", 3, 0.0)), Exists("k"), Exists("zz"), And(()), Or(()), And((Exists("k"), Ne("k", "a"))), Or((Eq("k", 1), Eq("k", 2.5)))]
    nodes = list(itertools.chain(leaves, map(Not, leaves)))
    df = spark.createDataFrame([(i, payload(p)) for i, p in enumerate(PAYLOADS)], f"id int, payload {PAYLOAD}")
    layout = MapLayout(F.col("payload"))
    for at in range(0, len(nodes), 30):
        part = nodes[at : at + 30]
        for row in df.select("id", *[compile_filter(n, layout).alias(f"c{i}") for i, n in enumerate(part)]).collect():
            p = PAYLOADS[row.id]
            assert [row[f"c{i}"] for i in range(len(part))] == [p is not None and truth(n, p) for n in part], p


def test_columns_layout_agrees_with_map(spark):
    df = spark.createDataFrame([(1, 5, 2.0, "x", ["a"]), (2, None, 7.5, None, None), (3, 2, None, "y", ["b", "a"])], "id int, n long, f double, s string, l array<string>")
    fields = {"n": (F.col("n"), "int"), "f": (F.col("f"), "float"), "s": (F.col("s"), "text"), "l": (F.col("l"), "[text]")}
    columns, maps = ColumnLayout(fields), MapLayout(payloads.from_columns(fields))
    for node in (Eq("n", 5), Eq("n", 5.0), Ne("s", "x"), Not(Gte("f", 3)), Contains("l", "a"), Contains("s", "x"), Exists("n"), Lt("n", 4.5), In("s", ("y", 1)), Eq("zz", 1), Ne("l", "a")):
        got = [[r.id for r in df.where(c).collect()] for c in (compile_filter(node, columns), compile_filter(node, maps), condition(node, columns))]
        assert got[0] == got[1] == got[2], node


def test_pushdown(spark, tmp_path):
    spark.range(10).selectExpr("id", "id as n").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(condition(And((Gt("n", 3), Eq("n", 5))), ColumnLayout({"n": (F.col("n"), "int")})))
    assert [r.id for r in df.collect()] == [5]
    assert "PushedFilters: [IsNotNull(n)" in df._jdf.queryExecution().executedPlan().toString()


def test_json():
    assert parse_filter({"and": [{"field": "a", "eq": 1}, {"not": {"field": "b", "in": ["x"]}}]}) == And((Eq("a", 1), Not(In("b", ("x",)))))
    for bad in ({}, {"field": "a"}, {"field": "a", "like": 1}, {"xor": []}, [], {"field": "a", "eq": None}, {"field": "a", "eq": [1]}):
        with pytest.raises(InvalidArgument):
            parse_filter(bad)


def test_payload_codecs():
    p = {"a": "x", "b": [1, 2.0, True], "c": 3.0}
    assert plain_payload(payload(p)) == p
    assert payload(None) is None and payload({}) == {}
    with pytest.raises(NonFiniteValue):
        payload({"a": math.inf})
    x = payloads.from_json('{"i": 9223372036854775807, "f": 9223372036854775808, "g": 3.0, "l": ["a", false]}')
    assert [type(x[k]) for k in "ifg"] == [int, float, float]
    for bad in ('{"a": null}', '{"a": {}}', '{"a": [[1]]}', "[1]", "{", '{"a": NaN}'):
        with pytest.raises(InvalidArgument):
            payloads.from_json(bad)
