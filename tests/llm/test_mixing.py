import pytest
from pyspark.sql import functions as F

from vectaria.llm import mixing as M


def brute(sizes):
    """Targets by sharing again until none is above its cap; exact fractions."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, open_ = total - sum(3 * sizes[s] for s in full), [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        more = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in full else share[s] for s in order}
        full |= more


CASES = [
    {"a": 100, "b": 100, "c": 100, None: 100}, {"a": 5, "b": 1000, "C": 30, "é": 0, "z": 7, None: 1}, {"a": 1, "b": 1, "c": 10**9}, {"a": 0, "b": 0}, {"x": 12},
]


@pytest.mark.parametrize("sizes", CASES)
def test_targets(spark, sizes):
    d = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.targets(d).collect()}
    assert got == {s: pytest.approx(t) for s, t in brute(sizes).items()} and sum(got.values()) == pytest.approx(sum(sizes.values()))


def docs(spark):
    source = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")))
    return spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), source.alias("source"))


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_mix_meets_targets_and_reruns_agree(spark, monkeypatch, broadcast):
    monkeypatch.setattr(M, "BROADCAST_SOURCES", broadcast)
    d = docs(spark)
    rows = M.mix(d).collect()
    assert len(rows) == 4000 and all(r["size"] == r.doc_id % 9 and 0 <= r["copies"] <= 3 for r in rows)
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert sum(r["size"] * r["copies"] for r in mine) == pytest.approx(mine[0]["target"], rel=0.12)
    again = {r.doc_id: r["copies"] for r in M.mix(d.repartition(7)).collect()}
    assert again == {r.doc_id: r["copies"] for r in rows}
    out = M.emit(d)
    assert out.columns == d.columns and out.count() == sum(again.values())


def test_draw_is_uniform(spark):
    x = [r.x for r in spark.range(4000).select(M.draw(F.col("id")).alias("x")).collect()]
    assert 0 <= min(x) and max(x) < 1 and abs(sum(x) / len(x) - 0.5) < 0.02


def test_emit_keeps_columns_of_any_name(spark):
    names = ("size", "copies", "copy", "row", "target", "source_size", "s", "t", "salt", "draw", "is_null", "part", "weight", "__size", "__source", "__copies", "col")
    d = docs(spark).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    out = M.emit(d)
    assert out.columns == d.columns
    rows = out.collect()
    assert len(rows) > 1000 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
