import pytest
from pyspark.sql import functions as F

from buslens.operators import quantiles as Q
from buslens.operators.catalog import bit_layout, catalog_from_rows
from buslens.plans.staging import sized


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_sides_are_not_broadcast(spark):
    left = spark.range(10)
    packed = spark.range(200_000).select("id", F.lit("the same text in each row").alias("text"))
    assert "BroadcastHashJoin" not in plan(left.join(sized(packed), "id", "left"))
    assert "BroadcastHashJoin" in plan(left.join(sized(packed.limit(100)), "id", "left"))


def test_bits_are_dealt_out_before_they_are_sorted(spark):
    rows = [(m, s, f"s{s}", 8 * s, 9, True, False, 1.0, 0.0, 0.0, 0.0, "", False, [], [], "Integer") for m in range(20) for s in range(3)]
    cat = catalog_from_rows(spark, [(m, m, f"m{m}", 8) for m in range(20)], rows)
    dealt = bit_layout(cat, max_task_bits=100)
    assert "REPARTITION_BY_NUM" in plan(dealt) and "hashpartitioning(msg_order" in plan(dealt).replace("#", " ").replace("msg_order ", "msg_order")
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, bit_layout(cat).collect()))


def test_exact_quantiles_move_few_rows(spark, monkeypatch):
    """Values of all sizes, ties, a null and a group of one: the same as in one task, without a shuffle of the values."""
    rows = spark.range(40_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 50 > 0, F.exp(F.hash("id") / 2**27)).alias("x"),
                                      (F.col("id") % 7).cast("double").alias("y")).unionByName(
        spark.sql("SELECT null AS k, 5.0D AS x, CAST(null AS DOUBLE) AS y"))
    wanted = {f"{c}{i}": (c, q) for c in "xy" for i, q in enumerate((0.0, 0.01, 0.5, 0.95, 0.9999, 1.0))}
    whole = {r["k"]: r.asDict() for r in Q.quantiles(rows, ["k"], wanted, blocked=False).collect()}
    missed = Q._near(rows, ["k"], wanted, 500, accuracy=2, slack=0.0)
    monkeypatch.setattr(Q, "_ranked", None)
    found = Q.quantiles(rows, ["k"], wanted, blocked=True, max_group_rows=500)
    for parts in (found, missed):
        parts = {r["k"]: r.asDict() for r in parts.collect()}
        assert len(parts) == len(whole) and all(parts[k] == pytest.approx(whole[k], rel=1e-12) for k in whole if k is not None)
        assert parts[None] == whole[None]
