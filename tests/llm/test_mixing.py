from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from noisefleet.llm import mixing as m


def fill(sizes: dict, weights=(3, 1, 2), share=1.5, most=2) -> dict:
    """Targets by the process itself: share, cap, share again what is left."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, None: 7}, {"x": 5}, {"a": 0, "b": 30}, {c: 100 for c in "abcdefg"},
                                   {"z": 0}, {"a": 1, "b": 1, "c": 10**9}])
def test_targets_equal_the_process(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in m.source_targets(rows).collect()}
    assert got == pytest.approx(fill(sizes))


def test_training_time_inverts_the_integral(spark):
    curves = (((0, 1.0), (0.5, 0.0), (1, 3.0)), ((0, 0.0), (1, 2.0)))
    shares = spark.range(101).select((F.col("id") / 100).alias("u"))
    for rank, curve in enumerate(curves):
        for r in shares.select("u", m.training_time(F.col("u"), F.lit(rank), curves).alias("t")).collect():
            done = 0.0
            for t0, w, slope, before in m.curve_pieces(curve):
                if r.t >= t0:
                    done = before + w * (r.t - t0) + slope * (r.t - t0) ** 2 / 2
            assert done == pytest.approx(r.u, abs=1e-9)


def test_curves_are_checked():
    for bad in ([(0, 1), (0, 1)], [(0, 0), (1, 0)], [(0, -1), (1, 3)]):
        with pytest.raises(ValueError):
            m.curve_pieces(bad)


def test_sources_meet_their_targets(docs):
    df = docs(*[(i, "word " * (1 + i % 17), "hot" if i % 3 else f"s{i % 7}") for i in range(600)])
    plan = m.mix(df)
    by_source = plan.groupBy("row.source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in by_source)
    assert plan.where("taken > 2 * size").count() == 0
    assert sorted(map(str, plan.collect())) == sorted(map(str, m.mix(df.repartition(7)).collect()))


def test_curriculum_repeats_whole_documents(docs):
    df = docs(*[(i, f"a{i}  b{i}\nc{i} " + "d " * (i % 9), "big") for i in range(50)], *[(100 + i, "x y z", "small") for i in range(3)])
    out = m.curriculum(df.withColumn("__at", F.lit(1)))
    assert out.columns == [*df.columns, "__at"]
    rows = out.collect()
    whole = {r.doc_id: r.text for r in df.collect()}
    assert all(whole[r.doc_id] == r.text and r.n_chars == len(r.text) for r in rows)
    # each source comes within half a document of its words
    plan = m.mix(df).groupBy(F.col("row.source").alias("source")).agg(F.sum("taken").alias("n"), F.max("size").alias("most")).collect()
    for p in plan:
        assert abs(sum(len(r.text.split()) for r in rows if r.source == p["source"]) - p["n"]) <= p["most"] / 2


def test_awkward_rows(awkward, docs):
    plan = m.mix(awkward)
    assert plan.count() == awkward.count()
    assert {r.taken for r in plan.where("size = 0").collect()} == {0}
    assert m.mix(docs().where("false")).count() == 0 and m.curriculum(docs().where("false")).count() == 0
