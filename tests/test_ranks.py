from __future__ import annotations

import random

from lethe.operators.ranks import with_running_sum
from lethe.session import materialise


def rows_of(n: int):
    rng = random.Random(n)
    # One group holds most rows, sequence numbers are sparse and not in the order of arrival.
    rows = [(None if i % 7 == 0 else f"g{i % 3 if i % 10 == 0 else 0}", i << 20, i % 5) for i in range(n)]
    rng.shuffle(rows)
    return rows


def test_places_and_totals_per_group(spark):
    rows = rows_of(500)
    df = spark.createDataFrame(rows, "g string, seq long, v long")
    got = with_running_sum(df, ["seq"], ["g"], before="place", total="n").collect()
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted(r[1] for r in rows if r[0] == g)
        want.update({(g, s): (i, len(own)) for i, s in enumerate(own)})
    assert {(r.g, r.seq): (r.place, r.n) for r in got} == want and len(got) == len(rows)


def test_running_sums_over_the_whole_table(spark):
    rows = rows_of(300)
    df = spark.createDataFrame(rows, "g string, seq long, v long")
    got = with_running_sum(df, ["seq"], value="v").collect()
    total, want = 0, {}
    for _, seq, v in sorted(rows, key=lambda r: r[1]):
        want[seq] = total
        total += v
    assert {r.seq: r.before for r in got} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, seq long, v long")
    assert with_running_sum(df, ["seq"], ["g"]).collect() == []


def test_one_group_is_spread_over_tasks(spark):
    rows = [("hot", i << 20, 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, seq long, v long").repartition(8)
    seen = {}

    def kept(table, label):
        seen["stored"] = materialise(table, label)
        return seen["stored"]

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with_running_sum(df, ["seq"], ["g"], write=kept)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in seen["stored"].groupBy("_part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500
