import random

import pytest
from pyspark.sql import functions as F

from wardlake.llm.ranges import Blocks

ROWS = "id bigint, tie bigint, w int, row int, block string"


def shapes():
    rng = random.Random(4)
    yield "even", [(i, 0, 1) for i in range(2000)]
    yield "outlier", [(i, 0, 1) for i in range(1500)] + [(1 << 60, 0, 1), (-(1 << 62), 0, 3)]
    yield "near the top", [((1 << 60) + i, 0, 1) for i in range(900)] + [(0, 0, 1)]
    yield "both ends", [(-(1 << 63), 0, 1), ((1 << 63) - 1, 0, 1)] + [(i, 0, 1) for i in range(500)]
    yield "one key", [(5, rng.randrange(1 << 59), 1) for _ in range(1200)]
    yield "one row many times", [(5, 7, 1)] * 600
    yield "no keys", [(None, rng.randrange(1 << 59), 1) for _ in range(700)] + [(i, 3, 1) for i in range(300)]
    yield "powers", [(1 << (i % 62), rng.randrange(1000), 1 + i % 5) for i in range(1000)]
    yield "heavy rows", [(i, 0, 500 if i % 50 == 0 else 1) for i in range(400)]
    yield "one", [(3, 3, 1)]
    yield "none", []


@pytest.mark.parametrize("rows", [pytest.param(r, id=n) for n, r in shapes()])
def test_blocks_are_ordered_and_of_the_wanted_weight(spark, rows):
    most = 100
    frame = spark.createDataFrame([(k, t, w, i, "x") for i, (k, t, w) in enumerate(rows)], ROWS).repartition(3).drop("block")
    blocks = Blocks.of(frame, "id", "tie", F.col("w"), most)
    got = blocks.add(frame, "id", "tie").collect()
    assert len(got) == len(rows)
    order = lambda r: (r.id is not None, r.id or 0, r.tie)
    got.sort(key=lambda r: (order(r), r.block))
    assert [r.block for r in got] == sorted(r.block for r in got) and {r.block for r in got} == set(range(blocks.n_blocks))
    for b in range(blocks.n_blocks):
        own = [r for r in got if r.block == b]
        heaviest = max(sum(r.w for r in own if (r.id, r.tie) == pair) for pair in {(r.id, r.tie) for r in own})
        assert sum(r.w for r in own) <= most + max(most, heaviest)
        assert all(r.block_before == (b - 1) % blocks.n_blocks for r in own)
        leads = [r for r in own if r.leads]
        assert leads and order(own[0]) in map(order, leads) and all(r.id == own[0].id for r in leads)
        assert {order(r) for r in leads} >= {order(r) for r in own if order(r) == order(own[0])}
    assert sum(w for _, _, w in rows) < 2 * most or blocks.n_blocks > 1 or len(set(rows)) == 1
    dealt = blocks.deal(blocks.add(frame, "id", "tie")).withColumn("p", F.spark_partition_id())
    assert {r.p - r.block for r in dealt.collect()} <= {0}
