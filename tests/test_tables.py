"""The table function of blocks against slices of whole strings."""

from __future__ import annotations

import random

import pytest

from strandlake.functions.tables import register_sequence_blocks


@pytest.mark.parametrize(("block", "context"), [(4, 6), (10, 0), (3, 20), (100, 7)])
def test_blocks(spark, block, context):
    rng = random.Random(block)
    whole = {k: "".join(rng.choice("ACGT") for _ in range(n)) for k, n in enumerate([0, 1, 4, 9, 10, 11, 57, 200])}
    rows = []
    for k, s in whole.items():
        at = line = 0
        while at < len(s):
            n = rng.choice([0, 1, 5, 30])
            rows.append((k, line, s[at : at + n] if n else None))
            at, line = at + n, line + 1
    rng.shuffle(rows)
    register_sequence_blocks(spark, f"blocks_{block}", block, context)
    spark.createDataFrame([*rows, (0, 0, "")], "key long, line int, piece string").repartition(5).createOrReplaceTempView("lines_of_blocks")
    got = sorted(tuple(r) for r in spark.sql(f"select * from blocks_{block}(table(lines_of_blocks) partition by key order by line)").collect())
    side = context // 2
    want = []
    for k, s in whole.items():
        for b in range(-(-len(s) // block)):
            want.append((k, b, "".join(s[p] if 0 <= p < len(s) else "N" for p in range(b * block - side, b * block + block + side))))
    assert got == want
