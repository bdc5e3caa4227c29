from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SF_DIR

from strandlake.llm import sharding as sh


@pytest.mark.parametrize("seed", range(8))
def test_flow_moves_the_fewest_bytes(seed):
    rng = random.Random(seed)
    supply = [rng.randint(0, 1000) for _ in range(rng.randint(1, 7))]
    capacity = sh.even(sum(supply), rng.randint(1, 9))
    got = sh.flow(supply, capacity)
    for i, s in enumerate(supply):
        assert sum(n for (a, _), n in got.items() if a == i) == s
    for j, c in enumerate(capacity):
        assert sum(n for (_, b), n in got.items() if b == j) <= c
    stay = sum(n for (a, b), n in got.items() if a == b)
    assert stay == sum(min(s, capacity[i]) for i, s in enumerate(supply) if i < len(capacity))


def test_reshard(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "é" * 9), (None, "no id"), (9004, "same"), (9004, "same")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())))
    got = sh.reshard(docs).collect()
    assert len(got) == sum(map(len, texts.values()))
    size, rows = Counter(), defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32) in texts[r.doc_id]
        assert r.law == "bytes" and 0 <= r.shard < 8 and r.grown_shard is None
        size[r.shard] += r.size
        rows[r.shard].append(r.slot)
    for slots in rows.values():
        assert sorted(slots) == list(range(len(slots)))
    mean = sum(size.values()) / 8
    assert max(abs(size[k] - mean) for k in range(8)) < 0.02 * mean + 300


def test_blocks_follow_the_flow():
    rng = random.Random(3)
    blocks = [(old, k, rng.randint(1, 400), rng.randint(1, 9)) for old in range(6) for k in range(200)]
    total = sum(b[2] for b in blocks)
    capacity = sh.even(total, 8)
    moves = sh.plan_moves(blocks, 6, capacity)
    assert sorted((m.old_shard, m.block) for m in moves) == sorted(b[:2] for b in blocks)
    size, sent = Counter(), Counter()
    for m in moves:
        size[m.shard] += m.n_bytes
        sent[m.old_shard, m.shard] += m.n_bytes
    assert max(abs(size[j] - capacity[j]) for j in range(8)) <= 400
    sizes = [sum(b[2] for b in blocks if b[0] == i) for i in range(6)]
    want = sh.flow(sizes, capacity)
    assert all(abs(sent[k] - want.get(k, 0)) <= 2 * 400 for k in sent | want)
    seen = defaultdict(list)
    rows = {b[:2]: b[3] for b in blocks}
    for m in sorted(moves, key=lambda m: m.first_slot):
        seen[m.shard].append((m.first_slot, rows[m.old_shard, m.block]))
    for parts in seen.values():
        assert [p[0] for p in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]


def test_only_affected_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x" * 50, k % 3, f"e{k}") for k in range(300)], "doc_id long, text string, old int, more string")
    placed, moves = sh.with_shards(docs, docs["old"], 3, 3)
    assert sum(m.n_bytes for m in moves if m.shard == m.old_shard) > 0.95 * sum(m.n_bytes for m in moves)
    sh.write_shards(placed, f"{tmp_path}/a", moves).count()
    same, new = sh.reshard_stored(spark, f"{tmp_path}/a", f"{tmp_path}/b", 3, 3)
    assert new == set() and same.count() == 300
    # Two full shards and a nearly empty third one: the others' blocks move there, a fourth shard is left as it is.
    docs = spark.createDataFrame([(k, "x" * 50, 0 if k < 100 else 1 if k < 180 else 2 if k < 190 else 3, f"e{k}") for k in range(250)], "doc_id long, text string, old int, more string")
    placed, moves = sh.with_shards(docs, docs["old"], 4, 4, slack=9.0)
    assert all(m.shard == m.old_shard for m in moves)
    sh.write_shards(placed, f"{tmp_path}/c", moves).count()
    out, new = sh.reshard_stored(spark, f"{tmp_path}/c", f"{tmp_path}/d", 4, 4, slack=0.05)
    import os

    assert new == {0, 1, 2}
    assert {x for x in os.listdir(f"{tmp_path}/d") if x.startswith("reshard_shard")} == {f"reshard_shard={k}" for k in new}
    rows = out.withColumn("slot", sh.slots(out)).collect()
    assert sorted(r.more for r in rows) == sorted(f"e{k}" for k in range(250))
    for k in range(4):
        assert sorted(r.slot for r in rows if r.reshard_shard == k) == list(range(sum(r.reshard_shard == k for r in rows)))


def test_files_have_all_columns(spark, tmp_path):
    docs = spark.createDataFrame([(None, f"text {k}", k, "x", 1.5) for k in range(50)], "doc_id long, text string, reshard_old int, slot string, n double")
    out = sh.reshard(docs, path=f"{tmp_path}/s")
    assert out.count() == 50
    stored = spark.read.parquet(f"{tmp_path}/s")
    assert set(stored.columns) == {"doc_id", "text", "reshard_old_", "slot", "n", *sh.COLUMNS}
    assert sorted(r.reshard_old_ for r in stored.collect()) == list(range(50))
    assert len({r.reshard_block for r in stored.collect()}) > 30  # rows without an id spread


def test_empty(spark):
    assert sh.reshard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
