"""Sharding: a minimum-cost flow from old shard sizes to new capacities, and the rewriting of what moves.

Documents lie in old shards, and each shard's documents in blocks by a hash of id and text. The sizes of the blocks, a
bounded table, go to the driver. There a min-cost flow finds how many bytes each old shard keeps and sends where, so that
the fewest bytes move (a byte that stays costs nothing, one that moves costs 1). Whole blocks then fill these flows, the
large ones first. Rows are never gathered by shard on one task: they are written and numbered block by block, and the
number of blocks grows with the bytes. Of a stored layout only the shards that a block leaves or enters are written anew.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import every, shared_dir, table, unused

#: Blocks of each old shard, and bytes of a block where there would be more of them.
BLOCKS, BLOCK_BYTES = 1024, 64 << 20
#: Most blocks of all shards together, which the driver takes up; beyond it blocks grow.
MOST_BLOCKS = 1 << 19
#: Bytes that a writing task takes of a shard, about.
TASK_BYTES = 128 << 20
OLD_SHARDS = 6
NEW_SHARDS = 8


def flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """(old, new) -> bytes: a flow of all supply into the capacities that moves the fewest bytes.

    Successive shortest paths over the old and new shards, whose number does not depend on the data.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def edge(a: int, b: int, cap: int, price: int) -> int:
        for x, y, c, p in ((a, b, cap, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
        return len(to) - 2

    total = sum(supply)
    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    between = {(i, j): edge(i, n + j, total, int(i != j)) for i in range(n) for j in range(m)}
    while True:
        best = {source: 0}
        via: dict[int, int] = {}
        changed = True
        while changed:
            changed = False
            for a in range(n + m + 2):
                if a in best:
                    for e in graph[a]:
                        if room[e] and best[a] + cost[e] < best.get(to[e], 1 << 60):
                            best[to[e]], via[to[e]], changed = best[a] + cost[e], e, True
        if sink not in best:
            break
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = to[via[at] ^ 1]
        sent = min(room[e] for e in path)
        for e in path:
            room[e] -= sent
            room[e ^ 1] += sent
    return {k: room[e ^ 1] for k, e in between.items() if room[e ^ 1]}


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one at most."""
    return [total // shards + (k < total % shards) for k in range(shards)]


@dataclass
class Move:
    """A block's new shard, and the slots of the new shard before its first row."""

    old_shard: int
    block: int
    shard: int
    first_slot: int
    n_bytes: int


def plan_moves(blocks: list[tuple[int, int, int, int]], old_shards: int, capacity: list[int]) -> list[Move]:
    """Where each block (old_shard, block, bytes, rows) goes: whole blocks, large ones first, by the min-cost flow of the shards' bytes.

    A block takes up what is left of one of its shard's flows, that to its own place before the others, then the largest.
    One that fits into none, as flows end within blocks, goes to one of these shards if there is room, else where most is.
    """
    sizes = [0] * old_shards
    for old, _, size, _ in blocks:
        sizes[old] += size
    flows = flow(sizes, capacity)
    room = list(capacity)
    goes: dict[tuple[int, int], int] = {}
    order = sorted(blocks, key=lambda b: (-b[2], b[0], b[1]))
    by_old: dict[int, dict[int, int]] = {}
    for (i, j), n in sorted(flows.items()):
        by_old.setdefault(i, {})[j] = n
    rest = []
    for b in order:
        old, block, size, _ = b
        own = by_old.get(old, {})
        fit = [j for j, n in own.items() if n >= size]
        if not fit:
            rest.append(b)
            continue
        new = old if old in fit else max(fit, key=lambda j: (own[j], -j))
        own[new] -= size
        room[new] -= size
        goes[old, block] = new
    for old, block, size, _ in rest:
        fit = [j for j in by_old.get(old, {}) if room[j] >= size]
        new = old if old in fit else max(fit or range(len(capacity)), key=lambda j: (room[j], -j))
        room[new] -= size
        goes[old, block] = new
    slots = [0] * len(capacity)
    out = []
    for old, block, size, rows in sorted(blocks):
        new = goes[old, block]
        out.append(Move(old, block, new, slots[new], size))
        slots[new] += rows
    return out


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


COLUMNS = ("reshard_old", "reshard_block", "reshard_shard", "reshard_first")


def _key(salt: int, id_col: str, text_col: str) -> Column:
    """A hash of id and text, so that rows that share an id, or have none, spread."""
    return F.xxhash64(F.lit(salt), F.col(id_col), F.xxhash64(F.col(text_col)))


def with_shards(docs: DataFrame, old_shard: Column | None = None, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, slack: float = 0.0) -> tuple[DataFrame, list[Move]]:
    """(docs with the columns COLUMNS, the moves): old shard, block, new shard, and the new shard's slots before the block.

    old_shard is 0 to old_shards - 1 (by default a hash of id and text). Rows of equal id and text share a block; a null
    counts as a value. By default the number of blocks follows the bytes. Shards may be larger than the mean by the share
    `slack`, which saves moves. An empty table has no moves and no rows.
    """
    if blocks is None:
        total = docs.agg(F.sum(text_size(F.col(text_col)))).first()[0] or 0
        blocks = min(MOST_BLOCKS // old_shards, max(BLOCKS, total // (old_shards * BLOCK_BYTES)))
    old = old_shard if old_shard is not None else F.pmod(_key(5, id_col, text_col), F.lit(old_shards))
    marked = docs.withColumns({COLUMNS[0]: old.cast("int"), COLUMNS[1]: F.pmod(_key(7, id_col, text_col), F.lit(blocks)).cast("int")})
    sizes = marked.groupBy(*COLUMNS[:2]).agg(F.sum(text_size(F.col(text_col))).alias("n_bytes"), F.count("*").alias("n_rows")).collect()  # MOST_BLOCKS rows at most
    found = [(r.reshard_old, r.reshard_block, r.n_bytes, r.n_rows) for r in sizes]
    moves = plan_moves(found, old_shards, [int(c * (1 + slack)) for c in even(sum(x[2] for x in found), new_shards)])
    where = docs.sparkSession.createDataFrame([(m.old_shard, m.block, m.shard, m.first_slot) for m in moves], "reshard_old int, reshard_block int, reshard_shard int, reshard_first long")
    return marked.join(F.broadcast(where), list(COLUMNS[:2])).select(*every(docs), *COLUMNS), moves


def affected(moves: list[Move]) -> set[int]:
    """New shards whose files change: a block leaves or enters."""
    return {x for m in moves if m.shard != m.old_shard for x in (m.shard, m.old_shard)}


def write_shards(placed: DataFrame, path: str, moves: list[Move], shards: set[int] | None = None) -> DataFrame:
    """Writes the documents of the given new shards (default: all) below path, a folder for each, and reads them back.

    Several tasks write a shard, each some of its blocks, about TASK_BYTES, and a block's rows lie together.
    """
    rows = placed if shards is None else placed.filter(F.col("reshard_shard").isin(sorted(shards)))
    total = sum(m.n_bytes for m in moves if shards is None or m.shard in shards)
    tasks = max(64, -(-total // (TASK_BYTES * max(1, len({m.shard for m in moves})))))
    rows.repartition(F.col("reshard_shard"), F.pmod("reshard_block", F.lit(tasks))).write.partitionBy("reshard_shard").parquet(path)
    return placed.sparkSession.read.schema(placed.schema).parquet(path)


def reshard_stored(spark: SparkSession, old_path: str, path: str, old_shards: int, new_shards: int, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.02) -> tuple[DataFrame, set[int]]:
    """(documents, shards): the layout at old_path, which write_shards has written, brought to new_shards; shards are those whose files are new.

    The other shards' files stay where they are and are read from there. Slots are numbered anew in all of them.
    """
    stored = spark.read.parquet(old_path)
    docs = stored.drop(*COLUMNS[:2], COLUMNS[3]).withColumnRenamed("reshard_shard", "reshard_was")
    placed, moves = with_shards(docs, F.col("reshard_was"), old_shards, new_shards, id_col, text_col, slack=slack)
    placed = placed.drop("reshard_was")
    new = affected(moves)
    written = write_shards(placed, path, moves, new) if new else placed.limit(0)
    kept = placed.filter(~F.col("reshard_shard").isin(sorted(new))) if new else placed
    return written.unionByName(kept), new


def slots(stored: DataFrame, id_col: str = "doc_id", tie: Column | None = None) -> Column:
    """Gapless number of each row in its new shard: the block's first slot plus the row's place in the block."""
    in_block = Window.partitionBy("reshard_old", "reshard_block").orderBy(F.col(id_col), *([tie] if tie is not None else []))
    return F.col("reshard_first") + F.row_number().over(in_block) - 1


def reshard(docs: DataFrame, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of the shard files, which are written to path (default: the shared folder).

    The files have all columns of docs; one that is called like one of COLUMNS gets an underscore. As docs don't lie in the old shards yet, all files are new; `reshard_stored` keeps
    those that don't change. Every row gets a slot of its own, repeated rows too; null texts have size 1 and crc 0.
    """
    spark = docs.sparkSession
    for name in COLUMNS:
        docs = docs.withColumnRenamed(name, unused(docs.columns, name)[0])
    placed, moves = with_shards(docs, old_shards=old_shards, new_shards=new_shards, id_col=id_col, text_col=text_col)
    if path is None:
        path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    stored = write_shards(placed, path, moves)
    rows = stored.select(F.col(id_col).alias("doc_id"), text_size(F.col(text_col)).alias("size"), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), *COLUMNS)
    rows = rows.withColumn("slot", slots(rows, "doc_id", F.struct("size", "text_crc32")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("reshard_shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: six old shards by a hash of the id become eight of near equal bytes."""
    return reshard(table(spark, sf_dir, "documents"))


QUERIES = {"op8_min_cost_flow_resharding": query}
