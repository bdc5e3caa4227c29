"""SimHash near-dedup: fingerprints of word shingles, joined by a binary trie with a Hamming error budget.

Fingerprints within `radius` bits are linked, and the connected components of the links are the groups of near copies. A
text may have fingerprints of several hash families; each family is joined by itself.

The join walks a binary trie against itself. The 64 bits are cut into radius + 2 blocks; two fingerprints within the
radius agree on two blocks at least. So one trie is kept for each pair of blocks, with these bits as its top levels,
and there the error budget is zero: a subtree below the top levels only meets itself. Spark deals out these subtrees
by a shuffle. Within a task all subtrees are walked at once, level by level: a pair of nodes splits into its up to four
pairs of children, differing bits add up, and a pair over the budget is dropped. Every link is found in some trie.

Subtrees of more than `SUBTREE` fingerprints are dealt out by their next bits in the same way, with the whole budget, and
only what is large even then, a cluster of near copies, is cut into slices; each pair of slices is walked by a task of its
own. A task sends on a spanning forest of its links only, so that a large group of near copies stays small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import first_of_each, if_small, mix64, park, row_key, table

RADIUS = 4
WIDTH = 4
#: Most fingerprints of a subtree that one task walks; a larger one is dealt out further.
SUBTREE = 4000


def simhashes(text: bytes, width: int = WIDTH, families: int = 1) -> list[int]:
    """The fingerprints of a text: bit k is 1 if it is set in over half of the shingles' hashes.

    The first family's hashes are XXH64 (seed 42), the others' are bijections of these. A-Z become a-z; words are runs
    outside ASCII white space; fewer words than `width` are one shingle; none give zero.
    """
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return [0] * families
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = max(1, n - width + 1)
    first, last = starts[:total], ends[-total:]
    ones, digest = np.zeros((families, 64), np.int64), xxhash.xxh64_intdigest
    for at in range(0, total, 1 << 15):
        hashes = np.array([digest(line[a:b], 42) for a, b in zip(first[at : at + (1 << 15)].tolist(), last[at : at + (1 << 15)].tolist(), strict=True)], dtype=np.uint64)
        for f in range(families):
            own = mix64(hashes ^ np.uint64(f * 0x9E3779B97F4A7C15 & 2**64 - 1)) if f else hashes
            ones[f] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return ((2 * ones > total) * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).tolist()


def fingerprints(text: Column | str, width: int = WIDTH, families: int = 1) -> Column:
    """The text's fingerprints as an array of longs (the 64 bits as they are); null and empty texts have zeros."""

    @F.arrow_udf("array<long>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            got = [simhashes(x.as_buffer().to_pybytes() if x.is_valid else b"", width, families) for x in batch.cast(pa.large_binary())]
            flat = np.array(got, dtype=np.uint64).view(np.int64).reshape(-1)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, families, dtype=np.int32)), pa.array(flat))

    return of(text)


def _blocks(radius: int, bits: int = 64) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of the radius + 2 blocks."""
    edges = [round(bits * k / (radius + 2)) for k in range(radius + 3)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _roots(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each row's smallest known row) after the links a-b."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return labels
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := labels[labels], labels):
            labels = further


def trie_links(group: np.ndarray, codes: np.ndarray, radius: int = RADIUS, leaf: int = 64, most: int = 1 << 20) -> np.ndarray:
    """For each row the first row of its component, where rows of one group link within `radius` bits.

    group and codes are sorted by (group, code). A node is a range of rows that share a prefix; the frontier holds pairs
    of nodes with the bits that already differ.
    """
    n = len(codes)
    labels = np.arange(n)
    if n < 2:
        return labels
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    last = np.append(first[1:], n)
    keep = last - first > 1
    start, stop = first[keep], last[keep]
    todo = [(0, start, stop, start, stop, np.zeros(len(start), np.int8))]
    ones: dict[int, np.ndarray] = {}

    def ones_before(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((codes >> np.uint64(63 - bit)) & np.uint64(1)))).astype(np.int64)
        return ones[bit]

    while todo:
        bit, a0, a1, b0, b1, err = todo.pop()
        if len(a0) > most:  # depth first, so that the frontier stays bounded
            for k in range(0, len(a0), most):
                todo.append((bit, *(x[k : k + most] for x in (a0, a1, b0, b1, err))))
            continue
        small = (a1 - a0) * (b1 - b0) <= leaf
        if bit == 64:
            small[:] = True
        if small.any():
            labels = _meet(labels, codes, a0[small], a1[small], b0[small], b1[small], radius)
            a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        count = ones_before(bit)
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        same = (a0 == b0) & (a1 == b1)
        nodes = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1)]
        other = ~same
        nodes.append((am[other], a1[other], b0[other], bm[other], err[other] + 1))
        grown = [np.concatenate(x) for x in zip(*nodes, strict=True)]
        alive = (grown[1] > grown[0]) & (grown[3] > grown[2]) & (grown[4] <= radius)
        alive &= ~((grown[0] == grown[2]) & (grown[1] == grown[3]) & (grown[1] - grown[0] == 1))
        todo.append((bit + 1, *(x[alive] for x in grown)))
    return labels


def _meet(labels: np.ndarray, codes: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, radius: int) -> np.ndarray:
    """labels after the links between the rows of small node pairs."""
    size = (a1 - a0) * (b1 - b0)
    for at in np.array_split(np.arange(len(size)), max(1, int(size.sum()) >> 21)):
        s = size[at]
        which = np.repeat(at, s)
        k = np.arange(len(which)) - np.repeat(np.cumsum(s) - s, s)
        wide = (b1 - b0)[which]
        a, b = a0[which] + k // wide, b0[which] + k % wide
        near = (a < b) & (np.bitwise_count(codes[a] ^ codes[b]) <= radius)
        if near.any():
            labels = _roots(labels, a[near], b[near])
    return labels


def hamming_links(prints: DataFrame, radius: int = RADIUS, subtree: int = SUBTREE) -> DataFrame:
    """(a, b) longs: links between distinct fingerprints `fp` that join exactly the components of all links within radius."""
    blocks = _blocks(radius)
    tries = list(combinations(range(len(blocks)), 2))

    def part(fp: str, lo: int, n: int) -> Column:
        return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << n) - 1))

    def cells(fp: str, parts: list[tuple[int, int]]) -> Column:
        """For each pair of parts (lowest bit, number of bits) its number and the values of both."""
        value = [part(fp, *p) for p in parts]
        return F.array(*(F.struct(F.lit(t).alias("trie"), (value[i] * F.lit(1 << parts[j][1]) + value[j]).alias("cell")) for t, (i, j) in enumerate(tries)))

    dealt = prints.select("fp", F.explode(cells("fp", blocks)).alias("at")).select("fp", "at.trie", "at.cell")
    tasks = dealt.select("fp", F.xxhash64("trie", "cell").alias("task"))
    large = park(dealt.groupBy("trie", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > subtree).select("trie", "cell"))
    if not large.isEmpty():
        large = if_small(large)
        tasks = dealt.join(large, ["trie", "cell"], "left_anti").select("fp", F.xxhash64("trie", "cell").alias("task"))
        # The other bits of a large subtree have the whole budget left: they are cut into blocks and paired once more.
        others = [[blocks[k] for k in range(len(blocks)) if k not in pair] for pair in tries]
        rest = F.coalesce(*(F.when(F.col("trie") == t, reduce(lambda x, b: x * F.lit(1 << b[1]) + part("fp", *b), of, F.lit(0).cast("long"))) for t, of in enumerate(others)))
        deep = dealt.join(large, ["trie", "cell"], "left_semi").withColumn("rest", rest)
        least = min(sum(n for _, n in of) for of in others)
        deep = deep.select("fp", F.xxhash64("trie", "cell").alias("above"), F.explode(cells("rest", _blocks(radius, least))).alias("at")).select("fp", F.xxhash64("above", "at.trie", "at.cell").alias("below"))
        # What is large even so, a cluster of near copies, is cut into slices: a fingerprint's slice meets every slice, itself included.
        dense = deep.groupBy("below").agg(F.count("*").alias("n")).filter(F.col("n") > subtree)
        dense = if_small(park(dense.select("below", F.ceil(F.col("n") * 2 / subtree).alias("slices"))))
        deep = deep.join(dense, "below", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("slices"))
        meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda k: F.least(k, mine) * F.col("slices") + F.greatest(k, mine))
        deep = deep.select("fp", "below", F.explode(meets).alias("pair")).select("fp", F.xxhash64("below", "pair").alias("task"))
        tasks = tasks.unionByName(deep)
    dealt = tasks
    dealt = dealt.repartition(F.col("task")).sortWithinPartitions("task")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_f, left_t = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            task = np.concatenate((left_t, batch.column(1).to_numpy()))
            codes = np.concatenate((left_f, batch.column(0).to_numpy().view(np.uint64)))
            whole = int(np.searchsorted(task, task[-1])) if len(task) else 0  # the last subtree may go on
            yield from done(task[:whole], codes[:whole])
            left_t, left_f = task[whole:], codes[whole:]
        yield from done(left_t, left_f)

    def done(task: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(task) < 2:
            return
        lone = np.concatenate(([True], task[1:] != task[:-1])) & np.concatenate((task[1:] != task[:-1], [True]))
        task, codes = task[~lone], codes[~lone]
        order = np.lexsort((codes, task))
        task, codes = task[order], codes[order]
        root = trie_links(task, codes, radius)
        k = np.flatnonzero(root != np.arange(len(root)))
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(codes[k].view(np.int64)), pa.array(codes[root[k]].view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(walk, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) longs for every node of links (a, b): root is the smallest node that is reachable.

    Each round hooks every node to its smallest neighbour, shortens the chains, and carries the links over to the roots;
    it halves the open nodes at least. All of it stays in distributed tables.
    """
    links = park(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    known: DataFrame | None = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near")))
        up = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up"))
        for _ in range(2):
            up = park(up)
            above = up.select(F.col("node").alias("up"), F.col("up").alias("further"))
            up = up.join(above, "up", "left").select("node", F.coalesce("further", "up").alias("up"))
        up = park(up)
        for end in ("a", "b"):
            links = links.join(up.select(F.col("node").alias(end), "up"), end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
        links = park(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
        if known is None:
            known = up.select("node", F.col("up").alias("root"))
        else:
            step = up.select(F.col("node").alias("root"), F.col("up"))
            known = known.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        known = park(known)
    return known if known is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _family_links(prints: DataFrame, family: int, radius: int) -> DataFrame:
    """(a, b): links that a further family of fingerprints adds, told in fingerprints of the first one."""
    pairs = park(prints.select("fp", F.col("fps")[family].alias("other")).distinct())
    stands = park(pairs.groupBy("other").agg(F.min("fp").alias("stand")))
    same = pairs.join(stands, "other").filter("fp != stand").select(F.col("fp").alias("a"), F.col("stand").alias("b"))
    links = hamming_links(stands.select(F.col("other").alias("fp")), radius)
    for end in ("a", "b"):
        links = links.join(stands.select(F.col("other").alias(end), "stand"), end).drop(end).withColumnRenamed("stand", end)
    return links.select("a", "b").unionByName(same)


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int, families: int) -> tuple[DataFrame, DataFrame]:
    """(rows, members): (no_id, id, text_hash, fp) of each row, and (fp, root) of the fingerprints that have a link."""
    rows = docs.select(*row_key(id_col, text_col), fingerprints(F.col(text_col), width, families).alias("fps"))
    rows = park(rows.select("no_id", "id", "text_hash", F.col("fps")[0].alias("fp"), *(["fps"] if families > 1 else [])))
    links = hamming_links(park(rows.select("fp").distinct()), radius)
    for family in range(1, families):
        links = links.unionByName(_family_links(rows, family, radius))
    return rows.drop("fps"), components(links).select(F.col("node").alias("fp"), "root")


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, families: int = 1) -> DataFrame:
    """(id, fp long, component_id): component_id is the smallest id that links within `radius` bits reach.

    With more families, texts whose fingerprints of any family are that close are linked: what one family misses by a few
    bits another one finds. One row for each row of docs; repeated ids stay repeated. Null and empty texts have fingerprint
    zero and link like any other; a null id comes back as null and is never the smallest, unless its group has no other.
    An empty table gives an empty one. Other columns of docs are not used, whatever their names.
    """
    rows, members = _grouped(docs, id_col, text_col, width, radius, families)
    members = park(members)
    each = park(rows.groupBy("fp").agg(F.min(F.when(~F.col("no_id"), F.col("id"))).alias("least")))
    # Only groups of several fingerprints need a name of their own; a large group is one row of `smallest`.
    linked = park(each.join(members, "fp"))
    smallest = if_small(park(linked.groupBy("root").agg(F.min("least").alias("smallest"))))
    named = linked.select("fp", "root").join(smallest, "root").select("fp", "smallest", F.lit(True).alias("linked"))
    each = park(each.join(named, "fp", "left").select("fp", F.when(F.col("linked"), F.col("smallest")).otherwise(F.col("least")).alias("component_id")))
    return rows.join(each, "fp").select(F.when(~F.col("no_id"), F.col("id")).alias("id"), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, families: int = 4) -> DataFrame:
    """The documents, of each group of near copies one row, with the columns of docs.

    It is the first by `first_of_each`: the smallest id, null ids last, then by hash of the text, then by the other columns.
    Groups are of rows, so rows of one id (or without one) whose texts differ are in groups of their own. Links are looked
    for in `families` fingerprints, as one of them at a small radius misses many copies with edits. Null and empty texts are
    copies of each other; an empty table stays empty; columns may have any names.
    """
    rows, members = _grouped(docs, id_col, text_col, width, radius, families)
    roots = rows.join(if_small(park(members)), "fp", "left").select("no_id", "id", "text_hash", F.coalesce("root", "fp").alias("root"))
    return first_of_each(docs, roots, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: each document's fingerprint (16 hex digits) and component."""
    groups = near_copy_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_near_dedup": query}
