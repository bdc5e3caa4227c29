"""Language identification by partial matching: context trees of up to ORDER bytes for each language, with escapes.

A node of a language's tree is a context that was seen before some byte, and is kept where it was seen: contexts of up to two
bytes in any case, longer ones with a byte that followed them LEAST times at least. In a node a byte that was seen n times
costs -log2(n / (total + kinds)); any other byte costs the escape, -log2(kinds / (total + kinds)), and then its cost in the
node of the context that is one byte shorter; a context without a node costs nothing on the way. Below the empty context all
256 bytes are equally likely. Bytes that a longer context has excluded are not taken out of the shorter ones. The statistics
are frozen after learning, so a text's code length is exact and does not depend on what was read before. The language of the
shortest code is the prediction.

The trees lie on each other: a byte after a context has one entry, with its cost in every language, so a byte of a text costs
about one look-up whatever the number of languages, and escapes cost further ones. The entries of all languages are at most
CELLS costs (two bytes each): with many languages, contexts of three bytes and more are kept from a higher count on. Four
languages of the largest test table have some 500,000 counts; a hundred languages have at most 320,000 entries, 64 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import chunks, mix64, park, table, text_buffer

#: Documents of a language that are learned from, in expectation; more are thinned by a hash of the id.
LEARNED = 4000
#: Bytes of the longest context, and the least count of a byte after a context of more than two bytes.
ORDER, LEAST = 4, 2
#: Costs that the model holds at most, over all entries and languages.
CELLS = 1 << 25
#: Costs are kept in steps of 1/STEPS bit.
STEPS = 512
UNKNOWN = "und"
_PAD = 0x0A

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte its ORDER predecessors and itself, as one number; before a text stand line ends."""
    n = len(raw)
    start = np.repeat(offsets[:-1], np.diff(offsets))
    at = np.arange(n) - start
    out = raw.astype(np.int64)
    for k in range(1, ORDER + 1):
        before = np.full(n, _PAD, np.int64)
        before[k:] = raw[:-k] if k < n else before[k:]
        before[at < k] = _PAD
        out |= before << (8 * k)
    return out


def _low(codes: np.ndarray, order: int) -> np.ndarray:
    """The last order + 1 bytes of each gram."""
    return codes & ((1 << (8 * (order + 1))) - 1)


class Lookup:
    """Numbers of sorted keys: a slot for each hash, and a sorted rest for keys whose slot another one has."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.slots = np.zeros(1 << self.bits, np.int32)
        slot = self._slot(keys)
        self.slots[slot] = np.arange(len(keys), dtype=np.int32)
        beaten = self.slots[slot] != np.arange(len(keys))
        self.rest = np.flatnonzero(beaten)
        self.shared = np.zeros(1 << self.bits, bool)
        self.shared[slot[beaten]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """The number of each code among the keys, -1 for those that are none."""
        if not len(self.keys):
            return np.full(len(codes), -1, np.int64)
        slot = self._slot(codes)
        found = self.slots[slot].astype(np.int64)
        wrong = self.keys[found] != codes
        found[wrong] = -1
        if len(self.rest):
            again = np.flatnonzero(wrong & self.shared[slot])
            if len(again):
                own = self.keys[self.rest]
                k = np.minimum(np.searchsorted(own, codes[again]), len(own) - 1)
                found[again] = np.where(own[k] == codes[again], self.rest[k], -1)
        return found


class Model:
    """Frozen costs in steps: entries[order] finds a context and byte, costs[order] has a row for it, escapes likewise for a context alone."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """counts has (order, gram, n) of each language, of all orders."""
        self.langs = langs
        self.entries: list[Lookup] = []
        self.contexts: list[Lookup] = []
        self.costs: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        shorter = None
        for order in range(ORDER + 1) if langs else ():
            own = [(codes[orders == order], n[orders == order]) for orders, codes, n in counts]
            grams = np.unique(np.concatenate([c for c, _ in own]))
            contexts = np.unique(grams >> 8)
            below = np.full((len(grams), len(langs)), 8.0)  # bits below the empty context
            if shorter is not None:
                below = shorter[1][np.searchsorted(shorter[0], _low(grams, order - 1))]
            bits, escapes = np.zeros((len(grams), len(langs))), np.zeros((len(contexts), len(langs)))
            for k, (codes, n) in enumerate(own):
                at = np.searchsorted(contexts, codes >> 8)
                total, kinds = (np.bincount(at, w, len(contexts)) for w in (n, None))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escapes[:, k] = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
                bits[:, k] = below[:, k] + escapes[np.searchsorted(contexts, grams >> 8), k]
                bits[np.searchsorted(grams, codes), k] = -np.log2(n / (total + kinds)[at])
            self.entries.append(Lookup(grams))
            self.contexts.append(Lookup(contexts))
            self.costs.append(self._steps(bits))
            self.escapes.append(self._steps(escapes))
            shorter = (grams, bits)

    @staticmethod
    def _steps(bits: np.ndarray) -> np.ndarray:
        return np.minimum(np.rint(bits * STEPS), 65535).astype(np.uint16)

    def bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths in 1/STEPS bits, by text and language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)), np.int64)
        if not len(raw):
            return out
        grams = _grams(raw, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        left = np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            codes = _low(grams[left], order)
            found = self.entries[order](codes)
            hit = found >= 0
            self._add(out, row[left[hit]], self.costs[order][found[hit]])
            left, codes = left[~hit], codes[~hit]
            if not len(left):
                break
            context = self.contexts[order](codes >> 8)
            known = context >= 0
            self._add(out, row[left[known]], self.escapes[order][context[known]])
        if len(left):
            self._add(out, row[left], np.full((len(left), len(self.langs)), 8 * STEPS, np.uint16))
        return out

    @staticmethod
    def _add(out: np.ndarray, row: np.ndarray, costs: np.ndarray) -> None:
        """Adds costs to their rows, which ascend."""
        if len(row):
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            out[row[first]] += np.add.reduceat(costs, first, axis=0, dtype=np.int64)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = LEARNED) -> Model:
    """The model of the documents with a language that are not held out, about `most` of each language.

    Null texts and languages, and null ids, are not learned from; repeated rows count again. Empty texts add nothing, long ones
    are counted whole. An empty table gives a model without languages.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null").filter(~held_out(F.col("id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    langs = sorted(sizes)
    if not langs:
        return Model([], [])
    share = F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(int(min(1.0, most / sizes[k]) * (1 << 30))))))
    part = rows.filter(F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(1 << 30)) < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for lang in np.unique(names).tolist():
                raw, offsets = text_buffer(batch.column(1).filter(pa.array(names == lang)))
                for lo, hi in chunks(offsets):
                    grams = _grams(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    for order in range(ORDER + 1):
                        codes, n = np.unique(_low(grams, order), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), lang, np.int32)), pa.array(np.full(len(codes), order, np.int32)), pa.array(codes), pa.array(n.astype(np.int64))], ["lang", "place", "code", "n"])

    number = F.create_map(*(x for k, name in enumerate(langs) for x in (F.lit(name), F.lit(k))))
    summed = part.select(number[F.col("lang")].alias("lang"), "text").mapInArrow(count, "lang int, place int, code long, n long").groupBy("lang", "place", "code").agg(F.sum("n").alias("n"))
    summed = park(summed.filter((F.col("place") <= 2) | (F.col("n") >= LEAST)))
    # Entries by the count that they have; so many as the model may hold are taken, those of short contexts all.
    sizes_of = {r.m: r.n for r in summed.filter("place > 2").groupBy(F.least("n", F.lit(1000)).alias("m")).agg(F.count_distinct("place", "code").alias("n")).collect()}  # a thousand rows at most
    least, room = 1000, CELLS // len(langs)
    while least > LEAST and sum(n for m, n in sizes_of.items() if m >= least - 1) <= room:
        least -= 1
    got = summed.filter((F.col("place") <= 2) | (F.col("n") >= least)).toArrow()  # bounded by CELLS
    lang, order, code, n = (got.column(c).to_numpy() for c in ("lang", "place", "code", "n"))
    return Model(langs, [(order[lang == k], code[lang == k], n[lang == k].astype(np.float64)) for k in range(len(langs))])


def predict(text: Column | str, model: Model, spark: SparkSession) -> Column:
    """struct(lang_pred, score): the language of the shortest code (the first by name of equal ones) and its share.

    The share is 2^-bits of the language over the sum of all languages', for the mean text of 1,000 bytes at most. A null
    text, one without a letter, and any text where nothing was learned is `und` with score 0. Rows are judged one by one by
    their text alone, so repeated rows, null ids and other columns make no difference; an empty table gives an empty one.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], dtype=object)
        for batch in texts:
            raw_all, offsets_all = text_buffer(batch)
            best, score = np.full(len(batch), len(m.langs)), np.zeros(len(batch))
            for lo, hi in chunks(offsets_all):
                base = offsets_all[lo]
                raw, offsets = raw_all[base : offsets_all[hi]], offsets_all[lo : hi + 1] - base
                heads = np.concatenate(([0], np.cumsum(_LETTER[raw])))[offsets]
                lettered = np.diff(heads) > 0
                for k in np.flatnonzero(~lettered & (np.diff(offsets) > 0)):
                    lettered[k] = any(c.isalpha() for c in batch[lo + int(k)].as_py())
                if m.langs:
                    bits = m.bits(raw, offsets) / STEPS
                    pick = bits.argmin(axis=1)
                    span = np.maximum(1.0, np.diff(offsets) / 1000)[:, None]
                    p = 1 / np.exp2(np.maximum(-1000, -(bits - bits.min(axis=1, keepdims=True)) / span)).sum(axis=1)
                    best[lo:hi] = np.where(lettered, pick, len(m.langs))
                    score[lo:hi] = np.where(lettered, p, 0.0)
            yield pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["lang_pred", "score"])

    return of(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), model, spark).alias("p")).select("doc_id", "held_out", "p.*")


QUERIES = {"op7_ppm_language": query}
