"""Token-ID output: documents as ids of a public tokenizer, in checksummed blocks of a context-mixing range coder.

Documents are dealt out by ranges of doc_id and encoded in this order. A file (Parquet as the container) has rows of whole
documents, about SEGMENT ids each: their doc_ids and numbers of ids, the vocabulary's bits, and the coded blocks with their checksums. Every row
can be decoded by itself, and every block of it as well. `start` follows from the files' sums, so no task sees all.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder
from .base import CHUNK_BYTES, byte_map, chunks, if_small, park, shared_dir, span_hashes, table, text_buffer, word_spans

END_ID = 2
#: Ids of a row of the file format; a longer document is a row of its own.
SEGMENT = 1 << 21
#: Words whose ids a worker keeps.
KEPT_WORDS = 1_000_000

FORMAT = "part int, segment int, id_bits int, doc_ids array<long>, n_tokens array<int>, blocks array<binary>, checks array<long>"


def default_tokenizer() -> str:
    """The path of the tokenizer file that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: 1 for letters, 2 for ASCII punctuation but the apostrophe.
_SIDE = np.zeros(256, np.uint8)
_SIDE[0x41:0x5B] = _SIDE[0x61:0x7B] = 1
_SIDE[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = 2
#: First byte of the letters U+00C0 to U+00FF; what follows it in capitals, and in letters (all but two signs).
_LEAD = 0xC3
_CAPITAL, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[0x80:0x9F], _LETTER[0x80:0xC0] = True, True
_CAPITAL[0x97] = _LETTER[[0x97, 0xB7]] = False
#: Bytes as the characters that a byte-level vocabulary writes them with.
_BYTE_CHARS = {k: chr(k) if 0x21 <= k <= 0x7E or 0xA1 <= k <= 0xAC or k >= 0xAE else chr(256 + n) for n, k in enumerate(sorted(range(256), key=lambda k: 0x21 <= k <= 0x7E or 0xA1 <= k <= 0xAC or k >= 0xAE))}
_id_of = attrgetter("id")
_LETTERS = re.compile("(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
# The settings of a tokenizer whose words WordEncoder can encode one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


def plain_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the bytes in lower case, the places of bytes that stand for other than ASCII and U+00C0 to U+00FF, where words can be cut).

    Letters beyond U+00FF stay as they are. A word is cut between a letter up to U+00FF and ASCII punctuation but the
    apostrophe: the tokenizer's pattern never joins them, and no composition goes over that border.
    """
    low, side = byte_map(raw, _LOWER), byte_map(raw, _SIDE)
    beyond = raw >= 0x80
    if beyond.any():
        lead = np.flatnonzero(raw[:-1] == _LEAD)
        after = raw[lead + 1]
        low[lead + 1] += _CAPITAL[after] * np.uint8(0x20)
        side[lead] = side[lead + 1] = _LETTER[after]
        beyond[lead] = beyond[lead + 1] = False
    return low, np.flatnonzero(beyond), np.flatnonzero(side[1:] * side[:-1] == 2) + 1


class WordEncoder:
    """Ids of whole texts.

    A tokenizer that composes (NFC), puts in lower case, drops white space, and splits by the pattern above joins neither
    over white space nor over the border of letters and punctuation. So each word between these has its ids, whatever
    stands beside it, and is encoded once. Lower case comes first only in words without characters beyond U+00FF, where
    composition changes nothing: it would change the others' ids (with combining marks, for one). Words of letters up to
    U+00FF are one piece of the pattern, and go to the tokenizer's model at once. Other tokenizers get whole texts.

    Words are known by a 64-bit hash of their bytes and are not compared by bytes: of n different words of a task two have
    the same hash once in 2^65 / n^2 times. Hashes lie in two tables of slots, by one or the other half of their bits.
    """

    SLOTS = 1 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, int(self.tokenizer.get_vocab_size() - 1).bit_length())
        settings = json.loads(self.tokenizer.to_str())
        level = {k: v for k, v in (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])[-1].items() if k != "trim_offsets"}
        self.by_word = settings["normalizer"] == _NORMALIZER and (settings["pre_tokenizer"] or {}).get("pretokenizers", [None])[0] == _SPLIT and level == _BYTE_LEVEL and settings["model"]["type"] == "BPE"
        #: Added tokens are looked for in whole texts; texts where their first characters come up are encoded whole.
        self.added = [t["content"][:2].encode() for t in settings["added_tokens"]]
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.place = np.zeros(2 * self.SLOTS, np.uint64), np.zeros(2 * self.SLOTS, np.int32)
        self.further: dict[int, int] = {}  # hashes whose slots are taken
        self.ids, self.end = np.zeros(1 << 20, np.int32), 0  # of all known words, one after the other
        self.start, self.size, self.n = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64), 0

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of single words, one after the other, and the words' numbers of ids."""
        told, plain = self.tokenizer.model.tokenize, _LETTERS.fullmatch
        texts = [w.decode("latin-1") for w in words]
        pieces = [told(x.translate(_BYTE_CHARS)) if plain(x) else None for x in texts]
        others = [k for k, x in enumerate(pieces) if x is None]
        found = [x.ids for x in self.tokenizer.encode_batch_fast([words[k].decode() for k in others], add_special_tokens=False)]
        for k in others:
            pieces[k] = ()
        size = np.fromiter(map(len, pieces), np.int64, len(words))
        ids = np.fromiter(map(_id_of, chain.from_iterable(pieces)), np.int32, int(size.sum()))
        if others:
            at = np.cumsum(size)[others]
            size[others] = [len(x) for x in found]
            ids = np.insert(ids, np.repeat(at, size[others]), np.fromiter(chain.from_iterable(found), np.int32))
        return ids, size

    def _add(self, words: list[bytes]) -> np.ndarray:
        """The places of new words."""
        got, size = self._encode(words)
        places, ends = np.arange(self.n, self.n + len(words)), self.end + np.cumsum(size)
        while self.n + len(words) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while ends[-1] > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.end : ends[-1]] = got
        self.start[places], self.size[places] = ends - size, size
        self.end, self.n = int(ends[-1]), self.n + len(words)
        return places

    def _keep(self, hashes: np.ndarray, places: np.ndarray) -> None:
        """Puts new hashes into free slots of the first table, then of the second, then aside."""
        for table in (0, 1):
            slot = self._slots(hashes, table)
            free = np.flatnonzero(self.hashes[slot] == 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.hashes[slot[free]], self.place[slot[free]] = hashes[free], places[free]
            left = np.ones(len(hashes), bool)
            left[free] = False
            hashes, places = hashes[left], places[left]
        self.further.update(zip(hashes.tolist(), places.tolist(), strict=True))

    def _slots(self, hashes: np.ndarray, table: int) -> np.ndarray:
        return ((hashes >> np.uint64(32 * table)) & np.uint64(self.SLOTS - 1)).astype(np.int64) + table * self.SLOTS

    def _places(self, data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Where the words' ids stand; new words are encoded."""
        slot = self._slots(hashes, 0)
        places = self.place.take(slot).astype(np.int64)
        open_ = np.flatnonzero(self.hashes.take(slot) != hashes)
        if len(open_):
            slot = self._slots(hashes[open_], 1)
            places[open_] = self.place.take(slot)
            open_ = open_[self.hashes.take(slot) != hashes[open_]]
        if len(open_):
            own, first, back = np.unique(hashes[open_], return_index=True, return_inverse=True)
            found = np.fromiter((self.further.get(h, -1) for h in own.tolist()), np.int64, len(own))
            new = np.flatnonzero(found < 0)
            if len(new):
                at = open_[first[new]]
                found[new] = self._add([data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                self._keep(own[new], found[new])
            places[open_] = found[back]
        return places

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a buffer, and each text's offsets in them."""
        if self.n > KEPT_WORDS:
            self._forget()
        data, whole = raw.tobytes(), range(0)
        if not self.by_word:
            whole = range(len(offsets) - 1)
        elif any(t in data for t in self.added):
            whole = np.unique(np.searchsorted(offsets, [m.start() for t in self.added for m in re.finditer(re.escape(t), data)], side="right") - 1).tolist()
        ids, at = self._by_word(raw, offsets) if self.by_word else (np.zeros(0, np.int32), np.zeros(len(offsets), np.int64))
        if len(whole):
            parts = np.split(ids, at[1:-1])
            for k, x in zip(whole, self.tokenizer.encode_batch_fast([data[offsets[k] : offsets[k + 1]].decode() for k in whole], add_special_tokens=False), strict=True):
                parts[k] = np.array(x.ids, np.int32)
            ids, at = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return ids, at

    def _by_word(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, beyond, cuts = plain_words(raw) if len(raw) else (raw, raw, None)
        starts, ends, before = word_spans(low, offsets, cuts=cuts)
        for k in np.unique(np.searchsorted(starts, beyond, side="right")).tolist() if len(beyond) else ():
            low[starts[k - 1] : ends[k - 1]] = raw[starts[k - 1] : ends[k - 1]]
        hashes = span_hashes(low, starts, ends)
        hashes |= hashes == 0  # 0 is a free slot
        of_word = self._places(low.tobytes(), starts, ends, hashes)
        n = self.size[of_word]
        stops = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(self.start[of_word] - stops[:-1], n) + np.arange(stops[-1])]
        return ids, stops[before]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder: a worker keeps the words that it knows from one task to the next."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Writes all documents to path, in ascending order of ids.

    Null ids come first; repeated ids all stay, in any order. A null or empty text is the end id alone, an empty table no
    row. A document of more than SEGMENT ids is a row of its own, coded LANES blocks at a time; other columns are not used.
    """
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = encoder(tokenizer), TaskContext.get().partitionId()
        names: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        segment = total = 0

        def row() -> pa.RecordBatch:
            blocks, checks = range_coder.encode(np.concatenate(held), bits=words.bits)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64()))
            values = ([part], [segment], [words.bits], [names], [sizes], [blocks], [checks])
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "segment", "id_bits", "doc_ids", "n_tokens", "blocks", "checks"])

        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for lo, hi in chunks(offsets, 2 * CHUNK_BYTES):
                ids, at = words.encode(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for k in range(hi - lo):
                    own = ids[at[k] : at[k + 1]]
                    if total and total + len(own) + 1 > SEGMENT:
                        yield row()
                        segment, total, names, sizes, held = segment + 1, 0, [], [], []
                    names.append(batch.column(0)[lo + k].as_py())
                    sizes.append(len(own) + 1)
                    held.append(np.append(own, np.int32(end_id)))
                    total += len(own) + 1
        if total:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(pack, FORMAT).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(part, segment, k, doc_id, n_tokens, ids binary: 32-bit little-endian) of all documents in the files."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes = r["n_tokens"]
                raw = range_coder.decode(r["blocks"], r["checks"], sum(sizes), bits=r["id_bits"]).astype("<u4").tobytes()
                ends = np.cumsum(sizes).tolist()
                ids = [raw[4 * (b - n) : 4 * b] for b, n in zip(ends, sizes, strict=True)]
                m = len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * m, pa.int32()), pa.array([r["segment"]] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(sizes, pa.int32()), pa.array(ids, pa.binary())], ["part", "segment", "k", "doc_id", "n_tokens", "ids"])

    return spark.read.schema(FORMAT).parquet(path).mapInArrow(unpack, "part int, segment int, k int, doc_id long, n_tokens int, ids binary")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, decoded from the files; a file that is damaged is an error, one without rows has none.

    Documents of equal or null ids each have a row. Where a segment begins is summed up within its part and over the parts.
    """

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes = r["n_tokens"]
                raw = range_coder.decode(r["blocks"], r["checks"], sum(sizes), bits=r["id_bits"]).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes, strict=True)]
                m = len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * m, pa.int32()), pa.array([r["segment"]] * m, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(ends - np.array(sizes), pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"])

    files = spark.read.schema(FORMAT).parquet(path)
    sums = files.select("part", "segment", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    earlier = (Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each task that wrote
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("parts_before"))
    where = sums.withColumn("n", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("segment").rowsBetween(*earlier)), F.lit(0)))
    where = if_small(park(where.join(parts, "part").select("part", "segment", (F.col("parts_before") + F.col("n")).alias("before"))))
    rows = files.mapInArrow(crc, "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(where, ["part", "segment"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: where each document's ids stand in the files, and their checksum."""
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_blocks(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return digest(spark, path)


QUERIES = {"op2_range_coded_tokens": query}
