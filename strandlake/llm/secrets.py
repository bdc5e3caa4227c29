"""Secret scans: fixed patterns, and a battery of randomness tests for long tokens.

A token's encoding is inferred from its characters. Three tests look at it: whether its letters are spread evenly over
the alphabet (chi-squared), whether its character classes alternate as often as chance would have it (runs), and whether
neighbours are related (serial correlation). Ordinary words fail the first: their letters follow the corpus's counts. So
the p-value of a token is the chance that ordinary text of its length is spread as evenly as it is; the other two tests
must not reject randomness. Tokens are called secret by Benjamini-Hochberg within classes of similar length, over all
tokens of all documents, so that short tokens, of which there are most, do not cost the long ones their power.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import park, table, text_buffer

#: Shortest token that is tested.
SHORTEST = 20
#: Share of false discoveries.
FALSE_SHARE = 0.01
#: Randomness is rejected by runs or correlation below this.
REJECT = 0.005
#: -log10 p in whole steps of 1 / STEPS.
STEPS = 20
MOST_STEP = 40 * STEPS

KINDS = ("assign", "access", "hex", "random")
# Patterns over bytes.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"[0-9a-f]{16,}")
TOKEN = re.compile(rb"[A-Za-z0-9+/_-]{%d,}" % SHORTEST)
# Alphabets of the encodings, from small to large.
ALPHABETS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36_upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64url", "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
    ("mixed", "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
)
_INDEX = [np.array([a.find(chr(b)) for b in range(256)]) for _, a in ALPHABETS]
_CLASS = np.zeros(256, np.int8)
_CLASS[[*range(0x61, 0x7B)]] = 1
_CLASS[[*range(0x41, 0x5B)]] = 2
_CLASS[[*range(0x30, 0x3A)]] = 3


def byte_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each byte stands in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for batch in batches:
            n += np.bincount(text_buffer(batch.column(0))[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(n)], ["byte", "n"])

    got = texts.select(F.col(text_col)).mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(256, np.int64)
    out[got["byte"].to_numpy()] = got["n"].to_numpy()
    return out


def _normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


class Battery:
    """The tests, with the letter shares of ordinary text for each alphabet."""

    def __init__(self, counts: np.ndarray):
        self.sums = []
        for _, a in ALPHABETS:
            q = counts[[ord(c) for c in a]] + 1.0
            q /= q.sum()
            self.sums.append((float((q**2).sum()), float((q**3).sum())))

    def step(self, token: bytes) -> int:
        """-log10 of the p-value in steps, or -1 where randomness is rejected."""
        b = np.frombuffer(token, np.uint8)
        for index, (q2, q3) in zip(_INDEX, self.sums, strict=True):
            at = index[b]
            if at.min() >= 0:
                break
        else:
            return -1
        n, k = len(b), int(index.max()) + 1
        o = np.bincount(at, minlength=k)
        pairs = float((o * (o - 1)).sum())  # chi-squared against an even spread is k / n * (pairs + n) - n
        mean = n * (n - 1) * q2
        var = 4 * n * (n - 1) * (n - 2) * (q3 - q2 * q2) + 2 * n * (n - 1) * (q2 - q2 * q2)
        p = _normal_below((pairs - mean) / math.sqrt(max(var, 1e-9)))
        chi = k / n * (pairs + n) - n
        too_uneven = _normal_below(((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))) > 1 - REJECT
        if too_uneven or self._runs(at, k) < REJECT or self._serial(at) < REJECT:
            return -1
        return min(MOST_STEP, int(-math.log10(max(p, 1e-300)) * STEPS))

    @staticmethod
    def _runs(at: np.ndarray, k: int) -> float:
        """Two-sided p of the number of runs above and below the middle of the alphabet."""
        high = at >= k / 2
        n, a = len(high), int(high.sum())
        b = n - a
        if a == 0 or b == 0:
            return 2.0 ** (1 - n)
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((high[1:] != high[:-1]).sum())
        return 2 * _normal_below(-abs(runs - mean) / math.sqrt(max(var, 1e-9)))

    @staticmethod
    def _serial(at: np.ndarray) -> float:
        """Two-sided p of the correlation of neighbours."""
        x = at - at.mean()
        total = float((x * x).sum())
        if total == 0:
            return 0.0
        n = len(x)
        r = float((x[1:] * x[:-1]).sum()) / total
        return 2 * _normal_below(-abs(r + 1 / n) * math.sqrt(n))


def length_class(n: int) -> int:
    """Classes of lengths, four for each doubling."""
    return int(math.log2(n) * 4)


def _points(raw: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
    """Places of bytes as places of code points."""
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [heads[x] for x in places]


def scan(text: Column | str, battery: Battery) -> Column:
    """struct(base, tokens): spans (kind, start, end) by the patterns, and tokens with their length class and step.

    Positions are code points, ends are exclusive; a null text has none. Tokens that overlap a base span are marked.
    """
    span = "struct<kind:int,start:int,stop:int>"

    @F.arrow_udf(f"struct<base:array<{span}>,tokens:array<struct<start:int,stop:int,class:int,step:int,clear:boolean>>>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
        token = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("class", pa.int32()), ("step", pa.int32()), ("clear", pa.bool_())])
        for batch in texts:
            raw, offsets = text_buffer(batch)
            base: list[list[dict]] = [[] for _ in range(len(batch))]
            tokens: list[list[dict]] = [[] for _ in range(len(batch))]
            for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                data = raw[a:b].tobytes()
                found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 12]
                found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data)]
                found += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
                found.sort()
                marks = [m.span() for m in TOKEN.finditer(data)]
                spans = np.array([(s, e) for s, _, e in found], np.int64).reshape(-1, 2)
                places = np.array(marks, np.int64).reshape(-1, 2)
                points, at = (spans, places) if data.isascii() else _points(raw[a:b], spans, places)
                base[r] = [{"kind": k, "start": s, "stop": e} for (_, k, _), (s, e) in zip(found, points.tolist(), strict=True)]
                # A token is clear if of the spans that begin before its end, none ends after its start.
                furthest = np.append(np.maximum.accumulate(spans[:, 1]), 0)
                clear = furthest[np.searchsorted(spans[:, 0], places[:, 1]) - 1] <= places[:, 0]
                tokens[r] = [{"start": s, "stop": e, "class": length_class(y - x), "step": battery.step(data[x:y]), "clear": c} for (s, e), (x, y), c in zip(at.tolist(), marks, clear.tolist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array(base, pa.list_(kind)), pa.array(tokens, pa.list_(token))], ["base", "tokens"])

    return of(text)


def lowest_steps(counts: dict[int, dict[int, int]], share: float = FALSE_SHARE) -> dict[int, int]:
    """For each length class the smallest step that Benjamini-Hochberg calls secret; a class without any has none."""
    out = {}
    for cls, by_step in counts.items():
        total, above = sum(by_step.values()), 0
        for step in sorted((s for s in by_step if s >= 0), reverse=True):
            above += by_step[step]
            if 10 ** (-step / STEPS) <= share * above / total:
                out[cls] = step
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FALSE_SHARE) -> DataFrame:
    """(id, base, found): spans by the patterns, and all spans, sorted by start and kind.

    One row for each row of docs, repeated and null ids included; other columns are not used. Null and empty texts have no
    span, an empty table no row. Equal p-values are called secret together. Texts are read twice: for the corpus's letters,
    and by the scan; a text takes time and memory in proportion to its length.
    """
    battery = Battery(byte_counts(docs, text_col))
    seen = park(docs.select(F.col(id_col).alias("id"), scan(F.col(text_col), battery).alias("s")).select("id", "s.base", "s.tokens"))
    tested = seen.select(F.explode("tokens").alias("t")).groupBy("t.class", "t.step").agg(F.count("*").alias("n")).collect()  # classes x steps
    counts: dict[int, dict[int, int]] = {}
    for r in tested:
        counts.setdefault(r["class"], {})[r["step"]] = r["n"]
    lowest = lowest_steps(counts, share)
    never = MOST_STEP + 1

    def from_class(t: Column) -> Column:
        if not lowest:
            return F.lit(never)
        return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in lowest.items() for x in kv)), t["class"]), F.lit(never))

    secret = F.filter("tokens", lambda t: t["clear"] & (t["step"] >= from_class(t)))
    added = F.transform(secret, lambda t: F.struct(F.lit(3).alias("kind"), t["start"].alias("start"), t["stop"].alias("stop")))
    by_start = F.transform(F.array_sort(F.transform(F.concat("base", added), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return seen.select("id", "base", by_start.alias("found"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: counts and spans of every document."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    n = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select(F.col("id").alias("doc_id"), *n, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))


QUERIES = {"op9_randomness_battery": query}
