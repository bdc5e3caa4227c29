"""A context-mixing range coder for token ids, over many blocks at once.

A block is coded from nothing: no statistics pass from one block to the next. Blocks run in step, one id of each at a
time and LANES blocks at most, so every line below works on an array with one entry a block.

Within a block an id is known by its slot: the ids that the block has had, in order of their first appearance. Three
predictions are mixed:

- order 2 and order 1: the slot that last followed the same two slots, or the same one, each with a confidence;
- order 0: counts of all slots of the block so far, with an escape for ids that have none.

For every pair of confidences the block learns weights of the three orders from how often each was right; they split the
range in three. The order-0 part goes to the slots by their counts (first seen: 1, then 2 for each time) and to the escape
by the number of slots. A new id is told by octaves, low ids being likelier, as merges are numbered by their frequency.

The block learns at `_renewals`, at every eighth to quarter of its way, and between them its statistics stand still. So the
encoder takes up all ids of such a span at once, and the decoder has the fewest steps for each id. An id that is new since
the last renewal takes the escape each time, and a slot each time.

All of it is one step of the arithmetic coder: a range of 64 bits of which 16 are sent on when it has become small; a
carry runs back into the words that were sent. Ids above 65,535 have their upper bits in a second step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

#: Ids of a block.
BLOCK = 1024
#: Blocks that run in step; memory is some 20 KB for each of them.
LANES = 2048
#: Ids of each block that are taken up at once.
SPAN = 16
#: Bits of the split in three, and of what the coder divides.
MIX, FINE = 12, 20
ONE, ALL = 1 << MIX, 1 << (MIX + FINE)
#: Most that the orders 2 and 1 get together.
MOST = ONE - 66
#: Added to the escape.
ESCAPE = 16
_OCTAVES, _LOW = 9, 16
_SLOTS2 = 1 << 9
_SMALL, _FULL = np.uint64(1 << 48), np.uint64(2**64 - 1)
_16, _32, _48 = np.uint64(16), np.uint64(32), np.uint64(48)
#: Confidences of a prediction: 0 to 3 hits.
_SURE = 3
#: How often, of 16 times, the better order is right by its confidence: what a block knows before it has learned.
_FIRST = np.array([1, 6, 10, 13], np.int64)


def _renewals(block: int) -> list[int]:
    """Where in a block the shares of the slots are taken anew: after 4, 8, 12 and 16 ids, then four times for each doubling."""
    out, t = [], 4
    while t < block:
        out.append(t)
        t += max(4, 1 << (t.bit_length() - 3))
    return out


def _stride(n: int) -> int:
    """Room for n 16-bit numbers in an odd number of cache lines, so that the same place of many blocks does not fall on the same few lines of the cache."""
    return 32 * (-(-n // 32) | 1)


class _Model:
    """Predictions, counts and weights of n blocks.

    Predictions are (slot + 1) * 4 + confidence; 0 predicts nothing. Arrays of ids, slots and the like have a row for each
    id of a span and a column for each block, or are one such row.
    """

    def __init__(self, n: int, block: int):
        if not 0 < block <= 4000:
            raise ValueError("a block has 1 to 4,000 ids")
        at, wide, wide2 = np.arange(n), _stride(block), _stride(_SLOTS2)
        self.at1, self.at2, self.at16 = at * wide, at * wide2, at * 16
        self.table1, self.table2 = np.zeros(n * wide, np.int16), np.zeros(n * wide2, np.int16)
        self.counts = np.zeros((n, wide), np.uint16)
        #: Counts before a slot and its own count, at the last renewal.
        self.shares = np.zeros((n, wide, 2), np.uint16)
        self.kinds, self.seen, self.total = np.zeros(n, np.int64), np.zeros(n, np.int64), ESCAPE
        #: How often the orders were tried, and order 2 or else order 1 was right: 20 bits each.
        first2, first1 = _FIRST[:, None], (16 - _FIRST)[:, None] * _FIRST // 16
        self.outcomes = np.tile((16 + (first2 << 20) + (first1 << 40)).reshape(-1), n)
        self._weigh()

    def _weigh(self) -> None:
        tried, two, one = self.outcomes & 0xFFFFF, (self.outcomes >> 20) & 0xFFFFF, self.outcomes >> 40
        unit = ((MOST << FINE) / tried).astype(np.int64)
        end2 = unit * two + ONE
        self.ends = end2 << 32 | end2 + unit * one + ONE

    def predict(self, last: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order 1, order 2, weights' places, ends of the parts of order 2 and order 1, unit of order 0) after the slots at `last`."""
        e1, e2 = self.table1.take(last), self.table2.take(k2)
        w = self.at16 + (((e2 & _SURE) << 2) + (e1 & _SURE))
        ends = self.ends.take(w)
        end1 = ends & 0xFFFFFFFF
        return e1, e2, w, (ends >> 32) & 0xFFFFFFFF, end1, (ALL - end1) // self.total

    def part(self, at: np.ndarray, end1: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and share of the slots at `at` where order 0 tells them."""
        share = self.shares.view(np.uint32).reshape(-1).take(at).astype(np.int64)
        start = unit * (share & 0xFFFF)
        start += end1
        share >>= 16
        share *= unit
        return start, share

    def learn(self, slots: np.ndarray, at: np.ndarray, last: np.ndarray, k2: np.ndarray, e1: np.ndarray, e2: np.ndarray, w: np.ndarray, new: np.ndarray) -> None:
        """Takes in a span. Where a place comes again, its last row counts."""
        told = ((slots + 1) << 2).astype(np.int16)
        hit1, hit2 = (e1 ^ told) <= _SURE, (e2 ^ told) <= _SURE
        self.table1[last] = np.where(hit1, np.minimum(e1 + 1, told + _SURE), told)
        self.table2[k2] = np.where(hit2, np.minimum(e2 + 1, told + _SURE), told)
        np.add.at(self.outcomes, w.reshape(-1), (1 + (hit2.astype(np.int64) << 20) + ((hit1 > hit2).astype(np.int64) << 40)).reshape(-1))
        np.add.at(self.counts.reshape(-1), at.reshape(-1), (np.uint16(2) - new).reshape(-1))

    def renew(self, t: int, kinds: np.ndarray) -> None:
        """From here on the first t ids count; kinds are the blocks' slots."""
        self._weigh()
        most = int(kinds.max())
        counts = self.counts[:, :most]
        self.shares[:, 1:most, 0] = np.cumsum(counts[:, :-1], axis=1, dtype=np.uint16)
        self.shares[:, :most, 1] = counts
        self.seen, self.total = 2 * t - kinds, 2 * t + ESCAPE

    def slot_of_count(self) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each count of all blocks, and where each block's begin."""
        most = int(self.counts.any(axis=0).sum())
        return np.repeat(np.tile(np.arange(most, dtype=np.uint16), len(self.counts)), self.counts[:, :most].reshape(-1)), np.cumsum(self.seen) - self.seen


def _hash(slot: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The place of two slots in table 2."""
    return (slot * 389 + before * 71) & (_SLOTS2 - 1)


def _spans(block: int, longest: int) -> Iterator[tuple[int, int]]:
    """From one renewal to the next."""
    edges = [0, *(t for t in _renewals(block) if t < longest), longest]
    yield from zip(edges, edges[1:], strict=False)


def _octave(ids: np.ndarray) -> np.ndarray:
    """0 for ids below 256, k for those from 2^(7 + k)."""
    return np.frexp((ids >> 8).astype(np.float64))[1].astype(np.int64)


def _new_part(octave: np.ndarray, offset: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and share of new ids in the escape, which goes from start to ALL."""
    wide = (ALL - start) // _OCTAVES
    share = wide >> (8 + np.maximum(octave - 1, 0))
    return start + octave * wide + offset * share, share


class _Encoder:
    def __init__(self, n: int, longest: int, steps: int):
        wide = _stride((2 * steps + 1) * longest + 8)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, _FULL)
        self.words = np.zeros(n * wide, np.uint16)
        self.first = np.arange(n) * wide
        self.at = self.first.copy()

    def put(self, start: np.ndarray, share: np.ndarray) -> None:
        """Narrows the ranges to parts of 2^32."""
        self.low, self.range, self.at = self._narrow(self.low, self.range, self.at, start, share)

    def put_some(self, which: np.ndarray, start: np.ndarray, share: np.ndarray) -> None:
        self.low[which], self.range[which], self.at[which] = self._narrow(self.low[which], self.range[which], self.at[which], start, share)

    def _narrow(self, old: np.ndarray, wide: np.ndarray, at: np.ndarray, start: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = wide >> _32
        low = r * start.view(np.uint64)
        low += old
        r *= share.view(np.uint64)
        over = np.flatnonzero(low < old)
        if len(over):
            back = at[over] - 1
            while len(back):  # a carry runs on through full words
                self.words[back] += np.uint16(1)
                back = back[self.words[back] == 0] - 1
        # The word is written in any case; where the range is large enough the place is not moved on.
        self.words[at] = low >> _48
        small = r < _SMALL
        at = at + small
        shift = small * _16
        low <<= shift
        r <<= shift
        again = np.flatnonzero(r < _SMALL)
        if len(again):
            self.words[at[again]] = low[again] >> _48
            at[again] += 1
            low[again] <<= _16
            r[again] <<= _16
        return low, r, at

    def done(self, k: int) -> bytes:
        """The words of block k; nothing more may be put there."""
        last = [(int(self.low[k]) >> shift) & 0xFFFF for shift in (48, 32, 16, 0)]
        return self.words[self.first[k] : self.at[k]].astype("<u2").tobytes() + np.array(last, "<u2").tobytes()


class _Decoder:
    def __init__(self, blocks: list[bytes]):
        n, wide = len(blocks), _stride(max(map(len, blocks)) // 2 + 4)
        words = np.zeros((n, wide), np.uint16)
        for k, b in enumerate(blocks):
            words[k, : len(b) // 2] = np.frombuffer(b, "<u2", len(b) // 2)
        w = words[:, :4].astype(np.uint64)
        self.code = (w[:, 0] << _48) | (w[:, 1] << _32) | (w[:, 2] << _16) | w[:, 3]
        self.words, self.range, self.at = words.reshape(-1), np.full(n, _FULL), np.arange(n) * wide + 4
        self.part = self.range >> _32

    def value(self) -> np.ndarray:
        """Where in 2^32 the codes lie."""
        self.part = self.range >> _32
        return (self.code // self.part).view(np.int64)

    def take(self, start: np.ndarray, share: np.ndarray) -> None:
        self.code, self.range, self.at = self._narrow(self.code, self.part, self.at, start, share)

    def take_bits(self, which: np.ndarray, bits: int) -> np.ndarray:
        """The next bits of some blocks."""
        part = self.range[which] >> _32
        found = np.minimum(self.code[which] // part, np.uint64(0xFFFFFFFF)).view(np.int64) >> (32 - bits)
        share = np.full(len(which), 1 << (32 - bits), np.int64)
        self.code[which], self.range[which], self.at[which] = self._narrow(self.code[which], part, self.at[which], found * share, share)
        return found

    def _narrow(self, code: np.ndarray, part: np.ndarray, at: np.ndarray, start: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code = code - part * start.view(np.uint64)
        r = part * share.view(np.uint64)
        small = r < _SMALL
        shift = small * _16
        code <<= shift
        code |= self.words.take(at, mode="clip") * small.view(np.uint8)
        at = at + small
        r <<= shift
        again = np.flatnonzero(r < _SMALL)
        if len(again):
            code[again] = (code[again] << _16) | self.words.take(at[again], mode="clip")
            at[again] += 1
            r[again] <<= _16
        return code, r, at


def _slots(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each id of a row (a block), and whether it takes the escape."""
    n, width = ids.shape
    order = np.argsort(ids, axis=1, kind="stable")
    order += np.arange(n)[:, None] * width
    order = order.reshape(-1)
    ordered = ids.reshape(-1).take(order).reshape(n, width)
    starts = np.ones((n, width), bool)
    np.not_equal(ordered[:, 1:], ordered[:, :-1], out=starts[:, 1:])
    starts = np.flatnonzero(starts)
    first = np.empty(n * width, np.int32)  # the first place of the same id in the block
    first[order] = np.repeat(order[starts], np.diff(np.append(starts, n * width)))
    window = np.searchsorted(_renewals(block), np.arange(width), side="right").astype(np.int16)
    new = np.tile(window, n) == np.tile(window, n).take(first)
    rank = (np.cumsum(new.reshape(n, width), axis=1, dtype=np.int32) - 1).reshape(-1)
    return np.where(new, rank, rank.take(first)).reshape(n, width), new.reshape(n, width)


def _groups(total: int, block: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first id, first block, lengths) of the blocks that run in step; only the very last one may be short."""
    for at in range(0, total, block * LANES):
        some = min(total - at, block * LANES)
        lengths = np.full(-(-some // block), block)
        lengths[-1] = some - block * (len(lengths) - 1)
        yield at, at // block, lengths


def _upper_bits(bits: int) -> int:
    if not 0 < bits <= 32:
        raise ValueError("ids have 1 to 32 bits")
    return max(0, bits - _LOW)


def encode(ids: np.ndarray, block: int = BLOCK, bits: int = 16) -> tuple[list[bytes], list[int]]:
    """The blocks of a run of ids below 2^bits (32 at most), and the crc32 of each block's ids as 32-bit little-endian numbers."""
    upper = _upper_bits(bits)
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or int(ids.max()) >> max(bits, _LOW)):
        raise ValueError(f"ids must be below 2^{max(bits, _LOW)} and not negative")
    ids = ids.astype(np.uint32 if upper else np.uint16)
    blocks: list[bytes] = []
    checks: list[int] = []
    for at, _, lengths in _groups(len(ids), block):
        own = ids[at : at + int(lengths.sum())]
        blocks += _encode(own, lengths, block, upper)
        raw = own.astype("<u4").tobytes()
        checks += [zlib.crc32(raw[4 * block * k : 4 * (block * k + n)]) for k, n in enumerate(lengths.tolist())]
    return blocks, checks


def _encode(ids: np.ndarray, lengths: np.ndarray, block: int, upper: int) -> list[bytes]:
    lanes, longest = len(lengths), int(lengths[0])
    padded = np.zeros(lanes * longest, ids.dtype)  # a short last block goes on with zeros, which come after its end
    padded[: len(ids)] = ids
    padded = padded.reshape(lanes, longest)
    slots, fresh = _slots(padded, block)
    columns, fresh = np.ascontiguousarray(padded.T), np.ascontiguousarray(fresh.T)
    slots = np.concatenate((np.zeros((2, lanes), np.int64), slots.T))  # before the first id stand two times slot 0
    model, out = _Model(lanes, block), _Encoder(lanes, longest, 2 if upper else 1)
    kinds, short = np.zeros(lanes, np.int64), b""
    with np.errstate(over="ignore"):
        for begin, end in _spans(block, longest):
            if begin:
                model.renew(begin, kinds)
            learned = []
            for lo in range(begin, end, SPAN):
                hi = min(end, lo + SPAN)
                slot, new = slots[lo + 2 : hi + 2], fresh[lo:hi]
                at, last = model.at1 + slot, model.at1 + slots[lo + 1 : hi + 1]
                k2 = model.at2 + _hash(slots[lo + 1 : hi + 1], slots[lo:hi])
                e1, e2, w, end2, end1, unit = model.predict(last, k2)
                told = ((slot + 1) << 2).astype(np.int16)
                start, share = model.part(at, end1, unit)
                one, two = ((e1 ^ told) <= _SURE).nonzero(), ((e2 ^ told) <= _SURE).nonzero()
                start[one], share[one] = end2[one], end1[one] - end2[one]
                start[two], share[two] = 0, end2[two]
                row, k = new.nonzero()
                told = columns[lo:hi][row, k].astype(np.int64)
                low = told & 0xFFFF
                octave = _octave(low)
                start[row, k], share[row, k] = _new_part(octave, low - np.where(octave > 0, 128 << octave, 0), end1[row, k] + unit[row, k] * model.seen[k])
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                for t in range(lo, hi):
                    if t == lengths[-1]:
                        short = out.done(lanes - 1)
                    out.put(start[t - lo], share[t - lo])
                    if upper:
                        some = slice(first[t - lo], first[t - lo + 1])
                        part = np.full(some.stop - some.start, 1 << (32 - upper), np.int64)
                        out.put_some(k[some], (told[some] >> _LOW) * part, part)
                kinds += new.sum(axis=0)
                learned.append((slot, at, last, k2, e1, e2, w, new))
            for x in learned:
                model.learn(*x)
    return [*map(out.done, range(lanes - 1)), short or out.done(lanes - 1)]


def decode(blocks: list[bytes], checks: list[int], total: int, block: int = BLOCK, bits: int = 16) -> np.ndarray:
    """The ids of a run; a block whose ids don't have their checksum raises ValueError."""
    upper = _upper_bits(bits)
    if len(blocks) != -(-total // block):
        raise ValueError("the number of blocks does not fit the number of ids")
    out = np.empty(total, np.uint32)
    for at, first, lengths in _groups(total, block):
        own = _decode(blocks[first : first + len(lengths)], lengths, block, upper)
        raw = own.astype("<u4").tobytes()
        for k, n in enumerate(lengths.tolist()):
            if zlib.crc32(raw[4 * block * k : 4 * (block * k + n)]) != checks[first + k]:
                raise ValueError(f"block {first + k} is damaged")
        out[at : at + len(own)] = own
    return out


def _decode(blocks: list[bytes], lengths: np.ndarray, block: int, upper: int) -> np.ndarray:
    lanes, longest = len(lengths), int(lengths[0])
    model, code = _Model(lanes, block), _Decoder(blocks)
    columns = np.zeros((longest + 2, lanes), np.int64)
    known = np.zeros(model.counts.size, np.uint32)
    kinds = np.zeros(lanes, np.int64)
    slot_at, begins = np.zeros(1, np.uint16), kinds
    span = [np.empty((SPAN, lanes), kind) for kind in (np.int64, np.int64, np.int64, np.int16, np.int16, np.int64, bool)]
    learned: list[list[np.ndarray]] = []
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        for begin, end in _spans(block, longest):
            if begin:
                model.renew(begin, kinds)
                slot_at, begins = model.slot_of_count()
            last = model.at1 + columns[begin + 1]
            for t in range(begin, end):
                k2 = model.at2 + _hash(columns[t + 1], columns[t])
                e1, e2, w, end2, end1, unit = model.predict(last, k2)
                v = code.value()
                rest = v - end1
                told_by = (rest < 0).nonzero()[0]
                # Whole quotients below 2^17 of numbers below 2^32: doubles have them exactly.
                value = (rest / unit).astype(np.int64)
                new = value >= model.seen
                new[told_by] = False
                k = new.nonzero()[0]
                slot = columns[t + 2]
                slot[:] = slot_at.take(begins + value, mode="clip")
                slot[k] = kinds.take(k)
                two = v.take(told_by) < end2.take(told_by)
                slot[told_by] = np.maximum((np.where(two, e2.take(told_by), e1.take(told_by)) >> 2) - 1, 0)  # a damaged block must not lead out of the tables
                kinds += new
                at = model.at1 + slot
                start, share = model.part(at, end1, unit)
                low, high = end2.take(told_by), end1.take(told_by)
                start[told_by], share[told_by] = np.where(two, 0, low), np.where(two, low, high - low)
                if len(k):
                    escape = end1.take(k) + unit.take(k) * model.seen.take(k)
                    wide, inside = (ALL - escape) // _OCTAVES, v.take(k) - escape
                    octave = np.minimum(inside // wide, _OCTAVES - 1)
                    size = 8 + np.maximum(octave - 1, 0)
                    offset = np.minimum((inside - octave * wide) // (wide >> size), (1 << size) - 1)
                    start[k], share[k] = _new_part(octave, offset, escape)
                    told = offset + np.where(octave > 0, 128 << octave, 0)
                code.take(start, share)
                if len(k):
                    if upper:
                        told |= code.take_bits(k, upper) << _LOW
                    known[at.take(k)] = told
                row = (t - begin) % SPAN
                for rows, x in zip(span, (at, last, k2, e1, e2, w, new), strict=True):
                    rows[row] = x
                last = at
                if row == SPAN - 1 or t == end - 1:
                    slots = columns[t + 2 - row : t + 3]
                    if end - begin <= SPAN:
                        model.learn(slots, *(rows[: row + 1] for rows in span))
                    else:  # the others of this span must not see it yet
                        learned.append([slots, *(rows[: row + 1].copy() for rows in span)])
            for x in learned:
                model.learn(*x)
            learned.clear()
    return known.take(columns[2:].T + model.at1[:, None]).reshape(-1)[: int(lengths.sum())]
