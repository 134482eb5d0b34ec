"""Passages that repeat across documents, by enhanced suffix arrays.

Every window of `least` bytes belongs to the run of its anchor, the smallest hash of GRAM bytes in it. The windows of a run that reach
far enough to the left of the anchor have one context of bytes in common, the others one to the right; these two halves are the
snippets that suffixes are dealt by: equal windows are in snippets with equal contexts, whatever their documents. Hashes only say where a snippet goes:

1. Documents are dealt to blocks by a hash of id and text. A block sends the hash of each distinct context once, and hears which occur
   in other blocks too, and which of those in very many snippets. A context that occurs once holds no repeat.
2. The snippets of the others are sent as bytes to the part of their context, each distinct one of a block once, with its smallest document and whether it
   has another; those of a context with very many go window by window to the part of the window, so that no context has to fit into
   one task. A part builds the suffix array of its distinct snippets and the longest common prefixes of neighbours, scans the intervals of common
   prefixes of at least `least` bytes with a stack, and keeps those whose suffixes are preceded by different bytes: the maximal repeats, with all their
   occurrences. Equal snippets are one leaf of that tree with its copies counted: the innermost interval there, under the same test. The smallest document of an
   interval marks the windows of the others; nothing else removes a byte.
3. Blocks turn the marks into spans of bytes.

Answers come in the order of what was asked, so positions don't travel. The texts move once; the three passes share that exchange.
`repeat_occurrences` gives the maximal repeats of the parts as a table.

Edge cases: null is the empty text; a text of fewer bytes than `least` keeps all; rows that share an id are one document; a null id is smaller than
any other; ids that aren't integers are numbered in their order first; repeats within one document are kept; bytes are compared as they are, without case folding;
other columns can be carried along and are otherwise ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .ranges import numbered
from .session import bounded_batches, table

LEAST, GRAM = 50, 16
#: Bytes of text in a block, bytes of hashes in a part, and bytes hashed at once.
BLOCK_BYTES, PART_BYTES, PIECE = 4 << 20, 8 << 20, 1 << 18
#: A context in more blocks than this, or in more distinct snippets of one block, goes window by window.
HOT_BLOCKS, HOT_SNIPPETS = 512, 64
#: Suffixes that are sorted at once, and padded bytes of snippets that are.
GROUP, PADDED = 100_000, 16 << 20
U = np.uint64
_LOW = U((1 << 20) - 1)
_NONE = U(2**64 - 1)
_GRAMS, _SPANS = K.byte_values(3), K.byte_values(33)
_C = 0x9FB21C651E98DF25


# ---- enhanced suffix array of one task -------------------------------------------------------------------------


def suffix_array(data: np.ndarray, at: np.ndarray, width: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at data[at : at + width], which zeros close, and the longest common prefix of each with the one before, 0 for one below `least`.

    Suffixes that are equal but for zeros at their ends are told apart by the caller, who knows their lengths.
    """
    n = len(at)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(data, width)[at]  # a copy
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    rows = rows[order]
    words = rows.view("<u8") if width % 8 == 0 else rows
    sure = least // 8 if width % 8 == 0 else 0
    alike = np.flatnonzero((words[1:, :sure] == words[:-1, :sure]).all(1)) + 1
    same = rows[alike] == rows[alike - 1]
    common = np.zeros(n, np.int64)
    common[alike] = np.where(same.all(1), width, same.argmin(1))
    common[common < least] = 0
    return order, common


def padded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, room: int) -> tuple[np.ndarray, int]:
    """The snippets, each followed by at least `room` zeros, one after another at a fixed distance; and that distance."""
    n, width = len(starts), int(lengths.max(initial=0))
    out = np.zeros((n + 1, width + room), np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width + 1, np.uint8)]), width)
    step = max(1, PADDED // max(width, 1))
    for i in range(0, n, step):
        some = view[starts[i : i + step]]
        some[np.arange(width)[None, :] >= lengths[i : i + step, None]] = 0
        out[i : i + step, :width][: len(some)] = some
    return out.ravel(), width + room


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, least: int, leaves: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the maximal repeats of at least `least`: intervals of the suffix array, found by a stack scan of the
    common prefixes, whose suffixes are preceded by different bytes. left: the byte before each suffix in order, -1 for none (unlike any other).

    leaves: for suffixes that stand for several equal ones their length, else 0. The equal ones are the innermost interval there; it is left-diverse only if
    they begin their texts, since copies that begin further in are preceded by the same byte."""
    n = len(lcp)
    if leaves is not None:
        several = np.flatnonzero((leaves >= least) & (left < 0))
        yield from zip(leaves[several].tolist(), several.tolist(), several.tolist(), strict=True)
    unlike = np.zeros(n + 1, np.int64)
    if n > 1:
        unlike[2:] = np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0))
    held = lcp >= least
    starts = np.flatnonzero(held & ~np.concatenate([[False], held[:-1]]))  # the second suffix of each outermost interval
    ends = np.flatnonzero(held & ~np.concatenate([held[1:], [False]]))
    two = starts == ends  # intervals of two suffixes hold no other
    pair = starts[two]
    pair = pair[unlike[pair + 1] > unlike[pair]]
    yield from zip(lcp[pair].tolist(), (pair - 1).tolist(), pair.tolist(), strict=True)
    for s, e in zip(starts[~two].tolist(), ends[~two].tolist(), strict=True):
        stack: list[tuple[int, int]] = []  # (length, first)
        for i, here in enumerate([*lcp[s : e + 1].tolist(), 0], s):
            first = i - 1
            while stack and stack[-1][0] > here:
                length, first = stack.pop()
                if unlike[i] > unlike[first + 1]:
                    yield length, first, i - 1
            if here >= least and (not stack or stack[-1][0] < here):
                stack.append((here, first))


def repeat_groups(texts: list[bytes], least: int = LEAST) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Maximal repeats of a few texts, each with all its (text, start) occurrences: the same steps on whole suffixes."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    width = max(8, -(-int(sizes.max(initial=0)) // 8) * 8)
    data, stride = padded(flat, np.cumsum(sizes) - sizes, sizes, width)
    count = np.maximum(sizes - least + 1, 0)
    of = np.repeat(np.arange(len(texts)), count)
    start = K.aranges(np.zeros(len(texts), np.int64), count)
    order, lcp = suffix_array(data, of * stride + start, width, least)
    of, start = of[order], start[order]
    lcp = _within(lcp, (sizes[of] - start))
    left = np.where(start > 0, data[np.maximum(of * stride + start - 1, 0)].astype(np.int64), -1)
    out = []
    for length, a, b in maximal_repeats(lcp, left, least):
        places = sorted(zip(of[a : b + 1].tolist(), start[a : b + 1].tolist(), strict=True))
        out.append((texts[of[a]][start[a] : start[a] + length], places))
    return sorted(out)


def _within(lcp: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common prefixes no longer than the suffixes themselves."""
    return np.minimum(lcp, np.minimum(lengths, np.concatenate([lengths[:1], lengths[:-1]]))) if len(lcp) else lcp


def distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each distinct snippet, the distinct snippet of each), by the bytes themselves."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = int(lengths.max())
    # Equal snippets are in the same slice, which some of their bytes pick; slices keep the padded bytes few.
    many = max(1, -(-n * (width + 1) // PADDED))
    of = np.zeros(n, np.int64)
    for k in range(0, int(lengths.min()), 5) if many > 1 else ():
        of = (of * 31 + data[starts + k]) % (1 << 40)
    of %= many
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    by = np.argsort(of, kind="stable")
    edge = np.searchsorted(of[by], np.arange(many + 1))
    first, each, have = [], np.zeros(n, np.int64), 0
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        some = by[a:b]
        if not len(some):
            continue
        rows = np.empty((len(some), width + 1), np.uint8)
        rows[:, 0] = lengths[some]  # which tells apart what only padding makes equal
        rows[:, 1:] = view[starts[some]]
        rows[:, 1:][np.arange(width)[None, :] >= lengths[some][:, None]] = 0
        _, once, at = np.unique(rows.view(f"S{width + 1}").ravel(), return_index=True, return_inverse=True)
        first.append(some[once])
        each[some] = at + have
        have += len(once)
    return np.concatenate(first), each


class Snippets:
    """The distinct snippets of a part, the smallest document of each and whether it occurs again, and the repeats among them."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, owner: np.ndarray, again: np.ndarray, least: int):
        self.data, self.least = data, least
        bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        once, self.each = distinct(data, bounds[:-1], lengths)
        self.starts, self.lengths = bounds[once], lengths[once].astype(np.int64)
        n = len(once)
        self.owner = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(self.owner, self.each, owner)
        self.copies = np.bincount(self.each, 1 + again, n).astype(np.int64)

    def repeats(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Groups of maximal repeats (length, first, last, snippet of each suffix in order, start of each suffix in its snippet)."""
        least = self.least
        count = self.lengths - least + 1
        width = -(-int(self.lengths.max(initial=0)) // 8) * 8
        of = np.repeat(np.arange(len(count)), count).astype(np.int32)
        within = K.aranges(np.zeros(len(count), np.int64), count).astype(np.uint8)
        # Suffixes that share `least` bytes are in one group, and a group is sorted in little memory; some of their bytes deal them out and decide nothing.
        groups = max(1, -(-len(of) // GROUP))
        data, stride = padded(self.data, self.starts, self.lengths, width)
        if groups > 1:
            eight = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))  # 8 bytes from each place
            at = of * np.int64(stride) + within
            group = (K.mix(eight[at] * U(31) + eight[at + least - 8]) % U(groups)).astype(np.int32)
            del at
            by = np.argsort(group, kind="stable")
            edges = np.searchsorted(group[by], np.arange(groups + 1))
        else:
            by, edges = np.arange(len(of)), np.array([0, len(of)])
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            snippet, start = of[by[x:y]].astype(np.int64), within[by[x:y]].astype(np.int64)
            order, lcp = suffix_array(data, snippet * stride + start, width, least)
            snippet, start = snippet[order], start[order]
            lcp = _within(lcp, self.lengths[snippet] - start)
            left = np.where(start > 0, data[np.maximum(snippet * stride + start - 1, 0)].astype(np.int64), -1)
            leaves = np.where(self.copies[snippet] > 1, self.lengths[snippet] - start, 0)
            found = np.array(list(maximal_repeats(lcp, left, least, leaves)), np.int64).reshape(-1, 3)
            yield found[:, 0], found[:, 1], found[:, 2], snippet, start

    def smallest(self) -> np.ndarray:
        """For each window of the distinct snippets, in order, the smallest document of the repeats that hold it."""
        count = self.lengths - self.least + 1
        begin = np.concatenate([[0], np.cumsum(count)])
        low = np.full(int(begin[-1]), np.iinfo(np.int64).max)
        for length, first, last, snippet, start in self.repeats():
            if not len(length):
                continue
            owners = self.owner[snippet]
            least = np.minimum.reduceat(np.append(owners, np.iinfo(np.int64).max), np.stack([first, last + 1], 1).ravel())[::2]
            each = K.aranges(first, last - first + 1)
            of = np.repeat(np.arange(len(length)), last - first + 1)
            windows = length[of] - self.least + 1
            np.minimum.at(low, K.aranges(begin[snippet[each]] + start[each], windows), np.repeat(least[of], windows))
        self.begin = begin
        return low


#: The bit of an answer that stands for the other documents of the asking block with this snippet.
_OTHERS = 31


def window_masks(data: np.ndarray, lengths: np.ndarray, owner: np.ndarray, again: np.ndarray, least: int = LEAST) -> np.ndarray:
    """For each snippet, of at most 31 windows, the windows as bits that a repeat with a smaller document than `owner` holds; and
    whether repeats hold all its windows, which is what counts for other documents of the same block (`again`)."""
    part = Snippets(data, lengths, owner, again, least)
    if not len(part.lengths):
        return np.zeros(0, np.uint32)
    low = part.smallest()
    masks = np.zeros(len(lengths), np.uint32)
    step = 1 << 17
    for i in range(0, len(lengths), step):
        d = part.each[i : i + step]
        own, count = owner[i : i + step], part.lengths[d] - least + 1
        window = low[K.aranges(part.begin[d], count)]
        of = np.repeat(np.arange(len(d)), count)
        bit = np.uint32(1) << (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint32)
        cut = np.cumsum(count) - count
        masks[i : i + step] = np.bitwise_or.reduceat(np.where(window < own[of], bit, np.uint32(0)), cut)
        all_held = np.logical_and.reduceat(window <= own[of], cut)
        masks[i : i + step] |= (all_held & again[i : i + step].astype(bool)).astype(np.uint32) << np.uint32(_OTHERS)
    return masks


# ---- runs of a block -----------------------------------------------------------------------------------------


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def halves(data: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, hash of the context) of the half runs."""
    half = (least - GRAM) // 2
    wide = 2 * GRAM if half + 1 >= GRAM else GRAM
    out: list[list[np.ndarray]] = [[], [], [], []]
    for i, j in K.slices(offsets, PIECE):
        for low in range(int(offsets[i]), max(int(offsets[j]) - least + 1, int(offsets[i]) + 1), PIECE):
            high = min(int(offsets[j]), low + PIECE + least - 1) if j == i + 1 else int(offsets[j])
            part = data[low:high]
            n = len(part)
            if n < max(least, wide):
                continue
            h = _GRAMS[part]
            step, factor = 1, _C
            while step < GRAM:
                left = h[:-step] * U(factor)
                left += h[step:]
                h, step, factor = left, step * 2, factor * factor % 2**64
            context = h
            if wide > GRAM:
                context = h[:-GRAM] * U(factor)
                context += h[GRAM:]
            h = h ^ (h >> U(29))
            h *= U(0xBF58476D1CE4E5B9)
            h &= ~_LOW
            h |= np.arange(len(h), dtype=U)
            m = _sliding_min(h, least - GRAM + 1)
            # no window crosses a bound of two rows
            inner = offsets[i + 1 : j] - low
            crossing = (inner[:, None] - np.arange(1, least)[None, :]).ravel()
            m[crossing[(crossing >= 0) & (crossing < len(m))]] = _NONE
            first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
            last = np.append(first[1:] - 1, len(m) - 1)
            held = m[first] != _NONE
            first, last = first[held], last[held]
            anchor = (m[first] & _LOW).astype(np.int64)
            # the windows that begin more than `half` before the anchor, and the others
            turn = np.clip(anchor - half, first, last + 1)
            first, last = np.stack([first, turn], 1).ravel(), np.stack([turn - 1, last], 1).ravel()
            some = first <= last
            first, last, anchor, right = first[some], last[some], np.repeat(anchor, 2)[some], (np.arange(len(some)) % 2 == 1)[some]
            # bytes that all windows of a half contain
            key = context[np.where(right, anchor, anchor - (wide - GRAM))]
            out[0].append(np.searchsorted(offsets, first + low, "right") - 1)
            out[1].append(first + low)
            out[2].append(last + low)
            out[3].append(K.mix(key + right.astype(U)))
            if j > i + 1:
                break
    if not out[0]:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U)
    return tuple(np.concatenate(x) for x in out)


_IDENTITY = U((1 << 39) - 1)


class Block:
    """The rows of a block and its half runs, with the distinct contexts in the order in which they are asked about."""

    def __init__(self, rows: pa.Table, parts: int, least: int = LEAST):
        self.rows, self.least, self.parts = rows, least, parts
        text = rows.column("text").cast(pa.large_string()).combine_chunks()
        self.data, self.offsets = K.column_bytes(text)
        self.owner = rows.column("number").fill_null(np.iinfo(np.int64).min).to_numpy().astype(np.int64) if rows.num_rows else np.zeros(0, np.int64)
        self.row, self.first, self.last, key = halves(self.data, self.offsets, least)
        self.key, self.each, count = np.unique(key, return_inverse=True, return_counts=True)
        self.count = count
        self.part = self._part(self.key)

    def _part(self, h: np.ndarray) -> np.ndarray:
        return ((h >> U(32)) * U(self.parts) >> U(32)).astype(np.int64)

    def contexts(self) -> Iterator[tuple[int, bytes]]:
        """(part, 5 bytes for each distinct context: 39 bits of its hash, and whether very many half runs here have it)."""
        five = (self.key & _IDENTITY) | (self.count > HOT_SNIPPETS).astype(U) << U(39)
        raw = five.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        for part, a, b in cuts(self.part):
            yield part, raw[a:b].tobytes()

    def flags(self, answers: dict[int, bytes]) -> np.ndarray:
        """Of each distinct context: 0 nobody has it elsewhere, 1 other blocks do, 2 very many snippets do."""
        out = np.zeros(len(self.key), np.uint8)
        for part, a, b in cuts(self.part):
            out[a:b] = np.frombuffer(zlib.decompress(answers[part]), np.uint8)
        return out

    def asked(self, flags: np.ndarray) -> tuple[np.ndarray, ...]:
        """The distinct snippets to be compared, in order of their part, and of each half run or single window that is asked about its
        snippet: (part, place, length, smallest document, whether it has others, first window, last window, row, snippet)."""
        flag = flags[self.each]
        cold = np.flatnonzero((flag == 1) | (flag == 0) & (self.count[self.each] > 1))
        hot = np.flatnonzero(flag == 2)
        size = self.last[hot] - self.first[hot] + 1
        window, window_row = K.aranges(self.first[hot], size), np.repeat(self.row[hot], size)
        first, last = np.concatenate([self.first[cold], window]), np.concatenate([self.last[cold], window])
        row = np.concatenate([self.row[cold], window_row])
        key = np.concatenate([self.key[self.each[cold]], K.span_hashes(self.data, window, window + self.least, _SPANS)])
        length = last - first + self.least
        once, each = distinct(self.data, first, length)
        low = np.full(len(once), np.iinfo(np.int64).max)
        np.minimum.at(low, each, self.owner[row])
        high = np.full(len(once), np.iinfo(np.int64).min)
        np.maximum.at(high, each, self.owner[row])
        part = self._part(key[once])
        order = np.argsort(part, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        once = once[order]
        return part[order], first[once], length[once], low[order], high[order] > low[order], first, last, row, back[each]

    def covered(self, flags: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
        """Whether each byte is in a window that also starts in a smaller document."""
        part, _, _, low, _, first, last, row, each = self.asked(flags)
        masks = np.zeros(len(part), np.uint32)
        for p, a, b in cuts(part):
            masks[a:b] = np.frombuffer(answers[p], np.uint32)
        mine = masks[each]
        own = mine & np.uint32((1 << _OTHERS) - 1)
        later = self.owner[row] > low[each]
        whole = later & (mine >> np.uint32(_OTHERS) > 0)
        starts, ends = [first[whole]], [last[whole] + self.least]
        some = np.flatnonzero(~whole & (own > 0))
        for bit in range(_OTHERS):
            on = some[(own[some] >> np.uint32(bit) & np.uint32(1)) > 0]
            starts.append(first[on] + bit)
            ends.append(first[on] + bit + self.least)
        n = len(self.data)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.concatenate(starts), 1)
        np.add.at(edge, np.concatenate(ends), -1)
        return np.cumsum(edge[:n], dtype=np.int32) > 0


def cuts(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, after the last) of the stretches of equal values."""
    edge = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else [0]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(part[a]), int(a), int(b)


# ---- exchanges -------------------------------------------------------------------------------------------------


ASK = "part int, block int, payload binary"
ANSWER = "block int, kind int, part int, payload binary"
_ASK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("payload", pa.binary())])


def _ask_contexts(rows: pa.Table, parts: int, least: int) -> pa.Table:
    number = rows.column("block")[0].as_py()
    return pa.Table.from_pylist([{"part": part, "block": number, "payload": p} for part, p in Block(rows, parts, least).contexts()], _ASK)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    now, blocks, payloads = None, [], []
    for batch in batches:
        for part, block, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now and blocks:
                yield now, blocks, payloads
                blocks, payloads = [], []
            now = part
            blocks.append(block)
            payloads.append(payload)
    if blocks:
        yield now, blocks, payloads


def _answer_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """1: other blocks have the context; 2: so many, or one of them so often, that it is to go window by window; 0: otherwise."""
    for part, blocks, payloads in _by_part(batches):
        sizes = [len(p) // 5 for p in payloads]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 5)
        five = wide.view("<u8").ravel()
        order = np.argsort(five & _IDENTITY, kind="stable")
        five = five[order]
        new = np.concatenate([[True], (five[1:] & _IDENTITY) != (five[:-1] & _IDENTITY)])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(five)))
        often = np.maximum.reduceat(five >> U(39), first) > 0
        flag = np.empty(len(five), np.uint8)
        flag[order] = np.repeat(np.where((count > HOT_BLOCKS) | often, 2, np.where(count > 1, 1, 0)), count)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        yield pa.RecordBatch.from_pylist([{"block": b, "kind": 0, "part": part, "payload": zlib.compress(flag[x:y].tobytes(), 1)} for b, x, y in zip(blocks, cut[:-1], cut[1:], strict=True)], _ANSWER)


def _answers_of(answers: pa.Table, kind: int) -> dict[int, bytes]:
    return {p: x for k, p, x in zip(answers.column("kind").to_pylist(), answers.column("part").to_pylist(), answers.column("payload").to_pylist(), strict=True) if k == kind}


def _ask_windows(rows: pa.Table, answers: pa.Table, parts: int, least: int) -> pa.Table:
    if not rows.num_rows:
        return pa.Table.from_pylist([], _ASK)
    block = Block(rows, parts, least)
    number = rows.column("block")[0].as_py()
    part, place, length, low, others, *_ = block.asked(block.flags(_answers_of(answers, 0)))
    out = []
    for p, a, b in cuts(part):
        text = block.data[K.aranges(place[a:b], length[a:b])]
        out.append({"part": p, "block": number, "payload": K.pack(np.array([b - a], np.int64), low[a:b], length[a:b].astype(np.uint8), others[a:b].astype(np.uint8), text)})
    return pa.Table.from_pylist(out, _ASK)


def _snippets(payloads: list[bytes]) -> tuple[list[int], tuple[np.ndarray, ...]]:
    sizes, owners, lengths, others, texts = [], [], [], [], []
    for p in payloads:
        n = int(np.frombuffer(p, np.int64, 1)[0])
        sizes.append(n)
        owners.append(np.frombuffer(p, np.int64, n, 8))
        lengths.append(np.frombuffer(p, np.uint8, n, 8 + 8 * n))
        others.append(np.frombuffer(p, np.uint8, n, 8 + 9 * n))
        texts.append(np.frombuffer(p, np.uint8, -1, 8 + 10 * n))
    return sizes, (np.concatenate(texts), np.concatenate(lengths).astype(np.int64), np.concatenate(owners), np.concatenate(others))


def _answer_windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for part, blocks, payloads in _by_part(batches):
        sizes, snippets = _snippets(payloads)
        masks = window_masks(*snippets, least)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        yield pa.RecordBatch.from_pylist([{"block": b, "kind": 1, "part": part, "payload": masks[x:y].tobytes()} for b, x, y in zip(blocks, cut[:-1], cut[1:], strict=True)], _ANSWER)


def _finish(rows: pa.Table, answers: pa.Table, parts: int, least: int, carried: list[str], text: bool) -> pa.Table:
    if not rows.num_rows:
        rows = rows.slice(0, 0)
    block = Block(rows, parts, least)
    covered = block.covered(block.flags(_answers_of(answers, 0)), _answers_of(answers, 1)) if len(block.data) else np.zeros(0, bool)
    o = block.offsets
    begins = covered & ~np.concatenate([[False], covered[:-1]])
    inside = o[:-1][np.diff(o) > 0]
    begins[inside] = covered[inside]
    total, spans = np.concatenate([[0], np.cumsum(covered)]), np.concatenate([[0], np.cumsum(begins)])
    removed = total[o[1:]] - total[o[:-1]]
    digests, kept = [], []
    null = block.rows.column("text").is_null().to_pylist()
    for a, b, r, none in zip(o[:-1].tolist(), o[1:].tolist(), removed.tolist(), null, strict=True):
        left = block.data[a:b] if not r else block.data[a:b][~covered[a:b]]
        digests.append(hashlib.sha256(left.tobytes()).hexdigest())
        if text:
            kept.append(None if none else left.tobytes().decode("utf-8", "ignore"))
    out = {"doc_id": block.rows.column("doc_id"), "n_bytes": pa.array(np.diff(o), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans[o[1:]] - spans[o[:-1]], pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    if text:
        out["kept_text"] = pa.array(kept, pa.string())
    return pa.table(out | {c: block.rows.column(c) for c in carried})


def _dealt(docs: DataFrame, id_col: str, text_col: str, least: int, carry: list[str]) -> tuple[DataFrame, int]:
    """Rows (doc_id, text, carried columns, number, block) dealt to blocks, and the number of parts."""
    if not GRAM < least <= GRAM + 61:
        raise ValueError(f"least must be in {GRAM + 1}..{GRAM + 61}")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c__{c}") for c in carry])
    rows = numbered(rows, "doc_id", "number")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    parts = max(8, -(-size * 2 * 5 // ((least - GRAM + 2) // 2) // PART_BYTES))
    block = F.pmod(F.xxhash64("number", "text"), F.lit(n)).cast("int")
    return rows.withColumn("block", block).repartition(max(1, -(-n // 2)), "block"), parts


def _meet(asked: DataFrame, parts: int, answer, schema: str) -> DataFrame:
    return asked.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(answer, schema)


def _asked(dealt: DataFrame, parts: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(answers about contexts, snippets to be compared)."""
    answers = _meet(dealt.groupBy("block").applyInArrow(lambda t: _ask_contexts(t, parts, least), ASK), parts, _answer_contexts, ANSWER)
    return answers, dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _ask_windows(a, b, parts, least), ASK)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, carry: list[str] | None = None, text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text][, carried columns]) for every row.

    Removed is each byte in a string of `least` bytes that also starts in a document with a smaller id. In kept_text, what a cut leaves
    of a character of several bytes is dropped, and null stays null.
    """
    carry = carry or []
    kinds = dict(docs.dtypes)
    dealt, parts = _dealt(docs, id_col, text_col, least, carry)
    carried = [f"c__{c}" for c in carry]
    context_answers, asked = _asked(dealt, parts, least)
    window_answers = _meet(asked, parts, lambda x: _answer_windows(x, least), ANSWER)
    result = f"doc_id {kinds[id_col]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * text + "".join(f", `c__{c}` {kinds[c]}" for c in carry)
    both = context_answers.unionAll(window_answers)
    out = dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(lambda a, b: _finish(a, b, parts, least, carried, text), result)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * text, *[F.col(f"c__{c}").alias(c) for c in carry])


OCCURRENCES = "repeat binary, owner bigint, first long"
_OCCURRENCES = pa.schema([("repeat", pa.binary()), ("owner", pa.int64()), ("first", pa.int64())])


def _ask_places(rows: pa.Table, answers: pa.Table, parts: int, least: int) -> pa.Table:
    """As _ask_windows, with every occurrence and its place in its text."""
    if not rows.num_rows:
        return pa.Table.from_pylist([], _ASK)
    block = Block(rows, parts, least)
    number = rows.column("block")[0].as_py()
    part, _, _, _, _, first, last, row, each = block.asked(block.flags(_answers_of(answers, 0)))
    part = part[each]
    order = np.argsort(part, kind="stable")
    part, first, row, length = part[order], first[order], row[order], (last - first)[order] + least
    out = []
    for p, a, b in cuts(part):
        text = block.data[K.aranges(first[a:b], length[a:b])]
        payload = K.pack(np.array([b - a], np.int64), block.owner[row[a:b]], length[a:b].astype(np.uint8), np.zeros(b - a, np.uint8), text, first[a:b] - block.offsets[row[a:b]])
        out.append({"part": p, "block": number, "payload": payload})
    return pa.Table.from_pylist(out, _ASK)


def _listed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for _, _, payloads in _by_part(batches):
        sizes = [int(np.frombuffer(p, np.int64, 1)[0]) for p in payloads]
        places = np.concatenate([np.frombuffer(p[len(p) - 8 * n :], np.int64) for p, n in zip(payloads, sizes, strict=True)])
        _, (text, lengths, owners, others) = _snippets([p[: len(p) - 8 * n] for p, n in zip(payloads, sizes, strict=True)])
        part = Snippets(text, lengths, owners, others, least)
        by = np.argsort(part.each, kind="stable")
        edge = np.searchsorted(part.each[by], np.arange(len(part.lengths) + 1))
        for length, first, last, snippet, start in part.repeats():
            for n, a, b in zip(length.tolist(), first.tolist(), last.tolist(), strict=True):
                at = part.starts[snippet[a]] + start[a]
                count = edge[snippet[a : b + 1] + 1] - edge[snippet[a : b + 1]]
                who = by[K.aranges(edge[snippet[a : b + 1]], count)]
                where = places[who] + np.repeat(start[a : b + 1], count)
                bytes_ = part.data[at : at + n].tobytes()
                for i in range(0, len(who), 2_000):
                    some = who[i : i + 2_000]
                    yield pa.RecordBatch.from_arrays([pa.array([bytes_] * len(some), pa.binary()), pa.array(owners[some]), pa.array(where[i : i + 2_000])], _OCCURRENCES.names)


def repeat_occurrences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(repeat, doc_id, first): the maximal repeats of the parts, a row for each occurrence, first being its first byte. doc_id is the id, or for ids that
    aren't integers its number in their order; the smallest bigint stands for a null id.

    A snippet is at most least + (least - GRAM) / 2 bytes long, and so is a repeat; one that is longer comes as overlapping repeats, and their
    union is all bytes in strings of `least` bytes that occur more than once.
    """
    dealt, parts = _dealt(docs, id_col, text_col, least, [])
    answers, _ = _asked(dealt, parts, least)
    places = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _ask_places(a, b, parts, least), ASK)
    return _meet(places, parts, lambda x: _listed(x, least), OCCURRENCES).select("repeat", F.col("owner").alias("doc_id"), "first").distinct()


def op3_repeats(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


# Windows as hexadecimal strings; a byte is removed if one of the 50 windows that cover it also starts in a smaller document.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, length(x) // 2)) AS p FROM d),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 2) AS b, CASE WHEN 2 * p + 100 <= length(x) THEN md5_number(substr(x, 2 * p + 1, 100)) END AS g FROM p),
m AS (SELECT *, CASE WHEN g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id THEN 1 ELSE 0 END AS dup FROM w),
c AS (SELECT doc_id, p, b, max(dup) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS cut FROM m),
s AS (SELECT *, cut = 1 AND coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0 AS begins FROM c),
a AS (SELECT doc_id, count(*) AS n_bytes, sum(cut) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(b, '' ORDER BY p) FILTER (cut = 0), '') AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
