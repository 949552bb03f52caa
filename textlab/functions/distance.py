"""Edit distances and optimal alignments of blocks of pairs.

A column of the table is two bit vectors, of the rows where its values rise and fall (Myers), kept for all pairs of a block at
once: a step of the recurrence advances every pair by a token of its hypothesis. The walk back needs two bits a cell. Pairs of
more than WIDE tokens on the shorter side go one by one, a row of the table a step; alignments of such keep every s-th row only
and recompute the rows between, so memory grows with the root of the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from . import units
from .text import codepoints, graphemes, words
from .units import Block

CELLS, WIDE, BITS, FEW, ALIGN_ROWS = 4_000_000, 512, 4_000_000, 512, 10_000
#: Divisors whose remainders are below the two values that fill up.
_REMAINDERS = (65_521, 65_519, 65_497, 65_479, 65_449, 65_447)
ALIGNED = ArrayType(StructType().add("ref", StringType()).add("hyp", StringType()))


def _narrow(a: Block, b: Block) -> tuple[Block, Block]:
    """Both with numbers of 16 bits, where a remainder tells all their tokens apart: comparisons cost their bytes."""
    most = max((int(x[0].max()) for x in (a, b) if len(x[0])), default=0)
    for by in (1 << 32,) if most < 0xFFF0 else _REMAINDERS:
        left, right = (a[0], b[0]) if by > most else (a[0] % np.uint32(by), b[0] % np.uint32(by))
        seen = np.empty(1 << 16, np.uint32)
        seen[left], seen[right] = a[0], b[0]
        if (seen[left] == a[0]).all() and (seen[right] == b[0]).all():
            return (left.astype(np.uint16), a[1]), (right.astype(np.uint16), b[1])
    return a, b


def _padded(block: Block, rows: np.ndarray, width: int, below: int) -> np.ndarray:
    """The values of these texts side by side, filled up with what no token is."""
    values, at = block
    begin, end = at[rows], at[rows + 1]
    places = begin[:, None] + np.arange(width)
    out = values[np.minimum(places, max(0, len(values) - 1))]
    out[places >= end[:, None]] = np.iinfo(values.dtype).max - below
    return out


def _columns(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, traced: bool) -> tuple[np.ndarray, list]:
    """Distances of the pairs (a, b) of n and m tokens, and for each token of b the bits of the rows where a diagonal step and
    where a deletion is on an optimal path."""
    pairs, width = a.shape  # whole bytes of bits
    w = -(-width // 64)
    one = np.uint64(1)
    rise, fall = np.full((w, pairs), ~np.uint64(0)), np.zeros((w, pairs), np.uint64)
    last, bit = (n - 1) // 64, ((n - 1) % 64).astype(np.uint64)
    distance = n.astype(np.int64)
    packed = np.zeros((pairs, w * 8), np.uint8)
    every, kept = np.arange(pairs), []
    for j in range(b.shape[1]):
        packed[:, : width // 8] = np.packbits((a == b[:, j, None]).ravel(), bitorder="little").reshape(pairs, -1)
        same = np.ascontiguousarray(packed.view("<u8").T)
        up, down = np.ones(pairs, np.uint64), np.zeros(pairs, np.uint64)
        rises, falls = np.empty_like(rise), np.empty_like(fall)
        ways = np.empty((w, pairs), np.uint64) if traced else None
        for k in range(w):
            eq, pv, mv = same[k], rise[k], fall[k]
            xv = eq | mv
            eq = eq | down
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            if traced:
                ways[k] = same[k] | ~(xh | mv)
            rises[k], falls[k] = ph, mh
            up, ph, down, mh = ph >> np.uint64(63), (ph << one) | up, mh >> np.uint64(63), (mh << one) | down
            rise[k], fall[k] = mh | ~(xv | ph), ph & xv
        at = rises[0] if w == 1 else rises[last, every], falls[0] if w == 1 else falls[last, every]
        distance += np.where(j < m, ((at[0] >> bit) & one).astype(np.int64) - ((at[1] >> bit) & one).astype(np.int64), 0)
        if traced:
            kept.append((ways, rise.copy()))
    return distance, kept


def _in_blocks(n: np.ndarray, m: np.ndarray, cells) -> Iterator[np.ndarray]:
    """Pairs of like sizes, as many as `cells` of the longest sides allow: the longest hypothesis sets a block's steps, so it
    is a tenth longer than the shortest at most, where a block of FEW pairs allows."""
    w = -(-n // 64)
    order = np.lexsort((m, w))
    at = 0
    while at < len(order):
        stop = int(np.searchsorted(w[order], w[order[at]], "right"))
        wide = int(n[order[at:stop]].max())
        size = m[order[at:stop]]
        end = max(FEW, int(np.searchsorted(size, 1.1 * size[0] + 1, "right")))
        for _ in range(2):
            end = max(1, min(end, len(size), BITS // cells(wide, int(size[min(end, len(size)) - 1]))))
        yield order[at : at + end]
        at += end


def distances(a: Block, b: Block) -> np.ndarray:
    """Levenshtein distances of the texts of two blocks, pair by pair."""
    n, m = np.diff(a[1]), np.diff(b[1])
    a, b = _narrow(a, b)
    out = np.maximum(n, m)
    swap = n > m
    low, high = np.minimum(n, m), np.maximum(n, m)
    for some, x, y in ((~swap, a, b), (swap, b, a)):
        rows = np.flatnonzero(some & (low > 0) & (low <= WIDE))
        for part in _in_blocks(low[rows], high[rows], lambda w, _: 8 * (w + 8)):
            own = rows[part]
            u, v = low[own], high[own]
            out[own] = _columns(_padded(x, own, -(-int(u.max()) // 8) * 8, 0), _padded(y, own, int(v.max()), 1), u, v, False)[0]
        for p in np.flatnonzero(some & (low > WIDE)):
            left, right = x[0][x[1][p] : x[1][p + 1]][None], y[0][y[1][p] : y[1][p + 1]][None]
            out[p] = _rows(left, right, np.arange(high[p] + 1, dtype=np.int32)[None], 0, None)[0, -1]
    return out


def _rows(a: np.ndarray, b: np.ndarray, prev: np.ndarray, first: int, ops: np.ndarray | None) -> np.ndarray:
    """Advances the table over the columns of `a` (pairs x rows) from row `first`; fills ops with 0 match or substitution,
    1 deletion, 2 insertion, preferred in this order."""
    ramp = np.arange(prev.shape[1], dtype=np.int32)
    for k in range(a.shape[1]):
        diagonal = prev[:, :-1] + (a[:, k, None] != b)
        row = np.empty_like(prev)
        row[:, 0] = first + k + 1
        np.minimum(diagonal, prev[:, 1:] + 1, out=row[:, 1:])
        row = np.minimum.accumulate(row - ramp, axis=1) + ramp
        if ops is not None:
            ops[k, :, 0] = 1
            ops[k, :, 1:] = np.where(row[:, 1:] == diagonal, 0, np.where(row[:, 1:] == prev[:, 1:] + 1, 1, 2))
        prev = row
    return prev


def _trace(ops: np.ndarray, i: np.ndarray, j: np.ndarray, stop: int, out: list) -> tuple[np.ndarray, np.ndarray]:
    """Walks back from rows i (counted within ops) and columns j to row `stop`; steps are appended to out."""
    every = np.arange(len(i))
    while True:
        live = (i > 0) | ((j > 0) & (stop == 0))
        if not live.any():
            return i, j
        op = np.where(i > 0, ops[np.maximum(i - 1, 0), every, j], 2)
        up, left = live & (op < 2), live & (op != 1)
        out.append((np.where(up, i - 1 + stop, -1), np.where(left, j - 1, -1)))
        i, j = i - up, j - left


def _walk(kept: list, n: np.ndarray, m: np.ndarray, out: list) -> None:
    """Walks back from the ends of a block's pairs over the bits of _columns."""
    ways, rises = (np.stack([x[s] for x in kept]) if kept else np.zeros((1, 1, len(n)), np.uint64) for s in (0, 1))
    pairs, i, j = np.arange(len(n)), n.copy(), m.copy()
    while len(pairs):
        row, column = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        bit = (row % 64).astype(np.uint64)
        of = lambda x: ((x[column, row // 64, pairs] >> bit) & np.uint64(1)).astype(bool)  # noqa: E731, B023
        diagonal = of(ways) & (i > 0) & (j > 0)
        up = diagonal | ((i > 0) & ((j == 0) | of(rises)))
        left = diagonal | ~up
        out.append((pairs, np.where(up, i - 1, -1), np.where(left, j - 1, -1)))
        i, j = i - up, j - left
        live = (i > 0) | (j > 0)
        if not live.all():
            pairs, i, j = pairs[live], i[live], j[live]


def _large(a: np.ndarray, b: np.ndarray) -> list:
    n, m = a.shape[1], b.shape[1]
    every = max(1, math.isqrt(n))
    kept = [np.arange(m + 1, dtype=np.int32)[None]]
    for at in range(0, n, every):
        kept.append(_rows(a[:, at : at + every], b, kept[-1], at, None))
    steps: list = []
    j = np.array([m])
    for k in range(len(kept) - 2, -1, -1):
        at = k * every
        part = a[:, at : at + every]
        ops = np.empty((part.shape[1], 1, m + 1), np.uint8)
        _rows(part, b, kept[k], at, ops)
        _, j = _trace(ops, np.array([part.shape[1]]), j, at, steps)
        kept.pop()
    if j[0] > 0:
        _trace(np.empty((1, 1, m + 1), np.uint8), np.array([0]), j, 0, steps)
    return steps


def steps(a: Block, b: Block, errors_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, i, j): the steps of optimal alignments, from the ends back and some pairs at a time; -1 for i is an insertion, for
    j a deletion. A diagonal step wins over a deletion, a deletion over an insertion. i and j count over the whole blocks."""
    n, m = np.diff(a[1]), np.diff(b[1])
    a, b = _narrow(a, b)

    def found(rows, pairs, i, j):
        pair = rows[pairs]
        i, j = np.where(i >= 0, i + a[1][pair], -1), np.where(j >= 0, j + b[1][pair], -1)
        if not errors_only:
            return pair, i, j
        both = (i >= 0) & (j >= 0)
        wrong = ~both
        wrong[both] = a[0][i[both]] != b[0][j[both]]
        return pair[wrong], i[wrong], j[wrong]

    for own in (np.flatnonzero((n > 0) & (m == 0)), np.flatnonzero((n == 0) & (m > 0))):
        for part in _in_blocks(np.zeros_like(own), (n + m)[own], lambda _, long: 8 * (long + 1)):
            rows = own[part]
            size = (n + m)[rows]
            pairs = np.repeat(np.arange(len(rows)), size)
            back = np.repeat(np.cumsum(size), size) - 1 - np.arange(size.sum())
            none = np.full(len(back), -1)
            yield found(rows, pairs, *((none, back) if n[rows[0]] == 0 else (back, none)))
    both = (n > 0) & (m > 0)
    small = both & ((n * m <= CELLS) & (n <= WIDE) | (n * m <= min(CELLS, WIDE * WIDE)))
    some = np.flatnonzero(small)
    for part in _in_blocks(n[some], m[some], lambda wide, long: 16 * (-(-wide // 64)) * long + 4 * wide):
        rows = some[part]
        x, y = _padded(a, rows, -(-int(n[rows].max()) // 8) * 8, 0), _padded(b, rows, int(m[rows].max()), 1)
        out: list = []
        _walk(_columns(x, y, n[rows], m[rows], True)[1], n[rows], m[rows], out)
        yield found(rows, *(np.concatenate([s[k] for s in out]) for k in range(3)))
    for p in np.flatnonzero(both & ~small):
        at = _large(a[0][a[1][p] : a[1][p + 1]][None], b[0][b[1][p] : b[1][p + 1]][None])
        i, j = (np.concatenate([s[k] for s in at]) for k in (0, 1))
        taken = (i >= 0) | (j >= 0)
        yield found(np.array([p]), np.zeros(taken.sum(), np.int64), i[taken], j[taken])


def _token_rows(lists: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return lists.flatten().cast(pa.string()), np.concatenate(([0], np.cumsum(lengths)))


def _numbered(ref: pa.Array, hyp: pa.Array) -> tuple[pa.Array, Block, Block]:
    """All tokens, and both sides with the numbers of equal tokens."""
    (x, n), (y, m) = _token_rows(ref), _token_rows(hyp)
    tokens = pa.concat_arrays([x, y])
    ids = tokens.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.uint32)
    return tokens, (ids[: len(x)], n), (ids[len(x) :], m)


def align(ref: pa.Array, hyp: pa.Array, errors_only: bool = False) -> pa.Array:
    """Optimal alignments of pairs of token lists (see steps). Null lists count as empty."""
    parts = [_align(ref.slice(at, ALIGN_ROWS), hyp.slice(at, ALIGN_ROWS), errors_only) for at in range(0, max(1, len(ref)), ALIGN_ROWS)]
    return pa.concat_arrays(parts)


def _align(ref: pa.Array, hyp: pa.Array, errors_only: bool) -> pa.Array:
    tokens, a, b = _numbered(ref, hyp)
    found = list(steps(a, b, errors_only)) or [(np.empty(0, np.int64),) * 3]
    pair, i, j = (np.concatenate([f[k] for f in found])[::-1] for k in range(3))
    order = np.argsort(pair, kind="stable")
    i, j = i[order], j[order]
    take = lambda k, more: tokens.take(pa.array(k + more, pa.int64(), mask=k < 0))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(pair, minlength=len(a[1]) - 1)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([take(i, 0), take(j, len(a[0]))], ["ref", "hyp"]))


@F.arrow_udf(ALIGNED)
def alignment(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """The aligned pairs of two token arrays; a null side is a deletion or an insertion."""
    return align(ref, hyp)


@F.arrow_udf(ALIGNED)
def alignment_errors(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """The aligned pairs whose sides differ."""
    return align(ref, hyp, errors_only=True)


def _by_slice(measure) -> Callable:
    def whole(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        parts = [measure(*x.columns) for x in units.slices(pa.record_batch([ref, hyp], ["ref", "hyp"]))]
        return pa.array(np.concatenate(parts) if parts else [], pa.int32())

    return whole


@F.arrow_udf(IntegerType())
def token_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Levenshtein distance between two arrays of strings; null if one is null."""
    _, x, y = _numbered(a, b)
    none = pc.or_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    return pa.array(distances(x, y), pa.int32(), mask=none)


def _text_distance(kind: str):
    def one(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        measure = _by_slice(lambda r, h: distances(*units.tokens(kind, units.points(r), units.points(h))))
        none = pc.or_(ref.is_null(), hyp.is_null()).to_numpy(zero_copy_only=False)
        return pa.array(measure(ref, hyp).to_numpy(zero_copy_only=False), pa.int32(), mask=none)

    one.__annotations__ = {"ref": pa.Array, "hyp": pa.Array, "return": pa.Array}
    return F.arrow_udf(one, IntegerType())


grapheme_distance, codepoint_distance, word_distance = (_text_distance(k) for k in ("grapheme", "codepoint", "word"))

UNITS = {"grapheme": (graphemes, grapheme_distance), "codepoint": (codepoints, codepoint_distance), "word": (words, word_distance)}
