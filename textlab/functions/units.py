"""Normalised texts and their units as arrays of numbers: what the alignment and distance kernels work on.

A block of texts is one array of code points with offsets. Normal form C is asked of Python only for the texts that need it;
everything else is whole-array arithmetic, so no object a text, let alone a unit, is made."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import COMPOSED, INERT, ZERO_WIDTH, NormProfile

SLICE_BYTES, SLICE_ROWS = 4_000_000, 10_000
_SPACES = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SIGNS = (*range(0x0BBE, 0x0BCE), 0x0BD7)
#: Units of a code point and up to two signs have numbers below this; those of more signs are numbered from here on.
_LONG = 1 << 31

Block = tuple[np.ndarray, np.ndarray]  # values, and the offsets of each text's


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: white space, zero-width marks, numbers of signs (0: none), and those outside INERT."""
    space, mark, sign, other = np.zeros(0x110000, bool), np.zeros(0x110000, bool), np.zeros(0x110000, np.uint32), np.ones(0x110000, bool)
    space[list(_SPACES)], mark[[ord(c) for c in ZERO_WIDTH]], sign[list(_SIGNS)] = True, True, np.arange(1, len(_SIGNS) + 1)
    for lo, hi in INERT:
        other[lo : hi + 1] = False
    return space, mark, sign, other


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The parts of a batch, in order, of about SLICE_BYTES bytes of text and SLICE_ROWS rows at most."""
    texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
    size = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), np.zeros(batch.num_rows, np.int64))
    ends, begin = np.cumsum(size), 0
    while begin < batch.num_rows:
        end = max(begin + 1, min(begin + SLICE_ROWS, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE_BYTES, "right"))))
        yield batch.slice(begin, end - begin)
        begin = end


def points(texts: pa.Array) -> Block:
    """Code points; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    begun = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), begun[bounds - bounds[0]]


def spelled(block: Block) -> pa.Array:
    return encoded(*block)


def _kept(block: Block, keep: np.ndarray) -> Block:
    return block[0][keep], np.concatenate(([0], np.cumsum(keep)))[block[1]]


def _unsettled(block: Block, first: np.ndarray) -> np.ndarray:
    """Numbers of the texts whose normal form C needs its tables, by the rules of text.nfc; first: code points that begin a text."""
    codes, at = block
    odd = _tables()[3][codes]
    odd[1:] |= (codes[1:] == 0x0BCD) & ((codes[:-1] < 0x0B80) | (codes[:-1] > 0x0BFF)) & ~first[1:]
    if not odd.any():
        return np.empty(0, np.int64)
    found = np.concatenate(([0], np.cumsum(odd)))
    return np.flatnonzero(found[at[1:]] > found[at[:-1]])


def _begins(block: Block) -> np.ndarray:
    first = np.zeros(len(block[0]), bool)
    first[block[1][:-1][block[1][:-1] < len(first)]] = True
    return first


def formed(texts: pa.Array) -> Block:
    """Code points of the texts in normal form C: what text.nfc makes of them, null as empty."""
    block = points(texts)
    if len(some := _unsettled(block, _begins(block))):
        new = [unicodedata.normalize("NFC", t or "") for t in texts.take(pa.array(some)).to_pylist()]
        changed = np.zeros(len(texts), bool)
        changed[some] = True
        block = points(pc.replace_with_mask(texts.cast(pa.string()), pa.array(changed), pa.array(new, pa.string())))
    codes, _ = block
    second = np.flatnonzero((codes[1:] == 0x0BBE) | (codes[1:] == 0x0BD7)) + 1
    second = second[~_begins(block)[second]]
    joined = {pair: second[(codes[second - 1] == ord(pair[0])) & (codes[second] == ord(pair[1]))] for pair in COMPOSED}
    if not any(map(len, joined.values())):
        return block
    codes, keep = codes.copy(), np.ones(len(codes), bool)
    for pair, places in joined.items():
        codes[places - 1], keep[places] = ord(COMPOSED[pair]), False
    return _kept((codes, block[1]), keep)


def encoded(codes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts of these code points; bounds: where each begins, and the end."""
    size = np.concatenate(([0], np.cumsum(1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000))))
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(size[bounds].astype(np.int32)), pa.py_buffer(data)])


def _word_starts(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """White space, and the code points that begin a word."""
    blank = _tables()[0][block[0]]
    start = ~blank
    start[1:] &= blank[:-1] | _begins(block)[1:]
    return blank, start


def count_words(texts: pa.Array) -> np.ndarray:
    block = points(texts)
    return np.diff(np.concatenate(([0], np.cumsum(_word_starts(block)[1])))[block[1]])


def cut_words(texts: pa.Array, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, line, words, piece): the words of the texts in normal form C, cut where the number of a word, counted from its
    text's offset, is a multiple of `width`; a piece's words are joined by one space."""
    block = formed(texts)
    blank, start = _word_starts(block)
    where = np.flatnonzero(start)
    each = np.diff(np.concatenate(([0], np.cumsum(start)))[block[1]])
    text = np.repeat(np.arange(len(texts)), each)
    first = np.cumsum(each) - each
    number = offsets[text] + np.arange(len(where)) - first[text]
    opens = number % width == 0
    opens[first[each > 0]] = True
    keep, codes = ~blank, block[0].copy()
    gaps = where[~opens] - 1
    keep[gaps], codes[gaps] = True, 0x20
    heads = np.flatnonzero(opens)
    bounds = np.concatenate(([0], np.cumsum(keep)))[np.append(where[heads], len(codes))]
    return text[heads], number[heads] // width, np.diff(np.append(heads, len(where))), encoded(codes[keep], bounds)


def normalized(texts: pa.Array, profile: NormProfile = NormProfile()) -> Block:
    """What text.normalize makes of the texts."""
    block = formed(texts)
    space, mark, _, _ = _tables()
    if profile.strip_zero_width and (gone := mark[block[0]]).any():
        block = _kept(block, ~gone)
    codes, at = block
    blank = space[codes]
    solid = np.flatnonzero(~blank)
    begin = np.searchsorted(solid, at[:-1])
    end = np.searchsorted(solid, at[1:])
    some = end > begin
    border = np.zeros(len(codes) + 1, np.int8)
    border[solid[begin[some]]] += 1
    border[solid[end[some] - 1] + 1] -= 1
    keep = np.cumsum(border[:-1], dtype=np.int8) > 0
    if profile.collapse_whitespace:
        codes = np.where(blank, np.uint32(0x20), codes)
        keep[1:] &= ~(blank[1:] & blank[:-1])
    return _kept((codes, at), keep)


def graphemes(block: Block) -> Block:
    """Each unit's number: equal units have equal numbers, in every block."""
    codes, at = block
    sign = _tables()[2][codes]
    start = sign == 0
    start[at[:-1][at[:-1] < len(codes)]] = True
    first = np.flatnonzero(start)
    signs = np.diff(np.append(first, len(codes))) - 1
    ids = codes[first] * np.uint32(324)
    for k, base in ((1, 18), (2, 1)):
        with_k = np.flatnonzero(signs >= k)
        ids[with_k] += sign[first[with_k] + k] * np.uint32(base)
    for i in np.flatnonzero(signs > 2):
        ids[i] = _long_unit(codes[first[i] : first[i] + signs[i] + 1].tobytes())
    return ids, np.concatenate(([0], np.cumsum(start)))[at]


_long: dict[bytes, int] = {}
_spelling: list[bytes] = []


def _long_unit(unit: bytes) -> int:
    if unit not in _long:
        _long[unit] = _LONG + len(_long)
        _spelling.append(unit)
    return _long[unit]


def unit_text(number: int) -> str:
    """The grapheme with this number, in the worker that numbered it."""
    if number >= _LONG:
        return _spelling[number - _LONG].decode("utf-32-le")
    point, signs = divmod(number, 324)
    return chr(point) + "".join(chr(_SIGNS[s - 1]) for s in divmod(signs, 18) if s)


def words(*blocks: Block) -> list[Block]:
    """Words between white space, numbered within these blocks."""
    found, counts = [], []
    for block in blocks:
        blank, start = _word_starts(block)
        solid = np.concatenate(([0], np.cumsum(~blank)))
        offsets = (4 * np.append(solid[np.flatnonzero(start)], solid[-1])).astype(np.int32)
        found.append(pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(block[0][~blank])]))
        counts.append(np.concatenate(([0], np.cumsum(start)))[block[1]])
    ids = pa.concat_arrays(found).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.uint32)
    cuts = np.cumsum([len(s) for s in found])[:-1]
    return list(zip(np.split(ids, cuts), counts))


def tokens(kind: str, *blocks: Block) -> list[Block]:
    """Graphemes, code points or words of the blocks, numbered alike in all of them."""
    return words(*blocks) if kind == "word" else [graphemes(b) for b in blocks] if kind == "grapheme" else list(blocks)
