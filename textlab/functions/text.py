"""Text functions on columns. White space is Unicode white space as `str.isspace` has it, a user-perceived unit is one code
point and the dependent signs of the Tamil block that follow it, and normal form C of the texts that need its tables is
the only step outside the JVM."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that results depend on.
SPACE = r"[\s\x1C-\x1F]"
ZERO_WIDTH = "\u200B\u200C\u200D\uFEFF"
SIGNS = r"\x{0BBE}-\x{0BCD}\x{0BD7}"
BLOCK = (0x0B80, 0x0BFF)
SLICE_ROWS = 200
LINE_ENDS = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\x{2028}\x{2029}]"


@dataclass(frozen=True)
class NormProfile:
    """What `normalize` does besides normal form C; carried with every result as its name."""

    strip_zero_width: bool = True
    collapse_whitespace: bool = True

    @property
    def name(self) -> str:
        kept = [n for n, on in (("zero-width", self.strip_zero_width), ("whitespace", self.collapse_whitespace)) if not on]
        return "keep " + "+".join(kept) if kept else "default"


#: Code points that no step of normal form C changes, moves or joins to another, but for COMPOSED and a virama after a code
#: point of another block. Texts of these alone need no table of decompositions.
INERT = ((0x00, 0x2FF), (0x388, 0x482), (0x0B80, 0x0BFF), (0x2002, 0x20CF), (0x3030, 0x3098), (0x309B, 0xA66E), (0xE000, 0xF8FF), (0xFFF0, 0xFFFF), (0x1F000, 0x1FAFF))
COMPOSED = {"\u0BC6\u0BBE": "\u0BCA", "\u0BC7\u0BBE": "\u0BCB", "\u0BC6\u0BD7": "\u0BCC", "\u0B92\u0BD7": "\u0B94"}
_INERT_ONLY = rf"\A[{''.join(rf'\x{{{lo:X}}}-\x{{{hi:X}}}' for lo, hi in INERT)}]*+\z"
_MOVED = r"[^\x{0B80}-\x{0BFF}]\x{0BCD}"

PROFILES = tuple(NormProfile(z, w) for z in (True, False) for w in (True, False))


@F.arrow_udf(StringType())
def _formed(texts: pa.Array) -> pa.Array:
    """Normal form C, slice by slice; null stays null."""
    form = unicodedata.normalize
    rows = range(0, len(texts), SLICE_ROWS)
    parts = [pa.array([None if t is None else form("NFC", t) for t in texts.slice(at, SLICE_ROWS).to_pylist()], pa.string()) for at in rows]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def nfc(c: Column | str) -> Column:
    """Normal form C; null stays null. Only texts with a code point outside INERT go to Python; in the others the pairs of
    COMPOSED are all that is joined."""
    c = F.col(c) if isinstance(c, str) else c
    joined = c
    for pair, one in COMPOSED.items():
        joined = F.replace(joined, F.lit(pair), F.lit(one))
    return F.coalesce(_formed(F.when(~c.rlike(_INERT_ONLY) | c.rlike(_MOVED), c)), joined)


@F.pandas_udf(StringType())
def codepoint_name(points: pd.Series) -> pd.Series:
    """The Unicode name of a code point, `<unnamed>` where there is none."""
    return points.map(lambda p: unicodedata.name(chr(int(p)), "<unnamed>"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def normalize(c: Column, profile: NormProfile = NormProfile(), trim: bool = True) -> Column:
    """Normal form C, zero-width marks out, white space collapsed, ends stripped (each as the profile says)."""
    out = nfc(c)
    if profile.strip_zero_width:
        out = F.translate(out, ZERO_WIDTH, "")
    if profile.collapse_whitespace:
        out = F.regexp_replace(out, rf"(?U){SPACE}+", " ")
    return strip(out) if trim else out


def words(c: Column) -> Column:
    """Words between white space; never an empty one."""
    return F.filter(F.split(c, rf"(?U){SPACE}+"), lambda t: t != "")


def normalize_line(c: Column) -> Column:
    return F.array_join(words(nfc(c)), " ")


def graphemes(c: Column) -> Column:
    """One code point and the signs that follow it; a leading sign is a unit of its own."""
    return F.regexp_extract_all(c, F.lit(rf"(?s).[{SIGNS}]*"), F.lit(0))


def codepoints(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def lines(c: Column) -> Column:
    """Lines as `str.splitlines` cuts them: a final line end makes no empty line."""
    found = F.split(c, LINE_ENDS)
    return F.when(F.element_at(found, -1) == "", F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)


def has_script(c: Column, block: tuple[int, int] = BLOCK) -> Column:
    return c.rlike(rf"[\x{{{block[0]:04X}}}-\x{{{block[1]:04X}}}]")


def rate(edits: Column, total: Column) -> Column:
    """edits / total; 0 of 0 is 0.0 and anything of 0 is 1.0. Rates may exceed 1."""
    return F.when(total == 0, F.when(edits == 0, 0.0).otherwise(1.0)).otherwise(edits.cast("double") / total)


def bind(value: Column, body) -> Column:
    """`body(value)` with the value computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
