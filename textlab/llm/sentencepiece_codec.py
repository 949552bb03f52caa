"""SentencePiece encoding and decoding by a distinct-chunk table.

Where no piece of a model holds a whitespace marker after another symbol, no merge can cross the start of a run of markers.
A text then falls apart into chunks (a run of markers and what follows it) that are segmented independently. The distinct
chunks of a slice of texts that the table lacks are segmented, and decoded, by the library in one call; ids are joined back
by position. The table belongs to the Python worker and outlives its tasks, so a chunk is segmented again only by another
worker or after it was forgotten; recurring chunks stay. It goes when the worker turns to another operator. Decoding joins the chunks' own decodings by position: most chunks
decode to themselves, the table names the others. A model whose pieces do cross markers is refused at construction.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows are encoded alike; very long
chunks (no space for a long stretch) are encoded but not remembered, so memory stays bounded; other columns are kept
(clashing result names replace the input's).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import kept_by_worker, table, text_map

MARK = "▁"
PART_CHARS = 500_000  # whose chunks are objects at once; a longer text is a part of its own
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
TYPES = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkCodec:
    """Encodes and decodes texts with a table of distinct chunks: at most `most` chunks of at most `longest` characters stay
    between calls."""

    def __init__(self, model: str, most: int = 200_000, longest: int = 48):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of this model crosses a whitespace marker")
        if [self.sp.encode(x) for x in ("a  b", " a")] != [self.sp.encode(x) for x in (f"a{MARK}{MARK}b", f"{MARK}a")]:
            raise ValueError("this model does not keep white space as it is")
        self.most, self.longest = most, longest
        self.mark = self.sp.piece_to_id(MARK)
        self.names = [f",{i}" for i in range(len(pieces))]
        self.ids: dict[str, str] = {}  # a chunk without its first marker -> its ids, each after a comma
        self.odd: dict[str, str] = {}  # the decodings of chunks that do not decode to themselves

    def _segment(self, chunks: list[str]) -> None:
        found = self.sp.encode(chunks, num_threads=1)
        # a lone decoding loses the first marker's space; a chunk without ids is a marker alone: the text ends with a space
        texts, name = self.sp.decode(found, num_threads=1), self.names.__getitem__
        for c, ids, text in zip(chunks, found, texts, strict=True):
            self.ids[c] = "".join(map(name, ids)) if ids else name(self.mark)
            if text != c:
                self.odd[c] = text

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks of a text, each without its first marker."""
        if MARK not in text and "  " not in text and text[0] != " ":
            return text.split(" ")
        return [c[1:].replace(MARK, " ") for c in CHUNK.findall(MARK + text.replace(" ", MARK))]

    def run(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """The number of ids, the ids as decimal text joined by commas, and the decoded text of each."""
        out, part, size = [], [], 0
        met: set[str] = set()
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= PART_CHARS:
                out += self._part(part, met)
                part, size = [], 0
        out += self._part(part, met)
        if len(self.ids) > self.most:  # what this call has met stays, as far as there is room
            self.ids = {c: self.ids[c] for c in met} if len(met) <= self.most else {}
        for c in [c for c in met if len(c) > self.longest]:
            self.ids.pop(c, None)
        if self.odd:
            self.odd = {c: x for c, x in self.odd.items() if c in self.ids}
        return out

    def _part(self, texts: list[str | None], met: set[str]) -> list[tuple[int, str, str]]:
        """run() of some texts, whose chunks are added to `met`; nothing is forgotten yet."""
        split = [self.chunks(t) if t else [] for t in texts]
        found = set().union(*split)
        met |= found
        if new := found.difference(self.ids):
            self._segment(list(new))
        look, odd, out = self.ids.__getitem__, self.odd, []
        for t, chunks in zip(texts, split, strict=True):
            ids = "".join(map(look, chunks))
            plain = not odd or odd.keys().isdisjoint(chunks)
            text = (t or "").replace(MARK, " ") if plain else " ".join([odd.get(c, c) for c in chunks])
            out.append((ids.count(","), ids[1:], text))
        return out


def worker_codec(model: str) -> ChunkCodec:
    """The Python worker's own codec."""
    return kept_by_worker((ChunkCodec, model), lambda: ChunkCodec(model))


def encode_decode(docs: DataFrame, model: str | None = None, text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), keep: list[str] | None = None) -> DataFrame:
    """`docs` (or the columns in `keep`) with the asked-for outputs: n_tokens, ids, decoded and their SHA-256 digests."""
    model = model or default_model()
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in outputs]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def make():
        codec = worker_codec(model)

        def fn(texts):
            rows, made = codec.run(texts), {}
            for o in outputs:
                if o == "n_tokens":
                    made[o] = [r[0] for r in rows]
                elif o == "ids":
                    ends = np.cumsum([0] + [r[0] for r in rows]).astype(np.int32)
                    values = np.fromstring(",".join([r[1] for r in rows if r[0]]), np.int32, sep=",") if ends[-1] else np.empty(0, np.int32)
                    made[o] = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                elif o == "decoded":
                    made[o] = [r[2] for r in rows]
                else:
                    made[o] = [digest(r[1 if o == "ids_sha256" else 2]) for r in rows]
            return made

        return fn

    return text_map(docs, kept, make, ", ".join(f"{o} {TYPES[o]}" for o in outputs), text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])
