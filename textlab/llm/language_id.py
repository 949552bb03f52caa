"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word in a language is the
sum over all its segmentations into pieces (forward algorithm); a text's is the product over its words. The piece
probabilities are fitted by expectation-maximisation (forward-backward counts) on the words of a bounded hash sample of
labelled documents (`SAMPLE` documents a language). Characters outside the vocabulary are pieces of their own at a small
fixed probability, so that every word has a finite score. The probabilities are learned from words of up to `LEARNED` letters;
all pieces of the vocabulary take part, and texts are scored by their whole words. Priors are equal.

The forward pass runs over all distinct words of a batch at once: a matrix of code points a word length, substring hashes
looked up in an open table of piece hashes.

Defined results: `und` with score 0 for null texts and texts without a letter, and for all texts where no language could be
learned; repeated rows get equal answers; long texts are scored whole; ties go to the first language in sorted order; other
columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, crc_fold, table

LETTERS = re.compile(r"[^\W\d_]+")
SAMPLE, ROUNDS, STEP, LONG, BLOCK = 300, 3, 24, 64, 4_096
UNSEEN, LETTER, LEARNED, PRIME = 1e-7, 3.0, 100, np.uint64(0x100000001B3)


def vocabulary() -> list[str]:
    """The letter pieces of the public vocabulary, lower-cased, without word marks."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(i).replace("▁", "").lower() for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    return sorted(p for p in pieces if LETTERS.fullmatch(p))


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, whole."""
    # runs of signs such as a superscript alone are no words
    return [w for w in LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def spelled(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64)


class Pieces:
    """Finds pieces by rolling hash of their code points; number len(list) stands for any absent single character."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.bits = max(12, (8 * len(pieces)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        for number, p in enumerate(pieces):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in p:
                    h = self.step(h, np.uint64(ord(c)))
            at = int(self.slot(h))
            while self.values[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = h, number
        self.probes = self._longest_run()

    @staticmethod
    def step(h, c):
        return (h ^ (c + np.uint64(0x9E3779B9))) * PRIME

    def slot(self, h):
        return (h * np.uint64(0x9E3779B97F4A7C15) & np.uint64(0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - self.bits) if isinstance(h, np.ndarray) else np.uint64((int(h) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits))

    def _longest_run(self) -> int:
        longest = run = 0
        for used in self.values >= 0:
            run = run + 1 if used else 0
            longest = max(longest, run)
        return longest + 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        at, mask = self.slot(h).astype(np.int64), (1 << self.bits) - 1
        out = np.where(self.keys[at] == h, self.values[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & mask
            hit = self.keys[at[open_]] == h[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (self.values[at[open_]] >= 0)]
        return out

    def arcs(self, letters: np.ndarray):
        """(begin, end, rows, pieces) of all pieces in a matrix of equally long words."""
        n = letters.shape[1]
        for i in range(n):
            h = np.zeros(len(letters), np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h = self.step(h, letters[:, j])
                number = self.find(h)
                if j == i:
                    number = np.where(number < 0, len(self.pieces), number)
                rows = np.flatnonzero(number >= 0)
                if len(rows):
                    yield i, j + 1, rows, number[rows]


def by_length(words: list[str]):
    groups = defaultdict(list)
    for k, w in enumerate(words):
        groups[len(w)].append(k)
    return groups.items()


class Model:
    """Sorted languages, their priors and piece probabilities (pieces and the absent character, by language)."""

    def __init__(self, languages: list[str], priors: np.ndarray, p: np.ndarray, pieces: Pieces):
        self.languages, self.priors, self.p, self.pieces = languages, priors, p, pieces

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, summed over segmentations."""
        out = np.empty((len(words), len(self.languages)))
        for n, numbers in by_length(words):
            numbers = np.array(numbers)
            if n > LONG:
                out[numbers] = [self._log_sum_long(spelled([words[k]], n)[0]) for k in numbers]
            else:
                out[numbers] = self._log_sums(spelled([words[k] for k in numbers], n))
        return out

    def _log_sum_long(self, letters: np.ndarray) -> np.ndarray:
        """The same sum for one long word: pieces are looked up for a block of its letters at once."""
        held, n, languages = self.pieces.longest, len(letters), len(self.languages)
        recent, scale = np.zeros((held, languages)), np.zeros(languages)
        recent[0] = 1  # recent[k] is the sum at k letters before the current one
        for start in range(0, n, BLOCK):
            end, first = min(n, start + BLOCK), max(0, start + 1 - held)
            part, h = letters[first:end], np.zeros(end - first, np.uint64)
            by_end = np.zeros((end - start, held, languages))
            for k in range(1, min(held, len(part)) + 1):
                h = self.pieces.step(h[: len(part) - k + 1], part[k - 1 :])
                number = self.pieces.find(h)
                number = np.where(number < 0, len(self.pieces.pieces), number) if k == 1 else number
                at = np.flatnonzero(number >= 0)
                ends = first + at + k - 1 - start
                at, ends = at[ends >= 0], ends[ends >= 0]
                by_end[ends, k - 1] = self.p[number[at]]
            for j, weights in enumerate(by_end, start + 1):
                new = (recent * weights).sum(0)
                recent[1:] = recent[:-1].copy()
                recent[0] = new
                if j % STEP == 0:
                    top = np.maximum(recent.max(0), 1e-300)
                    recent /= top
                    scale += np.log(top)
        return np.log(np.maximum(recent[0], 1e-300)) + scale

    def _log_sums(self, letters: np.ndarray) -> np.ndarray:
        """The forward sums at the ends of equally long words. Only as many of them are held as a piece is long, and they are
        scaled every STEP letters, so words of any length neither underflow nor fill memory."""
        rows_, n, held = *letters.shape, self.pieces.longest + 1
        a = np.zeros((held, rows_, len(self.languages)))
        a[0], scale, at = 1, np.zeros((rows_, len(self.languages))), 0
        for i, j, rows, piece in self.pieces.arcs(letters):
            if i != at:  # position i is final now; the slot of the one before is free
                a[at % held] = 0
                at = i
                if i % STEP == 0:
                    top = np.maximum(a.max(0), 1e-300)
                    a /= top
                    scale += np.log(top)
            a[j % held, rows] += a[i % held, rows] * self.p[piece]
        return np.log(np.maximum(a[n % held], 1e-300)) + scale


def expect(pieces: Pieces, p: np.ndarray, words: list[str], times: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language by forward and backward sums."""
    counts = np.zeros(len(p))
    for n, numbers in by_length(words):
        numbers = np.array(numbers)
        arcs = list(pieces.arcs(spelled([words[k] for k in numbers], n)))
        # scaled by a typical letter's probability, so that long words do not underflow; counts do not depend on it
        a, b = np.zeros((n + 1, len(numbers))), np.zeros((n + 1, len(numbers)))
        a[0] = b[n] = 1
        grow = np.exp(LETTER * np.arange(n + 1))
        for i, j, rows, piece in arcs:
            a[j, rows] += a[i, rows] * p[piece] * grow[j - i]
        for i, j, rows, piece in sorted(arcs, key=lambda x: -x[1]):
            b[i, rows] += b[j, rows] * p[piece] * grow[j - i]
        for i, j, rows, piece in arcs:
            share = times[numbers[rows]] * a[i, rows] * p[piece] * grow[j - i] * b[j, rows] / np.maximum(a[n, rows], 1e-300)
            counts += np.bincount(piece, share, len(counts))
    return counts


def fit(docs: DataFrame) -> Model:
    """Learns from `text` and non-null `lang` of `docs`."""
    rows = bounded_sample(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), SAMPLE, "doc_id", "lang").select("lang", "text").collect()
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in sorted(rows):
        counts[r.lang].update(words_of(r.text))
    languages = sorted(x for x in counts if counts[x])
    pieces = Pieces(vocabulary())
    size = len(pieces.pieces) + 1
    start = np.array([1.0 / len(x) ** 2 for x in pieces.pieces] + [UNSEEN])
    p = np.empty((size, len(languages)))
    for k, x in enumerate(languages):
        words, own = sorted(w for w in counts[x] if len(w) <= LEARNED), start / start.sum()
        times = np.array([counts[x][w] for w in words], float)
        for _ in range(ROUNDS):
            found = expect(pieces, own, words, times)
            own = (found + 0.01) / (found.sum() + 0.01 * size)
            own[-1] = UNSEEN
        p[:, k] = own
    return Model(languages, np.full(len(languages), 1.0 / max(1, len(languages))), p, pieces)


class Scorer:
    """Scores texts with a table of the words seen so far; a full table is dropped."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most, self.row, self.scores = model, most, {}, np.empty((0, len(model.languages)))

    def run(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of(t) for t in texts]
        new = sorted({w for ws in split for w in ws if w not in self.row})
        if len(self.row) + len(new) > self.most and self.row:
            self.row, self.scores = {}, self.scores[:0]
            new = sorted({w for ws in split for w in ws})
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.model.log_words(new)])
        names, sure = [], []
        for ws in split:
            if not ws or not self.model.languages:
                names.append("und"), sure.append(0.0)
                continue
            total = np.log(self.model.priors) + self.scores[np.fromiter(map(self.row.__getitem__, ws), np.int64, len(ws))].sum(0)
            best = int(total.argmax())
            names.append(self.model.languages[best])
            sure.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return names, sure


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, lang_pred and score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def fn(batch):
            keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(keys), 400):
                names, sure = scorer.run(texts[at : at + 400])
                yield {key: keys[at : at + 400], "lang_pred": names, "score": sure}

        return fn

    return arrow_map(docs.select(docs[key].alias("key"), docs[text].alias("text")), make, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs.where(crc_fold("doc_id", 4) != 2)))
    return out.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
