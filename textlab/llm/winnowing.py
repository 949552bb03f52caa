"""Benchmark decontamination by winnowing.

Of the six 5-word hashes in every window of 10 words, the minimum (the rightmost of equals) is the window's fingerprint;
texts that share 10 words share a fingerprint, whatever surrounds it (5 + 6 - 1 = 10). Documents' fingerprints are joined
with those of the benchmark, and each match is extended: the windows around it are compared word by word. Items of fewer
than 10 words are one window each and are looked up at every position.

The benchmark is a stated query set. Up to `MOST_BROADCAST` characters it is cut into blocks of bounded size, each broadcast
and indexed in a worker; every document meets every block, in one pass over the documents and without a shuffle. A larger
benchmark is never gathered: its fingerprints become a Bloom filter of at most `BLOOM_BITS` bits, and the windows of documents
whose fingerprint passes are joined with its windows, word for word, by shuffle. Both ways give the same results.

Defined results: null and empty texts have no words and no hits; an item without words is ignored; repeated documents give
repeated rows, repeated items each count; other columns are kept when asked for; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import arrow_map, stash, table, text_map, with_text
from .kernels import WordHashes, grams

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
BLOCK_CHARS, RESIDENT, PART_WORDS = 2_000_000, 4, 400_000
MOST_BROADCAST, BLOOM_BITS, PROBES = BLOCK_CHARS * RESIDENT, 1 << 27, 3
ODD = np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII digits, letters (A-Z lower-cased) and all code points from U+0080, as UTF-8."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Code-point offsets of words()."""
    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def hashes(ids: np.ndarray, k: int) -> np.ndarray:
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    a = ids.astype(np.uint64) * ODD
    a ^= a >> np.uint64(32)
    x = a[:n].copy()
    for i in range(1, k):
        x *= ODD
        x ^= x >> np.uint64(30)
        x += a[i : n + i]
    x *= ODD
    return x ^ (x >> np.uint64(31))


def fingerprints(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of the 5-grams that are the fingerprints of the windows at `starts`."""
    h = hashes(ids, GRAM)
    seen = sliding_window_view(h, SPAN)[starts]
    return np.unique(starts + SPAN - 1 - np.argmin(seen[:, ::-1], axis=1))


def full_windows(ids: np.ndarray, k: int) -> np.ndarray:
    """Starts of windows of k words that are all in the vocabulary (id 0 stands for any other word and for gaps)."""
    if len(ids) < k:
        return np.empty(0, np.int64)
    gaps = np.concatenate(([0], np.cumsum(ids == 0)))
    return np.flatnonzero(gaps[k:] == gaps[:-k])


class Index:
    """Windows of one block of the benchmark."""

    def __init__(self, items: list[tuple[str, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.tables: dict[int, tuple] = {}
        by_length: dict[int, list[tuple[str, list[bytes]]]] = {}
        for item, text in items:
            if w := words(text):
                by_length.setdefault(min(len(w), WINDOW), []).append((item, w))
        for k, group in by_length.items():
            flat, owner, starts = [], [], []
            for item, w in group:
                at = len(flat)
                flat += [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]
                starts += range(at, at + len(w) - k + 1)
                owner += [item] * (len(w) - k + 1)
            ids, starts = np.array(flat, np.int32), np.array(starts, np.int64)
            grid = np.stack([ids[starts + i] for i in range(k)], 1)
            distinct, which = np.unique(grid, axis=0, return_inverse=True)
            order = np.argsort(keys := np.array([hashes(row, k)[0] for row in distinct]), kind="stable")
            owners: list[set] = [set() for _ in distinct]
            for j, item in zip(which.ravel().tolist(), owner, strict=True):
                owners[j].add(item)
            marks = np.unique(hashes(ids, GRAM)[fingerprints(ids, starts)]) if k == WINDOW else None
            self.tables[k] = (keys[order], distinct[order], [owners[j] for j in order], marks)

    def hits(self, ids: np.ndarray):
        """(k, starts of windows that occur in the benchmark, number of the distinct window of each)."""
        for k, (keys, grid, _, marks) in self.tables.items():
            starts = full_windows(ids, k)
            if k == WINDOW and len(starts):
                at = fingerprints(ids, starts)
                at = at[np.isin(hashes(ids, GRAM)[at], marks)]
                around = np.unique((at[:, None] - np.arange(SPAN)).ravel())
                starts = around[np.isin(around, starts, assume_unique=True)]
            if not len(starts):
                continue
            own = np.stack([ids[starts + i] for i in range(k)], 1)
            h = own[:, 0].astype(np.uint64) * ODD
            h ^= h >> np.uint64(32)
            for i in range(1, k):
                a = own[:, i].astype(np.uint64) * ODD
                a ^= a >> np.uint64(32)
                h *= ODD
                h ^= h >> np.uint64(30)
                h += a
            h *= ODD
            h ^= h >> np.uint64(31)
            lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
            while len(starts) and (lo < hi).any():  # more than one step only where two windows share a hash
                live = lo < hi
                starts, own, lo, hi = starts[live], own[live], lo[live], hi[live]
                same = (grid[lo] == own).all(1)
                yield k, starts[same], lo[same]
                starts, own, lo, hi = starts[~same], own[~same], lo[~same] + 1, hi[~same]


def characters(benchmark: DataFrame, text: str) -> int:
    return benchmark.agg(F.sum(F.length(text))).first()[0] or 0


def _blocks(benchmark: DataFrame, item: str, text: str) -> list:
    """Broadcasts of about BLOCK_CHARS characters of items each, of MOST_BROADCAST in all, collected one at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    n = max(1, math.ceil(characters(benchmark, text) / BLOCK_CHARS))
    parts = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) for b in range(n))
    return [spark.sparkContext.broadcast([(r.i, r.t) for r in part.collect()]) for part in parts]


def marks(a: np.ndarray, k: int) -> np.ndarray:
    """The fingerprint of each window of k words: of full windows the least of their 5-grams' hashes, of shorter ones their own."""
    h = grams(a, GRAM if k == WINDOW else k)
    return sliding_window_view(h, SPAN).min(1) if k == WINDOW and len(h) >= SPAN else h if k < WINDOW else h[:0]


def item_windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """item, k, g (the words, joined by a space) and mark (its fingerprint) of each window of the benchmark."""

    def make():
        hashes = WordHashes()

        def fn(texts):
            take, k_, g, mark = [], [], [], []
            for i, t in enumerate(texts):
                if w := words(t):
                    k = min(len(w), WINDOW)
                    found = marks(hashes.array(w), k)
                    take += [i] * len(found)
                    k_ += [k] * len(found)
                    mark += found.view(np.int64).tolist()
                    g += [b" ".join(w[j : j + k]).decode("utf-8", "surrogatepass") for j in range(len(found))]
            return {"take": take, "k": k_, "g": g, "mark": mark}

        return fn

    return text_map(benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")), ["item"], make, "k int, g string, mark long")


class Bloom:
    """A set of 64-bit hashes that may hold others too."""

    def __init__(self, words_: np.ndarray):
        self.words, self.bits = words_, np.uint64(len(words_) * 64)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for i in range(PROBES):
            at = (h >> np.uint64(20 * i)) % self.bits
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def bloom(windows: DataFrame) -> Bloom:
    """The filter of the marks, summed up by Spark; the driver gets its words, at most BLOOM_BITS / 64."""
    distinct = windows.select("mark").distinct()
    bits = min(BLOOM_BITS, max(1 << 16, 1 << (16 * distinct.count()).bit_length()))
    probe = F.explode(F.array(*[F.expr(f"shiftrightunsigned(mark, {20 * i}) & {bits - 1}L") for i in range(PROBES)]))
    at = distinct.select(probe.alias("at"))
    word = F.shiftrightunsigned("at", 6).cast("int").alias("word")
    found = at.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return Bloom(out.view(np.uint64))


def hits_by_join(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str, item: str, benchmark_text: str) -> DataFrame:
    """The columns `keep`, __n_words, __items and __spans of each document, for a benchmark of any size."""
    windows = stash(item_windows(benchmark, item, benchmark_text))
    shared = docs.sparkSession.sparkContext.broadcast(bloom(windows))
    lengths = [r.k for r in windows.select("k").distinct().collect()]  # at most WINDOW

    def make():
        hashes, known = WordHashes(), shared.value

        def fn(texts):
            n, likely = [], []
            for t in texts:
                w = words(t)
                a, own = hashes.array(w), []
                for k in lengths:
                    for i in np.flatnonzero(known.has(marks(a, k))).tolist() if len(w) >= k else ():
                        own.append({"k": k, "i": i, "g": b" ".join(w[i : i + k]).decode("utf-8", "surrogatepass")})
                n.append(len(w))
                likely.append(own)
            return {"__n_words": n, "__likely": likely}

        return fn

    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    rows = stash(text_map(numbered, [*keep, "__row"], make, "__n_words long, __likely array<struct<k:int,i:int,g:string>>", text))
    likely = rows.select("__row", F.inline("__likely"))
    found = stash(likely.join(windows.select("k", "g").distinct(), ["k", "g"]))
    items = found.select("__row", "k", "g").distinct().join(windows.select("item", "k", "g").distinct(), ["k", "g"])
    items = items.groupBy("__row").agg(F.sort_array(F.collect_set("item")).alias("__items"))
    span = F.struct(F.col("i").alias("begin"), (F.col("i") + F.col("k")).alias("end"))
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["begin"].alias("begin"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1)) >= x["begin"]), grown(acc, x)).otherwise(F.concat(acc, F.array(x)))
    empty = F.expr("cast(array() as array<struct<begin:int,end:int>>)")
    spans = found.groupBy("__row").agg(F.aggregate(F.sort_array(F.collect_list(span)), empty, step).alias("__spans"))
    out = rows.drop("__likely").join(spans, "__row", "left").join(items, "__row", "left")
    return out.select(*keep, "__n_words", F.coalesce("__items", F.expr("cast(array() as array<string>)")).alias("__items"), F.coalesce("__spans", empty).alias("__spans"))


def merged(own: list[tuple[int, int]]) -> list[list[int]]:
    """Spans that touch or overlap made one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(own):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class Matcher:
    """Finds the windows of the benchmark's blocks in texts."""

    def __init__(self, blocks: list):
        self.blocks, self.resident = blocks, {}

    def index(self, i: int) -> Index:
        if i in self.resident:
            return self.resident[i]
        made = Index(self.blocks[i].value)
        if i < RESIDENT:
            self.resident[i] = made
        else:
            self.blocks[i].__dict__.pop("_value", None)
        return made

    def run(self, texts: list[str | None]) -> list[tuple[int, list[str], list[list[int]]]]:
        """The number of words, the items (sorted) and the hit spans of each text."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(words(t))
            size += len(part[-1]) + WINDOW
            if size >= PART_WORDS:
                out += self.matched(part)
                part, size = [], 0
        return out + self.matched(part)

    def matched(self, split: list[list[bytes]]) -> list[tuple[int, list[str], list[list[int]]]]:
        n = [len(w) for w in split]
        begin = np.cumsum([0] + [x + WINDOW for x in n])
        found, items = [[] for _ in n], [set() for _ in n]
        for b in range(len(self.blocks)):
            ix = self.index(b)
            get = ix.vocabulary.get
            flat = np.zeros(int(begin[-1]), np.int32)
            for j, w in enumerate(split):
                flat[begin[j] : begin[j] + n[j]] = np.fromiter((get(x, 0) for x in w), np.int32, n[j])
            for k, starts, which in ix.hits(flat):
                owner = np.searchsorted(begin, starts, "right") - 1
                for j in np.unique(owner):
                    mine = owner == j
                    found[j] += [(int(s - begin[j]), int(s - begin[j]) + k) for s in starts[mine]]
                    for x in np.unique(which[mine]):
                        items[j] |= ix.tables[k][2][x]
        return [(n[j], sorted(items[j]), merged(found[j])) for j in range(len(n))]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", benchmark_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings) and hit spans (word numbers, end exclusive) of each document."""
    if characters(benchmark, benchmark_text) > MOST_BROADCAST:
        found = hits_by_join(docs, benchmark, ["doc_id"], text, item, benchmark_text)
        n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
        return found.select("doc_id", F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.col("__items").alias("items"), F.col("__spans").alias("spans"))
    blocks = _blocks(benchmark, item, benchmark_text)

    def make():
        matcher = Matcher(blocks)

        def fn(texts):
            n, items, spans = zip(*matcher.run(texts), strict=True)
            return {"n_words": n, "n_hit": [sum(b - a for a, b in s) for s in spans], "items": items, "spans": [[{"begin": a, "end": b} for a, b in s] for s in spans]}

        return fn

    return text_map(docs, ["doc_id"], make, "n_words long, n_hit long, items array<string>, spans array<struct<begin:int,end:int>>", text)


def without(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    at, parts, last = word_spans(text), [], 0
    for a, b in spans:
        parts.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join(parts) + text[last:]


def cut(texts: list[str | None], found: list[tuple[int, list[list[int]]]], most_share: float) -> dict:
    """The numbers of the texts that stay, and what is left of them, from the number of words and the hit spans of each."""
    take, out = [], []
    for i, (n, spans) in enumerate(found):
        if sum(b - a for a, b in spans) <= most_share * n:
            take.append(i)
            out.append(without(texts[i], spans) if spans else texts[i])
    return {"take": take, "__cut": out}


def cut_hits(docs: DataFrame, benchmark: DataFrame, most_share: float = 0.5) -> DataFrame:
    """`docs` without the hit words (and what stands between them); documents with more than `most_share` of their words hit
    go. n_chars, where there is one, follows the text."""
    kept = [c for c in docs.columns if c != "text"]
    if characters(benchmark, "text") > MOST_BROADCAST:
        found = hits_by_join(docs, benchmark, docs.columns, "text", "item_id", "text")

        def judge():
            def fn(batch):
                spans = [[(s["begin"], s["end"]) for s in x] for x in batch.column("__spans").to_pylist()]
                got = cut(batch.column("text").to_pylist(), list(zip(batch.column("__n_words").to_pylist(), spans, strict=True)), most_share)
                rows = batch.take(pa.array(got["take"], pa.int64()))
                yield {c: rows.column(c) for c in kept} | {"__cut": got["__cut"]}

            return fn

        schema = StructType([docs.schema[c] for c in kept] + [StructField("__cut", StringType())])
        return with_text(arrow_map(found, judge, schema), docs)
    blocks = _blocks(benchmark, "item_id", "text")

    def make():
        matcher = Matcher(blocks)
        return lambda texts: cut(texts, [(n, spans) for n, _, spans in matcher.run(texts)], most_share)

    return with_text(text_map(docs, kept, make, "__cut string"), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
