"""Near-duplicate detection with SetSketch registers.

A document's set is that of its distinct word shingles. Its sketch holds, a register, the minimum of an exponential hash over
the set, truncated to a power of a base: r = floor(1 - log_b(min)), cut off at the ends. Registers of a union are the maxima
of the registers (mergeable), and those of two sets agree with a probability that grows with their similarity.

1. Every text is sketched once; equal sets form a class, named by a hash of the set.
2. Runs of `ROWS` registers are hashed into `BANDS` band keys; classes that share a key are candidates. With 4 registers in
   each of 32 bands a pair at similarity 0.8 is missed with probability below 1e-7.
3. Stars: each class is compared, on full sets, with one representative: the least class of a bucket, that with which it
   shares most buckets. This links large groups of near copies in a number of comparisons that grows with their members only.
4. What is left: buckets whose classes are in different components so far. Their most frequent component's members are
   compared with the others only, and the others among each other. On sketches, pairs are left out whose joint likelihood
   estimate of the similarity (from the numbers of greater, equal and smaller registers and the known sizes) is so low that
   0.8 is over five standard errors away, and pairs that share an earlier band (each pair is looked at once). The likely
   linked form clusters; their members' full sets are compared exactly.
5. Components over all edges are found by alternating large-star and small-star steps on tables.

A representative's star, and a bucket, with more than `CHUNK` members or `LOAD` shingles is cut into chunks, and every pair of
chunks with something to compare is a task of its own: no task holds more than two chunks and no pair is lost. Full sets are
made once for each class that shares a bucket.

Defined results: null and empty texts and texts without words have an empty set, are linked with nothing and kept; a text of
fewer words than a shingle is one shingle; repeated rows and ties go to the smallest key; rows without a key are linked like
others, their component is named by the smallest key in it and by null if there is none; very long texts are sketched whole,
in slices; other columns are kept by `keep_one`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import drop_unasked, stash, table, text_map
from .kernels import WordHashes, grams

REGISTERS, BANDS, ROWS, BASE, PERCENT = 128, 32, 4, 1.02, 80
CHUNK, LOAD = 1_024, 4_000_000
LOOSE = 5.0
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(1, 1 << 30, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def shingles(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles (words between ASCII white space, A-Z lower-cased)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(grams(hashes.array(words), k))


def sketch(found: np.ndarray) -> np.ndarray:
    """Truncated exponential minima of a non-empty set, as unsigned 16-bit registers."""
    least = np.full(REGISTERS, np.uint32(0xFFFFFFFF))
    short = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(found), 1024):
        x = short[at : at + 1024, None] * FACTORS
        x += SHIFTS
        np.minimum(least, x.min(0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**32 * (1 - 1e-12))
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 65_535).astype(np.uint16)


def similarity(d_more: np.ndarray, d_less: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of sets of sizes a and b whose registers differ upwards and downwards so often.

    A register of A exceeds B's with probability p(u - v j) and falls short with p(v - u j), for shares u and v of the sizes
    and p(x) = -log_b(1 - x (b - 1) / b); the likelihood of the three counts is maximised over a grid of j."""
    u = a / (a + b)
    most = np.minimum(u, 1 - u) / np.maximum(u, 1 - u)
    best, out = np.full(d_more.shape, -np.inf), np.zeros(d_more.shape)
    same = REGISTERS - d_more - d_less
    p = lambda x: np.clip(-np.log(1 - np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1 - 1e-9)
    for j in np.linspace(0.05, 1, 39):
        top = np.minimum(j, most)
        more, less = p(u - (1 - u) * top), p((1 - u) - u * top)
        value = d_more * np.log(more) + d_less * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-9))
        better = value > best
        best, out = np.where(better, value, best), np.where(better, top, out)
    return out


def floor_of(percent: int) -> float:
    t = percent / 100
    return t - LOOSE * np.sqrt(t * (1 - t) / REGISTERS)


def pairs_of(band: int, sketches: np.ndarray, sizes: np.ndarray, parts: np.ndarray, percent: int, first: int | None = None):
    """(i, j arrays) of likely pairs of members of a bucket of this band that belong to different parts and share no earlier
    band.

    With `first`, only pairs of one of the first `first` members with a later one."""
    n = len(sketches)
    least = floor_of(percent)
    bands = sketches.reshape(n, BANDS, ROWS)
    for i in range(n if first is None else first):
        j = np.arange(i + 1 if first is None else first, n)
        j = j[parts[j] != parts[i]]
        if not len(j):
            continue
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        j = j[100 * small >= percent * large]
        j = j[(sketches[j] == sketches[i]).sum(1) >= REGISTERS * (least - 0.05)]
        if band and len(j):
            j = j[~(bands[j, :band] == bands[i, :band]).all(2).any(1)]
        if len(j):
            more, less = (sketches[i] > sketches[j]).sum(1), (sketches[i] < sketches[j]).sum(1)
            j = j[similarity(more, less, np.full(len(j), float(sizes[i])), sizes[j].astype(float)) >= least]
        if len(j):
            yield i, j


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def set_name(items: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketched(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_hash, n_shingles, node (a hash of the set; null for an empty set) and sketch of each row."""

    def make():
        hashes = WordHashes()

        def fn(texts):
            n, nodes, sketches = [], [], []
            for t in texts:
                s = shingles(t, k, hashes)
                n.append(len(s))
                nodes.append(set_name(s) if len(s) else None)
                sketches.append(sketch(s).tobytes() if len(s) else None)
            return {"n_shingles": n, "node": nodes, "sketch": sketches}

        return fn

    named = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_hash"))
    return text_map(named, ["key", "text_hash"], make, "n_shingles long, node long, sketch binary")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """node and items (the full set) of the classes `wanted` (node, rep), made from their representatives' texts."""

    def make():
        hashes = WordHashes()

        def fn(texts):
            return {"items": [shingles(t, k, hashes).tobytes() for t in texts]}

        return fn

    named = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_hash")).alias("d")
    reps = wanted.select("node", F.col("rep.key").alias("rep_key"), F.col("rep.text_hash").alias("rep_hash"))
    met = named.join(reps, (F.col("text_hash") == F.col("rep_hash")) & F.col("key").eqNullSafe(F.col("rep_key")))
    return text_map(met.select("node", "text"), ["node"], make, "items binary").dropDuplicates(["node"])


def _binary(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """Arrays on the buffers of a binary column, without copies."""
    return [np.frombuffer(x.as_buffer(), kind) for part in column.chunks for x in part]


def _grouped(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """applyInArrow with a function from numpy columns (lists of arrays for binary ones) to columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    kinds = {"sketch": np.uint16, "items": np.uint64}

    def run(rows: pa.Table) -> pa.Table:
        drop_unasked()
        out = fn({c: _binary(rows.column(c), kinds[c]) if c in kinds else rows.column(c).to_numpy() for c in rows.column_names})
        return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.groupBy(*keys).applyInArrow(run, schema)


def buckets(nodes: DataFrame) -> DataFrame:
    """node, n_shingles, band, bucket and center (the bucket's least class), for buckets of two classes or more."""
    width = 2 * ROWS
    keys = F.array(*[F.struct(F.lit(j).alias("band"), F.xxhash64(F.lit(j), F.substring("sketch", 1 + j * width, width)).alias("bucket")) for j in range(BANDS)])
    rows = nodes.select("node", "n_shingles", F.explode(keys).alias("b")).select("node", "n_shingles", "b.band", "b.bucket")
    centers = rows.groupBy("band", "bucket").agg(F.count("*").alias("members"), F.min("node").alias("center")).where("members > 1")
    return rows.join(centers.drop("members"), ["band", "bucket"])


def parts_of(members: Column, load: Column) -> Column:
    return F.greatest(F.ceil(members / CHUNK), F.ceil(load / LOAD)).cast("int")


def dealt(parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), "node"), parts).cast("int")


def stars(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between classes and the representatives that they are really linked with."""
    shared = met.where("node <> center").groupBy("node", "n_shingles", "center").agg(F.count("*").alias("shared"))
    best = shared.groupBy("node", "n_shingles").agg(F.max_by("center", F.struct("shared", F.bitwise_not("center"))).alias("center"))
    best = stash(best)
    chunks = best.groupBy("center").agg(parts_of(F.count("*"), F.sum("n_shingles")).alias("parts"))
    members = best.join(chunks, "center").select("center", dealt(F.col("parts")).alias("part"), "node")
    hubs = chunks.select("center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("center").alias("node"))

    def fn(c):
        node, center = c["node"], int(c["center"][0])
        hub = c["items"][int(np.flatnonzero(node == center)[0])]
        near = [int(x) for x, items in zip(node, c["items"], strict=True) if x != center and linked(hub, items, percent)]
        return {"a": near, "b": [center] * len(near)}

    return _grouped(members.union(hubs).join(sets.select("node", "items"), "node"), ["center", "part"], fn, "a long, b long")


def open_rows(met: DataFrame, roots: DataFrame) -> DataFrame:
    """band, bucket, node, comp (its component so far) and own (its chunk), once for each chunk pair (ci, cj) it takes part in,
    for the buckets that hold several components. Chunks of the most frequent component come last and do not meet."""
    rows = met.drop("center").join(roots.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = rows.groupBy("band", "bucket", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("load"))
    by_size = F.struct("n", F.bitwise_not("comp"))
    wide = per.groupBy("band", "bucket").agg(F.count("*").alias("comps"), F.max_by("comp", by_size).alias("major"), F.max_by("n", by_size).alias("n1"), F.max_by("load", by_size).alias("load1"), F.sum("n").alias("n"), F.sum("load").alias("load")).where("comps > 1")
    whole = (F.col("n") <= CHUNK) & (F.col("load") <= LOAD)
    wide = wide.select("band", "bucket", "major", whole.alias("whole"), F.when(whole, 1).otherwise(parts_of(F.col("n") - F.col("n1"), F.col("load") - F.col("load1"))).alias("m"), F.when(whole, 0).otherwise(parts_of(F.col("n1"), F.col("load1"))).alias("q"))
    minor = F.col("whole") | (F.col("comp") != F.col("major"))
    met_wide = rows.join(wide, ["band", "bucket"])
    own = F.when(minor, dealt(F.col("m"))).otherwise(F.col("m") + dealt(F.greatest(F.col("q"), F.lit(1))))
    last = F.when(minor, F.col("m") + F.col("q")).otherwise(F.col("m")) - 1
    out = met_wide.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return out.select("band", "bucket", "node", "comp", "own", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj"))


def clusters(rows: DataFrame, percent: int) -> DataFrame:
    """cluster, band, split, own, comp and node of the likely linked members of each bucket or chunk pair."""

    def fn(c):
        band, ci, cj = int(c["band"][0]), int(c["ci"][0]), int(c["cj"][0])
        order = np.lexsort((c["node"], c["own"]))
        first = None if ci == cj else int((c["own"] == ci).sum())
        node, own, comp, sizes = (c[x][order] for x in ("node", "own", "comp", "n_shingles"))
        sketches = np.stack([c["sketch"][i] for i in order])
        forest, used = Forest(len(node)), set()
        for i, j in pairs_of(band, sketches, sizes, comp, percent, first):
            used.add(i)
            used.update(j.tolist())
            for x in j.tolist():
                forest.join(i, x)
        used = sorted(used)
        named = [xxhash.xxh64_intdigest(f"{band}:{c['bucket'][0]}:{ci}:{cj}:{node[forest.root(x)]}") - (1 << 63) for x in used]
        return {"cluster": named, "band": [band] * len(used), "split": [ci != cj] * len(used), "own": own[used], "comp": comp[used], "node": node[used]}

    return _grouped(rows, ["band", "bucket", "ci", "cj"], fn, "cluster long, band int, split boolean, own int, comp long, node long")


def edges_of(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of each cluster's components, from exact comparisons of full sets."""

    def fn(c):
        order = np.lexsort((c["node"], c["own"]))
        own, node, comp = (c[x][order] for x in ("own", "node", "comp"))
        first = int((own == own.min()).sum()) if c["split"][0] else None
        sets, sketches = [c["items"][i] for i in order], np.stack([c["sketch"][i] for i in order])
        _, number = np.unique(comp, return_inverse=True)
        forest, a, b = Forest(len(node)), [], []
        for i, j in pairs_of(int(c["band"][0]), sketches, np.array([len(s) for s in sets]), comp, percent, first):
            for x in j.tolist():
                if forest.root(int(number[i])) != forest.root(int(number[x])) and linked(sets[i], sets[x], percent):
                    forest.join(int(number[i]), int(number[x]))
                    a.append(comp[i])
                    b.append(comp[x])
        return {"a": a, "b": b}

    return _grouped(rows, ["cluster"], fn, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge. Large-star and small-star steps until all are stars."""
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stash(large.where("a <> b").distinct())
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a")
        edges = stash(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(root.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        if edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and edges.groupBy("a").count().where("count > 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(docs: DataFrame, k: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (key, text_hash, n_shingles, node), classes (node, rep: the row that stands for it), and the components' roots
    (node, root) of all classes that are linked with another; rep orders rows: those with a key first, by key."""
    rows = stash(sketched(docs, k, key, text))
    rep = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "text_hash")).alias("rep")
    nodes = stash(rows.where("node is not null").groupBy("node").agg(rep, F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    met = stash(buckets(nodes))
    wanted = met.select("node").distinct().join(nodes.select("node", "rep", "n_shingles", "sketch"), "node")
    sets = stash(full_sets(docs, wanted, k, key, text))
    first = components(stars(met, sets, percent))
    one = stash(first.union(first.select("root", "root").distinct()).toDF("node", "root"))
    again = open_rows(met, one).join(wanted.select("node", "n_shingles", "sketch"), "node")
    full = clusters(again, percent).join(sets, "node").join(wanted.select("node", "sketch"), "node")
    second = components(edges_of(full, percent))
    two = stash(second.union(second.select("root", "root").distinct()).toDF("root", "top"))
    joined = one.join(two, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = two.join(one.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return rows.drop("sketch"), nodes.select("node", "rep"), joined.union(alone)


def representatives(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """node and rep of its component, for every class."""
    linked_ones = roots.join(nodes, "node")
    least = linked_ones.groupBy("root").agg(F.min("rep").alias("least"))
    named = linked_ones.join(least, "root").select("node", "least")
    return stash(nodes.join(named, "node", "left").select("node", F.coalesce("least", "rep").alias("rep")))


def groups(docs: DataFrame, k: int, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable over links of at least `percent`) of each row."""
    rows, nodes, roots = classes(docs, k, percent, key, text)
    named = representatives(nodes, roots)
    own = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("rep.key"))
    return rows.join(named, "node", "left").select(F.col("key").alias(key), "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` for each component: that with the smallest key (any of equal key and text). Rows without words all
    stay, but for repetitions of a row with the same key and text."""
    rows, nodes, roots = classes(docs, k, percent, key, text)
    best = representatives(nodes, roots).select("rep.key", "rep.text_hash").distinct().withColumn("stands", F.lit(True))
    times = rows.groupBy("key", "text_hash", "node").agg(F.count("*").alias("times"))
    same = (F.col("t.text_hash") == F.col("b.text_hash")) & F.col("t.key").eqNullSafe(F.col("b.key"))
    kept = times.alias("t").join(best.alias("b"), same, "left").where(F.col("t.node").isNull() | F.col("b.stands"))
    kept = stash(kept.select(F.col("t.key").alias("__key"), F.col("t.text_hash").alias("__hash"), "times"))
    named = docs.withColumn("__text_hash", F.xxhash64(docs[text]))

    def of(chosen: DataFrame) -> DataFrame:
        return named.join(chosen, (F.col("__text_hash") == F.col("__hash")) & named[key].eqNullSafe(F.col("__key")), "left_semi")

    again = of(kept.where("times > 1")).dropDuplicates([key, "__text_hash"])
    return of(kept.where("times = 1")).unionByName(again).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), 4).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c2 FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c2 >= 80 * (na.n + nb.n - c2)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
