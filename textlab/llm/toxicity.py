"""Toxicity by weak supervision.

Many voters look at a text: groups of a public lexicon, the same lexicon after undoing letter substitutions, patterns
(insults addressed at a person, shouted insults, several insults close together), words and word beginnings mined from labelled rows, and two
voters for the absence of any sign. A generative label model (expectation-maximisation over a class and conditionally
independent votes, discounted by the voters' residual correlations) turns votes into posterior labels; a linear classifier
over voters and telling words is trained on those posteriors alone and calibrated on labelled rows.

Label model and classifier see every row of the learning fold: rows with the same votes and telling words are counted in
Spark, and the driver holds the distinct ones. Labels are one more voter of the label model, give its prior (their share over
all labelled rows of the fold), and serve to mine words and to calibrate; mining and calibration read a bounded hash sample of `LABELLED` labelled rows a class.

Defined results: null and empty texts are scored as texts without any sign; repeated rows score alike; long texts are read
whole; without labels of both classes (there is nothing to fit or calibrate on) the fixed voters have equal weights; other
columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, crc_fold, labelled_sample, table

LABELLED, MINED, MINED_VOTERS, CLOSE, THRESHOLD = 2_000, 400, 12, 8, 0.7
PREFIXES = (4, 5, 6, 7)
LEXICON = {
    "intelligence": "idiot idiots idiotic stupid stupidity moron morons moronic imbecile imbeciles dumb dumbass dimwit halfwit dunce cretin fool foolish brainless",
    "worth": "worthless useless pathetic loser losers trash garbage scum scumbag filth vermin parasite lowlife nobody failure",
    "disgust": "disgusting disgrace disgraceful repulsive revolting gross nasty vile sickening hideous ugly stinking filthy rotten",
    "ridicule": "clown clowns joke laughable ridiculous buffoon jerk creep freak weirdo coward pig rat snake dog donkey",
    "hostility": "hate hateful despise loathe die kill hurt destroy shut crap damn hell bastard bitch asshole fuck fucking shit bullshit",
    "de": "idioten dumm dummkopf blöd blödmann trottel depp versager abschaum müll widerlich ekelhaft erbärmlich wertlos arschloch scheiße schwein hure",
    "fr": "imbécile stupide crétin abruti débile nul minable ordure dégoûtant pathétique raté salaud connard merde pute clodo bouffon",
    "es": "idiota estúpido estúpida imbécil tonto basura asqueroso asquerosa patético inútil perdedor payaso escoria mierda cabrón puta gilipollas",
}
TOKEN = re.compile(r"[^\W_]+")
UNDO = str.maketrans("013457@$", "oieastas")
LEET = re.compile(r"\b(?=\w*[A-Za-z])(?=\w*[0-9@$])[A-Za-z0-9@$]{4,16}\b")
CORE = set(" ".join(LEXICON[g] for g in ("intelligence", "worth", "disgust", "ridicule")).split()) - {"nobody", "failure", "gross", "vile", "joke", "dog", "rat", "snake", "pig", "fool", "foolish", "nasty", "ugly"}
ADDRESSED = re.compile(r"\b(?:you|you're|your|he|she|they|such an?|what an?|total|complete|absolute)\b\W+(?:\w+\W+){0,2}(?:" + "|".join(sorted(CORE)) + r")\b", re.I)
GROUP = {w: g for g, words in enumerate(LEXICON.values()) for w in words.split()}
N_FIXED = len(LEXICON) + 7


def fixed_votes(text: str, tokens: set[str]) -> list[int]:
    """1 toxic, -1 not, 0 abstains: the lexicon's groups, patterns, and two voters for absence."""
    groups = {GROUP[t] for t in tokens & GROUP.keys()}
    votes = [int(g in groups) for g in range(len(LEXICON))]
    core = tokens & CORE
    near = False
    if core:
        at = [i for i, t in enumerate(TOKEN.findall(text.lower())) if t in CORE]
        near = any(b - a <= CLOSE for a, b in zip(at, at[1:], strict=False))
    shout = any(w.upper() in text for w in core)
    leet = any(w.lower().translate(UNDO) in GROUP for w in LEET.findall(text)) if re.search(r"\w[0134@$57]|[0134@$57]\w", text) else False
    votes += [int(bool(core)), int(near), int(shout), int(leet), int(bool(core) and bool(ADDRESSED.search(text)))]
    return votes + [0 if groups or leet else -1, 0 if core else -1]


def tokens_of(text: str | None) -> set[str]:
    return set(TOKEN.findall(text.lower())) if text else set()


def label_model(votes: np.ndarray, prior: float, rounds: int = 30, times: np.ndarray | None = None, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the toxic class for each row of votes, and each voter's weight after the correlation discount. A row
    counts as often as `times` says. `label`, where given, is one more voter, from whose votes the iteration starts."""
    times = np.ones(len(votes)) if times is None else times
    score = (votes == 1).sum(1) - 0.25 * (votes == -1).sum(1)
    if label is not None:
        score = np.where(label == 0, score, label)
        votes = np.column_stack([votes, label])
    n, m = times.sum(), votes.shape[1]
    values = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    q = np.clip(np.where(score > 0, 0.9, 0.05), 0.01, 0.99)
    weight = np.ones(m)
    for _ in range(rounds):
        rates = []
        for w in (q * times, (1 - q) * times):
            counts = np.einsum("n,nmv->mv", w, values) + 0.5
            rates.append(counts / counts.sum(1, keepdims=True))
        log = np.log(rates[0]) - np.log(rates[1])
        log[:, 1] = 0  # an abstention is no evidence
        part = np.einsum("nmv,mv->nm", values, log)
        expected = q[:, None] * np.einsum("mv,v->m", rates[0], [-1, 0, 1]) + (1 - q)[:, None] * np.einsum("mv,v->m", rates[1], [-1, 0, 1])
        rest = votes - expected
        spread = np.sqrt(times @ rest**2 / n) + 1e-6
        related = np.abs(rest.T @ (rest * times[:, None]) / n) / np.outer(spread, spread)
        np.fill_diagonal(related, 0)
        weight = 1 / (1 + np.where(related > 0.1, related, 0).sum(1))
        if label is not None:
            weight[-1] = 1  # what voters share with the label is no reason to doubt the label
        z = np.log(prior / (1 - prior)) + part @ weight
        q = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-4, 1 - 1e-4)
    return q, weight


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.02, steps: int = 400, rate: float = 0.5) -> np.ndarray:
    """Weights of a linear classifier (the last column of x is 1) on soft labels, by Adam-scaled gradient steps."""
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    keep = np.ones(x.shape[1])
    keep[-1] = 0
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) / weight.sum() + l2 / 20 * keep * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate / (1 + k / 100) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8) * 0.2
    return w


class Model:
    """Weights of the fixed voters and of words; `bias` closes the sum."""

    def __init__(self, voters: np.ndarray, words: dict[str, float], bias: float):
        self.voters, self.words, self.bias = voters, words, bias

    def score(self, text: str | None) -> float:
        text = text or ""
        tokens = tokens_of(text)
        z = self.bias + float(np.dot(self.voters, fixed_votes(text, tokens)))
        z += sum(self.words[t] for t in sorted(known(tokens, self.words)))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def signs(tokens: set[str]) -> set[str]:
    """The tokens, and the beginnings of longer ones marked by ^."""
    return tokens | {"^" + t[:k] for t in tokens for k in PREFIXES if len(t) >= k}


def known(tokens: set[str], words: dict[str, float]) -> set[str]:
    """The signs of a text that are among `words`."""
    found = tokens & words.keys()
    for k in PREFIXES:
        found |= {"^" + t[:k] for t in tokens if "^" + t[:k] in words}
    return found


def mined(texts: list[set[str]], y: list[int]) -> list[str]:
    """Signs that labelled toxic rows hold far more often than others, chosen so that each toxic row is met
    several times, the first counting most."""
    n = Counter(y)
    if not n[0] or not n[1]:
        return []
    toxic, clean = Counter(), Counter()
    for t, k in zip(texts, y, strict=True):
        if k == 1:
            toxic.update(signs(t))
    least = max(4, 0.006 * n[1])
    names = {w: c for w, c in toxic.items() if c >= least}
    for t, k in zip(texts, y, strict=True):
        if k == 0:
            clean.update(known(t, names))
    names = sorted(w for w, c in names.items() if (c + 0.5) / n[1] > 10 * (clean[w] + 0.5) / n[0])
    if not names:
        return []
    number = {w: i for i, w in enumerate(names)}
    has = np.zeros((len(names), len(texts)), bool)
    for j, t in enumerate(texts):
        for w in known(t, number):
            has[number[w], j] = True
    y1, chosen = np.array(y) == 1, []
    met, worth = np.zeros(len(texts), int), np.array([1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1])
    cost = 5 * has[:, ~y1].sum(1) * n[1] / n[0]
    while len(chosen) < min(MINED, len(names)):
        gain = has[:, y1] @ worth[np.minimum(met[y1], len(worth) - 1)] - cost
        gain[chosen] = -1
        best = int(gain.argmax())
        if gain[best] < least / 2:
            break
        chosen.append(best)
        met += has[best]
    return [names[i] for i in chosen]


def patterns(docs: DataFrame, labels: DataFrame, telling: list[str]) -> DataFrame:
    """(votes, words, label, n): how many rows have each combination of fixed votes, telling words (numbers in `telling`) and
    label (1 toxic, -1 not, 0 none). Labels join the votes, so no text is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(telling)})

    def make():
        number = shared.value

        def fn(batch):
            found = [pattern(t, number) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id").to_pylist(), "votes": [v for v, _ in found], "words": [w for _, w in found]}

        return fn

    known_labels = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg((2 * F.max("toxic").cast("int") - 1).alias("label"))
    voted = arrow_map(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, votes array<int>, words array<int>")
    return voted.join(known_labels, "doc_id", "left").groupBy("votes", "words", F.coalesce("label", F.lit(0)).alias("label")).agg(F.count("*").alias("n"))


def pattern(text: str | None, number: dict[str, int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    tokens = tokens_of(text)
    return tuple(fixed_votes(text or "", tokens)), tuple(sorted(number[w] for w in known(tokens, number)))


def features(votes: list, words: list, n_words: int) -> np.ndarray:
    """One row a pattern: its fixed votes, its telling words, and 1."""
    x = np.zeros((len(votes), N_FIXED + n_words + 1))
    x[:, :N_FIXED], x[:, -1] = votes, 1
    for row, w in zip(x, words, strict=True):
        row[N_FIXED + np.array(w, int)] = 1
    return x


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """Learns from documents and labels for which `learn` (a condition on doc_id) holds."""
    rows = sorted(((r.text or "", r.y) for r in labelled_sample(docs, labels, "toxic", LABELLED, keep=learn).collect()), key=lambda r: (r[1], r[0]))
    texts, y = [r[0] for r in rows], np.array([r[1] for r in rows])
    if not {0, 1} <= set(y.tolist()):
        return Model(np.r_[np.full(N_FIXED - 2, 1.0), 0.5, 1.5], {}, -1.0)
    telling = mined([tokens_of(t) for t in texts], y.tolist())
    prior = labels.where(learn & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y")).agg(F.avg("y")).first()[0]
    found = sorted(map(tuple, patterns(docs.where(learn), labels, telling).collect()))
    label, times = (np.array([r[k] for r in found], float) for k in (2, 3))
    x = features([r[0] for r in found], [r[1] for r in found], len(telling))
    words = x[:, N_FIXED:-1]
    more = [words[:, k::MINED_VOTERS].any(1) for k in range(MINED_VOTERS)] + [-1.0 * (words.sum(1) == 0) if telling else np.zeros(len(x))]
    q, _ = label_model(np.column_stack([x[:, :N_FIXED], *more]), float(np.clip(prior, 0.02, 0.6)), times=times, label=label)
    w = logistic(x, q, times)
    number = {t: i for i, t in enumerate(telling)}
    z = features(*map(list, zip(*(pattern(t, number) for t in texts), strict=True)), len(telling)) @ w
    # the scale is set on labelled rows, so that 0.7 separates the classes with a margin on both sides
    high, low = np.median(z[y == 1]), np.median(z[y == 0])
    cut = max(((np.mean(z[y == 1] >= c) - 5 * np.mean(z[y == 0] >= c)), c) for c in np.unique(np.r_[z, (high + low) / 2]))[1]
    below = z[z < cut]
    middle = (cut + (below.max() if len(below) else cut)) / 2
    scale = 6 / max(1e-6, high - low)
    w = w * scale
    w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - middle * scale
    return Model(w[:N_FIXED], dict(zip(telling, w[N_FIXED:-1].tolist(), strict=True)), float(w[-1]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, score and predicted (1 from THRESHOLD on) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def fn(batch):
            s = [model.score(t) for t in batch.column("text").to_pylist()]
            yield {key: batch.column("key").to_pylist(), "score": s, "predicted": [int(x >= THRESHOLD) for x in s]}

        return fn

    return arrow_map(docs.select(docs[key].alias("key"), docs[text].alias("text")), make, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels, crc_fold("doc_id", 3) != 1))
    return out.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
