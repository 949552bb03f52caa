"""Personal data: candidate spans judged by boosted trees.

Base rules find emails, IPv4 addresses, card numbers and phone numbers by their exact patterns; what they find stays. On top,
high-recall generators propose overlapping spans that the base rules miss (addresses spelled out with "at" and "dot", IPv6
addresses, card numbers inside longer digit chains, phone numbers without a plus or inside longer chains) and one more kind,
`secret` (keys, tokens and passwords given to a name). Boosted trees over format and context features give each candidate a
probability; a threshold a kind, calibrated for precision on examples held out of the training, selects; of overlapping
choices the likelier stays, and none may overlap a base span.

No labelled spans exist, so the trees are trained on the documents' own text: windows of a bounded hash sample of documents
(`WINDOWS` of them, of `WINDOW_CHARS` characters) give the words around a span, and base spans found in them, perturbed (spelled
out, put into longer chains, stripped of their plus or their checksum), give labelled candidates beside generated ones. The
base patterns are matched in linear time (long runs of letters, digits or spaces cannot make them quadratic).

Defined results: null and empty texts hold nothing; repeated rows are treated alike; ties between overlapping candidates go
to the earlier, then the longer; without documents the windows are invented words; other columns, whatever their names, are
kept by `redact`.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import bounded_sample, table, text_map, with_text

KINDS = ("email", "ip", "card", "phone")
EVERY = (*KINDS, "secret")
LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
PRECISION, CONTEXT, WINDOWS, WINDOW_CHARS = 0.995, 24, 600, 400


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = last + len(text[last:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append((begin, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind; matches that fail their test are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if DIGITS.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 if len(p) < 10 else not p.strip("0") or int(p[-3:]) <= 255 and not p[:-3].strip("0") for p in m[0].split("."))]
        for m in CHAIN.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?: ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| (?:at|AT) )[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) )[A-Za-z0-9-]{1,63}){1,4}")
IP6 = re.compile(r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])")
GROUPED = re.compile(r"(?<![0-9])(?=((?:[0-9]{4}[ -]?){3}[0-9]{4})(?![0-9]))")
AMEX = re.compile(r"(?<![0-9])(?=(3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9]))")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])")
CALLED = re.compile(r"(?i)\b(?:tel|phone|call|mobile|cell|fax|ring|telefon|téléphone|teléfono|móvil|handy|contact)")
PAID = re.compile(r"(?i)\b(?:card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta|pan)")
HOSTED = re.compile(r"(?i)\b(?:ip|host|server|addr|login|from|client|node)")
MAILED = re.compile(r"(?i)(?:mail|contact|write|reach|schreib|correo|courriel)")
NUMBERED = re.compile(r"(?i)(?:version|v|isbn|no|nr|order|invoice|ref|serial|id|sku|date|page|code)[.:# ]*$")

KEYLIKE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,128}(?![A-Za-z0-9+/_-])")
ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|auth)\w{0,8}[\"']? ?(?:=|:|is)? ?[\"']?$")
HASHED = re.compile(r"(?i)(?:sha-?[0-9]*|md5|commit|checksum|digest|hash|etag|uuid|revision|build)[ :=]{0,3}[\"']?$")


def entropy(s: str) -> float:
    """Bits a character."""
    n = np.array(list(Counter(s).values()), float) / max(1, len(s))
    return float(-(n * np.log2(n)).sum())


def overlaps(a: tuple[int, int], spans: list[tuple[int, int]]) -> bool:
    """Whether a span meets one of `spans`, which are in order and apart."""
    i = bisect_left(spans, (a[1],))
    return i > 0 and spans[i - 1][1] > a[0]


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """(kind number, begin, end) of overlapping spans besides the base ones."""
    found: list[tuple[int, int, int]] = []
    low = text if " at " in text or " AT " in text or re.search(r"[\[({<] ?(?:at|AT|@)", text) else ""
    if low and ("dot" in text or "DOT" in text or "[.]" in text or "(." in text or re.search(r"[\])}>] ?[A-Za-z0-9-]+\.[a-z]", text)):
        found += [(0, *m.span()) for m in SPELLED.finditer(text)]
    if DIGITS.search(text):
        if text.count(":") > 1:
            found += [(1, *m.span()) for m in IP6.finditer(text)]
        for m in CHAIN.finditer(text):
            if m.end() - m.start() >= 15:
                begin = m.start()
                found += [(2, begin + s.start(1), begin + s.end(1)) for p in (GROUPED, AMEX) for s in p.finditer(m[0])]
        found += [(3, *m.span()) for m in LOCAL_PHONE.finditer(text)]
        if "+" in text:
            for m in PHONE.finditer(text):
                if len(only_digits(m[0])) > 15:
                    found += [(3, m.start(), m.start() + s.end()) for s in [re.match(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])", m[0])] if s]
        found += [(4, *m.span()) for m in KEYLIKE.finditer(text) if DIGITS.search(m[0]) and re.search("[A-Za-z]", m[0])]
    return [c for c in dict.fromkeys(found) if not overlaps(c[1:], base.get(EVERY[c[0]], []))]


def features(text: str, kind: int, begin: int, end: int, base: dict[str, list[tuple[int, int]]]) -> list[float]:
    s, before, after = text[begin:end], text[max(0, begin - CONTEXT) : begin], text[end : end + CONTEXT]
    d = only_digits(s)
    groups = [len(x) for x in re.findall(r"[0-9]+", s)]
    marks = re.sub(r"[0-9A-Za-z]", "", s)
    others = any(overlaps((begin, end), base[k]) for k in KINDS if k != EVERY[kind])
    return [
        kind, len(s), len(d), float(luhn(d)) if d else 0.0, len(set(d)), len(groups), max(groups, default=0), min(groups, default=0),
        float(len(set(marks)) <= 1), float("(" in s and ")" in s), float(s.startswith("+")), s.count(":"), float("::" in s),
        float(bool(re.search(r"(?i)[\[({] ?(?:at|@|dot|\.)", s))), float(bool(re.search(r"(?i) dot ", s))), float(bool(re.search(r"(?i)(?:\.|dot ?[\])}]? ?)(?:com|org|net|edu|io|de|fr|es|uk|info)$", s))),
        float(bool(re.search(r"[0-9][ -]?$", before))), float(bool(re.match(r"[ -]?[0-9]", after))), float(bool(re.search(r"\w$", before))), float(bool(re.match(r"\w", after))),
        float(bool(CALLED.search(before))), float(bool(PAID.search(before))), float(bool(HOSTED.search(before))), float(bool(MAILED.search(before))), float(bool(NUMBERED.search(before))),
        float(bool(re.match(r"[0-9]{1,2}[:.][0-9]{2}[:.]", s))), float(d[:1] in "3456") if d else 0.0, float(d[:2] in ("19", "20")) if d else 0.0, float(others), float(bool(re.search(r"[A-Fa-f]", s))),
        entropy(s), float(bool(re.fullmatch("[0-9a-fA-F]+", s))), float(bool(ASSIGNED.search(before))), float(bool(HASHED.search(before))), float(before[-1:] in ("'", '"') and after[:1] == before[-1:]),
    ]


def windows(docs: DataFrame, text: str = "text") -> list[str]:
    """Pieces of a hash sample of about WINDOWS documents, each from a place that the text's hash names."""
    rows = docs.select(docs[text].alias("t"), F.xxhash64(docs[text]).alias("h"))
    begin = F.pmod(F.col("h"), F.greatest(F.length("t") - WINDOW_CHARS, F.lit(1))).cast("int") + 1
    return sorted(r.w for r in bounded_sample(rows, WINDOWS, "h").where("t <> ''").select(F.substring("t", begin, F.lit(WINDOW_CHARS)).alias("w")).collect())


def examples(n: int, seed: int, around: list[str] | tuple[str, ...] = ()) -> tuple[list[str], list[tuple[int, int, int, int]]]:
    """Texts with spans (text number, kind, begin, end) that are personal data; other candidates in them are not. Words and
    base spans of the windows `around` are used where there are any."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    invented = lambda: "".join(pick("an", "er", "tion", "ou", "de", "la", "st", "re", "li", "mo", "ka") for _ in range(int(rng.integers(1, 4))))
    real = [w for w in (re.findall(r"[^\W\d_]+[.,;!?]?", x) for x in around) if len(w) > 6]
    found: dict[str, list[str]] = {k: [] for k in KINDS}
    for x in around:
        for k, v in base_spans(x).items():
            found[k] += [x[b:e] for b, e in v]

    def phrase(k: int) -> str:
        if not real:
            return " ".join(invented() for _ in range(k))
        words = real[int(rng.integers(len(real)))]
        at = int(rng.integers(max(1, len(words) - k)))
        return " ".join(words[at : at + k])

    def word() -> str:
        w = re.sub(r"\W", "", phrase(1).lower())
        return w if w.isascii() and w else invented()

    def masked(s: str) -> str:
        """Other digits in the format of a base span."""
        return re.sub("[0-9]", lambda m: digits(1), s)

    key = lambda k, letters: "".join(letters[int(i)] for i in rng.integers(0, len(letters), k))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card(k: int = 16, first: str | None = None) -> str:
        body = (first or pick("4", "5", "2", "6", "3", "9", "7")) + digits(k - 2)
        body = body[: k - 1]
        return body + next(c for c in "0123456789" if luhn(body + c))

    def not_card(k: int = 16, first: str = "") -> str:
        while luhn(d := first + digits(k - len(first))):
            pass
        return d

    def spaced(d: str, mark: str) -> str:
        return mark.join(d[i : i + 4] for i in range(0, len(d), 4))

    def spelled(at: str, dot: str) -> str:
        local, _, host = pick(*found["email"]).partition("@")
        return f"{local}{at}{host.replace('.', dot)}"

    texts, spans = [], []
    for t in range(n):
        parts: list[tuple[str, int | None]] = []
        for _ in range(int(rng.integers(2, 5))):
            parts += [(phrase(int(rng.integers(1, 6))) + " ", None)]
            kind, good = int(rng.integers(5)), rng.random() < 0.5
            if kind == 0:
                host, top = word(), pick("com", "org", "net", "de", "fr", "es", "example.com", "io")
                if good:
                    at, dot = pick((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" (at) ", "."), (" AT ", " DOT "), ("{at}", "{dot}"))
                    parts += [(pick("", "mail ", "contact: ", "write to "), None), (spelled(at, dot) if found["email"] and rng.random() < 0.5 else f"{word()}{pick('', '.' + word(), digits(2))}{at}{host}{dot}{top.replace('.', dot)}", 0)]
                else:
                    parts += [(pick(f"{word()} at {word()}.{word()} {word()}", f"look at {word()}.{word()}", f"{word()} at the dot {word()}", f"arrived at {digits(1)}.{digits(2)}", f"{word()} at {word()} dot {word()}"), None)]
            elif kind == 1:
                if good:
                    six = [f"{rng.integers(0, 65536):x}" for _ in range(8)]
                    parts += [(pick("", "ip ", "host ", "from "), None), (pick(":".join(six), f"2001:db8::{six[0]}:{six[1]}", f"fe80::{six[0]}:{six[1]}:{six[2]}"), 1)]
                else:
                    parts += [(pick(f"{digits(2)}:{digits(2)}:{digits(2)}", f"at 1{digits(1)}:{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(1)}:{digits(1)}:{digits(1)}", f"ab:cd:ef:{digits(2)}"), None)]
            elif kind == 2:
                mark = pick("", " ", "-")
                if good:
                    parts += pick([(spaced(card(), mark), 2), (" " + not_card(), None)], [(spaced(card(), mark), 2), (" ", None), (spaced(card(), mark), 2)], [(pick("card ", "visa "), None), (card(15, "37"), 2)], [(spaced(card(), mark), 2), (" " + digits(int(rng.integers(2, 6))), None)], [(digits(int(rng.integers(2, 6))) + " ", None), (spaced(card(), mark), 2)])
                else:
                    parts += pick([(spaced(not_card(), mark), None)], [(pick("order ", "isbn ", "serial "), None), (not_card(20), None)], [(not_card(16) + " " + not_card(16), None)], [(pick("", "id "), None), (not_card(15, "37"), None)])
            elif kind == 4:
                secret = pick(key(40, hexes), key(32, hexes), key(int(rng.integers(20, 48)), mixed), "sk_" + key(24, mixed), "ghp_" + key(36, mixed), "AKIA" + key(16, mixed).upper())
                quote = pick('"', '"', "'", "")
                if good:
                    parts += [(pick("token", "api_key", "secret", "password", "access_key", "auth_token", "API key", "SECRET_KEY") + pick(" = ", "=", ": ", " is ") + quote, None), (secret, 4), (quote, None)]
                else:
                    parts += [(pick("sha256 ", "commit ", "md5: ", "checksum=", "etag: ", "build ", "uuid ", "", "", "see "), None), (pick(key(40, hexes), key(64, hexes), key(32, hexes), word() + "-" + word() + "-" + word() + digits(4), f"{word()}_{word()}_{digits(4)}_{word()}"), None)]
            else:
                mark = pick("-", " ", ".")
                if good and found["phone"] and rng.random() < 0.4:
                    base = masked(pick(*found["phone"]))
                    parts += pick([(pick("tel ", "call ", "phone: "), None), (base.lstrip("+"), 3)], [(base, 3), (" " + (masked(pick(*found["ip"])) if found["ip"] else not_card()), None)])
                elif good:
                    parts += [(pick("tel ", "phone: ", "call ", "", "mobile "), None), (pick(f"({digits(3)}) {digits(3)}{mark}{digits(4)}", f"{digits(3)}{mark}{digits(3)}{mark}{digits(4)}", f"{digits(1)}{mark}{digits(3)}{mark}{digits(3)}{mark}{digits(4)}"), 3)] if rng.random() < 0.7 else [(f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", 3), (" " + not_card(), None)]
                else:
                    parts += [(pick(f"version {digits(2)}.{digits(3)}.{digits(3)}", f"isbn {digits(3)}-{digits(3)}-{digits(4)}", f"{pick('19', '20')}{digits(2)} {digits(3)} {digits(3)}", f"{digits(2)} {digits(3)} {digits(3)}", f"no. {digits(3)} {digits(4)} {digits(4)}", f"({pick('19', '20')}{digits(2)}) {digits(3)}-{digits(3)}"), None)]
            parts += [(pick(". ", ", ", " "), None)]
        text = ""
        for s, kind in parts:
            if kind is not None:
                spans.append((t, kind, len(text), len(text) + len(s)))
            text += s
        texts.append(text)
    return texts, spans


@functools.lru_cache(maxsize=4)
def model(around: tuple[str, ...] = (), n: int = 1_800, seed: int = 5) -> tuple[BoostedTrees, tuple[float, ...]]:
    """The trees and, a kind, the least probability at which PRECISION holds on the held-out third."""
    texts, spans = examples(n, seed, around)
    true = set(spans)
    x, y, at = [], [], []
    for t, text in enumerate(texts):
        base = base_spans(text)
        for c in candidates(text, base):
            x.append(features(text, *c, base))
            y.append(float((t, *c) in true))
            at.append(t)
    x, y, at = np.array(x), np.array(y), np.array(at)
    trees = BoostedTrees().fit(x[at % 3 > 0], y[at % 3 > 0])
    held, p = at % 3 == 0, trees.probability(x)
    cuts = []
    for k in range(len(EVERY)):
        rows = held & (x[:, 0] == k)
        steps = [c for c in np.linspace(0.5, 0.99, 50) if (chosen := rows & (p >= c)).any() and y[chosen].mean() >= PRECISION]
        cuts.append(float(steps[0]) if steps else 2.0)
    return trees, tuple(cuts)


def find(text: str | None, trees: BoostedTrees, cuts: tuple[float, ...]) -> tuple[dict, dict]:
    """Base spans, and all spans, by kind, in order of begin."""
    if not text:
        return {k: [] for k in KINDS}, {k: [] for k in EVERY}
    base = base_spans(text)
    every = {k: list(base.get(k, ())) for k in EVERY}
    if found := candidates(text, base):
        p = trees.probability(np.array([features(text, *c, base) for c in found]))
        for q, (kind, begin, end) in sorted(((-q, c) for q, c in zip(p.tolist(), found, strict=True)), key=lambda r: (r[0], r[1][1], -r[1][2])):
            if -q >= cuts[kind] and not any(overlaps((begin, end), v) for v in every.values()):
                insort(every[EVERY[kind]], (begin, end))
    return base, every


def listed(spans: dict) -> str:
    return ",".join(f"{k}:{b}:{e}" for k in spans for b, e in spans[k])


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, counts of the base spans (n_email, n_ip, n_card, n_phone), the digest of the base spans, all spans, their
    number (n_spans) and how many of them the method added (n_added) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model(tuple(windows(docs, text))))

    def make():
        trees, cuts = shared.value

        def fn(texts):
            rows = [find(t, trees, cuts) for t in texts]
            n_base, n_spans = ([sum(map(len, r[k].values())) for r in rows] for k in (0, 1))
            return {f"n_{k}": [len(r[0][k]) for r in rows] for k in KINDS} | {"base_sha256": [hashlib.sha256(listed(r[0]).encode()).hexdigest() for r in rows], "spans": [listed(r[1]) for r in rows], "n_spans": n_spans, "n_added": [a - b for a, b in zip(n_spans, n_base, strict=True)]}

        return fn

    return text_map(docs, [key], make, ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long, n_added long", text)


def bare(text: str, spans: dict) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first, then the shorter, names
    the kind and the rest goes with the next one's."""
    parts, last = [], 0
    for b, e, k in sorted((b, e, k) for k, v in spans.items() for b, e in v):
        if e > last:
            parts += [text[last : max(b, last)], f"<{k}>"]
            last = e
    return "".join(parts) + text[last:]


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span replaced by its kind in angle brackets; n_chars, where there is one, follows."""
    shared, kept = docs.sparkSession.sparkContext.broadcast(model(tuple(windows(docs)))), [c for c in docs.columns if c != "text"]

    def make():
        trees, cuts = shared.value
        return lambda texts: {"__cut": [bare(t, find(t, trees, cuts)[1]) if t else t for t in texts]}

    return with_text(text_map(docs, kept, make, "__cut string"), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
