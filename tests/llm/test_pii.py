import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textlab.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    tests = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d),
        "phone": lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if tests[k](m[0])] for k, p in PATTERNS.items()}


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="0123456789.+-() @ab%_é٣", max_size=60))
def test_base_equals_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_base_on_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        assert pii.base_spans(r.text) == brute(r.text)


def test_long_runs_take_linear_time():
    begin = time.time()
    for c in ("a", "1", "1.", "1 ", "@a", "+1", "a.", "(", "+ ", "1:", "ab:"):
        pii.find(c * (120_000 // len(c)), *pii.model())
    assert time.time() - begin < 30


def test_held_out_precision_and_recall():
    trees, cuts = pii.model()
    texts, spans = pii.examples(600, seed=99)
    true, found = set(spans), set()
    base = {(t, pii.EVERY.index(k), *s) for t, x in enumerate(texts) for k, v in pii.base_spans(x).items() for s in v}
    for t, x in enumerate(texts):
        found |= {(t, pii.EVERY.index(k), *s) for k, v in pii.find(x, trees, cuts)[1].items() for s in v}
    assert base <= found
    added = found - base
    assert len(added & true) >= 0.97 * len(added) and len(added & true) >= 0.75 * len(true - base)


def test_added_cards_between_numbers():
    text = "see 4111111111111111 4012888888881881 and 1234567890123456 4929348385146306"
    spans = pii.find(text, *pii.model())[1]["card"]
    assert [text[a:b] for a, b in spans] == ["4111111111111111", "4012888888881881", "4929348385146306"]


def test_selection_against_a_plain_reading():
    """The likelier of overlapping candidates, base spans first, chosen one by one with quadratic comparisons."""
    trees, cuts = pii.model()
    for text in pii.examples(150, seed=31)[0]:
        base = pii.base_spans(text)
        chosen = [(k, *s) for k, v in base.items() for s in v]
        found = pii.candidates(text, base)
        p = [float(trees.probability(np.array([pii.features(text, *c, base)]))[0]) for c in found]
        for q, (kind, b, e) in sorted(zip(p, found, strict=True), key=lambda r: (-r[0], r[1][1], -r[1][2])):
            if q >= cuts[kind] and all(e <= x or y <= b for _, x, y in chosen):
                chosen.append((pii.EVERY[kind], b, e))
        got = [(k, *s) for k, v in pii.find(text, trees, cuts)[1].items() for s in v]
        assert sorted(got) == sorted(chosen)


def test_secrets_and_windows_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    around = pii.windows(docs)
    assert around == pii.windows(docs.repartition(7)) and max(map(len, around)) <= pii.WINDOW_CHARS and len(around) > 300
    trees = pii.model(tuple(around))
    text = 'set token = "5c4a26e9bd0c2c2e356de5663481732ff8d0ec46" and commit 5c4a26e9bd0c2c2e356de5663481732ff8d0ec46 now'
    base, every = pii.find(text, *trees)
    assert not any(base.values()) and every["secret"] == [(13, 53)]
    rows = pii.detect(docs).collect()
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added for r in rows)
    held = {r.doc_id for r in docs.where("text like '%token = \"%'").collect()}
    assert held and sum("secret" in r.spans for r in rows if r.doc_id in held) >= 0.9 * len(held)


def test_redaction_and_edges(spark):
    rows = [(1, "mail a.b@c.example.org now", 26, "k"), (2, None, None, "k"), (3, "", 0, "k"), (3, "clean words only", 16, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    out = pii.redact(docs).orderBy("doc_id", "text").collect()
    assert [(r.text, r.n_chars, r.spans) for r in out] == [("mail <email> now", 16, "k"), (None, None, "k"), ("", 0, "k"), ("clean words only", 16, "k")]
    got = pii.detect(docs).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got] == [(1, 0, 0, 0)] + [(0, 0, 0, 0)] * 3
    assert got[0].spans == "email:5:22" and (got[0].n_spans, got[0].n_added) == (1, 0) and pii.detect(spark.createDataFrame([], docs.schema)).count() == 0


def test_trees_learn_an_interaction():
    from textlab.llm.boosting import BoostedTrees

    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    assert ((BoostedTrees().fit(x[:1500], y[:1500]).probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
