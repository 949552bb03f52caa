"""Nulls, empty and very long texts, ties, repeated rows, clashing columns: what no other test of an operator covers."""

from pyspark.sql import functions as F

import corpus_pipeline as p
from textlab.llm import language_id, quality_rules, sharding, toxicity, winnowing

SF = "/root/testdata/sf0.001"
LONG = "plain words go on and on " * 40_000


def clashing(docs):
    """The table with extra columns that have the operators' own names."""
    for name in ("key", "row", "kept", "n_words", "spans", "items", "y", "target", "node", "n_shingles", "size", "n_tokens", "score"):
        docs = docs.withColumn(name, F.array(F.lit("x")))
    return docs


def test_language_ties_and_long_texts(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("aba ab", "l2"), ("aba ab", "l1"), ("xyx xy", "l3")] * 3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "aba"), (1, "aba"), (2, "x" * 50_000), (3, "aba " * 90_000), (None, "xy")], "doc_id long, text string")
    got = [(r.lang_pred, r.score) for r in language_id.predict(clashing(docs), model).orderBy("doc_id", F.desc("score")).collect()]
    assert [x for x, _ in got] == ["l3", "l1", "l1", "l3", "l1"] and got[1] == got[2] and abs(got[1][1] - 0.5) < 0.01


def test_toxicity_long_texts_and_ties(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    texts = spark.createDataFrame([(1, LONG), (2, LONG + "you are a worthless idiot and a pathetic loser"), (3, "same"), (None, "same"), (3, "same")], "doc_id long, text string")
    s = [(r.doc_id, r.score) for r in toxicity.score(clashing(texts), model).collect()]
    by = dict(s)
    assert by[2] > by[1] and len({x for d, x in s if d in (3, None)}) == 1
    assert toxicity.score(texts, model).where("doc_id = 2").first().score == by[2]


def test_quality_rules_long_texts(spark):
    docs = clashing(spark.createDataFrame([(1, LONG), (2, LONG), (None, None), (3, "a " * 300_000)], "doc_id long, text string"))
    got = {r.doc_id: r for r in quality_rules.judge(docs, None).collect()}
    assert got[1].n_words == got[2].n_words == 240_000 and got[1].n_repeat_words == 240_000 and got[1].base_failed and not got[3].kept
    assert got[None].n_words == 0 and got[None].base_failed


def test_sharding_long_texts_ties_and_null_keys(spark):
    docs = clashing(spark.createDataFrame([(1, LONG), (2, LONG), (None, None), (None, "x"), (2, LONG)], "doc_id long, text string"))
    got = sharding.assign(docs, shards=3).collect()
    assert len(got) == 5 and sorted(r["size"] for r in got) == [1, 2] + [len(LONG) + 1] * 3
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_winnowing_long_texts_and_clashing_columns(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, LONG + passage), (1, LONG + passage), (None, passage + " " + LONG), (2, None), (3, LONG)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame([(7, passage), (8, None), (9, " ")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in winnowing.decontaminate(docs, bench).collect())
    assert got == sorted([("1", 240_012, 12, ["7"])] * 2 + [("None", 240_012, 12, ["7"]), ("2", 0, 0, []), ("3", 240_000, 0, [])])
    cut = winnowing.cut_hits(docs, bench)
    assert cut.columns == docs.columns and cut.count() == 5 and cut.where("text like '%seven eight%'").isEmpty()


def test_stages_keep_nulls_repeats_and_clashing_columns(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    one = base.where("length(text) > 300").limit(1).collect()[0]
    odd = spark.createDataFrame([(None, one.text, "en", "s", 1), (one.doc_id, one.text, "en", "s", 1), (None, None, None, None, None), (77, "", None, None, 0), (78, LONG, "en", "s", len(LONG))], base.schema)
    docs = clashing(base.unionByName(odd))
    good = p.quality(spark, docs, SF)
    assert good.columns == docs.columns and good.where("text is null or text = ''").isEmpty()
    assert good.where(F.col("text") == one.text).count() in (0, 3)
    single = p.near_duplicates(spark, docs, SF)
    assert single.columns == docs.columns
    assert single.where(F.col("text") == one.text).count() <= 1 and single.where("text is null").count() == 1
    clean = p.decontaminate(spark, single, SF)
    bare = p.redact(spark, clean, SF)
    assert clean.columns == bare.columns == docs.columns and bare.count() == clean.count()
    assert bare.where("text is null").select("n_chars").first()[0] is None
    ids = p.encode(spark, bare, SF)
    assert ids.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"] and ids.count() == bare.count()
