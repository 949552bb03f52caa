"""Sources, pools, selection, provenance, statistics and frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, coverage
from ..operators.order import id_block, running_offset
from . import fixtures as X
from .registry import query

SLICE = 2_000


def selected(spark, d):
    return corpus.select(X.pool(spark, d))


@query(f"WITH {X.DOCS} SELECT source, count(*)::BIGINT AS n_docs, sum(length(text))::BIGINT AS n_codepoints, sum(len({X.sql_words('text')}))::BIGINT AS n_words FROM docs GROUP BY source")
def scan_sources(spark, d):
    t = F.col("text")
    return X.documents(spark, d).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.length(t)).cast("long").alias("n_codepoints"), F.sum(F.size(T.words(t))).cast("long").alias("n_words"))


@query(f"""
WITH {X.DOCS}, s AS (SELECT source, doc_id, (length(regexp_replace(text, '^{X.WS}+|{X.WS}+$', '', 'g')) + 1)::BIGINT AS n FROM docs)
SELECT source, doc_id, n AS n_codepoints, (sum(n) OVER (ORDER BY source, doc_id) - n)::BIGINT AS begin FROM s""")
def merge_sources(spark, d):
    """Where each stripped text, followed by one space, begins in the stream of all sources."""
    n = (F.length(T.strip(F.col("text"))) + 1).cast("long")
    docs = X.documents(spark, d).select("source", "doc_id", n.alias("n_codepoints"))
    placed = running_offset(docs, ["source"], id_block("doc_id"), [F.col("doc_id")], F.col("n_codepoints"), "inside")
    totals = docs.groupBy("source").agg(F.sum("n_codepoints").alias("total"))
    starts = running_offset(totals, [], F.substring("source", 1, 1), [F.col("source")], F.col("total"), "start")
    return placed.join(starts.select("source", "start"), "source").select("source", "doc_id", "n_codepoints", (F.col("start") + F.col("inside")).alias("begin"))


@query(f"WITH {X.POOL} SELECT source, line_no, line FROM pool")
def chunk_lines(spark, d):
    return X.pool(spark, d).select("source", "line_no", "line")


@query(f"WITH {X.STREAM} SELECT line_no, line FROM stream")
def chunk_stream(spark, d):
    return corpus.chunk(X.documents(spark, d), per_source=False, keep_tail=True).select("line_no", "line")


@query(f"WITH {X.DEDUP} SELECT source, line_no, line FROM firsts")
def dedup_lines(spark, d):
    return corpus.dedup(X.pool(spark, d))


@query(f"WITH {X.SELECTED} SELECT rank, source, line_no, line FROM selected")
def select_lines(spark, d):
    return selected(spark, d).select("rank", "source", "line_no", "line")


@query(f"WITH {X.POOL} SELECT source, count(*)::BIGINT AS lines, count(DISTINCT line)::BIGINT AS distinct_lines FROM pool GROUP BY ROLLUP (source)")
def pool_summary(spark, d):
    return corpus.summary(X.pool(spark, d))


@query(f"WITH {X.POOL}, {X.REGISTERS} SELECT register, count(DISTINCT source)::BIGINT AS sources, count(*)::BIGINT AS lines FROM pool JOIN registers USING (source) GROUP BY register")
def register_counts(spark, d):
    per = X.pool(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return per.join(F.broadcast(X.registers(spark)), "source").groupBy("register").agg(F.count("*").alias("sources"), F.sum("n").alias("lines"))


@query(f"WITH {X.SELECTED} SELECT source, count(*)::BIGINT AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM selected GROUP BY source")
def provenance_counts(spark, d):
    lines = X.pool(spark, d)
    return corpus.provenance(corpus.select(lines), lines)


@query(f"""
WITH {X.POOL} SELECT count(*)::BIGINT AS lines, sum(n_words)::BIGINT AS words, sum(length(line))::BIGINT AS codepoints,
  (SELECT count(DISTINCT t) FROM (SELECT unnest({X.sql_words("line")}) AS t FROM pool))::BIGINT AS unique_words,
  (SELECT count(DISTINCT t) FROM (SELECT unnest({X.sql_graphemes("line")}) AS t FROM pool))::BIGINT AS unique_graphemes FROM pool""")
def corpus_stats(spark, d):
    return corpus.statistics(X.pool(spark, d))


@query(f"WITH {X.POOL}, c AS (SELECT count(*)::BIGINT AS lines, count(DISTINCT line)::BIGINT AS distinct_lines FROM pool) SELECT lines, distinct_lines, lines - distinct_lines AS duplicates, (lines - distinct_lines)::DOUBLE / lines AS rate FROM c")
def duplicate_rate(spark, d):
    return corpus.duplicates(X.pool(spark, d))


_SPLIT = X.SELECTED + f""",
{X.COVERED},
bad AS (SELECT DISTINCT rank FROM (SELECT rank, unnest({X.sql_codepoints("line")}) AS c FROM selected) WHERE NOT regexp_matches(c, '{X.WS}') AND unicode(c) NOT IN (SELECT cp FROM covered)),
split AS (SELECT s.*, b.rank IS NULL AS renderable FROM selected s LEFT JOIN bad b ON b.rank = s.rank)"""


def split(spark, d):
    return coverage.split_renderable(selected(spark, d), coverage.common_coverage(X.faces(spark)))


@query(f"WITH {_SPLIT} SELECT rank, source, line_no, renderable FROM split")
def renderable_split(spark, d):
    return split(spark, d).select("rank", "source", "line_no", "renderable")


@query(f"""
WITH {_SPLIT} SELECT (SELECT count(*) FROM pool)::BIGINT AS raw_lines, (SELECT count(*) FROM firsts)::BIGINT AS distinct_lines, count(*)::BIGINT AS script_lines,
  count(*) FILTER (NOT renderable)::BIGINT AS dropped, count(*) FILTER (renderable)::BIGINT AS selected FROM split""")
def regeneration_audit(spark, d):
    """Counts after each step of building the corpus, duplicates and script filter apart. One pass over the distinct lines."""
    per = X.pool(spark, d).groupBy("line").agg(F.count("*").alias("n"))
    points = coverage.common_coverage(X.faces(spark))
    s = coverage.split_renderable(per.withColumn("script", T.has_script(F.col("line"))), points)
    good = F.col("script") & F.col("renderable")
    return s.agg(F.sum("n").alias("raw_lines"), F.count("*").alias("distinct_lines"), F.count_if("script").alias("script_lines"), F.count_if(F.col("script") & ~F.col("renderable")).alias("dropped"), F.count_if(good).alias("selected"))


@query(f"WITH {_SPLIT} SELECT rank, source, line_no FROM split WHERE renderable ORDER BY rank LIMIT {SLICE}")
def variant_slice(spark, d):
    """A variant's corpus: the first lines of the seeded order that every typeface can render."""
    return split(spark, d).where("renderable").orderBy("rank").limit(SLICE).select("rank", "source", "line_no")


def _counts(spark, d, tokens=T.graphemes):
    return corpus.frequency(X.pool(spark, d), tokens(F.col("line")))


_UNITS = f"{X.POOL},\ncounts AS (SELECT unit, count(*)::BIGINT AS n FROM (SELECT unnest({X.sql_graphemes('line')}) AS unit FROM pool) GROUP BY unit)"


@query(f"WITH {_UNITS} SELECT unit, n FROM counts")
def grapheme_frequency(spark, d):
    return _counts(spark, d)


@query(f"WITH {_UNITS} SELECT unit, n FROM counts WHERE regexp_matches(unit, '[\\x{{0B80}}-\\x{{0BFF}}]') AND NOT regexp_matches(unit, '^{X.WS}')")
def letter_frequency(spark, d):
    """Units with a letter of the script; a sign after a space is none."""
    u = F.col("unit")
    return _counts(spark, d).where(T.has_script(u) & ~u.rlike(rf"(?U)\A{T.SPACE}"))


@query(f"WITH {X.DOCS} SELECT unit, count(*)::BIGINT AS n FROM (SELECT unnest({X.sql_words('nfc_normalize(text)')}) AS unit FROM docs) WHERE regexp_matches(unit, '[\\x{{0B80}}-\\x{{0BFF}}]') GROUP BY unit")
def word_frequency(spark, d):
    return corpus.frequency(X.documents(spark, d), T.words(T.nfc("text"))).where(T.has_script(F.col("unit")))


_POINTS = f"{X.DOCS},\nfreq AS (SELECT unicode(c)::INTEGER AS cp, count(*)::BIGINT AS n FROM (SELECT unnest({X.sql_codepoints('nfc_normalize(text)')}) AS c FROM docs) WHERE NOT regexp_matches(c, '{X.WS}') GROUP BY 1)"


def points(spark, d):
    bare = F.regexp_replace(T.nfc("text"), rf"(?U){T.SPACE}+", "")
    return corpus.frequency(X.documents(spark, d), T.codepoints(bare), "c").select(F.ascii("c").alias("cp"), "n")


@query(f"WITH {_POINTS} SELECT cp, n FROM freq")
def codepoint_frequency(spark, d):
    return points(spark, d)


@query(f"WITH {_POINTS} SELECT count(*)::BIGINT AS points, sum(n)::BIGINT AS occurrences, count(*) FILTER (cp BETWEEN 2944 AND 3071)::BIGINT AS script_points, coalesce(sum(n) FILTER (cp BETWEEN 2944 AND 3071), 0)::DOUBLE / sum(n)::DOUBLE AS script_share FROM freq")
def script_share(spark, d):
    own = F.col("cp").between(*T.BLOCK)
    return points(spark, d).agg(F.count("*").alias("points"), F.sum("n").alias("occurrences"), F.count_if(own).alias("script_points"), (F.sum(F.when(own, F.col("n")).otherwise(0)) / F.sum("n")).alias("script_share"))


@query(f"WITH {_UNITS} SELECT unit, n FROM counts ORDER BY n DESC, unit LIMIT 15")
def top_graphemes(spark, d):
    return _counts(spark, d).orderBy(F.desc("n"), "unit").limit(15)


@query(f"WITH {_UNITS} SELECT row_number() OVER (ORDER BY n DESC, unit)::BIGINT AS rank, unit, n FROM counts")
def rank_frequency(spark, d):
    """Rank and frequency of units: plot data. The inventory of units is small, whatever the corpus."""
    from pyspark.sql import Window

    return _counts(spark, d).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "unit")).cast("long"))


_V, _C, _G = (" ".join(x) for x in (coverage.VOWELS, coverage.CONSONANTS, coverage.GRANTHA))
_VIRAMA = "chr(3021)"
_SIGNS = "['', chr(3006), chr(3007), chr(3008), chr(3009), chr(3010), chr(3014), chr(3015), chr(3016), chr(3018), chr(3019), chr(3020)]"
_lst = lambda s: f"string_split('{s}', ' ')"
SYLLABARY = f"""raw AS (
  SELECT 0 AS k, i AS a, 0 AS b, 'uyir' AS class, {_lst(_V)}[i] AS unit FROM range(1, 13) t(i)
  UNION ALL SELECT 1, 0, 0, 'aytham', '{coverage.AYTHAM}'
  UNION ALL SELECT 2, i, 0, 'mey', {_lst(_C)}[i] || {_VIRAMA} FROM range(1, 19) t(i)
  UNION ALL SELECT 3, i, j, 'uyirmey', {_lst(_C)}[i] || {_SIGNS}[j] FROM range(1, 19) t(i), range(1, 13) u(j)
  UNION ALL SELECT 4, i, j, 'grantha', {_lst(_G)}[i] || {_SIGNS}[j] FROM range(1, 5) t(i), range(1, 13) u(j)
  UNION ALL SELECT 5, i, 0, 'grantha', {_lst(_G)}[i] || {_VIRAMA} FROM range(1, 5) t(i)),
units AS (SELECT class, (row_number() OVER (ORDER BY k, a, b) - 1)::INTEGER AS ord, unit FROM raw)"""
_COUNTED = f"{_UNITS},\n{SYLLABARY},\ncounted AS (SELECT class, ord, units.unit, coalesce(n, 0)::BIGINT AS n FROM units LEFT JOIN counts ON counts.unit = units.unit)"
_REPORT = """count(*)::BIGINT AS total, count(*) FILTER (n > 0)::BIGINT AS covered, coalesce(string_agg(unit, ',' ORDER BY unit) FILTER (n = 0), '') AS missing,
  coalesce(array_to_string(list_slice(list(unit || ':' || n::VARCHAR ORDER BY n, ord) FILTER (n > 0), 1, 12), ','), '') AS rarest, sum(n)::BIGINT AS occurrences"""


@query(f"WITH {SYLLABARY} SELECT class, ord, unit FROM units")
def syllabary_units(spark, d):
    return coverage.syllabary(spark)


def counted(spark, d):
    return coverage.with_counts(coverage.syllabary(spark), _counts(spark, d))


@query(f"WITH {_COUNTED}, c AS (SELECT * FROM counted UNION ALL SELECT 'syllabary_247', ord, unit, n FROM counted WHERE class <> 'grantha') SELECT class, {_REPORT} FROM c GROUP BY class")
def syllabary_coverage(spark, d):
    return coverage.report(counted(spark, d))


@query(f"""
WITH {X.POOL}, {SYLLABARY}, counts AS (SELECT source, unit, count(*)::BIGINT AS n FROM (SELECT source, unnest({X.sql_graphemes("line")}) AS unit FROM pool) GROUP BY ALL),
g AS (SELECT DISTINCT source FROM counts),
counted AS (SELECT g.source, class, ord, units.unit, coalesce(n, 0)::BIGINT AS n FROM g CROSS JOIN units LEFT JOIN counts ON counts.unit = units.unit AND counts.source = g.source),
c AS (SELECT * FROM counted UNION ALL SELECT source, 'syllabary_247', ord, unit, n FROM counted WHERE class <> 'grantha')
SELECT source, class, {_REPORT} FROM c GROUP BY source, class""")
def coverage_by_source(spark, d):
    counts = corpus.frequency(X.pool(spark, d), T.graphemes(F.col("line")), by=["source"])
    return coverage.report(coverage.with_counts(coverage.syllabary(spark), counts, ["source"]), ["source"])


@query(f"""
WITH {_COUNTED}, core AS (SELECT * FROM counted WHERE class <> 'grantha'), s AS (SELECT coalesce(sum(n) FILTER (n < 27), 0)::DOUBLE / sum(n)::DOUBLE AS rare_share FROM core)
SELECT t AS threshold, (SELECT count(*) FROM core WHERE n < t)::BIGINT AS units, rare_share FROM (VALUES (1), (27), (270)) v(t), s""")
def exemplar_tiers(spark, d):
    return coverage.tiers(counted(spark, d))


@query(f"WITH {_COUNTED} SELECT unit, class, n FROM counted WHERE n > 0 ORDER BY n, ord LIMIT 12")
def rarest_units(spark, d):
    return coverage.rarest(counted(spark, d))


@query(f"WITH {X.COVERED} SELECT cp FROM covered")
def common_coverage(spark, d):
    return coverage.common_coverage(X.faces(spark))


_AUDIT = f"""{_POINTS}, {X.FACE_POINTS}, stems AS (SELECT DISTINCT stem FROM faces), total AS (SELECT sum(n) AS total FROM freq),
gaps AS (SELECT stem, cp, n FROM stems CROSS JOIN freq WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.stem = stems.stem AND p.cp = freq.cp)),
audit AS (SELECT s.stem, count(g.cp)::BIGINT AS missing_count, coalesce(sum(g.n), 0)::BIGINT AS missing_occurrences,
  (SELECT count(*) FROM points p WHERE p.stem = s.stem AND cp BETWEEN 2944 AND 3071)::BIGINT AS block_covered, coalesce(sum(g.n), 0)::DOUBLE / any_value(total)::DOUBLE AS missing_share
  FROM stems s CROSS JOIN total LEFT JOIN gaps g ON g.stem = s.stem GROUP BY s.stem)"""


@query(f"WITH {_AUDIT} SELECT *, missing_share > 0.0001 AS flagged FROM audit")
def font_coverage(spark, d):
    return coverage.audit(X.faces(spark), points(spark, d))


@query(f"""
WITH {_AUDIT}, worst AS (SELECT stem FROM audit WHERE missing_count > 0 ORDER BY missing_share DESC, stem LIMIT 8),
r AS (SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY n DESC, cp)::INTEGER AS rank, cp, n FROM gaps WHERE stem IN (SELECT stem FROM worst))
SELECT * FROM r WHERE rank <= 6""")
def font_gap_topk(spark, d):
    faces, freq = X.faces(spark), points(spark, d)
    return coverage.top_gaps(coverage.gaps(faces, freq), coverage.audit(faces, freq))


_LICENCES = [
    ("a", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "https://scripts.sil.org/OFL", "Copyright 2021"), ("b", "OFL", None, None), ("c", None, "http://scripts.sil.org/ofl", ""),
    ("d", "Licensed under the Apache License", None, None), ("e", "Virtual Academy/ order no:1", None, "Copyright"), ("f", None, None, "Copyright (c) 2003"), ("g", "Some Foundry", None, None), ("h", "", None, ""), ("i", None, None, None),
]
_q = lambda x: "NULL" if x is None else f"'{x}'"


@query(f"""
WITH f(stem, licence, url, cr) AS (VALUES {", ".join("(" + ", ".join(map(_q, r)) + ")" for r in _LICENCES)}),
b AS (SELECT CASE WHEN contains(coalesce(licence, '') || ' ' || coalesce(url, ''), 'Open Font License') OR contains(upper(coalesce(licence, '') || ' ' || coalesce(url, '')), 'OFL') THEN 'OFL 1.1'
  WHEN contains(coalesce(licence, '') || ' ' || coalesce(url, ''), 'Apache') THEN 'Apache 2.0' WHEN contains(coalesce(licence, '') || ' ' || coalesce(url, ''), 'Virtual Academy') THEN 'TVA (order no.)'
  WHEN coalesce(licence, '') <> '' OR coalesce(cr, '') <> '' THEN 'proprietary/unstated' ELSE 'none declared' END AS bucket FROM f)
SELECT bucket, count(*)::BIGINT AS n FROM b GROUP BY bucket""")
def license_buckets(spark, d):
    f = spark.createDataFrame(_LICENCES, "stem string, licence string, url string, cr string")
    return f.groupBy(coverage.licence_bucket(F.col("licence"), F.col("url"), F.col("cr")).alias("bucket")).agg(F.count("*").alias("n"))

