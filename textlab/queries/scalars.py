"""Scalar functions and tokenisers over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.layout import fold_angle
from . import fixtures as X
from .registry import query



@query(f"WITH {X.DOCS} SELECT doc_id, {X.sql_norm('text')} AS text FROM docs")
def normalize_text(spark, d):
    return X.documents(spark, d).select("doc_id", T.normalize(F.col("text")).alias("text"))


@query(f"WITH {X.DOCS} SELECT doc_id, array_to_string({X.sql_words('nfc_normalize(text)')}, ' ') AS line FROM docs")
def normalize_line(spark, d):
    return X.documents(spark, d).select("doc_id", T.normalize_line(F.col("text")).alias("line"))


def _tokens(spark, d, fn):
    found = X.documents(spark, d).select("doc_id", T.normalize(F.col("text")).alias("text")).select("doc_id", fn(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", "|").alias("tokens"))


def _sql_tokens(fn):
    return f"WITH {X.DOCS}, n AS (SELECT doc_id, {X.sql_norm('text')} AS text FROM docs), t AS (SELECT doc_id, {fn('text')} AS t FROM n) SELECT doc_id, len(t)::BIGINT AS n, array_to_string(t, '|') AS tokens FROM t"


@query(_sql_tokens(X.sql_graphemes))
def grapheme_tokens(spark, d):
    return _tokens(spark, d, T.graphemes)


@query(_sql_tokens(X.sql_codepoints))
def codepoint_tokens(spark, d):
    return _tokens(spark, d, T.codepoints)


@query(_sql_tokens(X.sql_words))
def word_tokens(spark, d):
    return _tokens(spark, d, T.words)


@query("""
WITH p AS (SELECT page_id, substring(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9]+', '_', 'g'), 1, 28) AS stem FROM pages)
SELECT page_id, stem || printf('_l%03d', page_id + 1) AS line_id, printf('page_%06d', page_id) AS page, printf('page_%06d_line_%03d', page_id, page_id % 50) AS crop,
  printf('f%02d', page_id % 30) AS face_variant, printf('n%03dk', page_id) AS size_variant FROM p""")
def line_ids(spark, d):
    p = X.table(spark, d, "pages").select("page_id", F.substring(F.regexp_replace(F.coalesce("url", F.lit("")), "[^A-Za-z0-9]+", "_"), 1, 28).alias("stem"))
    n = F.col("page_id")
    return p.select(
        "page_id", F.concat("stem", F.format_string("_l%03d", n + 1)).alias("line_id"), F.format_string("page_%06d", n).alias("page"), F.format_string("page_%06d_line_%03d", n, n % 50).alias("crop"),
        F.format_string("f%02d", n % 30).alias("face_variant"), F.format_string("n%03dk", n).alias("size_variant"),
    )


@query(rf"""
WITH {X.DOCS}, l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS line_no
  FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\x0B\f\r\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]') AS s FROM docs)),
t AS (SELECT doc_id, line_no::BIGINT AS line_no, regexp_replace(line, '^{X.WS}+|{X.WS}+$', '', 'g') AS line FROM l)
SELECT * FROM t WHERE line <> ''""")
def nonblank_lines(spark, d):
    cut = X.documents(spark, d).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    return cut.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.strip(F.col("line")).alias("line")).where("line <> ''")


@query(f"WITH {X.POOL} SELECT source, line_no, line FROM pool WHERE regexp_matches(line, '[\\x{{0B80}}-\\x{{0BFF}}]')")
def script_filter(spark, d):
    return X.pool(spark, d).where(T.has_script(F.col("line"))).select("source", "line_no", "line")


@query(f"""
WITH {X.DOCS}, c AS (SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN lang = 'en' THEN source ELSE lang END, '[a-zA-Z]', '', 'g'), '^{X.WS}+|{X.WS}+$', '', 'g') AS title,
  regexp_replace(regexp_replace(text, '[a-zA-Z]', '', 'g'), '^{X.WS}+|{X.WS}+$', '', 'g') AS text FROM docs)
SELECT doc_id, title || ' ' || text AS article FROM c WHERE title <> ''""")
def articles_clean(spark, d):
    """Articles without Latin letters; those whose title is empty then are dropped. One row an article."""
    clean = lambda c: T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), "[a-zA-Z]", ""))
    title = F.when(F.col("lang") == "en", F.col("source")).otherwise(F.col("lang"))
    return X.documents(spark, d).select("doc_id", clean(title).alias("title"), clean(F.col("text")).alias("text")).where("title <> ''").select("doc_id", F.concat_ws(" ", "title", "text").alias("article"))


@query()
def codepoint_names(spark, d):
    """Names of the distinct code points; the UDF sees each once."""
    points = X.documents(spark, d).select(F.explode(T.codepoints(T.nfc(F.col("text")))).alias("c")).distinct().select(F.ascii("c").alias("cp"))
    return points.select("cp", T.codepoint_name("cp").alias("name"))


@query("SELECT event_id, CASE WHEN abs(f) < 0.15 THEN 0.0 ELSE f END AS skew FROM (SELECT event_id, CASE WHEN a < -45 THEN a + 90 WHEN a > 45 THEN a - 90 ELSE a END AS f FROM (SELECT event_id, value - 50 AS a FROM events))")
def skew_fold(spark, d):
    return X.table(spark, d, "events").select("event_id", fold_angle(F.col("value") - 50).alias("skew"))
