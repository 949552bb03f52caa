"""The test tables in the roles the engine works on, as DataFrames and as SQL common table expressions.

Documents are transliterated letter by letter into the script whose combining signs the tokenisers are about, so that
graphemes, code points and words differ; sources, pools, pairs and typefaces follow from them. Whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus

# The transliteration, and the changes that make a hypothesis out of a reference.
LATIN = "aeioubcdfghjklmnpqrstvwxyz"
SCRIPT = "ாெிேுகஙசஞடணதநபமயரலவழளறனஜஷஸ"
SWAP_FROM, SWAP_TO = "கஙி", "சஞீ"
ABSENT = ""

WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SIGNS = r"\x{0BBE}-\x{0BCD}\x{0BD7}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.translate(F.coalesce("text", F.lit("")), LATIN, SCRIPT).alias("text"))


def pool(spark: SparkSession, sf_dir: str, keep_tail: bool = False) -> DataFrame:
    return corpus.chunk(documents(spark, sf_dir), keep_tail=keep_tail)


def corrupted(c):
    out = F.translate(c, SWAP_FROM, SWAP_TO)
    for a, b in (("ந", ""), ("ம", "மம"), (". ", ".")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, ref, hyp): every line of every source, tails included, and its corruption."""
    lines = pool(spark, sf_dir, keep_tail=True)
    return lines.select(F.concat("source", F.lit(":"), F.col("line_no").cast("string")).alias("name"), F.col("line").alias("ref"), corrupted(F.col("line")).alias("hyp"))


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def sql_graphemes(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s).[{SIGNS}]*')"


def sql_codepoints(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s).')"


def sql_norm(x: str, zero_width: bool = True, collapse: bool = True) -> str:
    out = f"nfc_normalize({x})"
    out = f"translate({out}, chr(8203) || chr(8204) || chr(8205) || chr(65279), '')" if zero_width else out
    out = f"regexp_replace({out}, '{WS}+', ' ', 'g')" if collapse else out
    return f"regexp_replace({out}, '^{WS}+|{WS}+$', '', 'g')"


def sql_corrupted(x: str) -> str:
    return f"replace(replace(replace(translate({x}, '{SWAP_FROM}', '{SWAP_TO}'), 'ந', ''), 'ம', 'மம'), '. ', '.')"


def sql_rate(edits: str, total: str) -> str:
    return f"(CASE WHEN {total} = 0 THEN (CASE WHEN {edits} = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) ELSE ({edits})::DOUBLE / ({total})::DOUBLE END)"


DOCS = f"docs AS (SELECT doc_id, source, lang, translate(coalesce(text, ''), '{LATIN}', '{SCRIPT}') AS text FROM documents)"
_WORDS = f"""{DOCS},
w AS (SELECT source, doc_id, word, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS o
  FROM (SELECT source, doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT source, doc_id, {sql_words("nfc_normalize(text)")} AS l FROM docs)))"""
ALL_LINES = f"{_WORDS},\nlines AS (SELECT source, (o // 12)::BIGINT AS line_no, string_agg(word, ' ' ORDER BY o) AS line, count(*)::BIGINT AS n_words FROM w GROUP BY ALL)"
POOL = f"{ALL_LINES},\npool AS (SELECT * FROM lines WHERE n_words = 12)"
STREAM = f"""{_WORDS},
g AS (SELECT word, row_number() OVER (ORDER BY source, o) - 1 AS o FROM w),
stream AS (SELECT (o // 12)::BIGINT AS line_no, string_agg(word, ' ' ORDER BY o) AS line FROM g GROUP BY ALL)"""
DEDUP = POOL + ",\nfirsts AS (SELECT s.source, s.line_no, line FROM (SELECT line, min({'source': source, 'line_no': line_no}) AS s FROM pool GROUP BY line))"
SELECTED = DEDUP + ",\nselected AS (SELECT (row_number() OVER (ORDER BY md5('0|' || line), source, line_no) - 1)::BIGINT AS rank, source, line_no, line FROM firsts WHERE regexp_matches(line, '[\\x{0B80}-\\x{0BFF}]'))"
PAIRS = f"{ALL_LINES},\npairs AS (SELECT source || ':' || line_no::VARCHAR AS name, line AS ref, {sql_corrupted('line')} AS hyp FROM lines)"

_enc = "array_to_string(list_transform({0}, lambda t: chr(list_position({1}, t)::INTEGER)), '')"


def sql_scored(pairs_cte: str, ref: str = "ref", hyp: str = "hyp", more: str = "", zero_width: bool = True, collapse: bool = True) -> str:
    """CTEs from `pairs` to `scored`; tokens are numbered within a pair and spelled as single bytes (up to 127 of them)."""
    lev = lambda a, b, d: f"levenshtein({_enc.format(a, d)}, {_enc.format(b, d)})::INTEGER"
    return f"""{pairs_cte},
clean AS (SELECT name{more}, {sql_norm(ref, zero_width, collapse)} AS ref, {sql_norm(hyp, zero_width, collapse)} AS hyp FROM pairs),
tok AS (SELECT name{more}, {sql_graphemes("ref")} AS ga, {sql_graphemes("hyp")} AS gb, {sql_codepoints("ref")} AS ca, {sql_codepoints("hyp")} AS cb, {sql_words("ref")} AS wa, {sql_words("hyp")} AS wb FROM clean),
dic AS (SELECT *, list_distinct(list_concat(ga, gb)) AS gd, list_distinct(list_concat(ca, cb)) AS cd, list_distinct(list_concat(wa, wb)) AS wd FROM tok),
scored AS (SELECT name{more}, {lev("ga", "gb", "gd")} AS grapheme_edits, len(ga)::INTEGER AS grapheme_ref, {lev("ca", "cb", "cd")} AS codepoint_edits, len(ca)::INTEGER AS codepoint_ref,
  {lev("wa", "wb", "wd")} AS word_edits, len(wa)::INTEGER AS word_ref FROM dic)"""


def sql_aggregate(source: str = "scored") -> str:
    micro = lambda u: sql_rate(f"coalesce(sum({u}_edits), 0)", f"coalesce(sum({u}_ref), 0)")
    macro = lambda u: f"round(coalesce(avg({sql_rate(f'{u}_edits', f'{u}_ref')}), 0), 9)"
    return f"""count(*)::BIGINT AS lines, {micro("grapheme")} AS cer_grapheme_micro, {macro("grapheme")} AS cer_grapheme_macro, {micro("codepoint")} AS cer_codepoint_micro,
  {micro("word")} AS wer_micro, {macro("word")} AS wer_macro, coalesce(sum(grapheme_ref), 0)::BIGINT AS total_graphemes, coalesce(sum(word_ref), 0)::BIGINT AS total_words FROM {source}"""


SCORED = sql_scored(PAIRS)

N_FACES = 29
_ranges = [(f"face_{i:02d}", [(0x21, 0x7E - i % 5), (0xA1, 0xFF - i % 7), (0x0B80, 0x0BCA if i == 11 else 0x0BF2)]) for i in range(N_FACES)]


def faces(spark: SparkSession) -> DataFrame:
    """29 typefaces (ord, stem, cmap) with deliberate gaps in their ranges of code points."""
    return spark.createDataFrame([(i, s, r) for i, (s, r) in enumerate(_ranges)], "ord long, stem string, cmap array<struct<lo:int,hi:int>>")


FACES = "faces(ord, stem, lo, hi) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{s}', {lo}, {hi})" for i, (s, r) in enumerate(_ranges) for lo, hi in r) + ")"
FACE_POINTS = f"{FACES},\npoints AS (SELECT DISTINCT stem, unnest(range(lo, hi + 1))::INTEGER AS cp FROM faces)"
COVERED = f"{FACE_POINTS},\ncovered AS (SELECT cp FROM points GROUP BY cp HAVING count(DISTINCT stem) = {N_FACES})"

_registers = [("literary" if i < 10 else "newsprint", f"src{i}") for i in range(20)]


def registers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_registers, "register string, source string")


REGISTERS = "registers(register, source) AS (VALUES " + ", ".join(f"('{r}', '{s}')" for r, s in _registers) + ")"

#: Rows of a projection: events a half hour, by type, as ink on 1,440 rows of a page.
ROWS = 1_440
PROJECTION = f"""proj AS (SELECT t.page, y.y, coalesce(e.ink, 0)::BIGINT AS ink FROM (SELECT DISTINCT event_type AS page FROM events) t
  CROSS JOIN (SELECT unnest(range(0, {ROWS}))::BIGINT AS y) y
  LEFT JOIN (SELECT event_type, floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 1800)::BIGINT AS y, count(*) AS ink FROM events GROUP BY ALL) e ON e.event_type = t.page AND e.y = y.y)"""


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("page"), F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1_704_067_200) / 1800).alias("y"))
    ink = e.groupBy("page", "y").agg(F.count("*").alias("ink"))
    dense = ink.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ROWS - 1).cast("long"))).alias("y"))
    return dense.join(ink, ["page", "y"], "left").withColumn("ink", F.coalesce("ink", F.lit(0)))
