"""Pairing, integrity, layout, line bands, grids, journals and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import grid, layout, pairs
from ..session import shared_folder
from ..sources import files
from . import fixtures as X
from .corpora import _SPLIT, selected, split
from .registry import query


def _gt(spark, d):
    return X.documents(spark, d).select(F.col("doc_id").alias("stem"), "text")


def _hyp(spark, d):
    return X.table(spark, d, "pages").select(F.col("page_id").alias("stem"), F.col("url").alias("text"))


@query(f"WITH {X.DOCS} SELECT doc_id AS stem, text AS ref, url AS hyp FROM docs JOIN pages ON page_id = doc_id")
def pairs_by_stem(spark, d):
    return pairs.by_stem(_gt(spark, d), _hyp(spark, d))


@query("SELECT count(*)::BIGINT AS n_missing, min(doc_id) AS first_missing FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def pairs_missing(spark, d):
    return pairs.missing(_gt(spark, d), _hyp(spark, d))


_ENDS = r"\r\n|[\n\x0B\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


@query(f"""
WITH t AS (SELECT conv_id, turn // 2 AS pair, role, unnest(s) AS line, generate_subscripts(s, 1)::BIGINT AS line_no FROM (SELECT *, CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END AS s
  FROM (SELECT conv_id, turn, role, regexp_split_to_array(coalesce(text, ''), '{_ENDS}') AS s FROM conversations))),
a AS (SELECT * FROM t WHERE role = 'user'), b AS (SELECT * FROM t WHERE role = 'assistant')
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.pair, b.pair) AS pair, coalesce(a.line_no, b.line_no) AS line_no, coalesce(a.line, '') AS ref, coalesce(b.line, '') AS hyp
FROM a FULL OUTER JOIN b ON a.conv_id = b.conv_id AND a.pair = b.pair AND a.line_no = b.line_no""")
def pairs_by_line(spark, d):
    """User turns against the assistant's next, line by line, the shorter one padded."""
    t = X.table(spark, d, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("pair"), "role", F.coalesce("text", F.lit("")).alias("text"))
    return pairs.by_line(t.where("role = 'user'"), t.where("role = 'assistant'"), ["conv_id", "pair"])


_SIDES = "k AS (SELECT coalesce(i.k, t.k) AS k, i.k IS NOT NULL AS l, t.k IS NOT NULL AS r FROM (SELECT DISTINCT doc_id AS k FROM documents) i FULL OUTER JOIN (SELECT DISTINCT doc_id + 7 AS k FROM labels) t ON i.k = t.k)"
_first = lambda cond: f"(SELECT coalesce(string_agg(k::VARCHAR, ',' ORDER BY k), '') FROM (SELECT k FROM k WHERE {cond} ORDER BY k LIMIT 10))"


@query(f"""WITH {_SIDES} SELECT count(*) FILTER (l)::BIGINT AS images, count(*) FILTER (r)::BIGINT AS transcriptions, count(*) FILTER (l AND r)::BIGINT AS pairs, count(*) FILTER (NOT r)::BIGINT AS orphan_images,
  count(*) FILTER (NOT l)::BIGINT AS orphan_transcriptions, {_first("NOT r")} AS first_images, {_first("NOT l")} AS first_transcriptions FROM k""")
def pair_integrity(spark, d):
    texts = X.table(spark, d, "labels").select((F.col("doc_id") + 7).alias("doc_id"))
    return pairs.integrity(X.table(spark, d, "documents").select("doc_id"), texts, "doc_id")


@query(f"""
WITH {X.DOCS}, t AS (SELECT doc_id, regexp_replace(text, '^{X.WS}+|{X.WS}+$', '', 'g') AS t FROM docs WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT (SELECT count(DISTINCT doc_id) FROM labels)::BIGINT AS images, (SELECT count(DISTINCT doc_id) FROM docs)::BIGINT AS transcriptions, count(*) FILTER (t <> '')::BIGINT AS complete, count(*) FILTER (t = '')::BIGINT AS still_empty,
  count(*) FILTER (t <> '' AND nfc_normalize(t) <> t)::BIGINT AS not_nfc, count(*) FILTER (t <> '' AND NOT regexp_matches(t, '[\\x{{0B80}}-\\x{{0BFF}}]'))::BIGINT AS no_script FROM t""")
def testset_check(spark, d):
    return pairs.completeness(X.table(spark, d, "labels").select("doc_id"), X.documents(spark, d).select("doc_id", "text"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality > 0)")
def resume_todo(spark, d):
    return pairs.todo(X.table(spark, d, "documents").select("doc_id"), X.table(spark, d, "labels"), "doc_id", F.col("quality"))


@query("SELECT count(*)::BIGINT AS images, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS recognised, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels))::BIGINT AS skipped FROM documents")
def resume_summary(spark, d):
    return pairs.resume_counts(X.table(spark, d, "documents"), X.table(spark, d, "labels"), "doc_id")


@query("""
WITH s AS (SELECT CASE event_type WHEN 'error' THEN 'box-fail: ' || event_id WHEN 'signup' THEN 'skip' WHEN 'view' THEN 'lstmf-fail: ' || user_id ELSE 'ok' END AS status FROM events)
SELECT split_part(status, ':', 1) AS status, count(*)::BIGINT AS n, split_part(status, ':', 1) NOT IN ('ok', 'skip') AS problem FROM s GROUP BY ALL""")
def status_tally(spark, d):
    e = F.col("event_type")
    status = F.when(e == "error", F.concat(F.lit("box-fail: "), F.col("event_id"))).when(e == "signup", "skip").when(e == "view", F.concat(F.lit("lstmf-fail: "), F.col("user_id"))).otherwise("ok")
    return pairs.status_tally(X.table(spark, d, "events").select(status.alias("status")))


@query("""
WITH s AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'box-fail: ' || event_id WHEN 'signup' THEN 'skip' WHEN 'view' THEN 'lstmf-fail: ' || user_id ELSE 'ok' END AS status FROM events)
SELECT event_id, status FROM s WHERE status NOT IN ('ok', 'skip') ORDER BY event_id LIMIT 10""")
def status_problems(spark, d):
    """The first ten problems, as the report of a run prints them."""
    e = F.col("event_type")
    status = F.when(e == "error", F.concat(F.lit("box-fail: "), F.col("event_id"))).when(e == "signup", "skip").when(e == "view", F.concat(F.lit("lstmf-fail: "), F.col("user_id"))).otherwise("ok")
    return pairs.first_problems(X.table(spark, d, "events").select("event_id", status.alias("status")), "event_id")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def stems_intersect(spark, d):
    return X.table(spark, d, "documents").select("doc_id").intersect(X.table(spark, d, "labels").select("doc_id"))


@query("(SELECT 'left' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id + 7 FROM labels)) UNION ALL (SELECT 'right', doc_id FROM (SELECT doc_id + 7 AS doc_id FROM labels EXCEPT SELECT doc_id FROM documents))")
def stems_except(spark, d):
    a, b = X.table(spark, d, "documents").select("doc_id"), X.table(spark, d, "labels").select((F.col("doc_id") + 7).alias("doc_id"))
    return a.subtract(b).select(F.lit("left").alias("side"), "doc_id").unionByName(b.subtract(a).select(F.lit("right").alias("side"), "doc_id"))


@query(f"WITH {X.FACES} SELECT DISTINCT ord, stem FROM faces WHERE ord IN (SELECT floor(i * 2.9)::BIGINT FROM range(0, 10) t(i))")
def typefaces_subset(spark, d):
    return grid.face_subset(X.faces(spark), X.N_FACES, 10).select("ord", "stem")


_STEMS = f"{X.FACES}, stems AS (SELECT DISTINCT ord, stem FROM faces)"


@query(f"WITH {X.SELECTED}, {_STEMS} SELECT rank, source, line_no, stem FROM selected JOIN stems ON ord = rank % {X.N_FACES}")
def font_assignment(spark, d):
    return layout.round_robin(selected(spark, d), X.faces(spark), X.N_FACES).select("rank", "source", "line_no", "stem")


@query(f"WITH {X.SELECTED}, {_STEMS} SELECT rank, stem FROM selected JOIN stems ON ord = ('0x' || substr(md5('0|' || rank), 1, 8))::BIGINT % {X.N_FACES}")
def font_assignment_random(spark, d):
    return layout.random_pick(selected(spark, d), X.faces(spark), X.N_FACES).select("rank", "stem")


@query(f"WITH {X.SELECTED}, {_STEMS}, c AS (SELECT stem, count(*)::BIGINT AS n FROM selected JOIN stems ON ord = rank % {X.N_FACES} GROUP BY stem) SELECT stem, n, (SELECT max(n) - min(n) FROM c)::BIGINT AS most_less_least FROM c")
def font_line_counts(spark, d):
    counts = layout.round_robin(selected(spark, d), X.faces(spark), X.N_FACES).groupBy("stem").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(layout.spread(counts).select((F.col("most") - F.col("least")).alias("most_less_least"))))


PAGE_HEIGHT, PADDING, LINE_HEIGHT, PROBE = layout.px(297), 60, 70, 64


@query(f"WITH {X.SELECTED} SELECT rank, rank // 50 AS page, rank % 50 AS row, {PADDING} + (rank % 50) * {LINE_HEIGHT} AS y, {PADDING} + (rank % 50) * {LINE_HEIGHT} + {PROBE + PADDING} <= {PAGE_HEIGHT} AS drawn FROM selected")
def page_layout(spark, d):
    return layout.page_layout(selected(spark, d), PAGE_HEIGHT, PADDING, LINE_HEIGHT, PROBE).select("rank", "page", "row", "y", "drawn")


THRESHOLD, SMOOTH = 2, max(3, X.ROWS // 400)


def _sql_bands(source, above, out):
    return f"""{out}_f AS (SELECT page, y, {above} AS up, {above} AND NOT coalesce(lag({above}) OVER (PARTITION BY page ORDER BY y), false) AS s FROM {source}),
{out} AS (SELECT page, g - 1 AS band, min(y) AS y0, max(y) + 1 AS y1 FROM (SELECT page, y, up, sum(s::INTEGER) OVER (PARTITION BY page ORDER BY y) AS g FROM {out}_f) WHERE up GROUP BY page, g)"""


_BANDS = f"{X.PROJECTION},\n{_sql_bands('proj', f'(ink > {THRESHOLD})', 'bands')}"
_SMOOTHED = f"{X.PROJECTION},\nsm AS (SELECT page, y, ink, sum(ink) OVER (PARTITION BY page ORDER BY y ROWS BETWEEN {SMOOTH // 2} PRECEDING AND {SMOOTH - 1 - SMOOTH // 2} FOLLOWING)::DOUBLE / {SMOOTH} AS smooth FROM proj)"


@query(f"WITH {_BANDS} SELECT page, band::BIGINT AS band, y0, y1 FROM bands")
def line_bands(spark, d):
    return layout.bands(X.projection(spark, d), "page", "y", F.col("ink") > THRESHOLD).select("page", F.col("band").cast("long").alias("band"), "y0", "y1")


@query(f"WITH {_SMOOTHED} SELECT page, y, smooth FROM sm")
def projection_smooth(spark, d):
    return layout.smooth(X.projection(spark, d), "page", "y", "ink", SMOOTH).select("page", "y", "smooth")


@query(f"""
WITH {_SMOOTHED}, pk AS (SELECT *, max(smooth) OVER (PARTITION BY page) AS peak FROM sm),
{_sql_bands("pk", f"(smooth > greatest(1.0, peak * {layout.PEAK_SHARE}))", "raw")},
h AS (SELECT page, list_sort(list(y1 - y0))[count(*) // 2 + 1] AS median FROM raw GROUP BY page),
j AS (SELECT page, y0, y1, sum(new) OVER (PARTITION BY page ORDER BY y0) AS g FROM (SELECT raw.page, y0, y1, (coalesce(y0 - lag(y1) OVER (PARTITION BY raw.page ORDER BY y0) >= median * {layout.MERGE_GAP}, true))::INTEGER AS new FROM raw JOIN h ON h.page = raw.page)),
l AS (SELECT page, min(y0) AS y0, max(y1) AS y1 FROM j GROUP BY page, g HAVING max(y1) - min(y0) >= {layout.MIN_HEIGHT}),
o AS (SELECT l.page, y0, y1, sum(ink) AS own FROM l JOIN proj ON proj.page = l.page AND y >= y0 AND y < y1 GROUP BY ALL)
SELECT o.page, (row_number() OVER (PARTITION BY o.page ORDER BY y0) - 1)::BIGINT AS band, y0, y1 FROM o JOIN (SELECT page, sum(ink) AS total FROM proj GROUP BY page) t ON t.page = o.page WHERE own >= total * {layout.MIN_INK}""")
def line_bands_merged(spark, d):
    return layout.merged_bands(X.projection(spark, d), "page", "y", "ink", SMOOTH).select("page", F.col("band").cast("long").alias("band"), "y0", "y1")


@query(f"""WITH {_BANDS}, n AS (SELECT page, count(*)::BIGINT AS bands FROM bands GROUP BY page), p AS (SELECT DISTINCT page FROM proj),
b AS (SELECT p.page, coalesce(bands, 0)::BIGINT AS bands, (coalesce(bands, 0) + length(p.page) % 2)::BIGINT AS lines FROM p LEFT JOIN n ON n.page = p.page)
SELECT page, bands, lines, CASE WHEN bands = lines THEN lines ELSE 0 END AS crops FROM b""")
def crops_written(spark, d):
    """Crops of pages whose bands and drawn lines agree in number; the pages of odd name length drew one line more."""
    rows = X.projection(spark, d)
    found = layout.bands(rows, "page", "y", F.col("ink") > THRESHOLD)
    n = found.groupBy("page").agg(F.count("*").alias("n"))
    drawn = rows.select("page").distinct().join(n, "page", "left").select("page", (F.coalesce("n", F.lit(0)) + F.length("page") % 2).alias("lines"))
    return layout.crops(found, drawn, "page")


SIZES, CAP = (100, 1_000, 10_000, 50_000, 198_653), 5_000


@query(f"""
WITH {_SPLIT}, {X.REGISTERS}, per AS (SELECT source, register, count(*) AS n FROM pool JOIN registers USING (source) GROUP BY ALL)
SELECT 'fonts' AS experiment, printf('f%02d', k) AS name, 50000::BIGINT AS n_lines, k::INTEGER AS n_faces, NULL::VARCHAR AS sources, 0 AS seed FROM (VALUES (5), (10), (29)) v(k)
UNION ALL SELECT 'size', printf('n%03dk', n // 1000), n::BIGINT, {X.N_FACES}, NULL, 0 FROM (VALUES {", ".join(f"({n})" for n in SIZES)}) v(n) WHERE n <= (SELECT count(*) FROM split WHERE renderable)
UNION ALL SELECT 'domain', register, {CAP}, {X.N_FACES}, string_agg(source, ',' ORDER BY source), 0 FROM per GROUP BY register HAVING sum(n) >= {CAP}
UNION ALL SELECT 'domain', 'mixed', {CAP}, {X.N_FACES}, string_agg(source, ',' ORDER BY source), 0 FROM per""")
def grid_variants(spark, d):
    """All three grids; sizes that the lines every typeface can render do not fill, and registers that the corpus does not,
    are left out."""
    available = split(spark, d).where("renderable").agg(F.count("*").alias("n"))
    fonts = grid.font_grid(spark, (5, 10, 29), 50_000)
    sizes = grid.size_grid(available, SIZES, X.N_FACES)
    return fonts.unionByName(sizes).unionByName(grid.domain_grid(X.pool(spark, d), X.registers(spark), CAP, X.N_FACES))


@query("""
SELECT event_type AS experiment, 'v' || event_id AS variant, NULL::VARCHAR AS status, NULL::VARCHAR AS error, value AS cer_grapheme_micro FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_type, 'v' || event_id, 'failed', 'user ' || user_id, NULL FROM events WHERE event_type = 'error'""")
def journal_union(spark, d):
    e = X.table(spark, d, "events").withColumn("variant", F.concat(F.lit("v"), F.col("event_id")))
    ok = e.where("event_type <> 'error'").select(F.col("event_type").alias("experiment"), "variant", F.col("value").alias("cer_grapheme_micro"))
    failed = e.where("event_type = 'error'").select(F.col("event_type").alias("experiment"), "variant", F.lit("failed").alias("status"), F.concat(F.lit("user "), F.col("user_id")).alias("error"))
    return grid.journal(ok, failed)


_RESULTS = [
    ("fonts", "f05", 50_000, 5, 0.081, 0.079, 0.0834, 0.0712, 0.3), ("fonts", "f29", 50_000, 29, 0.0521, 0.05, 0.0545, 0.044, 0.2226), ("fonts", "f10", 50_000, 10, 0.06654, None, None, 0.0561, 0.251),
    ("size", "n050k", 50_000, 29, 0.0521, 0.05, 0.0545, 0.044, 0.2226), ("size", "n010k", 10_000, 29, 0.0911, 0.088, 0.0942, 0.08, 0.31),
    ("domain", "newsprint", 34_000, 29, 0.07, 0.068, 0.0721, 0.06, 0.27), ("domain", "mixed", 34_000, 29, 0.06, None, None, 0.05, 0.24), ("domain", "literary", 34_000, 29, 0.0666, 0.06, 0.07, 0.055, 0.26), ("domain", "other", 34_000, 29, 0.1, 0.09, 0.11, 0.1, 0.4),
]
_COLUMNS = "experiment, name, n_lines, n_faces, cer_grapheme_micro, cer_grapheme_lo, cer_grapheme_hi, cer_codepoint_micro, wer_micro"
_sql = lambda v: "NULL::DOUBLE" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
RESULTS = f"results({_COLUMNS}) AS (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in _RESULTS)})"


def results(spark):
    return spark.createDataFrame([(*r, None) for r in _RESULTS], grid.RESULT)


@query(f"WITH {RESULTS} SELECT experiment, name, n_lines::BIGINT AS n_lines, n_faces, cer_grapheme_micro, cer_grapheme_lo, cer_grapheme_hi, cer_codepoint_micro, wer_micro FROM results")
def load_results(spark, d):
    """Results written as one `<experiment>/<name>/result.json` each and read back by pattern."""
    folder = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    files.write_results(results(spark), folder)
    return files.read_results(spark, folder).drop("timestamp")


_pct = lambda c: f"printf('%.2f', {c} * 100)"


@query(f"""
WITH {RESULTS}, o AS (SELECT *, CASE experiment WHEN 'fonts' THEN n_faces WHEN 'size' THEN n_lines ELSE coalesce(list_position(['literary', 'newsprint', 'mixed'], name) - 1, 9) END AS o,
  CASE WHEN cer_grapheme_lo IS NULL THEN '--' ELSE '[' || {_pct("cer_grapheme_lo")} || ', ' || {_pct("cer_grapheme_hi")} || ']' END AS ci FROM results)
SELECT experiment, (row_number() OVER (PARTITION BY experiment ORDER BY o, name) - 1)::BIGINT AS position,
  CASE experiment WHEN 'fonts' THEN printf('%2d', n_faces) WHEN 'size' THEN format('{{:,}}', n_lines) ELSE upper(name[1]) || name[2:] END AS label,
  {_pct("cer_grapheme_micro")} || ' & ' || ci || CASE experiment WHEN 'fonts' THEN ' & ' || {_pct("cer_codepoint_micro")} ELSE '' END || ' & ' || {_pct("wer_micro")} AS cells FROM o""")
def report_rows(spark, d):
    return grid.report_rows(results(spark))


@query(f"WITH {RESULTS}, s AS (SELECT * FROM results WHERE experiment = 'size') SELECT n_lines::BIGINT AS n_lines, cer_grapheme_micro * 100 AS rate, cer_grapheme_lo * 100 AS lo, cer_grapheme_hi * 100 AS hi, n_lines = (SELECT max(n_lines) FROM s) AS best FROM s WHERE (SELECT count(*) FROM s) >= 2")
def scaling_series(spark, d):
    return grid.scaling(results(spark))


