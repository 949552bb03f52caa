"""Evaluation of pairs: every line of every source against its corruption."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.distance import UNITS, alignment
from ..operators import evaluate
from ..session import stored
from . import fixtures as X
from .registry import query

BOOT, FLOOR = 200, 0.01
#: What the reference records of a variant: its resamples, and its most frequent confusions of each kind.
WHOLE_BOOT, RECORDED = 2_000, {"substitution": 30, "deletion": 15, "insertion": 15}


def scored(spark, d):
    return evaluate.score(X.pairs(spark, d))


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("cer_grapheme_macro", "wer_macro") if c in df.columns})


@query(f"WITH RECURSIVE {X.SCORED} SELECT name, grapheme_edits, grapheme_ref, codepoint_edits, codepoint_ref, word_edits, word_ref FROM scored")
def score_pairs(spark, d):
    return scored(spark, d).drop("profile")


def _distance(unit):
    def fn(spark, d):
        clean = X.pairs(spark, d).select("name", T.normalize(F.col("ref")).alias("ref"), T.normalize(F.col("hyp")).alias("hyp"))
        return clean.select("name", UNITS[unit][1](F.col("ref"), F.col("hyp")).cast("int").alias("edits"))

    fn.__name__ = f"edit_distance_{unit}"
    return query(f"WITH RECURSIVE {X.SCORED} SELECT name, {unit}_edits AS edits FROM scored")(fn)


edit_distance_grapheme, edit_distance_codepoint, edit_distance_word = (_distance(u) for u in UNITS)


@query(f"WITH {X.SCORED} SELECT {X.sql_aggregate()}")
def eval_aggregate(spark, d):
    return _rounded(evaluate.aggregate(scored(spark, d)))


@query(f"""WITH {X.SCORED} SELECT '{{"name":"' || name || '","grapheme_edits":' || grapheme_edits || ',"grapheme_ref":' || grapheme_ref || ',"codepoint_edits":' || codepoint_edits || ',"codepoint_ref":' || codepoint_ref
  || ',"word_edits":' || word_edits || ',"word_ref":' || word_ref || ',"profile":"default"}}' AS line FROM scored""")
def eval_report_json(spark, d):
    """One JSON object a pair, as the report's writer puts them out."""
    return scored(spark, d).select(F.to_json(F.struct("*")).alias("line"))


@query(f"""
WITH RECURSIVE {X.PAIRS},
p AS (SELECT name, {X.sql_words(X.sql_norm("ref"))} AS a, {X.sql_words(X.sql_norm("hyp"))} AS b FROM pairs),
t(name, i, r, a, b) AS (SELECT name, 0::BIGINT, range(0, len(b) + 1), a, b FROM p
  UNION ALL SELECT name, i + 1, list_transform(range(1, len(b) + 2), lambda j: j + list_min(list_transform(range(1, j + 1),
    lambda k: (CASE WHEN k = 1 THEN r[1] + 1 ELSE least(r[k] + 1, r[k - 1] + (CASE WHEN a[i + 1] = b[k - 1] THEN 0 ELSE 1 END)) END) - k))), a, b FROM t WHERE i < len(a)),
m AS (SELECT name, any_value(a) AS a, any_value(b) AS b, list(r ORDER BY i) AS d FROM t GROUP BY name),
bt(name, a, b, d, i, j, op, step) AS (SELECT name, a, b, d, len(a), len(b), '', 0 FROM m
  UNION ALL SELECT name, a, b, d, CASE WHEN op = 'I' THEN i ELSE i - 1 END, CASE WHEN op = 'D' THEN j ELSE j - 1 END, op, step + 1
  FROM (SELECT name, a, b, d, i, j, step, CASE WHEN i > 0 AND j > 0 AND d[i + 1][j + 1] = d[i][j] + (CASE WHEN a[i] = b[j] THEN 0 ELSE 1 END) THEN (CASE WHEN a[i] = b[j] THEN 'M' ELSE 'S' END)
    WHEN i > 0 AND d[i + 1][j + 1] = d[i][j + 1] + 1 THEN 'D' ELSE 'I' END AS op FROM bt WHERE i > 0 OR j > 0))
SELECT name, string_agg(op, '' ORDER BY step DESC) AS ops, count(*) FILTER (op IN ('S', 'D', 'I'))::BIGINT AS edits FROM bt GROUP BY name""")
def alignment_ops(spark, d):
    """The steps of each pair's word alignment: match, substitution, deletion, insertion."""
    clean = X.pairs(spark, d).select("name", T.normalize(F.col("ref")).alias("ref"), T.normalize(F.col("hyp")).alias("hyp"))
    steps = clean.select("name", alignment(T.words(F.col("ref")), T.words(F.col("hyp"))).alias("x"))
    op = lambda x: F.when(x["hyp"].isNull(), "D").when(x["ref"].isNull(), "I").when(x["ref"] == x["hyp"], "M").otherwise("S")
    ops = F.array_join(F.transform("x", op), "")
    return steps.select("name", ops.alias("ops"), F.length(F.replace(ops, F.lit("M"), F.lit(""))).cast("long").alias("edits"))


# Pairs whose alignment is known: a third of the lines with some units replaced by signs that no text holds, a third whose
# recognition failed (all deletions), a third without a reference (all insertions). Every line takes part.
_SWAPPED = "கபவ"


def _known(spark, d):
    c = F.col("line")
    kind = F.pmod("line_no", F.lit(3))
    lines = X.pool(spark, d, keep_tail=True)
    return lines.select(F.when(kind == 2, "").otherwise(c).alias("ref"), F.when(kind == 1, "").when(kind == 2, c).otherwise(F.translate(c, _SWAPPED, X.ABSENT)).alias("hyp"))


_CONFUSED = f"""{X.ALL_LINES},
u AS (SELECT line_no % 3 AS kind, unnest({X.sql_graphemes("line")}) AS g FROM lines),
confused AS (
  SELECT 'substitution' AS kind, g AS ref, translate(g, '{_SWAPPED}', '{X.ABSENT}') AS hyp, count(*)::BIGINT AS n FROM u WHERE kind = 0 AND translate(g, '{_SWAPPED}', '{X.ABSENT}') <> g GROUP BY ALL
  UNION ALL SELECT 'deletion', g, NULL, count(*)::BIGINT FROM u WHERE kind = 1 GROUP BY ALL
  UNION ALL SELECT 'insertion', NULL, g, count(*)::BIGINT FROM u WHERE kind = 2 GROUP BY ALL)"""


def _confused(spark, d):
    return evaluate.confusions(_known(spark, d))


@query(f"WITH {_CONFUSED} SELECT kind, ref, hyp, n FROM confused")
def confusions(spark, d):
    return _confused(spark, d)


@query(f"""WITH {_CONFUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, ref NULLS FIRST, hyp NULLS FIRST) AS k FROM confused)
SELECT kind, ref, hyp, n FROM r WHERE k <= CASE kind WHEN 'substitution' THEN 30 ELSE 15 END""")
def confusion_topk(spark, d):
    return evaluate.top_per_kind(_confused(spark, d), {"substitution": 30, "deletion": 15, "insertion": 15})


@query(f"""WITH {_CONFUSED}, s AS (SELECT ref, hyp, n FROM confused WHERE kind = 'substitution'), top AS (SELECT * FROM s ORDER BY n DESC, ref, hyp LIMIT 30)
SELECT ref, hyp, n, n::DOUBLE / (SELECT sum(n) FROM top)::DOUBLE AS share_stored, n::DOUBLE / (SELECT sum(n) FROM s)::DOUBLE AS share_all FROM top""")
def confusion_share(spark, d):
    return evaluate.confusion_share(_confused(spark, d))


def _sql_boot(n_boot):
    weight = " + ".join(f"(u >= {p})::BIGINT" for p in evaluate.POISSON)
    lo, hi = int(0.025 * n_boot), min(int(0.975 * n_boot), n_boot - 1)
    ends = "\nUNION ALL ".join(f"SELECT '{u}' AS metric, r[{lo + 1}] AS lo, r[{hi + 1}] AS hi FROM (SELECT list({X.sql_rate(f'sum_{u}_e', f'sum_{u}_r')} ORDER BY {X.sql_rate(f'sum_{u}_e', f'sum_{u}_r')}) AS r FROM reps)" for u in ("grapheme", "word"))
    return f"""{X.SCORED},
drawn AS (SELECT rep, grapheme_edits, grapheme_ref, word_edits, word_ref, ('0x' || substr(md5('0|' || rep || '|' || name), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u FROM scored, range(0, {n_boot}) t(rep)),
weighed AS (SELECT *, {weight} AS w FROM drawn),
reps AS (SELECT rep, sum(w * grapheme_edits) AS sum_grapheme_e, sum(w * grapheme_ref) AS sum_grapheme_r, sum(w * word_edits) AS sum_word_e, sum(w * word_ref) AS sum_word_r FROM weighed GROUP BY rep),
ends AS ({ends})"""


def _sql_boot_index(n_boot):
    """n rows drawn with replacement a replicate: row number floor of a digest modulo n."""
    lo, hi = int(0.025 * n_boot), min(int(0.975 * n_boot), n_boot - 1)
    ends = "\nUNION ALL ".join(f"SELECT '{u}' AS metric, r[{lo + 1}] AS lo, r[{hi + 1}] AS hi FROM (SELECT list({X.sql_rate(f'sum_{u}_e', f'sum_{u}_r')} ORDER BY {X.sql_rate(f'sum_{u}_e', f'sum_{u}_r')}) AS r FROM reps)" for u in ("grapheme", "word"))
    return f"""{X.SCORED},
numbered AS (SELECT row_number() OVER (ORDER BY name) - 1 AS i, * FROM scored), size AS (SELECT count(*) AS n FROM scored),
draws AS (SELECT rep, ('0x' || substr(md5('0|' || rep || '|' || k), 1, 8))::BIGINT % n AS i FROM size, range(0, n) a(k), range(0, {n_boot}) b(rep)),
reps AS (SELECT rep, sum(grapheme_edits) AS sum_grapheme_e, sum(grapheme_ref) AS sum_grapheme_r, sum(word_edits) AS sum_word_e, sum(word_ref) AS sum_word_r FROM draws JOIN numbered ON numbered.i = draws.i GROUP BY rep),
ends AS ({ends})"""


@query(f"WITH {_sql_boot_index(WHOLE_BOOT)} SELECT * FROM ends")
def bootstrap_ci_index(spark, d):
    """Percentile intervals over the reference's number of resamples, each of as many rows as there are, drawn with replacement."""
    return evaluate.bootstrap(scored(spark, d), "name", n_boot=WHOLE_BOOT, method="index")


@query(f"WITH {_sql_boot(BOOT)} SELECT * FROM ends")
def bootstrap_ci(spark, d):
    """Percentile intervals over {BOOT} resamples of all lines, by weights."""
    return evaluate.bootstrap(scored(spark, d), "name", n_boot=BOOT, method="poisson")


_METRICS = ("cer_grapheme_micro", "cer_grapheme_macro", "cer_codepoint_micro", "wer_micro", "wer_macro", "lines", "total_graphemes", "total_words")


@query(f"""WITH {_sql_boot(WHOLE_BOOT)}, agg AS (SELECT {X.sql_aggregate()})
SELECT metric || '_lo' AS metric, lo AS value FROM ends UNION ALL SELECT metric || '_hi', hi FROM ends
UNION ALL {" UNION ALL ".join(f"SELECT '{c}', {c}::DOUBLE FROM agg" for c in _METRICS)}""")
def variant_metrics(spark, d):
    """The numbers that a sweep records of a variant, one metric a row: all rates and totals, and the ends of the intervals over
    the reference's number of resamples. The confusions beside them are in variant_record."""
    s = stored(scored(spark, d))
    agg, ends = _rounded(evaluate.aggregate(s)), evaluate.bootstrap(s, "name", n_boot=WHOLE_BOOT, method="poisson")
    one = agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in _METRICS])))
    both = ends.select(F.inline(F.array(*[F.struct(F.concat("metric", F.lit(f"_{c}")).alias("metric"), F.col(c).alias("value")) for c in ("lo", "hi")])))
    return one.unionByName(both)


@query(f"WITH {_sql_boot(WHOLE_BOOT)} SELECT * FROM ends")
def bootstrap_ci_whole(spark, d):
    """Percentile intervals over the reference's number of resamples of all lines, by weights."""
    return evaluate.bootstrap(scored(spark, d), "name", n_boot=WHOLE_BOOT, method="poisson")


@query()
def variant_record(spark, d):
    """All that a sweep records of a variant: rates, lines and interval ends in rows of a metric alone, then the most frequent
    confusions of the same pairs, by kind, with their counts. SQL has no alignment of graphemes at this size."""
    s = stored(scored(spark, d))
    agg, ends = evaluate.aggregate(s), evaluate.bootstrap(s, "name", n_boot=WHOLE_BOOT, method="poisson")
    names = [c for c in agg.columns if c != "profile"]
    one = agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])))
    both = ends.select(F.inline(F.array(*[F.struct(F.concat("metric", F.lit(f"_{c}")).alias("metric"), F.col(c).alias("value")) for c in ("lo", "hi")])))
    clean = X.pairs(spark, d).select(T.normalize(F.col("ref")).alias("ref"), T.normalize(F.col("hyp")).alias("hyp"))
    top = evaluate.top_per_kind(evaluate.confusions(clean), RECORDED)
    bare = F.lit(None).cast("string")
    rates = one.unionByName(both).select("metric", bare.alias("ref"), bare.alias("hyp"), "value")
    return rates.unionByName(top.select(F.col("kind").alias("metric"), "ref", "hyp", F.col("n").cast("double").alias("value")))


_NOISY = f"{X.ALL_LINES},\npairs AS (SELECT source || ':' || line_no::VARCHAR AS name, replace(replace(line, 'ம', 'ம' || chr(8204)), ' ', ' ' || chr(160)) AS ref, {X.sql_corrupted('line')} AS hyp FROM lines)"


@query("\nUNION ALL ".join(f"(WITH {X.sql_scored(_NOISY, zero_width=p.strip_zero_width, collapse=p.collapse_whitespace)} SELECT '{p.name}' AS profile, {X.sql_aggregate()})" for p in T.PROFILES))
def profile_sensitivity(spark, d):
    """Rates under each of the four normalisation profiles, on references with joiners and no-break spaces."""
    ref = F.replace(F.replace(F.col("ref"), F.lit("ம"), F.lit("ம‌")), F.lit(" "), F.lit("  "))
    noisy = X.pairs(spark, d).withColumn("ref", ref)
    found = _rounded(evaluate.aggregate(evaluate.score_profiles(noisy, T.PROFILES), ["profile"]))
    names = spark.range(1).select(F.explode(F.array(*[F.lit(p.name) for p in T.PROFILES])).alias("profile"))
    return names.join(F.broadcast(found), "profile", "left").na.fill(0).select(*found.columns)


_PASSES = X.sql_scored(f"{X.ALL_LINES},\npairs AS (SELECT source || ':' || line_no::VARCHAR AS name, {X.sql_corrupted('line')} AS ref, translate(line, 'ரய', 'றழ') AS hyp FROM lines)")


def passes(spark, d):
    p = X.pairs(spark, d)
    return evaluate.score(p.select("name", F.col("hyp").alias("ref"), F.translate("ref", "ரய", "றழ").alias("hyp")))


@query(f"WITH {_PASSES}, agg AS (SELECT {X.sql_aggregate()}) SELECT lines, cer_grapheme_micro, wer_micro, cer_grapheme_micro > {FLOOR} AS above_floor FROM agg")
def agreement(spark, d):
    """Disagreement of two passes over the same lines, and whether it is over one in a hundred."""
    return evaluate.aggregate(passes(spark, d)).select("lines", "cer_grapheme_micro", "wer_micro", (F.col("cer_grapheme_micro") > FLOOR).alias("above_floor"))


@query(f"WITH {_PASSES} SELECT name, grapheme_edits FROM scored WHERE grapheme_edits > 0 ORDER BY grapheme_edits DESC, name LIMIT 8")
def worst_pairs(spark, d):
    return passes(spark, d).where("grapheme_edits > 0").orderBy(F.desc("grapheme_edits"), "name").limit(8).select("name", "grapheme_edits")


