"""Script and typeface coverage: the syllabary, unit counts against it, common coverage of typefaces, gaps and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BLOCK, SPACE, codepoints

# The letters of the script, from which units follow by rule.
VOWELS = "அ ஆ இ ஈ உ ஊ எ ஏ ஐ ஒ ஓ ஔ".split()
CONSONANTS = "க ங ச ஞ ட ண த ந ப ம ய ர ல வ ழ ள ற ன".split()
GRANTHA = "ஜ ஷ ஸ ஹ".split()
AYTHAM, VIRAMA = "ஃ", "\u0BCD"
VOWEL_SIGNS = ["", *(chr(c) for c in (0x0BBE, 0x0BBF, 0x0BC0, 0x0BC1, 0x0BC2, 0x0BC6, 0x0BC7, 0x0BC8, 0x0BCA, 0x0BCB, 0x0BCC))]
CORE = ("uyir", "aytham", "mey", "uyirmey")
MISSING_SHARE = 1e-4


def syllabary(spark: SparkSession) -> DataFrame:
    """(class, ord, unit): the 247 units of the script in four classes, and the 52 grantha units."""
    rows = [("uyir", v) for v in VOWELS] + [("aytham", AYTHAM)]
    rows += [("mey", c + VIRAMA) for c in CONSONANTS] + [("uyirmey", c + v) for c in CONSONANTS for v in VOWEL_SIGNS]
    rows += [("grantha", c + v) for c in GRANTHA for v in VOWEL_SIGNS] + [("grantha", c + VIRAMA) for c in GRANTHA]
    return spark.createDataFrame([(k, i, u) for i, (k, u) in enumerate(rows)], "class string, ord int, unit string")


def with_counts(units: DataFrame, counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every unit (of every group) with its count, 0 where it does not occur."""
    by = by or []
    if not by:
        return units.join(counts, "unit", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    groups = counts.select(*by).distinct()
    return groups.join(F.broadcast(units)).join(counts, [*by, "unit"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def report(counted: DataFrame, by: list[str] | None = None, rarest: int = 12) -> DataFrame:
    """total, covered, missing, rarest and occurrences of each class, and of the four core classes together as
    `syllabary_247` (of each group in `by`). Arrays are bounded by the class's units."""
    classes = F.when(F.col("class").isin(*CORE), F.array("class", F.lit("syllabary_247"))).otherwise(F.array("class"))
    each = counted.withColumn("class", F.explode(classes))
    seen = F.col("n") > 0
    few = F.slice(F.array_sort(F.collect_list(F.when(seen, F.struct("n", "ord", "unit")))), 1, rarest)
    return each.groupBy(*(by or []), "class").agg(
        F.count("*").alias("total"), F.count_if(seen).alias("covered"), F.array_join(F.array_sort(F.collect_list(F.when(~seen, F.col("unit")))), ",").alias("missing"),
        F.array_join(F.transform(few, lambda x: F.concat(x["unit"], F.lit(":"), x["n"].cast("string"))), ",").alias("rarest"), F.sum("n").alias("occurrences"),
    )


def tiers(counted: DataFrame, n_fonts: int = 27) -> DataFrame:
    """(threshold, units): how many core units occur less often than 1, n_fonts and 10 n_fonts times, and the share of all
    occurrences that units with fewer than n_fonts have."""
    core = counted.where(F.col("class").isin(*CORE))
    n = F.col("n")
    thresholds = (1, n_fonts, 10 * n_fonts)
    one = core.agg(*[F.count_if(n < t).alias(f"t{i}") for i, t in enumerate(thresholds)], F.sum(F.when(n < n_fonts, n).otherwise(0)).alias("rare"), F.sum("n").alias("every"))
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("units")) for i, t in enumerate(thresholds)]))
    share = F.when(F.col("every") == 0, 0.0).otherwise(F.col("rare") / F.col("every"))
    return one.select(rows.alias("x"), share.alias("rare_share")).select("x.threshold", "x.units", "rare_share")


def rarest(counted: DataFrame, k: int = 12) -> DataFrame:
    return counted.where(F.col("n") > 0).orderBy("n", "ord").limit(k).select("unit", "class", "n")


def common_coverage(faces: DataFrame) -> DataFrame:
    """(cp): code points that every typeface has. A typeface is (stem, cmap: ranges of code points)."""
    n = faces.agg(F.countDistinct("stem").alias("faces"))
    points = faces.select("stem", F.explode("cmap").alias("r")).select("stem", F.explode(F.sequence("r.lo", "r.hi")).alias("cp"))
    return points.groupBy("cp").agg(F.countDistinct("stem").alias("n")).join(F.broadcast(n)).where("n = faces").select("cp")


def face_points(faces: DataFrame) -> DataFrame:
    return faces.select("stem", F.explode("cmap").alias("r")).select("stem", F.explode(F.sequence("r.lo", "r.hi")).alias("cp")).distinct()


def gaps(faces: DataFrame, frequency: DataFrame) -> DataFrame:
    """(stem, cp, n): code points of the corpus that a typeface lacks. Both sides are inventories (typefaces x Unicode at most),
    never rows of the corpus."""
    wanted = frequency.join(F.broadcast(faces.select("stem").distinct()))
    return wanted.join(face_points(faces), ["stem", "cp"], "left_anti")


def audit(faces: DataFrame, frequency: DataFrame) -> DataFrame:
    """Missing code points, their occurrences and share, and the flag above MISSING_SHARE, of each typeface."""
    total = frequency.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    lost = gaps(faces, frequency).groupBy("stem").agg(F.count("*").alias("missing_count"), F.sum("n").alias("missing_occurrences"))
    block = face_points(faces).where(F.col("cp").between(*BLOCK)).groupBy("stem").agg(F.count("*").alias("block_covered"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = faces.select("stem").distinct().join(lost, "stem", "left").join(block, "stem", "left").join(F.broadcast(total))
    out = out.select("stem", zero("missing_count"), zero("missing_occurrences"), zero("block_covered"), "total")
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.col("missing_occurrences") / F.col("total"))
    return out.withColumn("missing_share", share).withColumn("flagged", F.col("missing_share") > MISSING_SHARE).drop("total")


def top_gaps(found: DataFrame, audited: DataFrame, faces: int = 8, points: int = 6) -> DataFrame:
    """The most frequent missing code points of the typefaces that miss most. The inputs are inventories."""
    from pyspark.sql import Window

    worst = audited.where("missing_count > 0").orderBy(F.desc("missing_share"), "stem").limit(faces).select("stem")
    rank = F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("n"), "cp"))
    return found.join(F.broadcast(worst), "stem").withColumn("rank", rank).where(F.col("rank") <= points).select("stem", "rank", "cp", "n")


def renderable(line: Column, covered: Column) -> Column:
    """Whether all characters but white space are in `covered`, an array of characters."""
    return F.size(F.array_except(codepoints(F.regexp_replace(line, rf"(?U){SPACE}+", "")), covered)) == 0


def split_renderable(lines: DataFrame, coverage: DataFrame) -> DataFrame:
    """`lines` with the flag `renderable`. The coverage is one array of at most all of Unicode, broadcast."""
    one = coverage.agg(F.collect_list(F.decode(F.unhex(F.lpad(F.hex(F.col("cp").cast("long")), 8, "0")), "UTF-32")).alias("covered"))
    return lines.join(F.broadcast(one)).withColumn("renderable", renderable(F.col("line"), F.col("covered"))).drop("covered")


def licence_bucket(licence: Column, url: Column, copyright_: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce(licence, F.lit("")), F.coalesce(url, F.lit("")))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(text.contains("Open Font License") | F.upper(text).contains("OFL"), "OFL 1.1").when(text.contains("Apache"), "Apache 2.0")
        .when(text.contains("Virtual Academy"), "TVA (order no.)").when(filled(licence) | filled(copyright_), "proprietary/unstated").otherwise("none declared")
    )
