"""Experiment grids, resume, journals and roll-ups to report rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VARIANT = "experiment string, name string, n_lines bigint, n_faces int, sources string, seed int"
RESULT = "experiment string, name string, n_lines bigint, n_faces int, cer_grapheme_micro double, cer_grapheme_lo double, cer_grapheme_hi double, cer_codepoint_micro double, wer_micro double, timestamp string"


def face_subset(faces: DataFrame, n: int, k: int) -> DataFrame:
    """k typefaces evenly spaced over the sorted ones; all where there are no more."""
    if k >= n:
        return faces
    return faces.join(F.broadcast(faces.sparkSession.range(k).select(F.floor(F.col("id") * F.lit(n / k)).alias("ord"))), "ord")


def font_grid(spark: SparkSession, steps: Iterable[int], n_lines: int, seed: int = 0) -> DataFrame:
    return spark.createDataFrame([("fonts", f"f{k:02d}", n_lines, k, None, seed) for k in steps], VARIANT)


def size_grid(available: DataFrame, steps: Iterable[int], n_faces: int, seed: int = 0) -> DataFrame:
    """One variant a size that the lines in `available` (one row, column n) allow."""
    rows = [("size", f"n{n // 1000:03d}k", n, n_faces, None, seed) for n in steps]
    sizes = available.sparkSession.createDataFrame(rows, VARIANT)
    return sizes.join(F.broadcast(available.select(F.col("n").alias("there")))).where("n_lines <= there").drop("there")


def domain_grid(pool: DataFrame, registers: DataFrame, cap: int, n_faces: int, seed: int = 0) -> DataFrame:
    """One variant a register with at least `cap` lines, and the mixture of all registers' sources."""
    per = pool.groupBy("source").agg(F.count("*").alias("n")).join(F.broadcast(registers), "source")
    joined = F.array_join(F.array_sort(F.collect_set("source")), ",")
    arms = per.groupBy(F.col("register").alias("name")).agg(F.sum("n").alias("have"), joined.alias("sources")).where(F.col("have") >= cap).select("name", "sources")
    both = arms.unionByName(per.agg(joined.alias("sources")).withColumn("name", F.lit("mixed")))
    return both.select(F.lit("domain").alias("experiment"), "name", F.lit(cap).cast("long").alias("n_lines"), F.lit(n_faces).alias("n_faces"), "sources", F.lit(seed).alias("seed"))


def unfinished(variants: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    return variants if force else variants.join(results.select("experiment", "name"), ["experiment", "name"], "left_anti")


def run(variants: list, work: Callable, log: Callable[[dict], None]) -> list:
    """Runs each variant; a failure becomes a journal row and the sweep goes on. The list is a grid of a few variants."""
    out = []
    for v in variants:
        stamp = lambda: datetime.now(UTC).isoformat()
        try:
            result = work(v)
        except Exception as e:  # the journal keeps what went wrong
            log({"experiment": v.experiment, "variant": v.name, "status": "failed", "error": str(e), "timestamp": stamp()})
            continue
        log({"experiment": v.experiment, "variant": v.name, **result, "timestamp": stamp()})
        out.append(result)
    return out


def journal(ok: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of both shapes; what a shape lacks is null."""
    return ok.unionByName(failed, allowMissingColumns=True)


def percent(c: Column) -> Column:
    return F.format_string("%.2f", c * 100)


def interval(lo: Column, hi: Column) -> Column:
    return F.when(lo.isNull() | hi.isNull(), "--").otherwise(F.format_string("[%.2f, %.2f]", lo * 100, hi * 100))


REGISTER_ORDER = ("literary", "newsprint", "mixed")


def report_rows(results: DataFrame) -> DataFrame:
    """(experiment, position, label, cells): the body rows of the three tables, in the order they are printed."""
    from pyspark.sql import Window

    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in REGISTER_ORDER]), F.col("name")), F.lit(0))
    place = F.when(place == 0, 9).otherwise(place - 1)
    order = F.when(F.col("experiment") == "fonts", F.col("n_faces")).when(F.col("experiment") == "size", F.col("n_lines")).otherwise(place)
    label = F.when(F.col("experiment") == "fonts", F.format_string("%2d", "n_faces")).when(F.col("experiment") == "size", F.format_number("n_lines", 0)).otherwise(F.initcap("name"))
    cells = F.array(percent(F.col("cer_grapheme_micro")), interval(F.col("cer_grapheme_lo"), F.col("cer_grapheme_hi")), F.when(F.col("experiment") == "fonts", percent(F.col("cer_codepoint_micro"))), percent(F.col("wer_micro")))
    rank = F.row_number().over(Window.partitionBy("experiment").orderBy("order", "name")) - 1
    rows = results.withColumn("order", order.cast("long"))
    return rows.select("experiment", rank.cast("long").alias("position"), label.alias("label"), F.array_join(cells, " & ").alias("cells"))


def scaling(results: DataFrame) -> DataFrame:
    """(n_lines, rate, lo, hi in percent, best) of the size variants, where there are at least two."""
    size = results.where("experiment = 'size'")
    n = size.agg(F.count("*").alias("rows"), F.max("n_lines").alias("most"))
    p = lambda c: F.col(c) * 100
    return size.join(F.broadcast(n)).where("rows >= 2").select("n_lines", p("cer_grapheme_micro").alias("rate"), p("cer_grapheme_lo").alias("lo"), p("cer_grapheme_hi").alias("hi"), (F.col("n_lines") == F.col("most")).alias("best"))


def latex_table(head: str, rows: list[str], caption: str, label: str) -> str:
    """A table around already formatted body rows (a report of at most some dozen)."""
    columns = "l" + "c" * head.count("&")
    body = "\n".join(f"{r} \\\\" for r in rows)
    return f"\\begin{{table}}[t]\n\\centering\\small\n\\begin{{tabular}}{{{columns}}}\n\\toprule\n{head} \\\\\n\\midrule\n{body}\n\\bottomrule\n\\end{{tabular}}\n\\caption{{{caption}}}\n\\label{{{label}}}\n\\end{{table}}\n"


def escape(c: Column) -> Column:
    """Text for a table cell; empty or null is two dashes."""
    return F.when(F.coalesce(c, F.lit("")) == "", "--").otherwise(F.replace(F.replace(c, F.lit("&"), F.lit("\\&")), F.lit("_"), F.lit("\\_")))
