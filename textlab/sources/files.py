"""Scans and sinks. Files are read whole where a file is a document; stems of file names are keys."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.text import graphemes, lines, strip
from ..operators.corpus import frequency, statistics
from ..operators.grid import RESULT
from ..operators.order import numbered

IMAGES = (".jpg", ".jpeg", ".png", ".tif", ".tiff")


class NoImagesError(RuntimeError):
    pass


class UnknownFacesError(ValueError):
    pass


def stem(suffix: str) -> Column:
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return F.url_decode(F.replace(F.regexp_replace(name, rf"{suffix}$", ""), F.lit("+"), F.lit("%2B")))


def _empty(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Names, without the suffix, of the files without a byte: Spark's readers leave such files out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/*{suffix}")
    found = path.getFileSystem(conf).globStatus(path) or ()
    return [f.getPath().getName().removesuffix(suffix) for f in found if f.isFile() and f.getLen() == 0]


def scan_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, name, size) of the files in a folder, those without a byte too. The files themselves are not read; their names
    are what Spark's own listing holds on the driver."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    one = lambda c: F.regexp_replace(c, "^file:/+", "file:/").alias("path")  # noqa: E731  (both spellings occur)
    names = spark.createDataFrame([(x,) for x in found.inputFiles()], "path string").select(one("path"))
    sizes = found.select(one(F.col("_metadata.file_path")), F.col("length").alias("size"))
    plain = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    both = names.join(sizes, "path", "left").select(plain.alias("path"), F.coalesce("size", F.lit(0)).alias("size"))
    return both.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "size")


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """(name, stem, size) of the page images of a folder, by suffix regardless of case, sorted by name; raises where there
    is none."""
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    rows = scan_files(spark, folder, recursive=False).where(suffix.isin(*IMAGES))
    if rows.isEmpty():
        raise NoImagesError(f"no page images in {folder}")
    return rows.select("name", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), "size").orderBy("name")


def scan_renderings(spark: SparkSession, folder: str) -> DataFrame:
    """(category, face, side, stem, size) of `<category>/<face>/gt/*.gt.txt` and `<category>/<face>/images/*.tiff`; other
    files are left out, and a folder without a file is not there."""
    parts = F.split("path", "/")
    at = lambda i: F.element_at(parts, -i)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    name, bare = F.col("name"), F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", "")
    rows = scan_files(spark, folder).where(F.size(F.split(bare, "/")) == len(root.rstrip("/").split("/")) + 4)
    gt, image = (at(2) == "gt") & name.endswith(".gt.txt"), (at(2) == "images") & name.endswith(".tiff")
    return rows.where(gt | image).select(at(4).alias("category"), at(3).alias("face"), at(2).alias("side"), F.regexp_replace("name", r"\.gt\.txt$|\.tiff$", "").alias("stem"), "size")


def load_faces(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """(ord, stem, path) of the .ttf and .otf files, sorted by name, or of those named; raises on a name that is not there.
    Typefaces are some dozen."""
    known = scan_files(spark, folder, recursive=False).where(F.lower("name").rlike(r"\.(ttf|otf)$")).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    if names is not None:
        wanted = spark.createDataFrame([(x,) for x in names], "stem string")
        absent = sorted(r.stem for r in wanted.join(known, "stem", "left_anti").collect())
        if absent:
            raise UnknownFacesError(f"no such typeface in {folder}: {', '.join(absent)}")
        known = known.join(F.broadcast(wanted.distinct()), "stem", "left_semi")
    return numbered(known, [F.col("name")], "ord").select("ord", "stem", "path")


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(source, doc_id, text): one row a `*.txt` file; the stem is the source."""
    found = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    rows = found.select(stem(r"\.txt").alias("source"), F.lit(0).cast("long").alias("doc_id"), F.col("value").alias("text"))
    none = spark.createDataFrame([(x, 0, "") for x in _empty(spark, folder, ".txt")], rows.schema)
    return rows.unionByName(none)


def read_stems(spark: SparkSession, folder: str, suffix: str = ".gt.txt") -> DataFrame:
    """(stem, text) of the files that end in `suffix`; a plain `.txt` scan leaves `.gt.txt` files out."""
    found = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    rows = found.select(F.col("_metadata.file_path").alias("path"), stem(suffix.replace(".", r"\.")).alias("stem"), F.col("value").alias("text"))
    rows = (rows.where(~F.col("path").endswith(".gt.txt")) if suffix == ".txt" else rows).drop("path")
    none = [(x, "") for x in _empty(spark, folder, suffix) if suffix != ".txt" or not x.endswith(".gt")]
    return rows.unionByName(spark.createDataFrame(none, "stem string, text string"))


def read_document(spark: SparkSession, ref: str, hyp: str, name: str = "document") -> DataFrame:
    """(name, ref, hyp): one pair of whole files."""
    one = lambda p, c: spark.read.text(p, wholetext=True).select(F.col("value").alias(c))
    return one(ref, "ref").join(F.broadcast(one(hyp, "hyp"))).select(F.lit(name).alias("name"), "ref", "hyp")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 0, line): stripped non-empty lines with their numbers in the file."""
    cut = spark.read.text(path, wholetext=True).select(F.posexplode(lines(F.col("value"))).alias("line_no", "line"))
    return cut.select(F.col("line_no").cast("long"), strip(F.col("line")).alias("line")).where("line <> ''")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of a JSON array; missing keys and nulls are empty."""
    rows = spark.read.schema("title string, text string").option("multiLine", True).json(path)
    return rows.select(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """One row a `<experiment>/<name>/result.json`, with the schema fixed so that no pass infers it."""
    return spark.read.schema(RESULT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "result.json").json(folder)


def write_lines(rows: DataFrame, path: str, order: str = "rank", column: str = "line") -> None:
    """One line a row, in the table's order; files sort by name into that order."""
    rows.orderBy(order).select(F.col(column).alias("value")).write.text(path)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, through Spark's file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def write_corpus(rows: DataFrame, path: str, order: str = "rank", column: str = "line", top: int = 20) -> None:
    """The lines, and beside them `<path>.stats.json`: their statistics and the most frequent graphemes (one row and `top`)."""
    write_lines(rows, path, order, column)
    of = rows.select(F.col(column).alias("line"))
    most = frequency(of, graphemes(F.col("line"))).orderBy(F.desc("n"), "unit").limit(top).collect()
    stats = statistics(of).first().asDict() | {"top_graphemes": [[r.unit, r.n] for r in most]}
    _put(rows.sparkSession, f"{path.rstrip('/')}.stats.json", json.dumps(stats, ensure_ascii=False, indent=2))


def write_evaluation(scored: DataFrame, aggregate: DataFrame, path: str) -> None:
    """`aggregate.json`, one object, and `per_line`, one object a pair without its alignment: pairs never pass the driver."""
    write_report(scored.drop("alignment"), f"{path.rstrip('/')}/per_line")
    _put(scored.sparkSession, f"{path.rstrip('/')}/aggregate.json", json.dumps(aggregate.first().asDict(), ensure_ascii=False, indent=2))


def write_report(rows: DataFrame, path: str) -> None:
    """One JSON object a row."""
    rows.write.json(path)


def write_results(results: DataFrame, folder: str) -> None:
    """One `<experiment>/<name>/result.json` a row, with the version of the code that made it (results of a sweep, some dozen
    at most)."""
    stamped = results.withColumn("code_version", F.lit(__version__))
    for row in stamped.select("experiment", "name", F.to_json(F.struct(*stamped.columns)).alias("json")).toLocalIterator():
        _put(results.sparkSession, f"{folder}/{row.experiment}/{row.name}/result.json", row.json)


def append_journal(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    """CSV part files that each carry the header."""
    rows.write.mode("append").option("header", True).csv(path)
