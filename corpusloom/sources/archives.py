"""Scans and sinks of corpus files: NDJSON archives, block collections, translation maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.blocks import first_per_key

# Sub-collections of papers, by external id.
PAPER_SUBSETS = ("arxiv", "acl", "pubmed", "pubmedcentral", "dblp", "mag")
# Templates that mark a page as a disambiguation, or as none; marks in titles.
DISAMBIGUATION_TEMPLATES = ("disambig", "disambiguation", "dab", "disamb", "hndis", "geodis", "begriffsklärung", "homonymie", "desambiguación")
ARTICLE_TEMPLATES = ("about", "for", "for multi", "other people", "other uses of", "distinguish")
TITLE_MARKS = ("disambiguation", "begriffsklärung", "homonymie", "desambiguación")


def read_tar_ndjson(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of the NDJSON members of .tar.gz archives: path, line, and ``record`` parsed with ``schema`` if given; rejected are path and line.

    Spark's text reader unpacks the stream, so an archive of any size is read line by line with constant memory, one task
    each. The archive's own headers lie between NUL bytes, which JSON text cannot hold: what stands between them is
    taken apart, and only what could be a line of a member is looked at. A damaged archive ends there without failing the job; lines that
    are no JSON object are rejected.
    """
    raw = spark.read.option("ignoreCorruptFiles", "true").text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    held = F.contains("value", F.lit("\x00"))
    pieces = F.split("value", "\x00+")
    # the last piece is a member's first line; an object in front of it is the end of the member before, the rest are header fields
    parts = F.when(held, F.filter(pieces, lambda x, i: x.startswith("{") | (i == F.size(pieces) - 1))).otherwise(F.array("value"))
    lines = raw.select("path", F.explode(parts).alias("line")).where((F.trim("line") != "") & ~F.regexp_like("line", F.lit(r"^\d+ [\w.]+=")))  # extended headers are such pairs
    judged = lines.withColumn("__good", F.coalesce(F.regexp_like("line", F.lit(r"^\s*\{")) & F.try_parse_json("line").isNotNull(), F.lit(False)))
    rows, rejected = judged.where("__good").drop("__good"), judged.where("NOT __good").drop("__good")
    return (rows.withColumn("record", F.from_json("line", schema)) if schema else rows), rejected


def read_papers(spark: SparkSession, pattern: str, schema: str, subset: str | None = None, limit: int = -1, external_ids: str = "externalids") -> DataFrame:
    """Paper records of all files that ``pattern`` names, those of one sub-collection if ``subset`` is given, at most ``limit`` of each file; adds path."""
    rows = spark.read.schema(schema).json(pattern).withColumn("path", F.col("_metadata.file_path"))
    if subset:
        rows = rows.where(in_subset(external_ids, [subset]))
    return limit_per_file(rows, limit, "corpusid")


def read_blocks(spark: SparkSession, path: str, schema: str, seen: DataFrame | None = None, id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt) of a JSON Lines (plain or gzip) or Parquet collection; rows whose id is in ``seen`` are left out."""
    if path.rstrip("/").endswith(".parquet"):
        rows, corrupt = spark.read.parquet(path), spark.createDataFrame([], "_corrupt_record string")
    else:
        raw = spark.read.text(path)
        parsed = raw.select("value", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
        bad = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()
        rows = parsed.where(~bad).select("r.*").drop("_corrupt_record")
        corrupt = parsed.where(bad).where("value <> ''").select(F.col("value").alias("_corrupt_record"))
    if seen is not None:
        rows = rows.join(seen.select(id_column), id_column, "left_anti")
    return rows, corrupt


def jsonl_to_parquet(spark: SparkSession, folder: str, target: str, schema: str | None = None, pattern: str = "*.jsonl*") -> int:
    """All JSON Lines files below a folder as one Parquet table; lines that are no JSON go to ``target`` + '.rejected' as text, their number is returned."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    shape = schema or files.option("mode", "DROPMALFORMED").json(folder).schema.simpleString()[len("struct<") : -1]
    lines = files.text(folder).where(F.trim("value") != "")
    good = F.regexp_like("value", F.lit(r"^\s*\{")) & F.try_parse_json("value").isNotNull()
    lines.where(good).select(F.from_json("value", shape).alias("r")).select("r.*").write.parquet(target)
    bad = lines.where(~F.coalesce(good, F.lit(False)))
    rejected = bad.count()
    if rejected:
        bad.write.text(f"{target}.rejected")
    return rejected


def limit_per_file(rows: DataFrame, n: int, order: str) -> DataFrame:
    """At most ``n`` rows of each input file; -1 is no limit. Needs a ``path`` column."""
    if n < 0:
        return rows
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("path").orderBy(order))).where(F.col("__n") <= n).drop("__n")


class TranslationMap:
    """(language, translation_key, translation_value) as Parquet by language; the newest row of a key holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self, language: str) -> DataFrame:
        """(key, value) of one language; only its folder is read. Empty where nothing was stored yet."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], "key string, value string")
        rows = self.spark.read.parquet(self.path).where(F.col("language") == language)
        newest = rows.groupBy("translation_key").agg(F.max_by("translation_value", "added").alias("value"))
        return newest.select(F.col("translation_key").alias("key"), "value")

    def append(self, rows: DataFrame) -> None:
        """Add rows (language, translation_key, translation_value), for each key of this batch the smallest value."""
        one = first_per_key(rows.select("language", "translation_key", "translation_value"), ["language", "translation_key"], ["translation_value"]).withColumn("added", F.current_timestamp())
        one.write.mode("append").partitionBy("language").parquet(self.path, compression="snappy")


def in_subset(external_ids: Column | str, subset: list[str] | tuple[str, ...] = PAPER_SUBSETS) -> Column:
    """Any of the ids in a map<string,string> is present and not empty."""
    ids = F.col(external_ids) if isinstance(external_ids, str) else external_ids
    return F.coalesce(F.exists(F.array(*[F.lit(s) for s in subset]), lambda s: F.coalesce(F.try_element_at(ids, s), F.lit("")) != ""), F.lit(False))


def template_names(table: DataFrame | None = None, given: tuple[str, ...] = DISAMBIGUATION_TEMPLATES) -> tuple[str, ...]:
    """The fixed names and those of ``table`` (language, template), in lower case: the union over its languages."""
    more = [] if table is None else [r["template"].lower() for r in table.select("template").distinct().collect()]  # a list kept by hand
    return tuple(dict.fromkeys([*given, *sorted(more)]))


def is_disambiguation(templates: Column | str, title: Column | str, wikitext: Column | str, listed_templates: tuple[str, ...] = DISAMBIGUATION_TEMPLATES, title_marks: tuple[str, ...] = TITLE_MARKS) -> Column:
    """By template, then by title, then not by an article's template, then by 'may refer to' near the start; cases are ignored."""
    t, name, body = (F.col(x) if isinstance(x, str) else x for x in (templates, title, wikitext))
    names = F.transform(F.coalesce(t, F.array().cast("array<string>")), lambda x: F.lower(F.element_at(F.split(x, ":"), -1)))
    listed = lambda values: F.arrays_overlap(names, F.array(*[F.lit(v) for v in values]))
    return (
        F.when(listed(listed_templates), True)
        .when(F.coalesce(name.rlike(rf"(?i). \(({'|'.join(title_marks)})\)$"), F.lit(False)), True)
        .when(listed(ARTICLE_TEMPLATES), False)
        .otherwise(F.coalesce(F.left(body, F.lit(100)).rlike(r"(?i). may (also )?refer to\b"), F.lit(False)))
    )


def dump_sizes(lines: DataFrame, column: str = "value") -> DataFrame:
    """(files, bytes, gigabytes) summed over the size figures of an index page's lines."""
    size = F.regexp_extract(column, r"\s(\d+)\s*$", 1)
    return lines.where(size != "").agg(F.count("*").alias("files"), F.sum(size.cast("long")).alias("bytes")).withColumn("gigabytes", F.col("bytes") / 1e9)


def latest_complete(releases: DataFrame, least_files: int = 270) -> DataFrame:
    """The newest ``release`` that has ``least_files`` files or more."""
    return releases.where(F.col("files") >= least_files).agg(F.max("release").alias("release"))
