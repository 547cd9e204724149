"""Document versions as text files: front matter, paths, and how they are read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_front_matter(raw: Column) -> Column:
    """``struct(meta map<string,string>, body)`` of a text that may open with ``key: value`` lines between ``---`` lines.

    Comments behind two spaces and quotes around a value go; a bare null is null. Of repeated keys the last counts.
    """
    text = F.replace(raw, F.lit("\r\n"), F.lit("\n"))
    parts = F.split(text, "---\n", 3)
    has = text.startswith("---\n") & (F.size(parts) == 3)
    pairs = F.filter(F.split(parts[1], "\n"), lambda s: F.contains(s, F.lit(": ")))

    def entry(line: Column) -> Column:
        cut = F.split(line, ": ", 2)
        value = F.trim(F.split(cut[1], "  #", 2)[0])
        quoted = (F.length(value) >= 2) & value.startswith('"') & value.endswith('"')
        plain = F.replace(F.replace(F.substring(value, F.lit(2), F.length(value) - 2), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
        return F.struct(F.trim(cut[0]).alias("key"), F.when(quoted, plain).when(value != "null", value).alias("value"))

    entries = F.transform(pairs, entry)
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    meta = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"]))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.struct(F.when(has, meta).otherwise(none).alias("meta"), F.when(has, F.regexp_replace(parts[2], r"^\n+", "")).otherwise(text).alias("body"))


def service(path: Column) -> Column:
    """The folders of a path: ``a/b/c.md`` gives ``a/b``."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def company(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def platform(path: Column) -> Column:
    """What a file's name has in parentheses at its end; null if nothing."""
    found = F.regexp_extract(path, r"\(([^()]*)\)(?:\.[A-Za-z]+)?$", 1)
    return F.when(found != "", found)


def is_document(path: Column) -> Column:
    """Markdown files in a folder, but for docs, hidden paths and read-me files."""
    return path.endswith(".md") & F.contains(path, F.lit("/")) & ~path.startswith("docs/") & ~path.rlike(r"(^|/)\.") & ~path.rlike(r"(?i)(^|/)readme\.md$")


def select_documents(documents: DataFrame, prefixes: list[str], path: str = "path") -> DataFrame:
    """Documents whose path starts with one of ``prefixes``; all of them where none is given."""
    on = F.lit(not prefixes)
    for prefix in prefixes:
        on = on | F.col(path).startswith(prefix)
    return documents.where(on)


def companies_of(documents: DataFrame, path: str = "path") -> DataFrame:
    """The companies that documents belong to."""
    return documents.select(company(F.col(path)).alias("company")).distinct()


def write_json(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines, nulls written out."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def read_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Versions from text files ``folder/<version>/<path>``: path, version, meta, body. Each file is one row, read in tasks."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))
    rest = F.element_at(F.split("file", folder.rstrip("/").split("://")[-1] + "/", 2), 2)
    rows = files.select(F.substring_index(rest, "/", 1).alias("version"), F.regexp_replace(rest, "^[^/]*/", "").alias("path"), split_front_matter(F.col("raw")).alias("f"))
    return rows.where(is_document(F.col("path"))).select("path", "version", "f.meta", "f.body")


def read_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Records written as JSON lines; a line ends at a line feed alone."""
    return spark.read.schema(schema).option("lineSep", "\n").json(folder)


def write_records(records: DataFrame, folder: str, by: str) -> None:
    """Records as JSON lines, a folder for each value of ``by``."""
    records.write.mode("overwrite").partitionBy(by).option("lineSep", "\n").json(folder)


def write_sheets(sheets: list[DataFrame], folder: str) -> None:
    """Sheets with the union of their columns as CSV with a header."""
    whole = sheets[0]
    for sheet in sheets[1:]:
        whole = whole.unionByName(sheet, allowMissingColumns=True)
    whole.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(folder)


def read_sheet(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).csv(folder)
