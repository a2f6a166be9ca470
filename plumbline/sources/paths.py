"""Paths as a user gives them: files to work on, and a row for everything that can't be."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import kept
from .files import analyse_files, excluded

_ERROR = "path string, rule string, message string"


def _listed(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)


def expand(spark: SparkSession, paths: Sequence[str], suffix: str, exclude: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(files, errors) of paths: folders are searched at any depth for names that end in suffix; each file comes once.

    files are Spark's binary files (path, modificationTime, length, content), listed now and read when content is asked for. errors: path,
    rule, message of paths that aren't there or are files of another kind. A folder ending in suffix is a folder. exclude: globs,
    relative to the folder that was given; a file named by itself is never excluded.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found, errors = [], []
    seen = F.lit(False)  # whether a file has come by an earlier path: a test of its name, so that no contents are shuffled
    for name in dict.fromkeys(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(conf)
        if not files.exists(path):
            errors.append((name, "path.missing", "no such file or folder"))
            continue
        whole = files.makeQualified(path).toString()
        if files.getFileStatus(path).isDirectory():
            base = whole.rstrip("/") + "/"
            here = F.col("path").startswith(base) & F.col("path").endswith(suffix) & ~excluded(F.substr("path", F.lit(len(base) + 1)), exclude)
            found.append(_listed(spark, name, suffix).where(here & ~seen))
        elif name.endswith(suffix):
            here = F.col("path") == whole
            found.append(spark.read.format("binaryFile").load(name).where(~seen))
        else:
            errors.append((name, "path.other-kind", f"no {suffix} file"))
            continue
        seen = seen | here
    empty = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return reduce(DataFrame.union, found) if found else empty, spark.createDataFrame(errors, _ERROR)


def analyse(spark: SparkSession, paths: Sequence[str], suffix: str, run: Callable[[str, bytes], Iterable[tuple[int, str]]], *, most_bytes: int = 64 << 20, exclude: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(path, line, message) of run over each file, and errors: those of expand(), files over most_bytes (never read) and files that run fails on.

    A file is read whole by one task, so most_bytes bounds what a task holds. Runs the analysis once; what it gives is stored.
    """
    files, errors = expand(spark, paths, suffix, exclude)
    large = files.where(F.col("length") > most_bytes).select("path", F.lit("path.too-large").alias("rule"), F.format_string("%d bytes", "length").alias("message"))
    out = kept(analyse_files(files.where(F.col("length") <= most_bytes), run))
    failed = out.where("line = 0 and message like 'internal-error: %'").select("path", F.lit("path.internal-error").alias("rule"), F.substring_index("message", ": ", -1).alias("message"))
    return out.where("not (line = 0 and message like 'internal-error: %')"), errors.unionByName(large).unionByName(failed)


def _uri_as_path(uri: Column) -> Column:
    """A file's ``_metadata.file_path`` as binary files name it: decoded, one slash where there is no authority."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^([^/:]+):///", "$1:/")


def footers(spark: SparkSession, paths: Sequence[str], suffix: str = ".parquet", *, whole_bytes: int = 4 << 20, exclude: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(path, line, message) with the rows that each file's footer promises as line, and errors: those of expand() and files without a readable footer.

    Files over whole_bytes are counted by Spark's reader, which reads no column and splits them; only smaller ones are read whole. A
    larger file that promises no row counts as one without a footer, as it can't be told from it.
    """
    def rows(path, content):
        import pyarrow.parquet as pq

        yield pq.ParquetFile(io.BytesIO(content)).metadata.num_rows, "rows"

    small, errors = analyse(spark, paths, suffix, rows, most_bytes=whole_bytes, exclude=exclude)
    wrong = {r["path"] for r in expand(spark, paths, suffix)[1].collect()}
    reader = spark.read.schema("__none string").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").option("ignoreCorruptFiles", "true")
    each = [reader.parquet(p).groupBy(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("n")) for p in dict.fromkeys(paths) if p not in wrong]
    if not each:
        return small, errors
    found = reduce(DataFrame.union, each).where(F.col("size") > whole_bytes).groupBy(_uri_as_path(F.col("uri")).alias("path")).agg(F.max("n").alias("n"))
    large = errors.where("rule = 'path.too-large'").select("path").join(found, "path", "left")
    silent = large.where("n is null").select("path", F.lit("path.internal-error").alias("rule"), F.lit("no rows in a footer").alias("message"))
    return small.unionByName(large.where("n is not null").select("path", F.col("n").alias("line"), F.lit("rows").alias("message"))), errors.where("rule <> 'path.too-large'").unionByName(silent)
