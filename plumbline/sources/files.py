"""Sources and sinks: globs with excludes, permissive parsing, baselines, configurations, diagnostics files."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Excluded everywhere: dependencies, build output and version control are no sources.
ALWAYS_EXCLUDED = ("**/.git/**", "**/node_modules/**", "**/vendor/bundle/**", "**/tmp/**")


#: Host of an https address; one with a user or password has none, as what follows ``@`` is the host in truth.
AUTHORITY = r"^https://([^/:?#@\\]+)(?::[0-9]*)?(?:[/?#]|$)"


def resolved(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` parts; ``..`` at the root stays there."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    fold = F.aggregate(parts, none, lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(fold, "/"))


def glob_pattern(glob: str) -> str:
    """A regular expression that holds for whole paths: ``**`` crosses folders, ``*`` and ``?`` don't, ``{a,b}`` is either."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return rf"\A{out}\z"


def excluded(path: Column, globs: Iterable[str]) -> Column:
    out: Column = F.lit(False)
    for g in (*ALWAYS_EXCLUDED, *globs):
        out = out | path.rlike(glob_pattern(g))
    return out


def list_files(spark: SparkSession, folder: str, name_filter: str = "*") -> DataFrame:
    """path, length of files below folder, listed (not read) by Spark's own reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name_filter).load(folder)
    return files.select("path", "length")


def list_tables(spark: SparkSession, folder: str, suffix: str = ".parquet") -> DataFrame:
    """name, files, length of tables below folder: what lies in it under a name that ends in suffix, be it a file or a folder of part files.

    Spark's reader passes over empty files and names that begin with ``_`` or a dot, so they don't count.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/") + "/"
    name = F.substring_index(F.substr("path", F.lit(len(base) + 1)), "/", 1)
    found = list_files(spark, folder).select(name.alias("name"), "length").where(F.col("name").endswith(suffix))
    return found.groupBy("name").agg(F.count("*").alias("files"), F.sum("length").alias("length"))


def parse_records(lines: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and a diagnostic for each that isn't well formed: one bad record never stops the others."""
    parsed = lines.withColumn("__r", F.from_json(column, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}))
    bad = F.col("__r").isNull() | F.col("__r._corrupt_record").isNotNull()
    good = parsed.where(~bad).withColumn("__r", F.col("__r").dropFields("_corrupt_record"))
    errors = parsed.where(bad).select(F.col(column).alias("source"), F.lit("parse-error").alias("rule"))
    return good.select(*lines.columns, "__r.*"), errors


def analyse_files(files: DataFrame, analyse: Callable[[str, bytes], Iterable[tuple[int, str]]]) -> DataFrame:
    """path, line, message of each file; a file whose analysis fails gives one row that says so."""
    def run(parts):
        import pandas as pd

        for pdf in parts:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, line, message) for line, message in analyse(path, bytes(content))]
                except Exception as e:  # noqa: BLE001 - one file's failure is a row, not the job's end
                    rows.append((path, 0, f"internal-error: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["path", "line", "message"])

    return files.select("path", "content").mapInPandas(run, "path string, line long, message string")


def load_baseline(payload: str) -> list[dict]:
    """Diagnostics of a JSON file: an array, or an object with "diagnostics"."""
    data = json.loads(payload)
    return data if isinstance(data, list) else list(data.get("diagnostics", []))


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """file, path, line, rule of the diagnostics in JSON files, each an array or an object with "diagnostics".

    A file that is no JSON is one row with its name as path and the rule "baseline.parse-error"; an object without diagnostics, an
    empty file's array or an empty one give none. Files are read whole, one a row: a baseline is split into files by who writes it.
    """
    item = "array<struct<path:string,line:long,rule:string>>"
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    inner = F.when(F.ltrim("value").startswith("["), F.from_json("value", item)).otherwise(F.from_json("value", f"diagnostics {item}")["diagnostics"])
    broken = F.try_parse_json(F.col("value")).isNull()
    one = F.array(F.struct(F.col("file").alias("path"), F.lit(None).cast("long").alias("line"), F.lit("baseline.parse-error").alias("rule")))
    return text.select("file", F.inline(F.when(broken, one).otherwise(F.coalesce(inner, F.array().cast(item)))))


def deep_merge(base: dict, over: dict) -> dict:
    """Mappings are merged key by key, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(name: str, read: Callable[[str], dict], _open: tuple[str, ...] = ()) -> dict:
    """A configuration with what it includes, which its own keys override; includes are relative to the file and may not form a cycle."""
    if name in _open:
        raise ValueError("includes form a cycle: " + " > ".join((*_open, name)))
    own = dict(read(name))
    includes = own.pop("includes", [])
    out: dict = {}
    for x in [includes] if isinstance(includes, str) else includes:
        out = deep_merge(out, load_config(posixpath.normpath(posixpath.join(posixpath.dirname(name), x)), read, (*_open, name)))
    return deep_merge(out, own)


class Policy:
    """What an extension may read: files below its roots, and addresses of its hosts over https."""

    def __init__(self, roots: Iterable[str] = (), hosts: Iterable[str] = (), most_bytes: int = 10 * 1024 * 1024):
        self.roots, self.hosts, self.most_bytes = tuple(map(posixpath.normpath, roots)), frozenset(hosts), most_bytes

    def may_read(self, path: str) -> bool:
        path = posixpath.normpath(path)
        return any(path == r or path.startswith(r.rstrip("/") + "/") for r in self.roots)

    def read(self, spark: SparkSession, path: str) -> bytes:
        """A file's bytes, if it may be read and is not over most_bytes (checked before any byte is)."""
        if not self.may_read(path):
            raise PermissionError(f"{path} is outside the roots")
        files = spark.read.format("binaryFile").load(path)
        if files.select("length").first()["length"] > self.most_bytes:
            raise PermissionError(f"{path} has more than {self.most_bytes} bytes")
        return bytes(files.select("content").first()["content"])

    def may_open(self, url: str) -> bool:
        m = re.match(AUTHORITY, url)
        return bool(m) and m[1].lower() in self.hosts

    def reads(self, path: Column) -> Column:
        """may_read of a column of paths; no for nulls."""
        at, out = resolved(path), F.lit(False)
        for r in self.roots:
            out = out | (at == r) | at.startswith(r.rstrip("/") + "/")
        return F.coalesce(out, F.lit(False))

    def opens(self, url: Column, subdomains: bool = False) -> Column:
        """may_open of a column of addresses; no for nulls. subdomains: hosts below a host that is named are allowed too."""
        host, out = F.lower(F.regexp_extract(url, AUTHORITY, 1)), F.lit(False)
        for h in sorted(self.hosts):
            out = out | (host == h)
            if subdomains:
                out = out | host.endswith("." + h)
        return F.coalesce(out, F.lit(False))


def locked_versions(lockfile: str) -> dict[str, str]:
    """Names and versions of a lockfile's ``specs`` sections: lines of four spaces, a name and a version in brackets."""
    return dict(re.findall(r"^ {4}([\w.-]+) \(([^)\s]+)\)$", lockfile, re.M))


def locked(text: Column) -> Column:
    """Array of name and version in a lockfile's text: entries of four spaces below ``specs:``, or a list of ``- name:`` and ``version:`` lines.

    In order, repeats included; entries' own requirements (six spaces) are none. Empty for other text, null for null.
    """
    entry, item = r"(?m)^ {4}([\w.-]+) \(([^)\s]+)\)$", r"(?m)^\s*- name: (\S+)\n\s+version: \"?([^\"\s]+)\"?$"

    def found(pattern: str) -> Column:
        part = lambda x, n: F.regexp_extract(x, pattern, n)
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(part(x, 1).alias("name"), part(x, 2).alias("version")))

    return F.concat(found(entry), found(item))


def write_diagnostics(df: DataFrame, path: str, as_json: bool = True) -> None:
    """One row a line, as JSON or as ``path:line: severity: message``; written whole or not at all by Spark's committer."""
    if as_json:
        df.write.mode("overwrite").json(path)
    else:
        df.select(F.format_string("%s:%d: %s: %s", "path", "line", "severity", "message").alias("value")).write.mode("overwrite").text(path)


def write_contracts(existing: DataFrame, generated: DataFrame, key: str, path: str, root: str) -> DataFrame:
    """Merges generated into existing and writes the result below root; a target outside root is refused."""
    from ..operators.contracts import merge

    if not Policy([root]).may_read(path):
        raise ValueError(f"{path} is outside {root}")
    out = merge(existing, generated, key)
    out.write.mode("overwrite").parquet(path)
    return out.sparkSession.read.parquet(path)
