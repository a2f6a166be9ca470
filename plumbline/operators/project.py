"""Several tables checked by one configuration: contracts and uses by table, a baseline, one diagnostics frame, its text or JSON, a status.

The configuration is a mapping (JSON, see sources.files.load_config for what it includes):

    tables:   name: {path, key: [..], open, arity: [least, most], members: {column: payload or {class, payload, nullable, private}},
              reads: [..], divisors: [..], returns: {name: [expression, payload]}, owner}
    disable:  rules or families      severity: {rule or family: level}      profile, comment
    baseline: a JSON file of diagnostics that are known already
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import load_baseline, load_config, write_diagnostics
from .check import Config, Contract, Member, Use, check, failed
from .rules import FIELDS, PROFILES

_KEYS = frozenset({"tables", "disable", "severity", "profile", "comment", "baseline"})
_TABLE = frozenset({"path", "key", "open", "arity", "members", "reads", "divisors", "returns", "owner"})
_MEMBER = {"class": "cls", "payload": "payload", "nullable": "nullable", "private": "private"}


def _known(given: Mapping, allowed, where: str) -> None:
    if odd := sorted(set(given) - set(allowed)):
        raise ValueError(f"{where}: unknown {', '.join(odd)}")


def _member(name: str, given) -> Member:
    if given is None or isinstance(given, str):
        return Member(payload=given)
    _known(given, _MEMBER, name)
    return Member(**{_MEMBER[k]: v for k, v in given.items()})


def contract_of(name: str, given: Mapping) -> tuple[Contract, Use]:
    _known(given, _TABLE, name)
    members = {k: _member(f"{name}.{k}", v) for k, v in given.get("members", {}).items()}
    use = Use(tuple(given.get("reads", ())), tuple(given.get("divisors", ())), {k: tuple(v) for k, v in given.get("returns", {}).items()}, bool(given.get("owner", False)))
    return Contract(members, tuple(given["arity"]) if given.get("arity") else None, bool(given.get("open", False))), use


def read_config(spark: SparkSession, path: str) -> dict:
    """A configuration and what it includes, each read by Spark."""

    def read(name: str) -> dict:
        return json.loads(spark.read.text(name, wholetext=True).first()[0])

    return load_config(path, read)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def check_all(spark: SparkSession, config: Mapping, root: str = "") -> DataFrame:
    """Diagnostics of all tables (path: the table's name), each table scanned once; one that isn't there is one diagnostic.

    Paths are below root. Diagnostics in the baseline (by path, line, column and rule; what it leaves out counts as null) are left out.
    An unknown key, level of severity or profile raises ValueError.
    """
    _known(config, _KEYS, "configuration")
    if config.get("profile", "balanced") not in PROFILES:
        raise ValueError(f"{config['profile']} is none of {', '.join(PROFILES)}")
    if odd := sorted(set(config.get("severity", {}).values()) - {"error", "warning", "info", "off"}):
        raise ValueError(f"severity: unknown {', '.join(odd)}")
    settings = Config(tuple(config.get("disable", ())), dict(config.get("severity", {})), config.get("profile", "balanced"), config.get("comment"))
    found, gone = [], []
    for name, given in config.get("tables", {}).items():
        contract, use = contract_of(name, given)
        path = (f"{root.rstrip('/')}/" if root else "") + given.get("path", f"{name}.parquet")
        if not _exists(spark, path):
            gone.append((name, None, None, "error", "path.missing", "builtin", "no such file or folder"))
            continue
        df = spark.read.parquet(path)
        own = settings if settings.comment is None or settings.comment in df.columns else Config(settings.disable, settings.overrides, settings.profile)
        found.append(check(df, contract, own, use, path=name, key=given.get("key")))
    out = reduce(DataFrame.unionByName, found, spark.createDataFrame(gone, "path string, line string, column string, severity string, rule string, source_family string, message string").select(*FIELDS))
    if not config.get("baseline"):
        return out
    text = spark.read.text((f"{root.rstrip('/')}/" if root else "") + config["baseline"], wholetext=True).first()[0]
    rows = [tuple(None if x.get(k) is None else str(x[k]) for k in ("path", "line", "column", "rule")) for x in load_baseline(text)]
    old = spark.createDataFrame(rows, "b_path string, b_line string, b_column string, b_rule string").distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in ("path", "line", "column", "rule")])
    return out.join(old, same, "left_anti")


def text_lines(diagnostics: DataFrame) -> DataFrame:
    """value: ``path:line: severity: rule: message``, without a line where there is none."""
    at = F.concat_ws(":", "path", "line")
    return diagnostics.select(F.concat(at, F.lit(": "), F.col("severity"), F.lit(": "), F.coalesce("rule", F.lit("-")), F.lit(": "), F.col("message")).alias("value"))


def run(spark: SparkSession, config: Mapping, out: str, *, root: str = "", as_json: bool = True) -> int:
    """Writes the diagnostics to out (a folder; JSON lines or text) and gives the status: 1 if one is an error, else 0. Checks once."""
    found = check_all(spark, config, root)
    stored = f"{out.rstrip('/')}/diagnostics"
    write_diagnostics(found, stored, True)
    again = spark.read.schema(found.schema).json(stored)
    if not as_json:
        text_lines(again).write.mode("overwrite").text(f"{out.rstrip('/')}/text")
    return int(failed(again))
