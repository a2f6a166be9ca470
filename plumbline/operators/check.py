"""A table checked against a contract: one diagnostics frame from one scan, then suppression and severity by configuration.

Findings about the table as a whole (members that aren't there, other classes) come from its schema alone. Findings about rows are an
array of what each row breaks, exploded: no shuffle, whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import class_of
from .refine import compile_payload
from .rules import FIELDS, comment_tokens, resolve_severity, suppressed

_FOUND = "path string, line string, column string, severity string, rule string, source_family string, message string"


@dataclass(frozen=True)
class Member:
    """A column: its class (None: any), the payload of its refinement, whether it may be null, whether only its owner may use it."""

    cls: str | None = None
    payload: str | None = None
    nullable: bool = True
    private: bool = False


@dataclass(frozen=True)
class Contract:
    """members by name; arity: how many of them a row has to fill (least, most; None: no limit); open: other columns may be there."""

    members: Mapping[str, Member]
    arity: tuple[int, int | None] | None = None
    open: bool = False


@dataclass(frozen=True)
class Use:
    """What a consumer does with a table: names it reads, integer divisors, outputs (name: expression and payload) and whether it is the owner."""

    reads: tuple[str, ...] = ()
    divisors: tuple[str, ...] = ()
    returns: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    owner: bool = False


@dataclass(frozen=True)
class Config:
    """disable: rules, families or "all"; overrides: level by rule or family; comment: the column with comments that silence a row."""

    disable: tuple[str, ...] = ()
    overrides: Mapping[str, str] = field(default_factory=dict)
    profile: str = "balanced"
    comment: str | None = None


def _name(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _outside(c: Column, payload: str) -> Column:
    """A value, not null, for which the refinement isn't proven."""
    return c.isNotNull() & ~F.coalesce(compile_payload(payload)(c), F.lit(False))


def _schema_findings(classes: dict[str, str], contract: Contract, use: Use) -> list[tuple[str, str, str]]:
    """(column, rule, message) of what the schema says."""
    out = []
    for name in dict.fromkeys((*contract.members, *use.reads, *use.divisors)):
        if name not in classes:
            out.append((name, "call.undefined-method", f"undefined member {name}"))
    if not contract.open:
        out += [(name, "call.undefined-method", f"{name} is in no contract") for name in classes if name not in contract.members]
    for name, m in contract.members.items():
        if m.cls and name in classes and classes[name] != m.cls:
            out.append((name, "call.argument-type-mismatch", f"{name}: {classes[name]} is no {m.cls}"))
        if m.private and not use.owner and name in use.reads:
            out.append((name, "def.method-visibility-mismatch", f"{name} is private"))
    payloads = [*((k, m.payload) for k, m in contract.members.items() if m.payload), *((k, p) for k, (_, p) in use.returns.items())]
    return out + [(name, "contract.unresolved-payload", f"{p} is no known refinement") for name, p in payloads if compile_payload(p) is None]


def _row_tests(classes: dict[str, str], contract: Contract, use: Use) -> list[tuple[str | None, str, str, Column]]:
    """(column, rule, message, whether a row breaks it)."""
    out: list[tuple[str | None, str, str, Column]] = []
    there = {k: m for k, m in contract.members.items() if k in classes}
    for name, m in there.items():
        c = _name(name)
        if not m.nullable:
            out.append((name, "call.possible-nil-receiver", f"{name} is nil", c.isNull()))
        if m.payload and m.cls in (None, classes[name]) and compile_payload(m.payload):
            out.append((name, "call.argument-type-mismatch", f"{name} is no {m.payload}", _outside(c, m.payload)))
    if contract.arity and there:
        least, most = contract.arity
        given = sum((_name(k).isNotNull().cast("int") for k in there), F.lit(0))
        wrong = (given < least) if most is None else (given < least) | (given > most)
        out.append((None, "call.wrong-arity", f"expected {least}..{'' if most is None else most} fields", wrong))
    for name in use.divisors:
        if classes.get(name) == "Integer":  # a division by a float zero raises nothing
            out.append((name, "flow.always-raises", f"division by {name}, which is zero", F.coalesce(_name(name) == 0, F.lit(False))))
    for name, (expression, payload) in use.returns.items():
        if compile_payload(payload):
            out.append((name, "def.return-type-mismatch", f"{name} is no {payload}", _outside(F.expr(expression), payload)))
    return out


def check(df: DataFrame, contract: Contract, config: Config = Config(), use: Use = Use(), *, path: str = "table", key: list[str] | None = None) -> DataFrame:
    """Diagnostics (path, line, column, severity, rule, source_family, message) of df.

    line: the row's key columns joined by "/" (a null among them: ``nil``), null for findings about the table and where no key is
    given. A row that breaks several rules has a diagnostic for each; repeated rows have theirs each. Nulls break no refinement, only
    ``nullable``; members that df lacks are one diagnostic each and are not tested further. Names that the user's columns clash with
    don't matter: only the findings leave the scan.
    """
    classes = {f.name: class_of(f.dataType.simpleString()) for f in df.schema.fields}
    spark = df.sparkSession
    silent = F.array(*[F.lit(x) for x in config.disable]).cast("array<string>")
    out = spark.createDataFrame([(path, None, c, "warning", r, "builtin", m) for c, r, m in _schema_findings(classes, contract, use)], _FOUND).where(~suppressed(F.col("rule"), silent))
    if tests := _row_tests(classes, contract, use):
        found = F.array(*[F.when(bad, F.struct(F.lit(c).cast("string").alias("column"), F.lit(r).alias("rule"), F.lit(m).alias("message"))) for c, r, m, bad in tests])
        line = F.concat_ws("/", *[F.coalesce(_name(k).cast("string"), F.lit("nil")) for k in key]) if key else F.lit(None).cast("string")
        tokens = F.concat(silent, F.coalesce(comment_tokens(_name(config.comment)), F.array().cast("array<string>"))) if config.comment else silent
        left = F.filter(found, lambda x: x.isNotNull())
        rows = df.select(line.alias("line"), tokens.alias("tokens"), F.explode(left).alias("x"))
        rows = rows.where(~suppressed(F.col("x.rule"), F.col("tokens")))
        out = out.unionByName(rows.select(F.lit(path).alias("path"), "line", "x.column", F.lit("warning").alias("severity"), "x.rule", F.lit("builtin").alias("source_family"), "x.message"))
    overrides = spark.createDataFrame(list(config.overrides.items()), "name string, level string")
    return resolve_severity(out, overrides, config.profile).select(*FIELDS)


def summary(diagnostics: DataFrame) -> DataFrame:
    """rule, severity, n."""
    return diagnostics.groupBy("rule", "severity").agg(F.count("*").alias("n"))


def failed(diagnostics: DataFrame) -> bool:
    """Whether there is an error; runs a job."""
    return not diagnostics.where("severity = 'error'").isEmpty()
