"""The calls a user starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import contracts, rules
from .operators.check import Config, Contract, Member, Use, check, failed, summary  # noqa: F401 - part of the API
from .operators.narrow import Test, keep
from .operators.profile import profile
from .operators.project import check_all, read_config, run  # noqa: F401 - part of the API
from .operators.refine import compile_payload
from .operators.scan import by_class, exit_status, type_scan  # noqa: F401 - part of the API

REFINEMENT = "refinement"  # key of a field's metadata that holds its payload


class DomainError(AssertionError):
    pass


def type_of(df: DataFrame, expression: str | Column) -> DataFrame:
    """The profile of one expression over df."""
    c = F.expr(expression) if isinstance(expression, str) else expression
    return profile(df.select(c.alias("value")), "expression")


def assert_domain(df: DataFrame, column: str, payload: str) -> DataFrame:
    """df itself; DomainError if a value that isn't null lies outside the refinement."""
    f = compile_payload(payload)
    if f is None:
        raise ValueError(f"{payload} is no known refinement")
    c = F.col(f"`{column}`")
    if bad := df.where(c.isNotNull() & ~F.coalesce(f(c), F.lit(False))).limit(1).collect():
        raise DomainError(f"{column}: {bad[0][column]!r} is no {payload}")
    return df


def declared(df: DataFrame, **payloads: str) -> DataFrame:
    """df with contracts in its fields' metadata."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={**df.schema[c].metadata, REFINEMENT: payloads[c]}) if c in payloads else F.col(f"`{c}`") for c in df.columns])


def contract_filter(df: DataFrame) -> Column:
    """Whether a row satisfies all contracts declared in df's metadata; a null satisfies none but those that admit nil."""
    out: Column = F.lit(True)
    for field in df.schema.fields:
        if payload := field.metadata.get(REFINEMENT):
            out = out & F.coalesce(compile_payload(payload)(F.col(f"`{field.name}`")), F.lit(False))
    return out


def narrowed(df: DataFrame, column: str, test: Test) -> tuple[DataFrame, DataFrame]:
    """The rows on the truthy and on the falsey edge of a test."""
    p = keep(F.col(f"`{column}`"), test)
    return df.where(p), df.where(~p)


def diff(baseline: DataFrame, current: DataFrame, key: list[str] | None = None) -> DataFrame:
    return rules.diff(current, baseline, key or [c for c in rules.FIELDS if c in current.columns and c != "severity"])


def infer_contract(df: DataFrame, name: str, existing: DataFrame | None = None) -> DataFrame:
    """The profile of df as a contract; with an existing contract (col, cls, lo, hi), how each column compares with it."""
    found = profile(df, name)
    return found if existing is None else contracts.classify(found.select("col", "cls", "lo", "hi"), existing, "col")


#: What the rules say, in short.
EXPLANATIONS = {
    "call.undefined-method": "a member that no provider declares", "call.wrong-arity": "more or fewer fields than the contract takes", "call.argument-type-mismatch": "a value outside its declared refinement", "call.possible-nil-receiver": "a null in a column that is used as never null",
    "dump.type": "reports the domain found", "assert.type-mismatch": "the domain found is not the one asserted", "flow.always-raises": "an integer division by a divisor that is zero", "flow.unreachable-branch": "an arm that no row can reach", "flow.always-truthy-condition": "a condition that holds for every row",
    "flow.dead-assignment": "a value written and never read", "def.return-type-mismatch": "an output outside its declared domain", "def.method-visibility-mismatch": "a private member used outside its owner", "def.ivar-write-mismatch": "a later write of another class than the first",
}


def explain(name: str | None = None) -> list[tuple[str, str, str]]:
    """(rule, severity in the balanced profile, explanation) of a rule, of a family, or of all."""
    return [(r, rules.SEVERITIES[r][1], text) for r, text in EXPLANATIONS.items() if name in (None, r, r.split(".")[0])]
