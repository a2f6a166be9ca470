"""Diagnostics as rows: rules' shared parts, suppression, severity, difference to a baseline, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import kept

FIELDS = ("path", "line", "column", "severity", "rule", "source_family", "message")

#: The rules and their severity in the three profiles.
SEVERITIES = {
    "call.undefined-method": ("error", "error", "error"), "call.wrong-arity": ("error", "error", "error"), "call.argument-type-mismatch": ("warning", "error", "error"), "call.possible-nil-receiver": ("off", "warning", "error"),
    "dump.type": ("info", "info", "info"), "assert.type-mismatch": ("error", "error", "error"), "flow.always-raises": ("error", "error", "error"), "flow.unreachable-branch": ("info", "warning", "error"),
    "flow.always-truthy-condition": ("info", "warning", "error"), "flow.dead-assignment": ("info", "warning", "warning"), "def.return-type-mismatch": ("warning", "warning", "error"), "def.method-visibility-mismatch": ("error", "error", "error"), "def.ivar-write-mismatch": ("warning", "warning", "error"),
}
PROFILES = ("lenient", "balanced", "strict")
#: Older names of rules, which still silence them.
ALIASES = {
    "undefined-method": "call.undefined-method", "wrong-arity": "call.wrong-arity", "argument-type-mismatch": "call.argument-type-mismatch", "possible-nil-receiver": "call.possible-nil-receiver",
    "dump-type": "dump.type", "assert-type": "assert.type-mismatch", "always-raises": "flow.always-raises", "unreachable-branch": "flow.unreachable-branch",
    "method-visibility-mismatch": "def.method-visibility-mismatch", "ivar-write-mismatch": "def.ivar-write-mismatch", "dead-assignment": "flow.dead-assignment", "always-truthy-condition": "flow.always-truthy-condition",
}


def diff(current: DataFrame, baseline: DataFrame, key: list[str]) -> DataFrame:
    """Rows new in current and rows fixed since baseline, by a key in which nulls are equal; repeated rows are kept."""
    def only(a: DataFrame, b: DataFrame, status: str) -> DataFrame:
        other = b.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
        cond = F.lit(True)
        for k in key:
            cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return a.join(other, cond, "left_anti").select(F.lit(status).alias("status"), "*")

    return only(current, baseline, "new").unionByName(only(baseline, current, "fixed"))


def family(rule: Column) -> Column:
    return F.substring_index(rule, ".", 1)


def suppressed(rule: Column, tokens: Column) -> Column:
    """Whether one of the tokens (array of rule names, their older names, families, ``all``) silences rule; a null rule is never silenced."""
    older = F.create_map(*[F.lit(x) for alias, name in ALIASES.items() for x in (name, alias)])
    hit = F.array_contains(tokens, rule) | F.array_contains(tokens, F.concat(family(rule), F.lit(".*"))) | F.array_contains(tokens, family(rule)) | F.array_contains(tokens, "all")
    hit = hit | F.coalesce(F.array_contains(tokens, F.try_element_at(older, rule)), F.lit(False))
    return F.coalesce(rule.isNotNull() & hit, F.lit(False))


def comment_tokens(text: Column, marker: str = "plumbline:disable") -> Column:
    """Tokens of a comment ``# marker a, b``."""
    return F.filter(F.split(F.regexp_extract(text, marker + r"\s+([\w.*, -]+)", 1), r"[\s,]+"), lambda x: x != "")


def suppress(diagnostics: DataFrame, comments: DataFrame, project: tuple[str, ...] = (), marker: str = "plumbline:disable") -> DataFrame:
    """diagnostics without those that the project's list, a comment of their file or one of their line silences.

    comments: path, line, text. ``# marker-file a, b`` holds for its whole path, ``# marker a, b`` for its line. Only lines with a
    marker are joined, each path's and line's tokens once (a set of rule names); a diagnostic without a path or line is silenced by the
    project's list alone, one without a rule by nothing.
    """
    none = F.array().cast("array<string>")

    def by(mark: str, name: str, *key: str) -> DataFrame:
        marked = comments.where(F.col("text").contains(mark)).select(*key, F.explode(comment_tokens(F.col("text"), mark)).alias("token"))
        return marked.groupBy(*key).agg(F.collect_set("token").alias(name))

    out = diagnostics.join(by(marker + "-file", "__file", "path"), "path", "left").join(by(marker, "__line", "path", "line"), ["path", "line"], "left")
    tokens = F.concat(F.array(*[F.lit(x) for x in project]).cast("array<string>"), F.coalesce("__file", none), F.coalesce("__line", none))
    return out.where(~suppressed(F.col("rule"), tokens)).select(*diagnostics.columns)


def resolve_severity(diagnostics: DataFrame, overrides: DataFrame, profile: str = "balanced") -> DataFrame:
    """Exact override, else the family's, else the profile's, else as authored; rows that come to "off" go. A null rule is untouched.

    overrides: name (rule or family), level, a name once; of any size, so how it is joined is left to the planner.
    """
    spark = diagnostics.sparkSession
    k = PROFILES.index(profile)
    base = F.broadcast(spark.createDataFrame([(r, s[k]) for r, s in SEVERITIES.items()], "rule string, __profile string"))
    exact = overrides.select(F.col("name").alias("rule"), F.col("level").alias("__exact"))
    wide = overrides.select(F.col("name").alias("__family"), F.col("level").alias("__wide"))
    out = diagnostics.withColumn("__family", family(F.col("rule"))).join(exact, "rule", "left").join(wide, "__family", "left").join(base, "rule", "left")
    level = F.coalesce("__exact", "__wide", "__profile", "severity")
    return out.withColumn("severity", level).where(F.col("severity") != "off").select(*diagnostics.columns)


def explained(asked: DataFrame, texts: dict[str, str]) -> DataFrame:
    """asked (name and others) with rule, family, balanced severity and text of each rule that the name stands for: the rule's own, an older name, or a family (a row for each of its rules). Unknown names have one row of nulls."""
    spark = asked.sparkSession
    rows = [(n, r, r.split(".")[0], SEVERITIES[r][1], texts[r]) for r in SEVERITIES for n in (r, r.split(".")[0], *(a for a, x in ALIASES.items() if x == r))]
    known = F.broadcast(spark.createDataFrame(rows, "name string, rule string, family string, severity string, text string"))  # fixed: three rows a rule at most
    return asked.join(known, "name", "left")


def qualified(rule: Column, source: Column) -> Column:
    """family.rule, without the family for built-in rules."""
    return F.when(source.isNull() | (source == "builtin"), rule).otherwise(F.concat(source, F.lit("."), rule))


def isolated(name: str, rule, df: DataFrame) -> DataFrame:
    """A plugin's rule over df, as it is stored in the checkpoint or shared folder; if it can't be built or fails when it runs, one diagnostic
    says so. Runs the rule."""
    try:
        out = rule(df)
        return out.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else kept(out)
    except Exception as e:  # noqa: BLE001 - any failure of foreign code
        return df.sparkSession.createDataFrame([(name, "plugin-runtime-error", type(e).__name__)], "path string, rule string, message string")


#: Questions that are asked in defence, so a constant answer is no finding.
DEFENSIVE = ("nil", "empty", "zero", "any", "none", "all", "respond_to")


def constant_conditions(df: DataFrame, conditions: list[tuple[str, str, Column, str]], profile: str = "balanced") -> DataFrame:
    """rule, severity, message, polarity, n of the conditions that come out alike for all of df's rows, found by one aggregate.

    conditions: name, question (what it asks: "compare", one of DEFENSIVE, or "literal"), column, place ("", "loop" or "block").
    Conditions that are literals, asked in defence, or inside loops and blocks are not looked at. A null condition is falsey. Over
    no rows nothing is constant.
    """
    asked = [(name, c) for name, question, c, place in conditions if question not in (*DEFENSIVE, "literal") and place not in ("loop", "block")]
    severity = SEVERITIES["flow.always-truthy-condition"][PROFILES.index(profile)]
    none = "array<struct<message:string,polarity:string>>"
    hits = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"t{i}") for i, (_, c) in enumerate(asked)]
    totals = df.agg(F.count("*").alias("n"), *hits)
    found = [F.when((F.col(f"t{i}") == F.col("n")) | (F.col(f"t{i}") == 0), F.struct(F.lit(name).alias("message"), F.when(F.col(f"t{i}") == 0, "falsey").otherwise("truthy").alias("polarity"))) for i, (name, _) in enumerate(asked)]
    rows = F.filter(F.array(*found).cast(none), lambda x: x.isNotNull())
    out = totals.where("n > 0").select("n", F.inline(rows))
    return out.select(F.lit("flow.always-truthy-condition").alias("rule"), F.lit(severity).alias("severity"), "message", "polarity", "n").where(F.col("severity") != "off")
