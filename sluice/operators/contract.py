"""Row contracts: rules compiled to violation predicates, quarantine with evidence, verdicts.

A contract compiles to one array column of violations per row.  Rules never see rows of other
partitions, so validation is one pass without a shuffle; only keyed deduplication shuffles.
"""

from __future__ import annotations

import enum
import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import ContractError


class Outcome(enum.Enum):
    PASS = "pass"
    COERCED = "coerced"
    ADMITTED_AS_VARIANT = "admitted_as_variant"
    VIOLATION = "violation"
    FATAL = "fatal"


class Verdict(enum.Enum):
    ACCEPT = "accept"
    QUARANTINE = "quarantine"
    REJECT_BATCH = "reject_batch"
    REJECT_RUN = "reject_run"


@dataclass(frozen=True)
class TrustPreset:
    """What a level of trust does with rows and fields that do not fit, and how deep it looks."""

    name: str
    violation: Verdict
    field: str = "capture_variant"
    depth: str = "full"
    freshness_slo: bool = False
    require_receipts: bool = False
    reconciliation_counts: bool = False
    full_lineage: bool = False
    nested: str = "capture_variant"
    retention: str = "package_retained"
    clean_runs_required: int = 3

    def verdicts(self) -> dict[Outcome, Verdict]:
        table = {o: Verdict.ACCEPT for o in (Outcome.PASS, Outcome.COERCED, Outcome.ADMITTED_AS_VARIANT)}
        return check_total(table | {Outcome.VIOLATION: self.violation, Outcome.FATAL: Verdict.REJECT_RUN})


TRUST = {
    "experimental": TrustPreset("experimental", Verdict.REJECT_RUN, retention="ephemeral"),
    "governed": TrustPreset("governed", Verdict.QUARANTINE),
    "financial": TrustPreset(
        "financial", Verdict.REJECT_RUN, field="fail_run", require_receipts=True, reconciliation_counts=True, full_lineage=True, nested="keep", retention="long"
    ),
    "serving": TrustPreset("serving", Verdict.QUARANTINE, depth="sampled_fast_path", freshness_slo=True),
}


def check_total(table: dict[Outcome, Verdict]) -> dict[Outcome, Verdict]:
    if missing := [o.value for o in Outcome if o not in table]:
        raise ContractError(f"no verdict for {', '.join(missing)}")
    return table


def validation_depth(preset: TrustPreset, clean_runs: int, *, drift: bool = False, anomaly: bool = False, quarantined: int = 0) -> str:
    """The fast path is earned by enough clean runs and lost by drift, anomalies or quarantine."""
    if preset.depth != "sampled_fast_path":
        return preset.depth
    return "full" if drift or anomaly or quarantined or clean_runs < preset.clean_runs_required else "sampled_fast_path"


_TEXT, _TIMES = (T.StringType,), (T.TimestampType, T.TimestampNTZType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


@dataclass(frozen=True)
class Rule:
    """One rule; ``violated`` gives true or false for every row, never null."""

    rule_id: str
    column: str

    code = ""

    def violated(self, kind: T.DataType) -> Column:
        raise NotImplementedError

    def value(self) -> Column:
        return F.col(f"`{self.column}`")

    def lints(self) -> list[str]:
        return []


@dataclass(frozen=True)
class Nullability(Rule):
    code = "nullability_violation"

    def violated(self, kind: T.DataType) -> Column:
        return self.value().isNull()


def _canonical(text: str, kind: T.DataType):
    """The value that a domain literal stands for, or None if it is not canonical for the type."""
    try:
        if isinstance(kind, T.StringType):
            return text
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False}.get(text)
        if isinstance(kind, _WHOLE):
            return int(text) if str(int(text)) == text else None
        if isinstance(kind, _FLOATS):
            return float(text)
        if isinstance(kind, _TIMES):
            return int(text) if str(int(text)) == text else None
    except ValueError:
        return None
    return None


@dataclass(frozen=True)
class Domain(Rule):
    """A value outside the allowed texts violates; null passes.  Literals that are not canonical are ignored."""

    allowed: tuple[str, ...] = ()
    code = "domain_violation"

    def violated(self, kind: T.DataType) -> Column:
        value = self.value()
        known = [v for v in (_canonical(t, kind) for t in self.allowed) if v is not None]
        if isinstance(kind, _FLOATS):
            # compared by bits: 0.0 is not -0.0, and NaN must be listed
            zeros = [str(v) for v in known if v == 0]
            rest = [v for v in known if v != 0 and not math.isnan(v)]
            inside = F.when(F.isnan(value), F.lit(any(math.isnan(v) for v in known)))
            inside = inside.when(value == 0, value.cast("double").cast("string").isin(zeros) if zeros else F.lit(False))
            inside = inside.otherwise(value.isin(rest) if rest else F.lit(False))
        elif isinstance(kind, _TIMES):
            inside = epoch_millis(value, kind).isin(known) if known else F.lit(False)
        else:
            inside = value.isin(known) if known else F.lit(False)
        return value.isNotNull() & ~F.coalesce(inside, F.lit(False))


@dataclass(frozen=True)
class Range(Rule):
    """Inclusive bounds on a number; null passes, NaN is an error unless there is no bound."""

    min: str | None = None
    max: str | None = None
    code = "range_violation"

    def violated(self, kind: T.DataType) -> Column:
        if not isinstance(kind, _WHOLE + _FLOATS):
            raise ContractError(f"{self.rule_id}: a range needs a number, not {kind.simpleString()}")
        parse = float if isinstance(kind, _FLOATS) else int
        try:
            low, high = (None if b is None else parse(b) for b in (self.min, self.max))
        except ValueError:
            raise ContractError(f"{self.rule_id}: a bound is no {kind.simpleString()}") from None
        value, out = self.value(), F.lit(False)
        if low is not None:
            out = out | (value < low)
        if high is not None:
            out = out | (value > high)
        if isinstance(kind, _FLOATS) and (low is not None or high is not None):
            out = F.when(F.isnan(value), F.raise_error(F.lit(f"{self.rule_id}: NaN has no place in a range")).cast("boolean")).otherwise(out)
        return F.coalesce(out, F.lit(False))

    def lints(self) -> list[str]:
        if self.min is None and self.max is None:
            return [f"{self.rule_id}: always true"]
        if self.min is not None and self.max is not None and float(self.min) > float(self.max):
            return [f"{self.rule_id}: unsatisfiable"]
        return []


@dataclass(frozen=True)
class Regex(Rule):
    """A text in which the pattern is not found anywhere violates; null passes."""

    pattern: str = ""
    code = "regex_violation"

    def violated(self, kind: T.DataType) -> Column:
        if not isinstance(kind, _TEXT):
            raise ContractError(f"{self.rule_id}: a pattern needs text, not {kind.simpleString()}")
        return self.value().isNotNull() & ~F.coalesce(self.value().rlike(self.pattern), F.lit(False))


@dataclass(frozen=True)
class Freshness(Rule):
    """A time more than ``max_age_ms`` before ``observed_at_ms`` violates, and so does null."""

    max_age_ms: int = 0
    observed_at_ms: int = 0
    code = "freshness_violation"

    def violated(self, kind: T.DataType) -> Column:
        if not isinstance(kind, _TIMES):
            raise ContractError(f"{self.rule_id}: freshness needs a timestamp, not {kind.simpleString()}")
        age = F.lit(self.observed_at_ms) - epoch_millis(self.value(), kind)
        return F.coalesce(age > self.max_age_ms, F.lit(True))


def epoch_millis(value: Column, kind: T.DataType) -> Column:
    """Milliseconds since the epoch, cut toward zero; times without a zone count as UTC."""
    if isinstance(kind, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), value)
    else:
        micros = F.unix_micros(value)
    return F.call_function("div", micros, F.lit(1000))


@dataclass(frozen=True)
class Dedup:
    """At most one row per key: the first or last in package order, or failure on any repeat."""

    keys: tuple[str, ...]
    keep: str = "first"
    exact_row: bool = False


@dataclass(frozen=True)
class Contract:
    rules: tuple[Rule, ...] = ()
    dedup: Dedup | None = None
    trust: TrustPreset = TRUST["governed"]
    redact: dict[str, str] = field(default_factory=dict)

    def lints(self) -> list[str]:
        return [x for r in self.rules for x in r.lints()]


def implied_rules(schema: T.StructType, rules: Sequence[Rule] = ()) -> tuple[Rule, ...]:
    """``rules``, after a nullability rule for every field that must not be null and has none."""
    named = {r.column for r in rules if isinstance(r, Nullability)}
    return (*(Nullability(f"{f.name}_not_null", f.name) for f in schema if not f.nullable and f.name not in named), *rules)


#: One row in so many is looked at on the fast path of sampled validation.
SAMPLE_ONE_IN = 100


def in_sample(keys: Sequence[str], one_in: int = SAMPLE_ONE_IN) -> Column:
    """Whether sampled validation looks at a row: told by a hash of ``keys``, so the same ones each run."""
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(one_in)) == 0


def sampled(df: DataFrame, keys: Sequence[str], one_in: int = SAMPLE_ONE_IN) -> DataFrame:
    return df.where(in_sample(keys, one_in))


_VIOLATION = "array<struct<rule_id:string,error_code:string,column:string,value:string>>"


def redacted(value: Column, decision: str | None) -> Column:
    """Preserve, hash, omit or mask a value that goes into evidence."""
    text = value.cast("string")
    if decision in (None, "preserve"):
        return text
    if decision == "hash":
        return F.concat(F.lit("sha256:"), F.sha2(text, 256))
    if decision == "omit":
        return F.lit(None).cast("string")
    if decision.startswith("mask"):
        mask = decision.partition(":")[2] or "***"
        return F.when(value.isNotNull(), F.lit(mask))
    raise ContractError(f"unknown redaction: {decision}")


def _predicates(df: DataFrame, contract: Contract) -> list[Column]:
    """For each rule whether a row breaks it: true or false, never null."""
    kinds = {f.name: f.dataType for f in df.schema}
    for rule in contract.rules:
        if rule.column not in kinds:
            raise ContractError(f"{rule.rule_id}: no column {rule.column}")
    return [rule.violated(kinds[rule.column]) for rule in contract.rules]


def _entries(contract: Contract) -> list[Column]:
    """For each rule the evidence of a row that breaks it."""
    return [
        F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.code).alias("error_code"),
            F.lit(rule.column).alias("column"),
            redacted(rule.value(), contract.redact.get(rule.column)).alias("value"),
        )
        for rule in contract.rules
    ]


def with_violations(df: DataFrame, contract: Contract, column: str = "violations") -> DataFrame:
    """``df`` and, per row, the rules it breaks, in rule order."""
    none = F.array().cast(_VIOLATION)
    parts = [F.when(p, F.array(e)).otherwise(none) for p, e in zip(_predicates(df, contract), _entries(contract))]
    return df.withColumn(column, F.concat(*parts).cast(_VIOLATION) if parts else none)


@dataclass
class Validated:
    """Accepted rows, one evidence row per broken rule, and the counts of the verdict."""

    rows: DataFrame
    accepted: DataFrame
    contract: Contract
    predicates: list[Column]
    ordinal: Sequence[str] = ()

    @functools.cached_property
    def quarantine(self) -> DataFrame:
        each = [F.when(p, e) for p, e in zip(self.predicates, _entries(self.contract))] or [F.lit(None).cast(_VIOLATION[6:-1])]
        broken = self.rows.where(self.broken).select(*self.ordinal, F.explode(F.array(*each)).alias("v"))
        return broken.where("v is not null").select(*self.ordinal, "v.*")

    @property
    def broken(self) -> Column:
        return reduce(lambda a, b: a | b, self.predicates, F.lit(False))

    def summary(self) -> DataFrame:
        """input_rows, accepted_rows and quarantined_rows in one pass; only counts leave the tasks."""
        return self.rows.agg(
            F.count(F.lit(1)).alias("input_rows"),
            F.count(F.when(~self.broken, 1)).alias("accepted_rows"),
            F.count(F.when(self.broken, 1)).alias("quarantined_rows"),
        )

    def violations_by_rule(self) -> DataFrame:
        """rule_id and violations of every rule, from one aggregate."""
        counts = self.rows.agg(*[F.count(F.when(p, 1)).alias(f"n{i}") for i, p in enumerate(self.predicates)] or [F.lit(0).alias("none")])
        pairs = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"n{i}").alias("violations")) for i, r in enumerate(self.contract.rules)]
        return counts.select(F.explode(F.array(*pairs)).alias("p")).select("p.*") if pairs else counts.where(F.lit(False)).select(F.lit("").alias("rule_id"), F.lit(0).cast("bigint").alias("violations"))

    def enforce(self) -> "Validated":
        """Raise if the trust preset rejects a run with violations; looks no further than the first."""
        verdict = self.contract.trust.verdicts()[Outcome.VIOLATION]
        if verdict in (Verdict.REJECT_RUN, Verdict.REJECT_BATCH) and self.predicates and not self.rows.where(self.broken).isEmpty():
            raise ContractError(f"rows break the contract, and trust {self.contract.trust.name} rejects the run")
        return self


def validate(df: DataFrame, contract: Contract, ordinal: Sequence[str] = (), sample: Column | None = None) -> Validated:
    """Split ``df`` by ``contract``; ``ordinal`` columns identify rows in the evidence.

    With ``sample`` only rows of the sample are looked at and the others pass: the fast path of sampled validation.

    Accepted rows pass plain predicates, which stay in generated code and reach the scan; evidence is built for
    the broken rows alone.
    """
    predicates = _predicates(df, contract)
    if sample is not None:
        predicates = [sample & p for p in predicates]
    accepted = df.where(reduce(lambda a, b: a & b, [~p for p in predicates])) if predicates else df
    return Validated(df, accepted, contract, predicates, ordinal)
