"""From a resource to loaded rows, in the order that gives the steps their meaning.

Filter and projection, transforms, limit, contract, final selection, names and captured variants,
late rows, package-wide dedup, package, delivery, receipt, checkpoint.  So a limit counts rows before
validation, and quarantined rows never win a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import ContractError, DeliveryError, PositionError, SchemaError
from sluice.functions.expressions import Lowering, project
from sluice.functions.sqltext import columns_of, parse_scalar
from sluice.ledger import Checkpoint, Ledger
from sluice.operators.contract import TRUST, Contract, Validated, implied_rules, in_sample, validate, validation_depth
from sluice.operators.dedup import distinct_rows, keep_one, refuse_repeats
from sluice.operators.late import LateSplit, split_late
from sluice.operators.residual import VARIANT_COLUMN, capture
from sluice.operators.routing import with_route
from sluice.operators.schema import NamePolicy, check_destination, conform, fingerprint, normalize_columns, reconcile
from sluice.operators.segments import limit_in_order
from sluice.operators.transforms import apply_transforms
from sluice.plans.frontend import parse_resource
from sluice.plans.resource import DESTINATIONS, Resource
from sluice.positions import Cursor, from_json
from sluice.sinks.lake import Lake, Receipt
from sluice.sinks.package import Package, Packages

Source = Callable[..., DataFrame]


@dataclass
class Registry:
    """Sources by name; each is called with the session and the arguments of ``upstream``."""

    sources: dict[str, Source] = field(default_factory=dict)

    def register(self, name: str, source: Source) -> None:
        self.sources[name] = source

    def open(self, spark: SparkSession, resource: Resource) -> DataFrame:
        if resource.source not in self.sources:
            raise ContractError(f"no source {resource.source}")
        return self.sources[resource.source](spark, **resource.arguments)

    def mount(self, spark: SparkSession, view: str, source: str, **arguments) -> None:
        """A source as a view for any Spark SQL; filters, columns and limits are pushed as its reader can."""
        self.sources[source](spark, **arguments).createOrReplaceTempView(view)


def parquet_source(root: str) -> Source:
    """Tables of a folder of Parquet files or folders: ``upstream(source => ..., table => 'orders')``."""

    def open_table(spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{table}.parquet")

    return open_table


@dataclass
class Plan:
    """A resource's rows before and after its contract; nothing has run yet."""

    resource: Resource
    admitted: DataFrame
    validated: Validated
    late: LateSplit

    @property
    def accepted(self) -> DataFrame:
        return self.late.admitted


@dataclass(frozen=True)
class Options:
    """What a run takes beside the resource file."""

    contract: Contract = Contract()
    schema: T.StructType | None = None
    transforms: tuple = ()
    filters: tuple[str, ...] = ()
    select: tuple[str, ...] = ()
    limit: int | None = None
    order_by: tuple[str, ...] = ()
    normalize: NamePolicy | None = None
    event_time: str | None = None
    watermark: object = None
    after: object = None  # committed cursor: strictly greater values are read
    window: tuple | None = None  # [from, to) of the cursor, for backfills
    carried: DataFrame | None = None
    statistics: bool = False
    depth: str = "full"  # sampled_fast_path: one row in SAMPLE_ONE_IN is validated


def select_upstream(df: DataFrame, resource: Resource) -> DataFrame:
    """WHERE first, then the outputs; all columns for ``*``."""
    if resource.outputs is None:
        return df if resource.where is None else df.where(Lowering(df).lower(resource.where))
    return project(df, resource.outputs, resource.where)


def _fitted(df: DataFrame, schema: T.StructType, field: str) -> DataFrame:
    """``df`` in the declared types; what has no place there is captured, or fails the run."""
    extra = [c for c in df.columns if c not in schema.names]
    coerced = {d.name: schema[d.name].dataType for d in reconcile(df.schema, schema) if d.decision == "coerced"}
    if field == "fail_run":
        if extra:
            raise SchemaError(f"fields without a place: {extra}")
        strict = df.select(*[F.col(f"`{c}`").cast(coerced[c]).alias(c) if c in coerced else F.col(f"`{c}`") for c in df.columns])
        return conform(strict, schema)[0]
    if not extra and not coerced:
        return conform(df, schema)[0]
    kept = capture(df, [c for c in df.columns if c not in extra], unfit=coerced)
    return conform(kept, T.StructType([*schema.fields, kept.schema[VARIANT_COLUMN]]))[0]


def plan(spark: SparkSession, resource: Resource, registry: Registry, options: Options = Options()) -> Plan:
    df = registry.open(spark, resource)
    if resource.cursor and options.after is not None:
        df = df.where(F.col(resource.cursor) > F.lit(options.after))
    if options.window is not None:
        if not resource.cursor:
            raise ContractError("a backfill needs a cursor")
        df = df.where((F.col(resource.cursor) >= F.lit(options.window[0])) & (F.col(resource.cursor) < F.lit(options.window[1])))
    if options.schema is not None:
        df = _fitted(df, options.schema, TRUST[resource.trust].field)
    df = select_upstream(df, resource)
    for f in options.filters:
        df = df.where(Lowering(df).lower(parse_scalar(f)))
    df = apply_transforms(df, options.transforms)
    if options.limit is not None:
        df = limit_in_order(df, options.order_by or df.columns, options.limit)
    rules = implied_rules(T.StructType([f for f in options.schema or () if f.name in df.columns]), options.contract.rules)
    contract = Contract(rules, options.contract.dedup, TRUST[resource.trust], options.contract.redact)
    sample = None
    if options.depth == "sampled_fast_path":
        sample = in_sample(options.order_by or [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    checked = validate(df, contract, options.order_by, sample)
    out = checked.accepted
    if options.select:
        out = out.select(*options.select)
    if options.normalize is not None:
        out = normalize_columns(out, options.normalize)
    late = split_late(out, options.event_time, options.watermark, resource.execution.late) if options.event_time and options.watermark is not None else LateSplit(out)
    if options.carried is not None:
        # rows that an earlier epoch held back have passed their contract and are not late again
        late.admitted = late.admitted.unionByName(options.carried)
    dedup = contract.dedup
    if options.event_time and resource.execution.late == "admit_with_annotation" and (dedup or resource.exact_row_dedup):
        raise ContractError("annotated late rows need their own ordinals and do not go with package dedup")
    if resource.exact_row_dedup or (dedup and dedup.exact_row):
        late.admitted = distinct_rows(late.admitted)
    elif dedup and dedup.keep == "fail":
        refuse_repeats(late.admitted, dedup.keys)
    elif dedup:
        late.admitted = keep_one(late.admitted, dedup.keys, options.order_by, dedup.keep)
    return Plan(resource, df, checked, late)


@dataclass(frozen=True)
class RunResult:
    package: Package
    receipts: tuple[Receipt, ...]
    checkpoint: Checkpoint
    quarantined: int


def run(
    spark: SparkSession, resource: Resource | str, registry: Registry, lake: Lake, packages: Packages, ledger: Ledger, options: Options = Options(), package_id: str | None = None
) -> RunResult:
    """Run a resource to its checkpoint; running a package id again changes nothing."""
    if isinstance(resource, str):
        resource = parse_resource(resource)
    # each window of a backfill has a state of its own
    scope = "resource" if options.window is None else f"window[{options.window[0]},{options.window[1]})"
    head = ledger.head(resource.resource_id, scope)
    if resource.disposition == "append" and resource.cursor and head is not None and head.output_position_json and options.after is None and options.window is None:
        position = from_json(head.output_position_json)
        if isinstance(position, Cursor):
            options = Options(**{**options.__dict__, "after": position.number() if position.kind == "int" else position.value})
    package_id = package_id or f"{resource.resource_id}-{(head.sequence if head else 0) + 1:06d}"
    planned = plan(spark, resource, registry, options)
    # the fast path is earned by clean runs, and lost when the schema drifts or a row is quarantined
    drift = head is not None and head.schema_hash != fingerprint(planned.accepted.schema)
    depth = validation_depth(TRUST[resource.trust], ledger.clean_runs(resource.resource_id, scope), drift=drift)
    if depth != options.depth:
        options = replace(options, depth=depth)
        planned = plan(spark, resource, registry, options)
    planned.validated.enforce()
    check_destination(planned.accepted.schema, DESTINATIONS["parquet"], allow_lossy=True)
    package = packages.build(package_id, planned.accepted, planned.validated.quarantine, options.order_by if options.statistics else (), statistics=options.statistics, lineage=[{"from": resource.source, "to": resource.target or resource.resource_id, "relation": "loads"}])
    quarantined = packages.manifest(package_id)["quarantined"]
    if packages.manifest(package_id)["status"] == "packaged":
        packages.set_status(package_id, "loading")
    rows, target = packages.read(package_id), resource.target or resource.resource_id
    if resource.route:
        receipts = lake.deliver_routed(target, with_route(rows, resource.route.field), package.package_hash, resource.disposition, resource.route.max_targets, resource.keys)
    else:
        receipts = [lake.deliver(target, rows, package.package_hash, resource.disposition, resource.keys, resource.delete)]
    if not receipts and TRUST[resource.trust].require_receipts:
        raise DeliveryError("trust needs a receipt, and nothing was delivered")
    checkpoint = ledger.commit(resource.resource_id, receipts[0] if receipts else None, _position(rows, resource), scope, quarantined_rows=quarantined)
    packages.set_status(package_id, "checkpointed")
    return RunResult(package, tuple(receipts), checkpoint, quarantined)


def _position(rows: DataFrame, resource: Resource) -> Cursor | None:
    if not resource.cursor or resource.cursor not in rows.columns:
        return None
    high = rows.agg(F.max(resource.cursor).alias("m")).first()["m"]
    if high is None:
        return None
    kind = "int" if isinstance(high, int) else "string"
    return Cursor(resource.cursor, kind, str(high))


def preview(spark: SparkSession, resource: Resource | str, registry: Registry, rows: int = 20, options: Options = Options()) -> DataFrame:
    """A few rows that would be accepted; nothing is written."""
    resource = parse_resource(resource) if isinstance(resource, str) else resource
    return plan(spark, resource, registry, options).accepted.limit(rows)


def explain(spark: SparkSession, resource: Resource | str, registry: Registry, options: Options = Options()) -> str:
    """The physical plan of a resource's accepted rows."""
    resource = parse_resource(resource) if isinstance(resource, str) else resource
    return plan(spark, resource, registry, options).accepted._jdf.queryExecution().explainString(spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def required_columns(resource: Resource, contract: Contract) -> set[str]:
    """Columns of the source that a run needs: outputs, filter, cursor; rules see outputs only."""
    trees: Sequence = [t for _, t in resource.outputs or ()] + ([resource.where] if resource.where else [])
    names = {name for name, _ in resource.outputs or ()}
    if resource.outputs is not None and (missing := {r.column for r in contract.rules} - names):
        raise ContractError(f"rules name columns that are not selected: {sorted(missing)}")
    return set().union(*map(columns_of, trees)) | ({resource.cursor} if resource.cursor else set())


def backfill_windows(start: int, stop: int, step: int) -> list[tuple[int, int]]:
    """``[start, stop)`` cut into windows of ``step``; each gets a scope and a package of its own."""
    if step < 1 or stop <= start:
        raise PositionError("a backfill needs a step and a range")
    return [(a, min(a + step, stop)) for a in range(start, stop, step)]
