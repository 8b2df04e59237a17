"""``python -m sluice NOUN ...`` over a project folder: sluice.json, resources/*.sql and contracts/*.json.

    init                         make an empty project
    add NAME SQL                 add a resource
    validate | compile           check every resource, or print what each compiles to
    discover SOURCE TABLE        the schema of a source's table
    plan | explain NAME          columns and steps, or the physical plan
    preview NAME [--limit n] [--filter 'c > 1']... [--select a,b] [--order-by a]
    run NAME [--limit n] [--filter ...] [--package id]
    backfill NAME FROM TO STEP   a run per window of the cursor
    sql 'SELECT ...'             read-only SQL over the system tables
    status | state NAME          freshness of every resource, or one's checkpoints
    package NAME [verify|archive TO]    a package's manifest
    schema NAME | contract NAME  the columns of a resource, or its rules
    doctor                       receipts against what targets hold
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from sluice.errors import SluiceError
from sluice.operators import contract as C

_RULES = {"nullability": C.Nullability, "domain": C.Domain, "range": C.Range, "regex": C.Regex, "freshness": C.Freshness}


def load_contract(path: Path) -> C.Contract:
    """A contract file: {"rules": [{"kind", "rule_id", "column", ...}], "dedup": {...}, "redact": {...}}."""
    if not path.exists():
        return C.Contract()
    spec = json.loads(path.read_text())
    rules = []
    for r in spec.get("rules", []):
        r = dict(r)
        kind = r.pop("kind")
        if "allowed" in r:
            r["allowed"] = tuple(r["allowed"])
        rules.append(_RULES[kind](**r))
    dedup = spec.get("dedup")
    return C.Contract(tuple(rules), C.Dedup(tuple(dedup["keys"]), dedup.get("keep", "first")) if dedup else None, redact=spec.get("redact", {}))


class Project:
    """A project folder and the session that its commands share."""

    def __init__(self, root: Path) -> None:
        from pyspark.sql import SparkSession

        from sluice.ledger import Ledger
        from sluice.plans.run import Registry, parquet_source
        from sluice.sinks.lake import Lake
        from sluice.sinks.package import Packages
        from sluice.storage import Folder

        self.root, self.spec = root, json.loads((root / "sluice.json").read_text())
        self.spark = SparkSession.builder.appName("sluice").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        store = self.spec.get("store") or f"file://{root.resolve()}/store"
        self.lake, self.packages = Lake(self.spark, store), Packages(self.spark, f"{store}/packages")
        self.ledger = Ledger(Folder(self.spark, store), self.spec.get("pipeline", "default"))
        self.registry = Registry({name: parquet_source(s["root"]) for name, s in self.spec.get("sources", {}).items()})

    def names(self) -> list[str]:
        return sorted(p.stem for p in (self.root / "resources").glob("*.sql"))

    def resource(self, name: str):
        from sluice.plans.frontend import parse_resource

        return parse_resource((self.root / "resources" / f"{name}.sql").read_text(), name)

    def contract(self, name: str) -> C.Contract:
        return load_contract(self.root / "contracts" / f"{name}.json")

    def options(self, name: str, args):
        from sluice.plans.run import Options

        order = tuple((args.order_by or "").split(",")) if args.order_by else ()
        select = tuple(args.select.split(",")) if args.select else ()
        return Options(self.contract(name), filters=tuple(args.filter or ()), limit=args.limit, order_by=order, select=select)


def _show(value) -> None:
    print(json.dumps(value, indent=1, default=str))


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _init(root: Path) -> None:
    for name in ("resources", "contracts"):
        (root / name).mkdir(parents=True, exist_ok=True)
    if not (root / "sluice.json").exists():
        (root / "sluice.json").write_text(json.dumps({"pipeline": "default", "sources": {}}, indent=1))


def command(noun: str, words: list[str], args) -> None:
    root = Path(args.project)
    if noun == "init":
        return _init(root)
    if noun == "add":
        from sluice.plans.frontend import parse_resource

        parse_resource(words[1], words[0])
        return (root / "resources" / f"{words[0]}.sql").write_text(words[1]) and None
    p = Project(root)
    from sluice import system
    from sluice.plans import run as R
    from sluice.plans.resource import delivery_guarantee
    from sluice.plans.run import Options, backfill_windows

    if noun in ("validate", "compile"):
        found = {}
        for name in p.names():
            resource = p.resource(name)
            needed = R.required_columns(resource, p.contract(name))
            found[name] = resource if noun == "compile" else {"columns": sorted(needed), "lints": p.contract(name).lints()}
        return _show(found)
    if noun == "discover":
        return _show(json.loads(p.registry.sources[words[0]](p.spark, table=words[1]).schema.json()))
    if noun == "sql":
        system.mount(p.spark, p.lake, p.packages, p.ledger, [p.resource(n) for n in p.names()])
        return _show(_rows(system.system_sql(p.spark, words[0])))
    if noun == "status":
        heads = [(n, h.created_at_ms if (h := p.ledger.head(n)) else None, p.spec.get("max_age_ms", {}).get(n)) for n in p.names()]
        seen = p.spark.createDataFrame(heads, "resource_id string, last_ms bigint, max_age_ms bigint")
        status = system.freshness(seen, int(time.time() * 1000))
        return _show({"resources": _rows(status), "summary": _rows(system.freshness_summary(status))[0]})
    if noun == "doctor":
        written: dict[str, int] = {}
        for r in p.lake.receipts():
            written[r.target] = r.counts.get("rows_written", 0) + (0 if r.disposition == "replace" else written.get(r.target, 0))
        held = {t: df.count() for t in written if (df := p.lake.read(t)) is not None}
        both = [p.spark.createDataFrame(list(x.items()) or [("", 0)], "target string, n bigint").where("target <> ''") for x in (written, held)]
        return _show(_rows(system.drift(both[0], both[1], ["target"], "n")))
    name = words[0]
    if noun == "package":
        if "verify" in words:
            p.packages.verify(name)
        if "archive" in words:
            return _show(p.packages.archive(name, words[-1]))
        return _show(p.packages.manifest(name))
    if noun == "state":
        return _show([c.__dict__ for c in p.ledger.history(name)])
    resource, contract = p.resource(name), p.contract(name)
    if noun == "contract":
        return _show({"rules": [{"kind": type(r).__name__.lower(), **r.__dict__} for r in contract.rules], "lints": contract.lints()})
    options = p.options(name, args)
    if noun == "schema":
        return _show(json.loads(R.plan(p.spark, resource, p.registry, options).accepted.schema.json()))
    if noun == "plan":
        return _show({"resource": name, "columns": sorted(R.required_columns(resource, contract)), "guarantee": delivery_guarantee(resource.disposition, False), "trust": resource.trust})
    if noun == "explain":
        return print(R.explain(p.spark, resource, p.registry, options))
    if noun == "preview":
        return _show(_rows(R.preview(p.spark, resource, p.registry, args.limit or 20, options)))
    if noun == "run":
        result = R.run(p.spark, resource, p.registry, p.lake, p.packages, p.ledger, options, args.package)
        return _show({"package": result.package.package_id, "rows": result.package.row_count, "quarantined": result.quarantined, "receipts": [r.receipt_id for r in result.receipts], "checkpoint": result.checkpoint.sequence})
    if noun == "backfill":
        done = []
        for low, high in backfill_windows(*map(int, words[1:4])):
            o = Options(**{**options.__dict__, "window": (low, high)})
            result = R.run(p.spark, resource, p.registry, p.lake, p.packages, p.ledger, o, f"{name}-{low}-{high}")
            done.append({"window": [low, high], "rows": result.package.row_count})
        return _show(done)
    raise SluiceError(f"unknown noun {noun}")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sluice", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("noun")
    parser.add_argument("words", nargs="*")
    parser.add_argument("--project", default=".")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--filter", action="append")
    parser.add_argument("--select")
    parser.add_argument("--order-by")
    parser.add_argument("--package")
    args = parser.parse_args(argv)
    try:
        command(args.noun, args.words, args)
    except SluiceError as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
