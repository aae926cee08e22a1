"""Command line: import, audit, research run, preflight, benchmark, experiments."""

from __future__ import annotations

import argparse
import json
import sys

from .plans import research as R
from .registry import ExperimentRegistry
from .session import session
from .sources import sinks, tables


def _positive(x: str) -> int:
    n = int(x)
    if n < 1:
        raise argparse.ArgumentTypeError("must be positive")
    return n


def _share(x: str) -> float:
    v = float(x)
    if not 0 <= v <= 1:
        raise argparse.ArgumentTypeError("must lie between 0 and 1")
    return v


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="signalloom")
    sub = top.add_subparsers(dest="command", required=True)
    imp = sub.add_parser("import", help="flat vendor exports to prices and gaps")
    imp.add_argument("files", nargs="+", metavar="SYMBOL=PATH")
    imp.add_argument("--output", required=True)
    for name in ("audit", "run"):
        p = sub.add_parser(name)
        for table in ("prices", "memberships", "dates", "config"):
            p.add_argument(f"--{table}", required=True)
        p.add_argument("--output", required=name == "run")
        p.add_argument("--least", type=_positive, default=50)
        if name == "run":
            p.add_argument("--train-end", required=True)
            p.add_argument("--lags", type=int, default=2)
            p.add_argument("--pca", type=_share)
            for x in ("folds", "test-dates", "least-train"):
                p.add_argument(f"--{x}", type=_positive)
    for name in ("preflight", "benchmark"):
        p = sub.add_parser(name)
        p.add_argument("--panel", required=True)
        p.add_argument("--config", required=True)
        if name == "benchmark":
            p.add_argument("--output", required=True)
            p.add_argument("--registry")
            p.add_argument("--manifest")
            p.add_argument("--final", action="store_true")
    dev = sub.add_parser("develop", help="a development run from input tables to a verified bundle")
    for name in ("prices", "memberships", "dates", "panel-config", "config", "registry", "manifest", "output"):
        dev.add_argument(f"--{name}", required=True)
    ver = sub.add_parser("verify", help="check a bundle against its registry")
    for name in ("bundle", "registry"):
        ver.add_argument(f"--{name}", required=True)
    abl = sub.add_parser("ablate", help="the benchmark by target or by features")
    abl.add_argument("kind", choices=("target", "features"))
    for name in ("panel", "config", "output"):
        abl.add_argument(f"--{name}", required=True)
    abl.add_argument("--more", nargs="*", default=[])
    sub.add_parser("experiments").add_argument("--registry", required=True)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "experiments":
        print(json.dumps(ExperimentRegistry(args.registry).runs()))
        return 0
    if args.command == "run" and len({x is None for x in (args.folds, args.test_dates, args.least_train)}) > 1:
        raise SystemExit("walk-forward settings go together")
    if args.command == "benchmark" and bool(args.registry) != bool(args.manifest):
        raise SystemExit("a registry needs a manifest")
    spark = session()
    if args.command == "import":
        prices, gaps, digests = tables.import_files(spark, dict(f.split("=", 1) for f in args.files))
        sinks.write_run(args.output, prices, {"missing_prices": gaps}, {"manifest": digests})
    elif args.command in ("audit", "run"):
        settings = tables.read_json_object(args.config)
        settings["features"] = tuple(settings.get("features", R.PanelConfig().features))
        config = R.PanelConfig(**settings)
        prices, members = tables.read_table(spark, args.prices), tables.read_table(spark, args.memberships)
        dates = tables.read_as_of_dates(spark, args.dates)
        if args.command == "audit":
            found = R.audit_inputs(prices, members, dates, config, args.least)
            if args.output:
                sinks.write_bundle(args.output, {k: found[k] for k in ("by_date", "by_security")}, {"warnings": found["warnings"]})
            print(json.dumps({"dates": found["by_date"].count(), "warnings": found["warnings"]}))
            return 0
        panel = R.panel_from_tables(prices, members, dates, config)
        out = R.run_research(panel, list(config.features), "forward_excess_return", args.train_end, least=args.least, lags=args.lags, folds=args.folds, test_dates=args.test_dates or 4, least_train=args.least_train or 12, pca_share=args.pca)
        reports = {k: v for k, v in out.items() if hasattr(v, "write")}
        sinks.write_run(args.output, panel, reports, {"selection": out["selection"], "config": settings})
    elif args.command == "develop":
        settings = tables.read_json_object(args.panel_config)
        settings["features"] = tuple(settings.get("features", R.PanelConfig().features))
        bench = R.BenchmarkConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in tables.read_json_object(args.config).items()})
        out = R.develop(tables.read_table(spark, args.prices), tables.read_table(spark, args.memberships), tables.read_as_of_dates(spark, args.dates), R.PanelConfig(**settings), bench, registry=ExperimentRegistry(args.registry), manifest=tables.read_json_object(args.manifest), path=args.output)
        print(json.dumps({"run": out["run"], "frozen": out["frozen"], "warnings": out["audit"]["warnings"]}))
    elif args.command == "verify":
        report = R.verify_development(spark, args.bundle, ExperimentRegistry(args.registry))
        print(json.dumps({"run": report["run"], "frozen": report["frozen"]}))
    elif args.command == "ablate":
        config = R.BenchmarkConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in tables.read_json_object(args.config).items()})
        panel = tables.read_table(spark, args.panel)
        arms = R.target_ablation(panel, config) if args.kind == "target" else R.feature_ablation(panel, config, tuple(args.more))
        sinks.write_bundle(args.output, {f"{arm}_{t}": out[t] for arm, out in arms.items() for t in ("fold_metrics", "summary")}, {"frozen": {arm: out["frozen"] for arm, out in arms.items()}})
    else:
        settings = tables.read_json_object(args.config)
        config = R.BenchmarkConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})
        panel = tables.read_table(spark, args.panel)
        if args.command == "preflight":
            state = R.preflight_benchmark(panel, config)
            print(json.dumps(sinks.json_safe(state)))
            return 0 if state["feasible"] else 2
        registry = ExperimentRegistry(args.registry) if args.registry else None
        out = R.run_benchmark(panel, config, registry=registry, manifest=tables.read_json_object(args.manifest) if args.manifest else None, final=args.final)
        frames = {k: out[k] for k in ("predictions", "native_daily", "common_daily", "fold_metrics", "summary")}
        sinks.write_bundle(args.output, frames, {"frozen": out["frozen"], "details": out["details"], "acceptance": out["acceptance"]})
    return 0


if __name__ == "__main__":
    sys.exit(main())
