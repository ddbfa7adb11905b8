"""Commands: scan, validate, plan, copy, config, check-config, rollback."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from framelake.config import Settings, diagnose, load_settings
from framelake.operators import filters, reports, state
from framelake.plans import organise, run
from framelake.session import build_session, table
from framelake.sources import logs, sinks

# Exit codes.
OK, ERROR, CANCELLED, CONFIG, INVALID_FILES, PARTLY = 0, 1, 2, 3, 4, 5


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="framelake", description=__doc__)
    p.add_argument("command", choices=["scan", "validate", "plan", "copy", "config", "check-config", "rollback"])
    p.add_argument("--data", help="folder with the files table")
    p.add_argument("--config", help="JSON or YAML file of settings")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--out", help="folder for results")
    p.add_argument("--log", help="folder of operation logs; a copy with one can be resumed and rolled back")
    p.add_argument("--session", help="log session to roll back")
    p.add_argument("--resume", action="store_true", help="carry on an unfinished session")
    p.add_argument("--fresh", action="store_true", help="start anew whatever is unfinished")
    p.add_argument("--execute", action="store_true", help="roll back rather than show the steps")
    p.add_argument("--json", action="store_true", help="settings as JSON")
    p.add_argument("--move", action="store_true")
    p.add_argument("--master", default="local[*]")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        settings, sources = load_settings(a.config, dict(x.split("=", 1) for x in a.set))
    except ValueError as problem:
        print(problem, file=sys.stderr)
        return CONFIG
    if a.command == "config" and a.json:
        print(json.dumps({s.name: {"value": s.value, "source": s.source} for s in sources}, default=str, indent=1))
        return OK
    if a.command == "config":
        for s in sources:
            print(f"{s.name:<22} {str(s.value)[:38]:<38} {s.source}")
        return OK
    if a.command == "check-config":
        found = diagnose(settings)
        for kind in ("errors", "warnings", "hints"):
            for text in getattr(found, kind):
                print(f"{kind[:-1]}: {text}")
        return CONFIG if found.errors else OK
    spark = build_session(a.master)
    try:
        return _run(spark, a, settings)
    except KeyboardInterrupt:
        spark.sparkContext.cancelAllJobs()
        return CANCELLED


def _run(spark, a: argparse.Namespace, settings: Settings) -> int:
    if a.command == "rollback":
        if a.execute:
            counts = run.roll_back(spark, a.log, a.session)
            print(json.dumps(counts))
            return PARTLY if counts.get("Failed") else OK
        steps = state.inverse_operations(run.latest_results(logs.read_operations(spark, a.log, a.session)))
        _show(steps, a.out)
        return PARTLY if steps.where("action = 'invalid'").limit(1).count() else OK
    if a.command == "copy" and a.log and not settings.dry_run:
        header, errors, warnings = run.resumable(spark, a.log, settings)
        for text in warnings:
            print(f"warning: {text}", file=sys.stderr)
        decision = state.resume_decision(a.fresh, header, errors, a.resume)
        if decision in ("invalid", "ask"):
            print(f"session {header['id']} is unfinished: {'; '.join(errors) or 'choose --resume or --fresh'}", file=sys.stderr)
            return CONFIG
        if decision == "fresh":
            header = run.start(spark, organise.plan(table(spark, a.data, "files"), settings), settings, a.log, a.move)
        done = run.carry_on(spark, a.log, header, progress=run.report)
        print(json.dumps({"session": done["id"], "results": done["results"]}))
        return PARTLY if done["results"].get("Failed") else OK
    files = table(spark, a.data, "files")
    if a.command in ("scan", "validate"):
        rows = organise.destinations(organise.library(files), settings)
        print(json.dumps(filters.scan_totals(rows).first().asDict()))
        if a.command == "scan":
            print(reports.summary_text(reports.copy_statistics(rows), rows))
            print(reports.unknown_text(rows))
        _show(rows.select("path", "name", "length", "is_valid", F.col("rejection.reason").alias("reason")), a.out)
        return INVALID_FILES if a.command == "validate" and rows.where("not is_valid").limit(1).count() else OK
    planned = organise.plan(files, settings)
    print(json.dumps(organise.plan_totals(planned).first().asDict()))
    if a.command == "plan":
        _show(planned, a.out)
        return OK
    indexed = planned.withColumn("file_index", F.col("file_id"))
    done = sinks.execute(indexed, filters.destination_root(settings.destination), a.move, dry_run=settings.dry_run)
    _show(done, a.out)
    return OK


def _show(rows, out: str | None) -> None:
    if out:
        rows.write.mode("overwrite").json(out)
    else:
        rows.show(20, False)


if __name__ == "__main__":
    sys.exit(main())
