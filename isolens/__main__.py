"""Command line: infer, verify, audit, triage, capture.

Standard output holds the report, or nothing where the row filters are not proven.  Exit codes: 0, 1 (input or output), 2
(usage), 3 (ceiling exceeded), 10 to 13 (the first control that failed).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolens.functions import statements as st
from isolens.functions import wire
from isolens.operators import audit, diff, infer, proof, resolve, triage
from isolens.operators.rowfilter import Legs
from isolens.session import session
from isolens.sources import files


def _relations(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def _policy(spark: SparkSession, path: str) -> list:
    """Scoped relations of an accepted policy; a policy is small by nature."""
    return files.read_policy(spark, path).filter("class = 'scoped'").collect()


def run_infer(spark: SparkSession, a: argparse.Namespace) -> int:
    found = infer.infer(infer.catalog(spark, _relations(spark, a.data, a.relations)))
    if a.out:
        files.write_policy(found, a.out)
    for r in found.orderBy("schema", "name").collect():
        print(r.schema, r.name, r["class"], r.tenant_column or "-", r.reason, sep="\t")
    return 0


def run_verify(spark: SparkSession, a: argparse.Namespace) -> int:
    scoped = _policy(spark, a.policy)
    if not scoped:
        print("the policy has no scoped relation", file=sys.stderr)
        return audit.EXIT["usage"]
    relations = _relations(spark, a.data, [r.name for r in scoped])
    proven = proof.prove_policy(spark, relations, scoped, proof.Role(a.role, a.superuser, a.bypass)).cache()
    if not proof.accounted(proven, spark.createDataFrame([(r.name,) for r in scoped], "name string")).first().accounted:
        print("not proven: a scoped relation is neither seeded nor skipped", file=sys.stderr)
        return 1
    total = proof.aggregate(proven).first()
    if not total.proven:
        print(f"not proven: {total.first_failure}", file=sys.stderr)
        return audit.EXIT[total.first_failure]
    written = audit.text if a.output == "text" else audit.document
    if a.command == "verify":
        sys.stdout.writelines(written(audit.head(None, proven, a.shared_database), None))
        return 0
    seeded = {r.table for r in proven.filter("seeded").collect()}
    own = [r for r in scoped if r.name in seeded]
    events = audit.judged_events(files.read_events(spark, a.events))
    known = events.groupBy("sql", "params").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.sha2(F.concat_ws("\x1f", "sql", F.to_json("params")), 256)).cache()
    legs = Legs(spark, {n: df for n, df in relations.items()}, {r.name: r.tenant_column for r in own})
    unfiltered = proof.unconfirmed(legs)
    if unfiltered:
        print(f"not proven: A4, no filter in the plan of {', '.join(unfiltered)}", file=sys.stderr)
        return audit.EXIT["A4"]
    keys = {r.name: [k for k in (r.primary_key, *(r.unique_keys or [])) if k] for r in own}
    captured = diff.as_captured(known.toLocalIterator())
    found = diff.verdicts_table(spark, diff.diff_reads(legs, captured, [st.Scoped(r.name, r.tenant_column) for r in own], keys))
    verdicts = audit.with_population(found.join(known, "id"), [r.name for r in own], [r.name for r in scoped if r.name not in seeded]).cache()
    sys.stdout.writelines(written(audit.head(verdicts, proven, a.shared_database), audit.queries(verdicts).orderBy("verdict", "sql", F.to_json("params"))))
    return audit.EXIT["ceiling"] if audit.ceiling(audit.rates(audit.counts(verdicts))).first().exceeded else 0


def run_triage(spark: SparkSession, a: argparse.Namespace) -> int:
    sources = files.read_sources(spark, a.root)
    if a.output == "json":
        print(triage.report(sources, a.root).first().report)
        return 0
    print(triage.LABEL)
    for r in triage.suspicions(triage.statements(sources)).orderBy("rank").collect():
        print(f"{r.rank}. {r.file}:{r.line} {r.verb} {r.table} ({r.confidence:.2f}): {r.reason}")
    return 0


def run_capture(spark: SparkSession, a: argparse.Namespace) -> int:
    """Frames of both directions (Parquet) to events (JSON lines); the answers of the server give the types of binary parameters."""
    found = resolve.captured(resolve.protocol_events(wire.messages(files.read_frames(spark, a.frames), startup=a.startup)))
    files.write_events(found.drop("seq"), a.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="isolens", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, run in (("infer", run_infer), ("verify", run_verify), ("audit", run_verify), ("triage", run_triage), ("capture", run_capture)):
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        if name in ("infer", "verify", "audit"):
            s.add_argument("--data", required=True, help="folder with a Parquet table for each relation")
        if name == "infer":
            s.add_argument("--out")
            s.add_argument("relations", nargs="+")
        if name in ("verify", "audit"):
            s.add_argument("--policy", required=True)
            s.add_argument("--role", default="restricted", help="role that the application connects as")
            s.add_argument("--superuser", action="store_true", help="the role is a superuser")
            s.add_argument("--bypass", action="store_true", help="the role bypasses row filters")
            s.add_argument("--shared-database", action="store_true", help="say in the report that the tests of the application share a database")
            s.add_argument("--output", choices=("json", "text"), default="json")
        if name == "audit":
            s.add_argument("--events", required=True)
        if name == "triage":
            s.add_argument("root")
            s.add_argument("--output", choices=("json", "text"), default="json")
        if name == "capture":
            s.add_argument("--frames", required=True)
            s.add_argument("--out", required=True)
            s.add_argument("--startup", action="store_true", help="connections were captured from their first byte")
    a = p.parse_args(argv)
    try:
        return a.run(session("isolens"), a)
    except OSError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
