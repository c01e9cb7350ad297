"""``python -m rulespark <store> <command>``: status, ingest, changes, decide, apply, publish, ask."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rulespark import pipeline
from rulespark.operators import profile, publish
from rulespark.sources import files
from rulespark.sources.sinks import Store


def _status(store: Store, args: argparse.Namespace) -> object:
    tables = {t: store.read(t) for t in store.tables()}
    out = {"tables": {r.table_name: r.n for r in profile.table_counts(tables).collect()} if tables else {}}
    if "staging" in tables:
        out["staging"] = {r.status: r.n for r in profile.breakdown(tables["staging"], "status").collect()}
        if args.failed:
            rows = tables["staging"].filter("publish_error is not null").orderBy(F.desc("updated_at"), "extraction_id").limit(20)
            out["failed"] = [r.asDict() for r in rows.select("extraction_id", "publish_error").collect()]
    if args.sample and "policies" in tables:
        out["sample"] = [r.asDict() for r in profile.json_rows(profile.sample_rows(tables["policies"], ["policy_id"])).collect()]
    return out


def _ingest(store: Store, args: argparse.Namespace) -> object:
    batch = pipeline.create_batch(store, "command line", "cli")
    read = files.documents(store.spark, args.path)
    rows = read.filter("text is not null").select("source_uri", F.col("text").alias("raw_content"), F.element_at(F.split("source_uri", "/"), -1).alias("title"), F.col("kind").alias("doc_type"), F.lit(1).alias("seq"))
    staged = pipeline.ingest_batch(store, batch, rows)
    out = {"batch_id": batch, "extractions": staged.count(), "unreadable": [r.asDict() for r in read.filter("text is null").select("source_uri", "error").limit(100).collect()]}
    out["requests"] = [r.request_id for r in pipeline.plan_changes(store.spark, store, batch).collect()]
    if not args.no_apply:
        out["changes"] = pipeline.apply_changes(store, "command line")
    if not args.no_publish:
        pipeline.publish_batch(store, batch)
    return out


def _changes(store: Store, args: argparse.Namespace) -> object:
    return [r.asDict(recursive=True) for r in profile.json_rows(store.read("schema_change_requests").orderBy(F.desc("created_at"), "request_id").limit(200)).collect()]


def _decide(store: Store, args: argparse.Namespace) -> object:
    pipeline.decide(store, args.ids, args.decision, args.by, args.note)
    return {"decided": args.ids}


def _apply(store: Store, args: argparse.Namespace) -> object:
    return pipeline.apply_changes(store, "command line")


def _publish(store: Store, args: argparse.Namespace) -> object:
    return [r.asDict() for r in pipeline.publish_batch(store, args.batch).select("batch_id", "total", *publish.STATES).limit(100).collect()]


def _ask(store: Store, args: argparse.Namespace) -> object:
    got = pipeline.ask(store, args.question, batch_id=args.batch, context=pipeline.snapshot_context(store))
    return got if args.json else got["answer"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> object:
    top = argparse.ArgumentParser(prog="rulespark")
    top.add_argument("store", help="folder of the tables")
    commands = top.add_subparsers(dest="command", required=True)
    add = lambda name, run: (p := commands.add_parser(name)).set_defaults(run=run) or p
    status = add("status", _status)
    status.add_argument("--sample", action="store_true")
    status.add_argument("--failed", action="store_true")
    load = add("ingest", _ingest)
    load.add_argument("path")
    load.add_argument("--no-apply", action="store_true")
    load.add_argument("--no-publish", action="store_true")
    add("changes", _changes)
    decide = add("decide", _decide)
    decide.add_argument("decision", choices=("approved", "rejected"))
    decide.add_argument("ids", nargs="+")
    decide.add_argument("--by", default="command line")
    decide.add_argument("--note", default="")
    add("apply", _apply)
    add("publish", _publish).add_argument("--batch")
    ask = add("ask", _ask)
    ask.add_argument("question")
    ask.add_argument("--batch")
    ask.add_argument("--json", action="store_true")
    args = top.parse_args(argv)
    said = args.run(Store(spark or SparkSession.builder.appName("rulespark").getOrCreate(), args.store), args)
    print(said if isinstance(said, str) else json.dumps(said, indent=1, default=str))
    return said


if __name__ == "__main__":
    main()
