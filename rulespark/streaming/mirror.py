"""The event mirror: an append-only sink and a latest-state table, fed by a stream of policy events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rulespark.functions import payload
from rulespark.operators.ingest import latest_per_key, new_only
from rulespark.operators.publish import current_state
from rulespark.sources.sinks import Store

EVENT = "event_id string, policy_id string, batch_id string, event_type string, event_time timestamp, payload_json string"


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events once by id; state older than the watermark is dropped, and so are events that are."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def counts(events: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("event_time", delay).groupBy(F.window("event_time", window), "event_type").agg(F.count("*").alias("n"))


def current(store: Store) -> DataFrame | None:
    """The latest state of each policy: the buckets side by side."""
    parts = [store.read(t) for t in store.tables() if t.startswith("policies_current_")]
    return reduce(DataFrame.unionByName, parts) if parts else None


def current_fields(store: Store, hints: dict[str, str]) -> DataFrame | None:
    """The latest state of each policy with the fields of its payload by their type hints (``payload.read``)."""
    rows = current(store)
    return None if rows is None else payload.read(rows, "payload_json", hints)


def _fresh(store: Store, events: DataFrame) -> DataFrame:
    """The events whose id their day has not seen, with ``_day``; of the store only those days are read."""
    days = {f"_day={r._day}" for r in events.select("_day").distinct().collect()}  # the days of one batch
    have = store.read("policy_events", days)
    return events if have is None else new_only(events, have.select("event_id"), "event_id")


def _latest(store: Store, seen: DataFrame) -> DataFrame:
    """The latest state of each policy in the buckets that ``seen`` touches, with ``_bucket``; of equal times the new one."""
    touched = [r._bucket for r in seen.select("_bucket").distinct().collect()]  # ``buckets`` numbers at most
    known = [t for b in touched if (t := store.read(f"policies_current_{b:04d}")) is not None]
    if not known:
        return seen
    columns = ["policy_id", "payload_json", "updated_at"]
    old = reduce(DataFrame.unionByName, [t.select(*columns) for t in known]).withColumn("_new", F.lit(0))
    both = seen.select(*columns, F.lit(1).alias("_new")).unionByName(old)
    return latest_per_key(both, ["policy_id"], [F.desc_nulls_last("updated_at"), F.desc("_new")]).select(*columns)


def start(events: DataFrame, store: Store, checkpoint: str, once: bool = True, buckets: int = 64) -> StreamingQuery:
    """Append events and bring the latest state of each policy up to date; a batch that comes twice changes nothing.

    An event is never too late, there is no watermark. Repeats of an event have its id and its time: they
    go within a batch, and by the ids of the days that a batch touches, which are all of the history it
    reads. Policies are kept in ``buckets`` tables by hash of their id, and a batch reads and rewrites
    those it touches. Events and states are one write each, and one commit together.
    """
    bucket = F.pmod(F.xxhash64("policy_id"), F.lit(buckets)).cast("int")

    def batch(df: DataFrame, _: int) -> None:
        df = df.dropDuplicates(["event_id"]).withColumn("_day", F.coalesce(F.date_format("event_time", "yyyyMMdd"), F.lit("none"))).persist()
        seen = current_state(df).withColumn("_bucket", bucket).persist()
        try:
            with store.transaction():
                store.write_parts("policy_events", _fresh(store, df), "_day", lambda day: "policy_events", add=True)
                store.write_parts("policies_current", _latest(store, seen).withColumn("_bucket", bucket), "_bucket", lambda b: f"policies_current_{int(b):04d}", add=False)
        finally:
            seen.unpersist()
            df.unpersist()

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
