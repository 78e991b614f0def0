"""Occurrences as they arrive: a document's state, its barrier, and the changes that it sends out."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.grouping import Resolver, hit_of

#: What a row of the stream can be: an occurrence, the end of a detector, a new start, the end of the document.
KINDS = ("found", "regex_finished", "ner_finished", "reopened", "closed")
INPUT = "doc_id long, seq long, kind string, entity_type string, page_index int, value string, normalized_value string, source string, confidence double, bbox struct<x:double,y:double,width:double,height:double>"
CHANGES = "doc_id long, op string, group_id string, entity_type string, canonical_value string, index_in_type int, n_members long, enabled boolean"


class Session:
    """What is kept per document."""

    def __init__(self) -> None:
        self.state = Resolver()
        self.ended: set[str] = set()
        self.sent: dict[str, tuple] = {}

    def take(self, row: dict) -> None:
        if row["kind"] == "found":
            self.state.add(hit_of(row))
        elif row["kind"] == "reopened":
            self.ended.clear()
        else:
            self.ended.add(row["kind"])

    @property
    def ready(self) -> bool:
        """T4: both detectors have ended."""
        return {"regex_finished", "ner_finished"} <= self.ended

    def changes(self, doc_id: int) -> list[tuple]:
        """Groups created, updated or removed since the last time."""
        now = {}
        for n, x in self.state.finished():
            now[f"{doc_id}:{x.entity_type}:{n}"] = (x.entity_type, x.canonical, n, len(x.members), x.enabled)
        out = [(doc_id, "removed", k, v[0], v[1], v[2], v[3], v[4]) for k, v in self.sent.items() if k not in now]
        out += [(doc_id, "created" if k not in self.sent else "updated", k, *v) for k, v in now.items() if self.sent.get(k) != v]
        self.sent = now
        return out


def _step(idle_ms: int, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (doc_id,) = key
    names = [c.split()[0] for c in CHANGES.split(", ")]
    if state.hasTimedOut:
        # A document that nobody has touched for its time is forgotten
        state.remove()
        yield pd.DataFrame([], columns=names)
        return
    session = pickle.loads(state.get[0]) if state.exists else Session()  # noqa: S301 - written by this function alone
    rows = pd.concat(list(parts), ignore_index=True).sort_values("seq", kind="stable").to_dict("records")
    closed = False
    for row in rows:
        closed = closed or row["kind"] == "closed"
        if row["kind"] != "closed":
            session.take(row)
    out = session.changes(int(doc_id)) if session.ready else []
    if closed:
        state.remove()
    else:
        state.update((pickle.dumps(session),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame(out, columns=names)


def resolved(stream: DataFrame, idle_ms: int = 0) -> DataFrame:
    """The change rows of a stream of occurrences and control rows (INPUT). Repeats change nothing, as the
    identity of an occurrence is part of the state (T6). With idle_ms a document that nothing arrives for is forgotten
    (T7, T13); without, a run to the end of what is there can end."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _step(idle_ms, key, parts, state)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("doc_id").applyInPandasWithState(step, CHANGES, "session binary", "update", timeout)


def table_stream(spark: SparkSession, directory: str, name: str, files_per_trigger: int = 16) -> DataFrame:
    """A table's files as a stream that takes a bounded number at a time."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).parquet(f"{directory}/{name}.parquet")


def distinct_stream(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """T6 with bounded state: repeats within the lateness that is allowed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def dirty_pages(stream: DataFrame, time: str, every: str = "1 hour") -> DataFrame:
    """The pages touched in each interval, once."""
    return stream.withWatermark(time, every).groupBy(F.window(time, every), "doc_id", "page_index").agg(F.count("*").alias("n"))


def latest(batch: DataFrame, key: str, revision: str, priority: str) -> DataFrame:
    """Of requests on a key the newest counts, with the highest priority that any of them had."""
    return batch.groupBy(key).agg(F.max(revision).alias(revision), F.max(priority).alias(priority))


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """A stream run to the end of what is there, each micro-batch written to a folder of its own, which a batch that is
    run again overwrites; consumers of a batch fail alone."""
    spark = stream.sparkSession

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")
