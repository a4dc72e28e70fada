"""A journal as a stream: the state of a repository's walk, entry by entry. Equals operators.replay on the same entries."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COUNTERS = ("resolutions", "checkout_failed", "unresolved", "code_rows", "transplanted", "transplanted_clean", "minted")
OUTPUT = ", ".join(["repo int", "seen long", "live boolean", "walked long", "resumed_from string", *(f"{c} long" for c in COUNTERS), "digests map<string, string>"])


class Replay(StatefulProcessor):
    """[INC03 as a stream, an extension] Counters, walked commits and last digests of a key; void while its last header does not fit.

    Entries arrive in journal order from one trigger to the next; inside a trigger they are put in order here. Commits and digests
    are map states, a row each in the state store, so a key's state need not fit in memory; what a trigger brings of one key does.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.force = handle.getValueState("force", "fits boolean")
        self.counts = handle.getValueState("counts", "state string")
        self.commits = handle.getMapState("commits", "commit string", "seq long")
        self.digests = handle.getMapState("digests", "id string", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fits = bool(self.force.get()[0]) if self.force.exists() else False
        s = json.loads(self.counts.get()[0]) if self.counts.exists() else {"seen": 0, "live": False, "walked": 0, "last": None} | dict.fromkeys(COUNTERS, 0)
        for e in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            s["seen"] += 1
            if e.kind == "header":
                fits = bool(e.fits)
            elif fits:
                s["live"] = True
                if e.kind == "commit":
                    self.commit(s, e)
        self.force.update((fits,))
        self.counts.update((json.dumps(s),))
        digests = {k[0]: v[0] for k, v in self.digests.iterator()}
        yield pd.DataFrame({"repo": [int(key[0])], "seen": [s["seen"]], "live": [s["live"]], "walked": [s["walked"]], "resumed_from": [s["last"]], **{c: [s[c]] for c in COUNTERS}, "digests": [digests]})

    def commit(self, s: dict, e) -> None:
        if not self.commits.containsKey((e.commit,)):
            s["walked"] += 1
            self.commits.updateValue((e.commit,), (int(e.seq),))
        s["last"] = e.commit
        s["resolutions"] += e.resolved is True
        if e.outcome in ("checkout_failed", "pubspec_unresolved"):
            s["checkout_failed" if e.outcome == "checkout_failed" else "unresolved"] += 1
            return
        for r in [] if e.rows is None else e.rows:
            s["code_rows"] += 1
            self.digests.updateValue((r["id"],), (r["digest"],))
            if r["status"] == "isolated":
                s["transplanted"] += 1
                s["transplanted_clean"] += bool(r["clean"])
        s["minted"] += 0 if e.new_groups is None else len(e.new_groups)

    def close(self) -> None:
        pass


def replayed(spark: SparkSession, path: str, schema: str, checkpoint: str, name: str) -> DataFrame:
    """Run a folder of journal files to its end, a file a trigger in order of time; the last state of each repository that has a live entry.

    The stream writes each changed state to a table named `name`, in memory; a job that goes on for ever would upsert it instead.
    """
    provider = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        states = source.groupBy("repo").transformWithStateInPandas(Replay(), OUTPUT, "Append", "None")
        states.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, was)
    return spark.table(name).groupBy("repo").agg(F.max_by(F.struct("*"), "seen").alias("m")).select("m.*").filter("live")
