"""Statement resolution as a stream: the state of each connection is kept by name and by turn."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RESOLVED = "conn int, seq bigint, kind string, stmt string, sql string, resolved boolean, oids array<bigint>"


class Connection(StatefulProcessor):
    """Statements by name, describes that wait for their answer in order, and parameter types by name.

    parse and close change what a name stands for; bind is resolved from it; describe queues its name, and a parameter
    description ("t") gives its types to the name that has waited longest.  A bind has types only if as many
    as it has values.  A row description ("T") is about the name that was answered last; without one it is unresolved.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.statements = handle.getMapState("statements", "stmt string", "sql string")
        self.waiting = handle.getListState("waiting", "stmt string")
        self.types = handle.getMapState("types", "stmt string", "oids array<bigint>")
        self.last = handle.getValueState("last", "stmt string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if not frames:
            return
        out = []
        waiting = [w[0] for w in self.waiting.get()] if self.waiting.exists() else []
        for r in pd.concat(frames).sort_values("seq").itertuples(index=False):
            name = (r.stmt if isinstance(r.stmt, str) else "",)
            if r.kind == "parse":
                self.statements.updateValue(name, (r.sql,))
            elif r.kind == "close":
                self.statements.removeKey(name)
            elif r.kind == "describe":
                waiting.append(name[0])
            elif r.kind == "t" and waiting:
                about = (waiting.pop(0),)
                self.types.updateValue(about, (list(r.oids),))
                self.last.update(about)
            elif r.kind == "T":
                about = self.last.get()[0] if self.last.exists() else ""
                out.append((int(key[0]), int(r.seq), "T", about, None, about != "", list(r.oids)))
            elif r.kind == "bind":
                known = self.statements.containsKey(name)
                sql = self.statements.getValue(name)[0] if known else None
                oids = list(self.types.getValue(name)[0]) if self.types.containsKey(name) else None
                fits = oids is not None and len(oids) == int(r.n_params)
                out.append((int(key[0]), int(r.seq), "bind", name[0], sql, known, oids if fits else None))
            elif r.kind == "query":
                out.append((int(key[0]), int(r.seq), "query", None, r.sql, True, None))
        self.waiting.put([(w,) for w in waiting]) if waiting else self.waiting.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESOLVED.split(", ")])

    def close(self) -> None:
        pass


def resolve_stream(events: DataFrame) -> DataFrame:
    """Binds, queries and row descriptions of a stream of events (conn, seq, kind, stmt, sql, n_params, oids), resolved.

    Needs the RocksDB state store.  Within a batch events are ordered by seq; batches must come in order.
    """
    return events.groupBy("conn").transformWithStateInPandas(Connection(), outputStructType=RESOLVED, outputMode="Append", timeMode="None")


def to_folder(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream as JSON lines, a folder for each batch; a batch that is run again replaces its own, so nothing comes twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{path}/batch={number}")

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
