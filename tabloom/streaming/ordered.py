"""Results that come in any order are committed in theirs, each once: a stream whose state is what has to wait.

Workers finish pairs of versions in any order and many workbooks at a time. Per workbook the state holds the next
sequence number and the results that wait for it, in a map on disk (RocksDB), so a workbook with a long queue takes no
memory. A result whose turn it is goes out at once, with those that waited for it; one that was given out already, or
that waits already, is dropped. After a restart the stream goes on from its checkpoint, and the sink, Trail.commit, leaves
out pairs that are done, so what a broken batch had written is not written again.

Sequences of a key begin with 1 and have no gaps; a result without a sequence ends the stream with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

from ..plans.trail import KEYS, Trail

#: Fixed value: the state store that keyed maps need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What a worker says of a pair that it has compared; its changes are staged in a table of their own.
RESULTS = "workbook_id bigint, sequence bigint, previous_id string, current_id string, digest string, changes bigint"


class InOrder(StatefulProcessor):
    """Gives out the rows of a key by ascending sequence, without gaps."""

    def __init__(self, sequence: str, columns: list[str], payload: StructType):
        self.sequence, self.columns, self.payload = sequence, columns, payload

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "sequence bigint, waiting bigint")
        self.waiting = handle.getMapState("waiting", "sequence bigint", self.payload)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, held = tuple(self.next.get()) if self.next.exists() else (1, 0)
        row_of = Row(*self.columns)
        for row in rows:
            n = row[self.sequence]
            if n is None:
                raise ValueError(f"a result of {key} has no {self.sequence}")
            if n < at:
                continue
            if n > at:
                if not (held and self.waiting.containsKey((n,))):
                    self.waiting.updateValue((n,), tuple(row[c] for c in self.payload.names))
                    held += 1
                continue
            yield row_of(*[row[c] for c in self.columns])
            at += 1
            while held and self.waiting.containsKey((at,)):
                own = {**{k: row[k] for k in self.columns if k not in self.payload.names}, self.sequence: at, **dict(zip(self.payload.names, self.waiting.getValue((at,)), strict=True))}
                yield row_of(*[own[c] for c in self.columns])
                self.waiting.removeKey((at,))
                at, held = at + 1, held - 1
        self.next.update((at, held))

    def close(self) -> None:
        pass


def in_order(results: DataFrame, key: list[str], sequence: str = "sequence") -> DataFrame:
    """The rows of a stream that can be committed now, in the order of their sequence within each key."""
    results.sparkSession.conf.set(*PROVIDER)
    payload = StructType([StructField(f.name, f.dataType) for f in results.schema if f.name not in key and f.name != sequence])
    whole = StructType([StructField(f.name, f.dataType) for f in results.schema])
    return results.groupBy(*key).transformWithState(InOrder(sequence, results.columns, payload), whole, "Append", "None")


def start_commits(results: DataFrame, changes: DataFrame, trail: Trail, checkpoint: str, run_id: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Commit a stream of RESULTS in order; changes is the table in which their changes are staged.

    The checkpoint of a workbook moves with what is committed, and so only over pairs without a gap before them.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        now = trail.stage(rows)
        pairs = now.withColumns({"run_id": F.lit(run_id).cast("bigint"), "status": F.when(F.col("changes") > 0, "PROCESSADA").otherwise("SEM_ALTERACOES"), "pair_id": F.xxhash64(*KEYS["pair"])}).drop("sequence")
        last = now.groupBy("workbook_id").agg(F.max_by("current_id", "sequence").alias("version_id"))
        trail.commit(pairs, changes.join(now.select(*KEYS["pair"]), KEYS["pair"], "left_semi"), last)
        trail.discard_staging()

    writer = in_order(results, ["workbook_id"]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def committed(spark: SparkSession, results: DataFrame, key: list[str], sequence: str, folder: str) -> DataFrame:
    """Run in_order over what a streaming table holds now; folder keeps the rows and the stream's place."""
    out = in_order(results, key, sequence)
    out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")
