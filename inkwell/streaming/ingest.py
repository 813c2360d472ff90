"""Streams: files that are dropped into a folder, and answers that are masked while they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.answer import MaskingStream
from ..operators.guard import Matcher, Registry
from ..operators.ingest import ingest
from ..operators.store import Store
from ..sources.files import BINARY, named


def watch(spark: SparkSession, folder: str, store: Store, registry: Callable[[], Registry], key: bytes, factory: Callable, checkpoint: str, once: bool = False, **settings) -> StreamingQuery:
    """Ingest what appears below a folder. A batch that is replayed after a crash finds its files unchanged and does nothing."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).load(folder)

    def batch(df: DataFrame, _: int) -> None:
        rows = named(df, folder)
        if not rows.isEmpty():
            ingest(store, rows, registry(), key, factory, **settings)

    out = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="10 seconds")).start()


def mask_answers(deltas: DataFrame, matcher: Matcher) -> DataFrame:
    """answer_id, text of a stream of deltas (answer_id string, n long, delta string, last boolean).

    The state of an answer is its raw text and how much of the masked text is out; the end is held back for as long
    as a protected name may still be growing there, so a name that is split over deltas or batches never leaves.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, sent = state.get if state.exists else ("", 0)
        stream = MaskingStream(matcher, text, sent)
        rows = pd.concat(list(frames)).sort_values("n")
        out = "".join(map(stream.push, rows["delta"].fillna("")))
        if rows["last"].any():
            out += stream.close()
            state.remove()
        else:
            state.update((stream.text, stream.sent))
        if out:
            yield pd.DataFrame({"answer_id": [key[0]], "text": [out]})

    return deltas.groupBy("answer_id").applyInPandasWithState(step, "answer_id string, text string", "text string, sent int", "append", GroupStateTimeout.NoTimeout)


def progress(events: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Counts of progress events (ts, event_type) in windows of time, late ones up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"))
