"""Forward cursors as streams: a sorting writer with a bounded window, and range lookups, per contig."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sorted_writer(stream: DataFrame, key: str, pos: str, payload: str, window: int) -> DataFrame:
    """Records of each key in position order: (key, pos, payload, late).

    The watermark of a key is its largest position less ``window``; records at or under it are
    emitted, in order; a record that comes under a watermark already passed is emitted at once with
    ``late`` set, so a sink can stop on it as a strict writer does. At the end of the input call
    ``flush`` with what is left, or send a record far behind the last one.
    """
    kinds = dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, {pos} long, {payload} {kinds[payload]}, late boolean"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, at, what = state.get if state.exists else (-1, [], [])
        rows = pd.concat(list(batches), ignore_index=True)
        late = rows[rows[pos] < mark] if mark >= 0 else rows.iloc[:0]
        fresh = rows.drop(late.index)
        held = pd.concat([pd.DataFrame({pos: list(at), payload: list(what)}), fresh[[pos, payload]]], ignore_index=True)
        top = held[pos].max() if len(held) else mark
        mark = max(mark, int(top) - window, 0)
        held = held.sort_values([pos, payload], kind="stable", ignore_index=True)
        out, stay = held[held[pos] <= mark], held[held[pos] > mark]
        state.update((int(mark), [int(x) for x in stay[pos]], list(stay[payload])))
        yield pd.concat([late[[pos, payload]].assign(late=True), out.assign(late=False)]).assign(**{key: k[0]})[[key, pos, payload, "late"]]

    slim = stream.select(key, F.col(pos).cast("long").alias(pos), payload)
    state = f"mark long, at array<long>, what array<{kinds[payload]}>"
    return slim.groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def strict(written: DataFrame, key: str, pos: str) -> DataFrame:
    """The writer's rows without ``late``; a late record is an error, as positions must not go back beyond the window."""
    said = F.concat(F.lit("out of order at "), F.col(key).cast("string"), F.lit(":"), F.col(pos).cast("string"))
    return written.withColumn(pos, F.when(F.col("late"), F.raise_error(said).cast("long")).otherwise(F.col(pos))).drop("late")


def chunk_counts(stream: DataFrame, time: str, delay: str, width: str, *keys: str) -> DataFrame:
    """Tumbling windows over event time: rows of each window and key, late rows dropped after ``delay``."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


class ForwardCursor:
    """A strict cursor over position-sorted records of one contig for driver-side use: ranges must not go back."""

    def __init__(self, records: Iterator[tuple[int, object]]):
        self.records, self.held, self.next = iter(records), [], None
        self.start = self.stop = self.last = -1

    def seek(self, start: int, stop: int) -> list:
        """Records with start <= position <= stop."""
        if start < self.start or stop < self.stop:
            raise ValueError("the cursor only moves forward")
        self.start, self.stop = start, stop
        self.held = [r for r in self.held if r[0] >= start]
        while True:
            if self.next is None:
                self.next = next(self.records, None)
                if self.next is None:
                    break
                if self.next[0] < self.last:
                    raise ValueError("records are out of order")
                self.last = self.next[0]
            if self.next[0] > stop:
                break
            if self.next[0] >= start:
                self.held.append(self.next)
            self.next = None
        return [r for r in self.held if r[0] <= stop]
