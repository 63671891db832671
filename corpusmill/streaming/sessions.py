"""Conversation memory on a stream: the last few clean exchanges per conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmill.functions import patterns as P
from corpusmill.functions.screening import has_pii

OUT = "conv_id bigint, turn bigint, transcript string, n_turns int"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastTurns(StatefulProcessor):
    """Keeps the last ``turns`` exchanges of a conversation, by turn; a row with ``clear`` set forgets those before it.

    A key's rows of one micro-batch may come in several Arrow batches; they are put in order together before any of them
    is answered, so the number of rows in a micro-batch, which the source's limits set, bounds what a key holds. A turn
    that comes in a later micro-batch than a newer one is answered from what is remembered of the turns before it and
    takes its place among them; transcripts already emitted stay as they are.
    """

    def __init__(self, turns: int = P.HISTORY_TURNS):
        self.turns = turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getListState("memory", "turn bigint, shown string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.memory.get()]
        arrived = pd.concat(list(rows), ignore_index=True).sort_values("turn", kind="stable")
        out = []
        for r in arrived.itertuples(index=False):
            turn = int(r.turn)
            if r.clear:
                kept = [x for x in kept if x[0] > turn]
                continue
            before = [shown for t, shown in kept if t < turn][-self.turns:]
            out.append((key[0], turn, "\n".join(before), len(before)))
            kept = sorted([*kept, (turn, r.shown)], key=lambda x: x[0])[-self.turns:]
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "turn", "transcript", "n_turns"])
        self.memory.clear()
        if kept:
            self.memory.appendList(kept)

    def close(self) -> None:
        pass


class TurnsInOrder(StatefulProcessor):
    """The same by event time: a turn waits until the watermark has passed it, so no earlier one can come any more, and then all
    that are due are answered in order. What was dropped behind the watermark is in no transcript.

    A conversation holds its waiting turns, which the watermark's delay bounds, and the last ``turns`` ones. ``ttl`` milliseconds after
    its last turn, in event time, it is forgotten; a timer sees to that, so silent conversations leave no state.
    """

    def __init__(self, turns: int, ttl: int):
        self.turns, self.ttl = turns, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, turn bigint, clear boolean, shown string")
        self.memory = handle.getListState("memory", "turn bigint, shown string")
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = [(int(r.at), int(r.turn), bool(r.clear), r.shown) for df in rows for r in df.itertuples(index=False)]
        self.waiting.appendList(arrived)
        for at in {a for a, *_ in arrived}:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[1], r[0]))
        due, later = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]
        last = self.last.get()[0] if self.last.exists() else None
        kept, out = [tuple(r) for r in self.memory.get()], []
        for at, turn, clear, shown in due:
            if last is not None and at >= last + self.ttl:
                kept = []  # silent for too long, whether or not its timer came first
            last = at if last is None else max(last, at)
            if clear:
                kept = [x for x in kept if x[0] > turn]
                continue
            before = [s for t, s in kept if t < turn][-self.turns:]
            out.append((key[0], turn, "\n".join(before), len(before)))
            kept = sorted([*kept, (turn, shown)], key=lambda x: x[0])[-self.turns:]
        if last is not None and last + self.ttl <= now:
            kept, last = [], None
        self.keep(later, kept, last)
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "turn", "transcript", "n_turns"])

    def keep(self, later: list, kept: list, last: int | None) -> None:
        for state, rows in ((self.waiting, later), (self.memory, kept)):
            state.clear()
            if rows:
                state.put(rows)
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))
            self.handle.registerTimer(last + self.ttl)

    def close(self) -> None:
        pass


def clean_turns(exchanges: DataFrame, chars: int, *more: Column) -> DataFrame:
    """Exchanges without personal data, as they are remembered."""
    clean = exchanges.where(~has_pii(F.col("question")))
    return clean.select("conv_id", "turn", (F.col("clear") if "clear" in exchanges.columns else F.lit(False)).alias("clear"), F.concat(
        F.lit("User: "), "question", F.lit("\nAssistant: "), F.left("answer", F.lit(chars))).alias("shown"), *more)


def ordered_sessions(exchanges: DataFrame, event_time: str, delay: str = "10 minutes", ttl: str = "1 day",
                     turns: int = P.HISTORY_TURNS, chars: int = P.HISTORY_ANSWER_CHARS) -> DataFrame:
    """Transcript of the exchanges before each one, by event time: turns may come up to ``delay`` late and in any order, and
    are answered once, in order, when the watermark has passed them. After ``ttl`` of silence a conversation is forgotten.

    ``exchanges``: conv_id, turn, question, answer, the time column and optionally clear. Exchanges with personal data never
    reach the state; rows without a conversation or a time, or from before 1970, where watermarks begin, are left out.
    """
    timed = exchanges.where(F.col(event_time).isNotNull() & F.col("conv_id").isNotNull()).withWatermark(event_time, delay)
    rows = clean_turns(timed, chars, F.unix_millis(F.col(event_time)).alias("at"), F.col(event_time).alias("event_time"))
    return rows.groupBy("conv_id").transformWithStateInPandas(
        TurnsInOrder(turns, int(pd.Timedelta(ttl).total_seconds() * 1000)), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def stream_sessions(exchanges: DataFrame, turns: int = P.HISTORY_TURNS, chars: int = P.HISTORY_ANSWER_CHARS) -> DataFrame:
    """Transcript of the exchanges before each one. Exchanges with personal data never reach the state.

    ``exchanges``: conv_id, turn, question, answer and optionally clear.
    """
    return clean_turns(exchanges, chars).groupBy("conv_id").transformWithStateInPandas(
        LastTurns(turns), outputStructType=OUT, outputMode="append", timeMode="none")
