"""The episode state machine over arriving steps: keyed state, checkpoints, the same result as in batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.episodes import STEP, State, transition

_FIELDS = "anchor string, active string, initialized boolean, boot boolean, bootstrap_branch string, episodes long, launches long, streak long, slept_s long, error string, ended boolean"
OUTPUT = "run string, seq long, " + _FIELDS.replace("boot boolean, ", "")
_REST = STEP.removeprefix("run string, seq long, ")
_NAMES = [c.split()[0] for c in _REST.split(", ")]


class Tracker(StatefulProcessor):
    """State of a run, and the steps that came before their turn.

    Steps of a run are numbered from 1 without gaps. Each is taken in its turn however the
    micro-batches bring them: one that is early waits in the state, one that comes again changes
    nothing.
    """

    def __init__(self, begin: State, max_episodes: int):
        self.begin, self.max_episodes = begin, max_episodes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "next long, " + _FIELDS)
        self.waiting = handle.getMapState("waiting", "seq long", _REST)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        turn, *state = self.state.get() if self.state.exists() else (1, *self.begin)
        early = {}
        for r in rows:
            if r.seq >= turn:
                early[r.seq] = tuple(r[n] for n in _NAMES)
        began = turn
        while True:
            step = early.pop(turn, None)
            if step is None and self.waiting.containsKey((turn,)):
                step = tuple(self.waiting.getValue((turn,)))
                self.waiting.removeKey((turn,))
            if step is None:
                break
            state, turn = transition(tuple(state), dict(zip(_NAMES, step, strict=True)), self.max_episodes), turn + 1
        for seq, step in early.items():
            self.waiting.updateValue((seq,), step)
        self.state.update((turn, *state))
        if turn > began:
            yield Row(run=key[0], seq=turn - 1, **{n.split()[0]: v for n, v in zip(_FIELDS.split(", "), state, strict=True) if n != "boot boolean"})

    def close(self) -> None:
        pass


def track(steps: DataFrame, anchor: str, initialized: bool = True, max_episodes: int = 0) -> DataFrame:
    """Streaming ``steps`` (the columns of ``STEP``) to the state of each run after every micro-batch that moved it.

    Every run begins at ``anchor``, without an active branch.
    """
    begin: State = (anchor, "", initialized, not initialized, None, 0, 0, 0, 0, None, False)
    return steps.groupBy("run").transformWithState(Tracker(begin, max_episodes), OUTPUT, "Append", "None")


def run_to_end(tracked: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has arrived, then stop; started again with the same checkpoint, it goes on where it was.

    State is kept in RocksDB, which holds more than fits in memory.
    """
    conf, key = tracked.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = tracked.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(key, before) if before else conf.unset(key)
