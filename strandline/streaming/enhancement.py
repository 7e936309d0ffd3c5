"""The closed loop over a stream of recordings: one state for each item, one attempt at a time.

The hooks are plain functions: ``executor(audio, plan) -> audio``, ``measure(audio) -> {metric: value}`` and
``reviser(plan, before, after) -> plan or None``, where a plan is a list of (kind, value). The state of an item
holds its source, its metrics and the plan to try next; once it is decided only the decision stays, and goes when ``forget`` has passed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandline.functions import dsp
from strandline.operators.closed_loop import MAX_ACTIONS, WEIGHTS

ITEMS = "sample_id string, audio array<float>, plan array<struct<kind:string,value:double>>"
OUT = "sample_id string, attempt int, plan array<struct<kind:string,value:double>>, utility_gain double, decision string, kept_audio array<float>"
Plan = list[tuple[str, float]]
Metrics = dict[str, float | None]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_UNIT = {
    "si_sdr": lambda x: 1 / (1 + math.exp(-x / 6)),
    "pesq": lambda x: (x - 1) / 3.5,
    "dnsmos": lambda x: (x - 1) / 4,
    "wer": lambda x: 1 - min(1.0, max(0.0, x)),
}


def utility(metrics: Metrics) -> float:
    """The weighted mean of the metrics that there are, as ``operators.closed_loop.utility``."""
    given = [(w, min(1.0, max(0.0, _UNIT.get(k, float)(metrics[k])))) for k, w in WEIGHTS.items() if metrics.get(k) is not None]
    if not given:
        raise ValueError("no objective metric")
    return sum(w * v for w, v in given) / sum(w for w, _ in given)


def sound(plan: Plan) -> Plan:
    """The plan, if it has no fault."""
    limits = {"gain": 4.0, "spectral_gate": 1.0, "dc_remove": math.inf}
    if not 1 <= len(plan) <= MAX_ACTIONS:
        raise ValueError("a plan has one to eight actions")
    for kind, value in plan:
        if kind not in limits or not math.isfinite(value) or kind != "dc_remove" and not 0 <= value <= limits[kind]:
            raise ValueError(f"{kind}: not a valid action")
    return plan


class EnhancementLoop(StatefulProcessor):
    """Makes the attempts of each item until one is accepted or none is left.

    The first row of an id starts it; later rows of that id are repeats and change nothing. A revised plan is tried when a timer fires, in a batch
    of its own, so that a batch makes one attempt an item at most and a restart goes on with the attempt that comes next. Without
    timers (``paced`` false, for runs over what is there) all attempts of an item are made when it comes.
    """

    def __init__(
        self,
        measure: Callable[[np.ndarray], Metrics],
        reviser: Callable[[Plan, Metrics, Metrics], Plan | None] | None = None,
        max_revisions: int = 0,
        min_gain: float = 0.0,
        executor: Callable[[np.ndarray, Plan], np.ndarray] = dsp.acted,
        paced: bool = True,
        forget_ms: int = 24 * 3600 * 1000,
    ):
        if max_revisions < 0:
            raise ValueError("max_revisions cannot be negative")
        self.measure, self.reviser, self.executor = measure, reviser, executor
        self.max_revisions, self.min_gain, self.paced, self.forget_ms = max_revisions, min_gain, paced, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "audio binary, before string, plan string, attempt int")
        self.decided = handle.getValueState("decided", "decision string")

    def close(self) -> None:
        pass

    def _attempt(self, key: tuple, audio: np.ndarray, before: Metrics, plan: Plan, at: int) -> tuple[Row, Plan | None]:
        candidate = self.executor(audio, sound(plan))
        after = self.measure(candidate)
        gain = utility(after) - utility(before)
        revised = None
        if gain >= self.min_gain:
            decision = "accept"
        else:
            revised = self.reviser(plan, before, after) if self.reviser and at < self.max_revisions else None
            decision = "rollback" if revised is None else "revise"
        kept = {"accept": candidate, "rollback": audio}.get(decision)
        row = Row(
            sample_id=key[0],
            attempt=at + 1,
            plan=[Row(kind=k, value=float(v)) for k, v in plan],
            utility_gain=float(gain),
            decision=decision,
            kept_audio=None if kept is None else np.asarray(kept, float).tolist(),
        )
        return row, revised

    def _go_on(self, key: tuple, audio: np.ndarray, before: Metrics, plan: Plan, at: int, timers) -> Iterator[Row]:
        while True:
            row, plan = self._attempt(key, audio, before, plan, at)
            yield row
            at += 1
            if plan is None:
                self.open.clear()
                self.decided.update((row["decision"],))
                if self.paced:
                    self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.forget_ms)
                return
            if self.paced:
                self.open.update((audio.tobytes(), json.dumps(before), json.dumps(plan), at))
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + 1)
                return

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = next(rows)
        for _ in rows:
            pass
        if self.open.exists() or self.decided.exists():
            return
        audio = np.asarray(first["audio"] or [], np.float32)
        if not len(audio):
            raise ValueError("audio must be a non-empty mono waveform")
        plan = [(a["kind"], a["value"] or 0.0) for a in first["plan"] or []]
        yield from self._go_on(key, audio, self.measure(audio), plan, 0, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.open.exists():
            self.decided.clear()
            return
        audio, before, plan, at = self.open.get()
        yield from self._go_on(key, np.frombuffer(bytes(audio), np.float32), json.loads(before), [tuple(a) for a in json.loads(plan)], at, timerValues)


def enhanced(stream: DataFrame, loop: EnhancementLoop) -> DataFrame:
    """A row for each attempt of each item of ``stream`` (sample_id, audio, plan); the deciding one has the audio that is kept."""
    keep_states_on_disk(stream.sparkSession)
    return stream.groupBy("sample_id").transformWithState(loop, OUT, "Append", "ProcessingTime" if loop.paced else "None")


def keep_states_on_disk(spark: SparkSession) -> None:
    """State of this kind needs the store that holds it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
