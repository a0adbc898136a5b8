"""Model calls that fail alone: a bounded number in flight in each task, a time limit for each, a row for each failure."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Call = Callable[[str, list[dict[str, str]]], str]
OUTCOME = "struct<answer: string, error: string>"
#: Calls in flight in a task, seconds that one may take, and how many times the calls in flight may be late and still running.
IN_FLIGHT = 3
TIMEOUT = 75.0
LATE = 16
#: Outcomes that wait for an earlier row's, in multiples of the calls in flight.
AHEAD = 16


class _Running:
    """One call in a thread of its own.  What ends it first, its answer or its time limit, is its outcome."""

    def __init__(self, call: Call, model: str, parts: list[dict[str, str]], timeout: float, slots: threading.Semaphore) -> None:
        self.deadline, self.timeout, self.slots = time.monotonic() + timeout, timeout, slots
        self.outcome: dict[str, str | None] | None = None
        self.lock, self.over = threading.Lock(), threading.Event()
        self.thread = threading.Thread(target=self._work, args=(call, model, parts), daemon=True)
        self.thread.start()

    def _work(self, call: Call, model: str, parts: list[dict[str, str]]) -> None:
        try:
            answer = call(model, parts)
            self.end(None if answer is None else str(answer), None if answer is not None else "ValueError: no answer")
        except BaseException as error:  # noqa: BLE001  any failure is this row's alone
            self.end(None, f"{type(error).__name__}: {error}")

    def end(self, answer: str | None, error: str | None) -> None:
        with self.lock:
            if self.outcome is None:
                self.outcome = {"answer": answer, "error": error}
                self.over.set()
                self.slots.release()

    def wait(self) -> dict[str, str | None]:
        if not self.over.wait(max(0.0, self.deadline - time.monotonic())):
            self.end(None, f"TimeoutError: no answer within {self.timeout:g} s")
        return self.outcome

    def expire(self, now: float) -> None:
        if self.deadline <= now:
            self.wait()


def outcomes(call: Call, asked: Iterable[tuple[str, list[dict[str, str]]]], in_flight: int = IN_FLIGHT, timeout: float = TIMEOUT) -> Iterator[dict[str, str | None]]:
    """The outcome of each call, in the order asked.  A late call is given up, and its slot is free, though its thread
    may go on; with LATE times ``in_flight`` of such threads a call fails without being made."""
    slots, ahead, late = threading.Semaphore(in_flight), deque(), []
    for model, parts in asked:
        while not slots.acquire(timeout=max(0.001, min((c.deadline for c in ahead if not c.over.is_set()), default=0.0) - time.monotonic())):
            now = time.monotonic()
            for c in ahead:
                c.expire(now)
        late = [t for t in late if t.is_alive()]
        if len(late) >= LATE * in_flight:
            slots.release()
            ahead.append(_refused(len(late)))
        else:
            ahead.append(_Running(call, model, parts, timeout, slots))
        while ahead and (ahead[0].over.is_set() or len(ahead) >= AHEAD * in_flight):
            yield _ended(ahead.popleft(), late)
    while ahead:
        yield _ended(ahead.popleft(), late)


class _refused(_Running):
    """A call that is not made, as too many late ones still run."""

    def __init__(self, late: int) -> None:
        self.deadline, self.thread, self.over = 0.0, None, threading.Event()
        self.outcome = {"answer": None, "error": f"RuntimeError: {late} late calls still run"}
        self.over.set()


def _ended(call: _Running, late: list[threading.Thread]) -> dict[str, str | None]:
    told = call.wait()
    if call.thread is not None and call.thread.is_alive():
        late.append(call.thread)
    return told


def isolated_call(make: Callable[[], Call], in_flight: int = IN_FLIGHT, timeout: float = TIMEOUT) -> Callable[[Column, Column], Column]:
    """A Column function (model, parts) -> struct(answer, error), of which one is null.

    ``make`` runs once in a task and gives the callable, so that a client is opened once.  Marked as non-deterministic,
    so that no rule of the optimizer makes a call twice; write the result before other steps read it.
    """

    @F.arrow_udf(OUTCOME)
    def ask(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        call = make()
        kind = pa.struct([("answer", pa.string()), ("error", pa.string())])
        for models, parts in batches:
            asked = ((m, [dict(p) for p in ps or []]) for m, ps in zip(models.to_pylist(), parts.to_pylist(), strict=True))
            yield pa.array(list(outcomes(call, asked, in_flight, timeout)), kind)

    return ask.asNondeterministic()


def told_apart(rows: DataFrame, answer: str, outcome: Column, error: str = "error") -> DataFrame:
    """``rows`` with the answer of a call and its error, which an earlier call's error comes before."""
    asked = rows.withColumn("__outcome", outcome)
    earlier = [F.col(error)] if error in rows.columns else []
    return asked.withColumns({answer: F.col("__outcome.answer"), error: F.coalesce(*earlier, "__outcome.error")}).drop("__outcome")


def succeeded(results: DataFrame, error: str = "error") -> DataFrame:
    """The results that count as done: a failed task is asked again."""
    return results.where(F.col(error).isNull()) if error in results.columns else results
