"""Conversations side by side within a task: bounded threads, a shared rate, retries, rows in their order."""

from __future__ import annotations

import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from itertools import groupby
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcurio.plans.providers import Provider, _introduced, with_replies


class ThreadProvider(Protocol):
    """A service that keeps the conversations itself: a thread is begun once and then only asked."""

    def begin(self, introduction: list[str]) -> str: ...

    def ask(self, thread: str, text: str) -> str: ...


class TokenBucket:
    """At most ``burst`` calls at once and ``rate`` a second over time, whoever calls."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.held, self.at, self.lock = float(burst), clock(), threading.Lock()

    def take(self) -> None:
        with self.lock:  # the wait is booked under the lock and slept outside of it
            now = self.clock()
            self.held = min(float(self.burst), self.held + (now - self.at) * self.rate) - 1
            self.at = now
            wait = -self.held / self.rate if self.held < 0 else 0.0
        if wait:
            self.sleep(wait)


class Patient:
    """Calls under a rate; what fails is called again after 1, 2, 4, ... times ``pause`` seconds, up to ``attempts`` times."""

    def __init__(self, attempts: int, pause: float, bucket: TokenBucket | None) -> None:
        self.attempts, self.pause, self.bucket = attempts, pause, bucket

    def __call__(self, call: Callable[[], str]) -> str:
        for k in range(self.attempts):
            if self.bucket:
                self.bucket.take()
            try:
                return call()
            except Exception:
                if k == self.attempts - 1:
                    raise
                time.sleep(self.pause * 2**k * random.uniform(0.5, 1.0))
        raise ValueError("at least one attempt")


class _Patiently:
    """A provider whose every call is patient."""

    def __init__(self, model: Provider, patient: Patient) -> None:
        self.model, self.patient = model, patient

    def generate(self, system: str, messages: list[dict[str, str]]) -> str:
        return self.patient(lambda: self.model.generate(system, messages))


class Conversation:
    """The open questions of one conversation, answered one after another by one thread at a time."""

    def __init__(self, model: Provider | ThreadProvider, patient: Patient, introduction: object, history: int) -> None:
        self.model, self.patient, self.introduction, self.history = model, patient, introduction, history
        self.open: deque[tuple[list[str], Future]] = deque()
        self.lock, self.busy, self.begun = threading.Lock(), False, False
        self.turns: list[dict[str, str]] = []

    def ask(self, texts: list[str], workers: ThreadPoolExecutor) -> Future:
        """The replies to ``texts``, asked one after another: one future for all, as one a question costs more than many a reply."""
        replies: Future = Future()
        with self.lock:
            self.open.append((texts, replies))
            start, self.busy = not self.busy, True
        if start:
            workers.submit(self._answer)
        return replies

    def _answer(self) -> None:
        while True:
            with self.lock:
                if not self.open:
                    self.busy = False
                    return
                texts, replies = self.open.popleft()
            try:
                replies.set_result([self._reply(text) for text in texts])
            except BaseException as e:
                replies.set_exception(e)

    def _reply(self, text: str) -> str:
        threaded = hasattr(self.model, "ask")
        try:
            if not self.begun:
                parts = [self.introduction or ""] if self.introduction is None or isinstance(self.introduction, str) else list(self.introduction)
                self.head = self.patient(lambda: self.model.begin(parts)) if threaded else _introduced(_Patiently(self.model, self.patient), self.introduction)
                self.begun = True
            if threaded:
                return self.patient(lambda: self.model.ask(self.head, text))
            said = [*self.head, *self.turns[-self.history :], {"role": "user", "content": text}]
            answer = self.patient(lambda: self.model.generate("", said))
        except Exception as e:  # a service's failure concerns its row alone
            answer = f"Model error: {e}"
            if threaded or not self.begun:
                return answer
        self.turns = [*self.turns, said[-1], {"role": "assistant", "content": answer}][-self.history :]
        return answer


def converse_together(df: DataFrame, provider: Callable[[], Provider | ThreadProvider], key: str, order: str, introduction: str, prompt: str = "prompt", out: str = "raw_response", history: int = 20, at_once: int = 8, rate: float | None = None, burst: int = 1, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """:func:`providers.converse` with up to ``at_once`` conversations of a task at the same time.

    Turns of one conversation stay in their order and see the same history as one after another; rows
    leave in the order they came. A provider that has ``begin`` and ``ask`` keeps the history itself.
    ``rate`` calls a second, with ``burst`` at once, are what a *task* makes, retries included, so a
    service's limit is to be divided by the tasks that run together. What fails ``attempts`` times is a
    reply that says so. A task holds the rows of the batches it works on, and of each open conversation
    the last ``history`` messages.
    """
    schema = df.withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, patient = provider(), Patient(attempts, pause, TokenBucket(rate, burst) if rate else None)
        waiting: deque[tuple[pa.RecordBatch, list[Future]]] = deque()
        finish = lambda batch, replies: with_replies(batch, out, [x for r in replies for x in r.result()])
        at, talk = object(), None
        with ThreadPoolExecutor(at_once) as workers:
            for batch in batches:
                replies, first = [], 0
                texts = [text or "" for text in batch.column(prompt).to_pylist()]
                for k, rows in groupby(batch.column(key).to_pylist()):
                    if talk is None or k != at:
                        at, talk = k, Conversation(model, patient, batch.column(introduction)[first].as_py(), history)
                    last = first + sum(1 for _ in rows)
                    replies.append(talk.ask(texts[first:last], workers))
                    first = last
                waiting.append((batch, replies))
                if len(waiting) > 1:  # one batch is answered while the next one is read
                    yield finish(*waiting.popleft())
            while waiting:
                yield finish(*waiting.popleft())

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)
