"""Model back ends behind one protocol, and their use from executors."""

from __future__ import annotations

import json
import os
import re
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def generate(self, system: str, messages: list[dict[str, str]]) -> str: ...


class EchoProvider:
    """A deterministic stand-in: answers with a statement over the first table that the prompt names."""

    def generate(self, system: str, messages: list[dict[str, str]]) -> str:
        named = re.search(r"(?<!\S)Table:\s+(\S+)", " ".join([system, *(m["content"] for m in messages)]))
        return f"```sql\nSELECT * FROM {named[1] if named else 't'}\n```"


def generate(df: DataFrame, provider: Callable[[], Provider], system: str, prompt: str = "prompt", out: str = "raw_response") -> DataFrame:
    """One reply a row; a task makes its provider once. A failure is a reply that says so."""
    schema = df.withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for batch in batches:
            yield batch.assign(**{out: [_reply(model, system, [{"role": "user", "content": p or ""}]) for p in batch[prompt]]})

    return df.mapInPandas(run, schema)


def converse(df: DataFrame, provider: Callable[[], Provider], key: str, order: str, introduction: str, prompt: str = "prompt", out: str = "raw_response", history: int = 20) -> DataFrame:
    """Questions of one schema in one conversation: the introduction first, then each with the last turns.

    Rows are grouped by key and sorted; a group streams through a task, of which only the last
    ``history`` messages are held, so a schema with very many questions needs no more memory. An
    introduction of several parts (an array) is sent part by part, each answered, and stays ahead of
    the history. Columns that the conversation doesn't need go by in Arrow's form, unread.
    """
    schema = df.withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, at, head, turns = provider(), object(), [], []
        for batch in batches:
            intros, replies = batch.column(introduction), []
            for row, (k, p) in enumerate(zip(batch.column(key).to_pylist(), batch.column(prompt).to_pylist(), strict=True)):
                if k != at:
                    at, head, turns = k, _introduced(model, intros[row].as_py()), []
                said = [*head, *turns[-history:], {"role": "user", "content": p or ""}]
                replies.append(_reply(model, "", said))
                turns = [*turns, said[-1], {"role": "assistant", "content": replies[-1]}][-history:]
            yield with_replies(batch, out, replies)

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def with_replies(batch: pa.RecordBatch, out: str, replies: list[str]) -> pa.RecordBatch:
    """The batch with ``replies`` as column ``out``, in the place of one of that name."""
    values, at = pa.array(replies, pa.string()), batch.schema.get_field_index(out)
    return batch.append_column(out, values) if at < 0 else batch.set_column(at, out, values)


def _introduced(model: Provider, introduction: object) -> list[dict[str, str]]:
    """The messages ahead of a conversation; parts but a single one are answered as they come."""
    parts = [introduction or ""] if introduction is None or isinstance(introduction, str) else list(introduction)
    messages: list[dict[str, str]] = []
    for part in parts:
        messages.append({"role": "user", "content": part})
        if len(parts) > 1:
            messages.append({"role": "assistant", "content": _reply(model, "", messages)})
    return messages


def _reply(model: Provider, system: str, messages: list[dict[str, str]]) -> str:
    try:
        return model.generate(system, messages)
    except Exception as e:  # a service's failure concerns its row alone
        return f"Model error: {e}"


def hashed_embedding(text: str = "text", dims: int = 64):
    """A deterministic stand-in for a sentence encoder: counts of words hashed to ``dims`` places, as a column."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\W+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    # bound to a lambda's variable: within the inner lambda the words would be hashed anew for each place
    count = lambda p, k: (F.size(p) - F.size(F.array_remove(p, k))).cast("float")
    return F.transform(F.array(places), lambda p: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: count(p, k)))[0]


class HttpProvider:
    """A chat service over HTTP, in the common chat-completions form or the messages form.

    The key is read from an environment variable on the executors, so it is no part of a plan.
    """

    def __init__(self, url: str, model: str, form: str = "chat", key_variable: str = "MODEL_API_KEY", max_tokens: int = 1024, timeout: float = 120.0):
        if form not in ("chat", "messages"):
            raise ValueError(f"unknown form {form!r}")
        self.url, self.model, self.form, self.key_variable, self.max_tokens, self.timeout = url, model, form, key_variable, max_tokens, timeout

    def generate(self, system: str, messages: list[dict[str, str]]) -> str:
        key = os.environ.get(self.key_variable, "")
        body = {"model": self.model, "max_tokens": self.max_tokens}
        if self.form == "chat":
            body["messages"] = [{"role": "system", "content": system}] * bool(system) + messages
            headers = {"Authorization": f"Bearer {key}"}
        else:
            body |= {"messages": messages} | ({"system": system} if system else {})
            headers = {"x-api-key": key}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            out = json.load(reply)
        return out["choices"][0]["message"]["content"] if self.form == "chat" else out["content"][0]["text"]


class FallbackProvider:
    """The first of several providers that answers."""

    def __init__(self, *providers: Provider):
        self.providers = providers

    def generate(self, system: str, messages: list[dict[str, str]]) -> str:
        for p in self.providers[:-1]:
            try:
                return p.generate(system, messages)
            except Exception:  # the next one's turn
                continue
        return self.providers[-1].generate(system, messages)


def answer_tokens(prompt_chars: int, context: int = 8100, most: int = 1024) -> int:
    """Tokens to ask for: what the context leaves, 100 in reserve, between 50 and ``most``."""
    return max(50, min(most, context - prompt_chars // 4 - 100))
