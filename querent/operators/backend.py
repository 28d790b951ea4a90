"""Text generation behind an interface: a protocol, a scripted stand-in, a registry, a batch operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.functions.text import FINAL_BEGIN, FINAL_END
from querent.session import ship

Message = dict[str, str]


class Backend(Protocol):
    """Anything that turns messages into text; ``seed`` and ``temperature`` are hints."""

    def generate(self, messages: list[Message], max_new_tokens: int = 512, **settings: object) -> str: ...


@dataclass
class Scripted:
    """Gives prepared answers in turn, the last one again and again; keeps what it was asked."""

    answers: list[str]
    asked: list[list[Message]] = field(default_factory=list)

    def generate(self, messages: list[Message], max_new_tokens: int = 512, **settings: object) -> str:
        self.asked.append(messages)
        return self.answers[min(len(self.asked), len(self.answers)) - 1] if self.answers else ""


_KINDS: dict[str, Callable[..., Backend]] = {"scripted": Scripted}
_MADE: dict[tuple, Backend] = {}


def register(kind: str, make: Callable[..., Backend]) -> None:
    _KINDS[kind] = make


def maker(kind: str) -> Callable[..., Backend]:
    """What makes backends of a kind; unknown kinds raise ValueError."""
    if kind not in _KINDS:
        raise ValueError(f"unknown backend: {kind}")
    return _KINDS[kind]


def make(kind: str, cache: bool = True, **settings: object) -> Backend:
    """The backend of a kind, one a process for equal settings; unknown kinds raise ValueError."""
    return made(kind, maker(kind), cache, **settings)


def made(kind: str, build: Callable[..., Backend], cache: bool = True, **settings: object) -> Backend:
    """The same from a maker that the caller holds, as executors do: kinds are registered on the driver alone."""
    key = (kind, repr(sorted(settings.items())))
    if not cache or key not in _MADE:
        _MADE[key] = build(**settings)
    return _MADE[key]


def clear() -> None:
    _MADE.clear()


def marked(messages: list[Message]) -> list[Message]:
    """The messages with the request to put the answer between marks, in the system and last user message."""
    ask = f"\nPut only the final answer between {FINAL_BEGIN} and {FINAL_END}."
    out = [dict(m) for m in messages]
    system = next((m for m in out if m.get("role") == "system"), None)
    if system is None:
        system = {"role": "system", "content": ""}
        out.insert(0, system)
    user = next((m for m in reversed(out) if m.get("role") == "user"), None)
    if user is None:
        user = {"role": "user", "content": ""}
        out.append(user)
    for m in (system, user):
        m["content"] = ((m.get("content") or "") + ask).strip()
    return out


def generate(prompts: DataFrame, done: DataFrame, kind: str, keys: list[str], **settings: object) -> DataFrame:
    """``keys, text`` of prompts (``keys, system, user``) not in ``done`` yet; each executor's worker makes
    the backend once, by the maker that travels with the task, and streams rows through it."""
    import pandas as pd

    ship(prompts.sparkSession)
    build = maker(kind)
    rest = prompts.join(done.select(*keys).distinct(), keys, "left_anti").select(*keys, "system", "user")

    def run(frames):
        backend = made(kind, build, **settings)
        for f in frames:
            texts = [backend.generate([{"role": "system", "content": s or ""}, {"role": "user", "content": u or ""}]) for s, u in zip(f["system"], f["user"], strict=True)]
            yield pd.concat([f[keys], pd.Series(texts, name="text", dtype=object, index=f.index)], axis=1)

    return rest.mapInPandas(run, rest.drop("system", "user").schema.add("text", "string"))


def write_back(profiles: DataFrame, made: DataFrame, keys: list[str], column: str = "profile_text") -> DataFrame:
    """Generated texts put before the profiles that they describe; blank ones change nothing, and a
    text that is there already isn't put twice."""
    t = made.select(*keys, F.trim("text").alias("_t"))
    new = (F.coalesce("_t", F.lit("")) != "") & ~F.startswith(F.coalesce(F.col(column), F.lit("")), F.coalesce("_t", F.lit("")))
    return profiles.join(t, keys, "left").withColumn(column, F.when(new, F.concat_ws("\n", "_t", column)).otherwise(F.col(column))).drop("_t")
