"""Language-model calls over injected providers: stateless models, sessions with history, and history as a table."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.errors import HandleClosed, checked_options

Message = dict[str, str]
#: Messages and execution options to the answer's text.
Provider = Callable[[Sequence[Message], Mapping[str, Any]], str]
EXECUTION = {"temperature": None, "maxOutputTokens": None, "timeout": None}
_PROVIDERS: dict[str, Callable[[Mapping[str, Any]], Provider]] = {}


class ChatError(ValueError):
    pass


def register(name: str, make: Callable[[Mapping[str, Any]], Provider]) -> None:
    if not name or name in _PROVIDERS:
        raise ChatError(f"provider {name!r} has no name or is there already")
    _PROVIDERS[name] = make


def execution(given: Mapping[str, Any] | None) -> dict[str, Any]:
    o = checked_options(given, EXECUTION, "model options")
    if o["temperature"] is not None and not 0 <= o["temperature"] <= 2:
        raise ChatError("temperature lies between 0 and 2")
    if o["maxOutputTokens"] is not None and not o["maxOutputTokens"] > 0:
        raise ChatError("maxOutputTokens must be positive")
    if o["timeout"] is not None and o["timeout"] < 0:
        raise ChatError("timeout can't be negative")
    return {k: v for k, v in o.items() if v is not None}


def _fits(value: Any, schema: Mapping[str, Any], path: str = "$") -> None:
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    want = schema.get("type")
    wants = want if isinstance(want, list) else [want] if want else []
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if wants and not any(number and (w == "number" or w == "integer" and float(value).is_integer()) or w in kinds and isinstance(value, kinds[w]) for w in wants):
        raise ChatError(f"{path} isn't {want}")
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        raise ChatError(f"{path} has a value that isn't allowed")
    if isinstance(value, dict):
        for k in schema.get("required", ()):
            if k not in value:
                raise ChatError(f"{path}.{k} is missing")
        own = schema.get("properties", {})
        for k, v in value.items():
            if k in own:
                _fits(v, own[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                raise ChatError(f"{path}.{k} isn't known")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            _fits(v, schema["items"], f"{path}[{i}]")
    if number and ("minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]):
        raise ChatError(f"{path} is out of range")


class Model:
    """A stateless model; each call stands alone."""

    def __init__(self, provider: Provider, instructions: str | None = None) -> None:
        self._provider, self._instructions = provider, instructions

    def __repr__(self) -> str:
        return "<model>"

    def _ask(self, text: str, task: str | None, given: Mapping[str, Any] | None, before: Sequence[Message] = ()) -> str:
        o = execution(given)
        head = "\n\n".join(x for x in (self._instructions, task) if x)
        return self._provider([*([{"role": "system", "content": head}] if head else []), *before, {"role": "user", "content": text}], o)

    def generate(self, prompt: str, options: Mapping[str, Any] | None = None) -> str:
        return self._ask(prompt, None, options)

    def chat(self, message: str, options: Mapping[str, Any] | None = None, messages: Sequence[Message] = ()) -> str:
        return self._ask(message, None, options, messages)

    def summarize(self, text: str, options: Mapping[str, Any] | None = None, style: str | None = None, max_words: int | None = None) -> str:
        if max_words is not None and max_words <= 0:
            raise ChatError("max_words must be positive")
        return self._ask(text, "Summarize the user's text." + (f" Style: {style}." if style else "") + (f" At most {max_words} words." if max_words else ""), options)

    def extract(self, text: str, schema: Mapping[str, Any], options: Mapping[str, Any] | None = None) -> Any:
        """The answer's JSON, held against the schema."""
        answer = self._ask(text, "Answer with JSON for this schema and nothing else: " + json.dumps(schema, sort_keys=True), options)
        try:
            value = json.loads(answer)
        except ValueError:
            raise ChatError("the answer isn't JSON") from None
        _fits(value, schema)
        return value

    def classify(self, text: str, labels: Sequence[str], options: Mapping[str, Any] | None = None) -> dict[str, str]:
        if not labels or len(set(labels)) != len(labels) or not all(x.strip() for x in labels):
            raise ChatError("labels must be different and not blank")
        answer = self._ask(text, "Answer with exactly one of these labels: " + json.dumps(list(labels)), options).strip().strip('"')
        if answer not in labels:
            raise ChatError("the answer is no label")
        return {"label": answer}

    def query(self, dialect: str, text: str, **given: Any) -> list[Any]:
        """One result in a list; counting and testing answers is refused."""
        calls = {"generate": self.generate, "chat": self.chat, "summarize": self.summarize, "extract": self.extract, "classify": self.classify}
        if dialect not in calls:
            raise ChatError(f"unknown dialect {dialect!r}")
        return [calls[dialect](text, **given)]

    def query_count(self, *_: Any, **__: Any) -> int:
        raise ChatError("COUNT and EXISTS aren't for models")

    query_exists = query_count


class Session(Model):
    """A conversation; a turn is kept only if the provider answered."""

    def __init__(self, model: Model, instructions: str | None = None, history: Sequence[Message] = ()) -> None:
        super().__init__(model._provider, "\n\n".join(x for x in (model._instructions, instructions) if x) or None)
        self._history, self._busy = [dict(m) for m in history], False

    def chat(self, message: str, options: Mapping[str, Any] | None = None, messages: Sequence[Message] = ()) -> str:
        if messages:
            raise ChatError("a session has its own messages")
        if self._busy:
            raise HandleClosed("the session is busy")
        self._busy = True
        try:
            answer = self._ask(message, None, options, self._history)
        finally:
            self._busy = False
        self._history += [{"role": "user", "content": message}, {"role": "assistant", "content": answer}]
        return answer

    def history(self) -> list[Message]:
        return [dict(m) for m in self._history]

    def reset(self) -> bool:
        self._history.clear()
        return True

    def fork(self) -> Session:
        out = Session(Model(self._provider, self._instructions), None, self._history)
        return out


def model(provider: str, given: Mapping[str, Any]) -> Model | Session:
    o = checked_options(given, {"model": None, "apiKey": None, "session": False}, "model")
    if provider not in _PROVIDERS:
        raise ChatError(f"no provider {provider!r}")
    if not o["model"]:
        raise ChatError("model is needed")
    made = Model(_PROVIDERS[provider](o))
    return Session(made) if o["session"] else made


def histories(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, messages)`` in the order of turns, from ``(key, turn, role, text)``."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    return messages.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("messages"))
