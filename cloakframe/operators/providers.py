"""Model providers as wire formats: a request's URL, headers and body, and the answer in a reply. Sending is a function of the caller.

`provider(...)` makes of a format and a `send` function the callable that `generate` takes; errors never hold a request's text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

Send = Callable[[str, dict[str, str], dict[str, Any]], dict[str, Any]]


class ProviderError(RuntimeError):
    pass


@dataclass(frozen=True)
class Answer:
    text: str
    model: str | None = None
    finish: str | None = None
    input_tokens: int = 0
    output_tokens: int = 0


def _split(messages: list[dict]) -> tuple[str, list[dict]]:
    """System texts joined, and the rest."""
    system = [m["content"] for m in messages if m["role"] == "system" and isinstance(m["content"], str)]
    return "\n\n".join(filter(None, system)), [m for m in messages if m["role"] != "system"]


def _given(**values: Any) -> dict[str, Any]:
    return {k: v for k, v in values.items() if v is not None}


def _chat(base: str, key: str, model: str, messages: list[dict], most: int | None, temperature: float | None) -> tuple[str, dict, dict]:
    return f"{base}/chat/completions", {"authorization": f"Bearer {key}"} if key else {}, {"model": model, "messages": messages, **_given(max_tokens=most, temperature=temperature)}


def _messages(base: str, key: str, model: str, messages: list[dict], most: int | None, temperature: float | None) -> tuple[str, dict, dict]:
    system, rest = _split(messages)
    return f"{base}/v1/messages", {"x-api-key": key, "anthropic-version": "2023-06-01"}, {"model": model, "max_tokens": most or 16_000, "messages": rest, **_given(system=system or None, temperature=temperature)}


def _contents(base: str, key: str, model: str, messages: list[dict], most: int | None, temperature: float | None) -> tuple[str, dict, dict]:
    if not re.fullmatch(r"[\w.-]+", model):
        raise ProviderError("invalid model name")
    system, rest = _split(messages)
    contents = [{"role": "model" if m["role"] == "assistant" else "user", "parts": [{"text": m["content"]}]} for m in rest]
    return f"{base}/models/{model}:generateContent", {"x-goog-api-key": key}, {"contents": contents, "generationConfig": _given(temperature=temperature, maxOutputTokens=most), **_given(systemInstruction={"parts": [{"text": system}]} if system else None)}


def _local(base: str, key: str, model: str, messages: list[dict], most: int | None, temperature: float | None) -> tuple[str, dict, dict]:
    return f"{base}/api/chat", {}, {"model": model, "messages": messages, "stream": False, "options": _given(temperature=temperature, num_predict=most)}


def _read_chat(r: dict) -> Answer:
    choice, usage = r["choices"][0], r.get("usage") or {}
    return Answer(choice["message"].get("content") or "", r.get("model"), choice.get("finish_reason"), usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0))


def _read_messages(r: dict) -> Answer:
    usage = r.get("usage") or {}
    return Answer("".join(b["text"] for b in r["content"] if b["type"] == "text"), r.get("model"), r.get("stop_reason"), usage.get("input_tokens", 0), usage.get("output_tokens", 0))


def _read_contents(r: dict) -> Answer:
    first, usage = r["candidates"][0], r.get("usageMetadata") or {}
    return Answer("".join(p.get("text", "") for p in first.get("content", {}).get("parts", [])), r.get("modelVersion"), first.get("finishReason"), usage.get("promptTokenCount", 0), usage.get("candidatesTokenCount", 0))


def _read_local(r: dict) -> Answer:
    return Answer(r["message"]["content"], r.get("model"), r.get("done_reason"), r.get("prompt_eval_count", 0), r.get("eval_count", 0))


# Formats and where they are served by default.
FORMATS = {
    "openai": ("https://api.openai.com/v1", _chat, _read_chat),
    "openai-compatible": (None, _chat, _read_chat),
    "anthropic": ("https://api.anthropic.com", _messages, _read_messages),
    "gemini": ("https://generativelanguage.googleapis.com/v1beta", _contents, _read_contents),
    "ollama": ("http://localhost:11434", _local, _read_local),
}


def request_of(kind: str, messages: list[dict], model: str, key: str = "", base: str | None = None, most_tokens: int | None = None, temperature: float | None = None) -> tuple[str, dict[str, str], dict[str, Any]]:
    """(URL, headers, body) of a request: messages are (role, content)."""
    default, make, _ = FORMATS[kind]
    if not (base or default):
        raise ProviderError(f"{kind}: a base URL is required")
    if not model:
        raise ProviderError(f"{kind}: a model is required")
    return make((base or default).rstrip("/"), key, model, messages, most_tokens, temperature)


def answer_of(kind: str, reply: dict[str, Any]) -> Answer:
    """The answer in a reply; an error reply or another shape raises, with a short reason."""
    if "error" in reply:
        error = reply["error"]
        raise ProviderError(f"{kind}: {str(error.get('message', 'request rejected') if isinstance(error, dict) else error)[:200]}")
    try:
        return FORMATS[kind][2](reply)
    except (KeyError, IndexError, TypeError) as error:
        raise ProviderError(f"{kind}: the reply has no answer") from error


def provider(kind: str, send: Send, model: str, instructions: str | None = None, **options: Any) -> Callable[[str], str]:
    """text -> answer, by a format and a function that sends (URL, headers, body) and gives the reply as a mapping."""

    def ask(text: str) -> str:
        messages = [*([{"role": "system", "content": instructions}] if instructions else []), {"role": "user", "content": text}]
        try:
            reply = send(*request_of(kind, messages, model, **options))
        except (OSError, json.JSONDecodeError) as error:
            raise ProviderError(f"{kind}: request failed ({type(error).__name__})") from None
        return answer_of(kind, reply).text

    return ask
