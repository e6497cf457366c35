"""An extractor that asks a chat-completions endpoint for JSON of the contract."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from notewarp.operators.extraction import PROMPT, json_schema
from notewarp.settings import MAX_INPUT_TOKENS

# Seconds until a request is given up, and the sampling temperature.
TIMEOUT_S, TEMPERATURE = 120.0, 0
Post = Callable[[str, dict, bytes, float], tuple[int, bytes]]


class CompletionError(RuntimeError):
    """The endpoint gave no usable answer; `kind` is transport, status, empty, contract or budget."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(f"{kind}: {message}")
        self.kind = kind


def post(url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, bytes]:
    """One HTTP request by the standard library."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, data=body, headers=headers, method="POST"), timeout=timeout) as answer:
            return answer.status, answer.read()
    except HTTPError as error:
        return error.code, error.read()


def token_usage(usage: dict | None) -> dict[str, int]:
    """Token counts of an answer; what it doesn't give is 0."""
    usage = usage or {}
    inner = lambda name, key: int((usage.get(name) or {}).get(key) or 0)
    return {
        "input_tokens": int(usage.get("prompt_tokens") or 0),
        "output_tokens": int(usage.get("completion_tokens") or 0),
        "cached_input_tokens": inner("prompt_tokens_details", "cached_tokens"),
        "reasoning_tokens": inner("completion_tokens_details", "reasoning_tokens"),
    }


@dataclass(frozen=True)
class Completion:
    """Callable like any extractor; it goes to the tasks, so it holds plain values only."""

    model: str
    base_url: str
    key: str | None = None
    max_input_tokens: int = MAX_INPUT_TOKENS
    timeout: float = TIMEOUT_S
    send: Post = post

    def __post_init__(self) -> None:
        if not self.model or self.max_input_tokens < 1:
            raise ValueError("a model and a positive budget are needed")

    def body(self, title: str, evidence_json: str, ontology_json: str) -> bytes:
        parts = {"title": title, "ontology": ontology_json, "evidence": evidence_json}
        text = re.sub(r"\{(title|ontology|evidence)\}", lambda m: parts[m.group(1)], PROMPT)
        if -(-len(text) // 4) > self.max_input_tokens:
            raise CompletionError("budget", f"about {-(-len(text) // 4)} tokens, {self.max_input_tokens} allowed")
        schema = {"type": "json_schema", "json_schema": {"name": "extraction", "strict": True, "schema": json_schema()}}
        return json.dumps({"model": self.model, "temperature": TEMPERATURE, "response_format": schema, "messages": [{"role": "user", "content": text}]}).encode()

    def __call__(self, title: str, evidence_json: str, ontology_json: str) -> tuple[str, dict[str, int]]:
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}
        try:
            status, answer = self.send(self.base_url.rstrip("/") + "/chat/completions", headers, self.body(title, evidence_json, ontology_json), self.timeout)
        except OSError as error:
            raise CompletionError("transport", str(error)) from error
        if status >= 400:
            raise CompletionError("status", str(status))
        try:
            read = json.loads(answer)
            choices = read["choices"]
            content = choices[0]["message"]["content"] if choices else None
        except (ValueError, KeyError, TypeError, IndexError) as error:
            raise CompletionError("contract", "not a completion") from error
        if not content:
            raise CompletionError("empty", "no content")
        return content, token_usage(read.get("usage"))
