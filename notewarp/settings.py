"""Settings of the command line and the service, from the environment or a mapping."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

# Families of providers, their endpoints and the model that is used where none is named.
PROVIDERS = ["openai", "gemini", "custom"]
OPENAI_URL, GEMINI_URL = "https://api.openai.com/v1", "https://generativelanguage.googleapis.com/v1beta/openai/"
GEMINI_MODEL, PROMPT_VERSION, MAX_INPUT_TOKENS = "gemini-3.5-flash", "v1", 6500


@dataclass(frozen=True)
class Settings:
    """Where things are and which model is asked."""

    store: str
    source_key: str | None
    provider: str
    model: str | None
    base_url: str
    model_key: str | None
    prompt_version: str
    max_input_tokens: int

    def remote(self) -> Settings:
        """These settings, if they suffice for the note service and the model; else an error that says what is missing."""
        needed = {"NOTEWARP_SOURCE_KEY": self.source_key, "NOTEWARP_MODEL": self.model, **({"GEMINI_API_KEY": self.model_key} if self.provider == "gemini" else {})}
        if missing := [name for name, value in needed.items() if not value]:
            raise ValueError("set " + " and ".join(missing))
        return self


def provider_of(env: Mapping[str, str]) -> str:
    """The named provider, whatever its case; else the one whose key or address is there."""
    if named := env.get("NOTEWARP_PROVIDER"):
        if named.casefold() not in PROVIDERS:
            raise ValueError(f"NOTEWARP_PROVIDER must be one of {', '.join(PROVIDERS)}")
        return named.casefold()
    if env.get("NOTEWARP_BASE_URL"):
        return "custom"
    return "gemini" if env.get("GEMINI_API_KEY") else "openai"


def load(store: str | None = None, env: Mapping[str, str] | None = None) -> Settings:
    """Settings from `env` (by default the process's); `store` wins over NOTEWARP_STORE. Empty values count as not set."""
    env = {k: v for k, v in (os.environ if env is None else env).items() if v}
    provider = provider_of(env)
    gemini = provider == "gemini"
    tokens = env.get("NOTEWARP_MAX_INPUT_TOKENS", str(MAX_INPUT_TOKENS))
    if not tokens.isdecimal() or int(tokens) < 1:
        raise ValueError("NOTEWARP_MAX_INPUT_TOKENS must be a positive integer")
    home = env.get("XDG_DATA_HOME") or str(Path.home() / ".local" / "share")
    return Settings(
        store=store or env.get("NOTEWARP_STORE") or f"{home}/notewarp/store",
        source_key=env.get("NOTEWARP_SOURCE_KEY"),
        provider=provider,
        model=env.get("NOTEWARP_MODEL") or (GEMINI_MODEL if gemini else None),
        base_url=env.get("NOTEWARP_BASE_URL") or (GEMINI_URL if gemini else OPENAI_URL),
        model_key=env.get("NOTEWARP_MODEL_KEY") or env.get("GEMINI_API_KEY" if gemini else "OPENAI_API_KEY"),
        prompt_version=env.get("NOTEWARP_PROMPT_VERSION", PROMPT_VERSION),
        max_input_tokens=int(tokens),
    )
