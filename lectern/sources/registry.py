"""Extractors by name, settings, prompts."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

Extractor = Callable[[SparkSession, str], DataFrame]
_EXTRACTORS: dict[str, Extractor] = {}


def register(name: str, extractor: Extractor) -> None:
    """Makes (spark, path) -> documents available under a name."""
    _EXTRACTORS[name] = extractor


def extractor(name: str) -> Extractor:
    try:
        return _EXTRACTORS[name]
    except KeyError:
        raise ValueError(f"unknown extractor {name!r}; there are: {', '.join(sorted(_EXTRACTORS))}") from None


# The model of each provider.
MODELS = {"anthropic": "claude-sonnet-4-20250514", "openai": "gpt-4o", "groq": "llama-3.1-70b-versatile", "ollama": "llama3.1", "google": "gemini-3-flash-preview", "google-fast": "gemma-4-31b-it"}


@dataclass(frozen=True)
class Settings:
    """How documents become decks."""

    chunk_size: int = 8000
    overlap_size: int = 1500
    chapters_for_multi: int = 3
    chars_for_multi: int = 100_000
    review_cycles: int = 3
    writer_batch: int = 5
    max_slides: int = 20
    #: Chapters begin at the chunk with their heading; or, as an ordinal compared to chunk numbers, elsewhere.
    ordinal_positions: bool = False
    duplicate_policy: str = "overwrite"
    provider: str = "anthropic"
    models: dict[str, str] = field(default_factory=lambda: dict(MODELS))
    max_concurrent: int = 5
    attempts: int = 6
    timeout: float = 600.0

    @property
    def model(self) -> str:
        return self.models[self.provider]


#: File name of each task's prompt template.
PROMPTS = {
    "analyse": "analyst_chunk", "merge_chapter": "analyst_merge_chapter", "merge_document": "analyst_merge_document", "plan": "planner",
    "write": "writer", "summarise": "writer_summary", "review": "critic", "refine": "refiner",
}
#: Settings with a fixed set of values.
CHOICES = {"duplicate_policy": ("overwrite", "keep_both")}


def settings(path: str | None = None, **changes: Any) -> Settings:
    """The defaults, overlaid with a JSON file if there is one, then with changes; unknown keys and values raise.

    In the file, PROVIDER names the provider, MODELS replaces the models as a whole, PIPELINE is merged key by key.
    """
    said: dict[str, Any] = {}
    if path and os.path.exists(path):
        with open(path) as f:
            try:
                held = json.load(f)
            except json.JSONDecodeError as e:
                raise ValueError(f"{path} is no JSON: {e}") from None
        said = {name.lower(): held[name] for name in ("PROVIDER", "MODELS") if name in held} | held.get("PIPELINE", {})
        if odd := sorted(set(held) - {"PROVIDER", "MODELS", "PIPELINE"}):
            raise ValueError(f"unknown sections: {', '.join(odd)}")
    said |= changes
    names = {f.name for f in fields(Settings)}
    if odd := sorted(set(said) - names):
        raise ValueError(f"unknown settings: {', '.join(odd)}; there are: {', '.join(sorted(names))}")
    made = replace(Settings(), **said)
    for key, allowed in (CHOICES | {"provider": tuple(made.models)}).items():
        if getattr(made, key) not in allowed:
            raise ValueError(f"{key} must be one of {', '.join(allowed)}")
    return made


def prompts(folder: str) -> dict[str, str]:
    """The templates of all tasks, by task; those that a folder doesn't have are left out."""
    found = {task: prompt(folder, name) for task, name in PROMPTS.items()}
    return {task: text for task, text in found.items() if text}


def prompt(folder: str, name: str, *, named: bool = False) -> str:
    """A prompt template; an agent's own may be missing (empty), one asked for by name may not."""
    path = os.path.join(folder, f"{name}.txt")
    if not os.path.exists(path):
        if named:
            raise FileNotFoundError(path)
        return ""
    with open(path) as f:
        return f.read()
