"""Providers by name: clients over HTTP, and what their errors mean."""

from __future__ import annotations

import json
import os
import socket
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from lectern.model.client import Client, Fatal, Transient
from lectern.model.stub import Stub

Post = Callable[[str, dict, dict, float], tuple[int, str]]
_PROVIDERS: dict[str, Callable[..., Client]] = {}


def register(name: str, factory: Callable[..., Client]) -> None:
    """Makes factory(model=, key=, timeout=) -> client available; variants of a name (name-x) use it as well."""
    _PROVIDERS[name] = factory


def known() -> list[str]:
    return sorted(_PROVIDERS)


def client_for(provider: str, model: str, *, timeout: float = 600.0) -> Client:
    """The client of a provider; its key is in the variable of the provider's base name (NAME_API_KEY)."""
    base = provider.split("-")[0]
    if base not in _PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}; there are: {', '.join(known())}")
    return _PROVIDERS[base](model=model, key=os.environ.get(f"{base.upper()}_API_KEY", ""), timeout=timeout)


def checked(status: int, text: str) -> str:
    """The text of a reply that worked; rate limits and errors of the server are worth another try, all others are not."""
    if status < 400:
        return text
    raise (Transient if status == 429 or status >= 500 else Fatal)(f"HTTP {status}: {text[:300]}")


def post(url: str, headers: dict, body: dict, timeout: float) -> tuple[int, str]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, reply.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")
    except (TimeoutError, socket.timeout, urllib.error.URLError, ConnectionError) as e:
        raise Transient(f"{type(e).__name__}: {e}") from None


@dataclass
class Http:
    """A chat endpoint of the usual form: a list of messages in, the first choice out."""

    model: str
    key: str = ""
    timeout: float = 600.0
    url: str = "http://localhost:11434/v1/chat/completions"
    provider: str = "http"
    post: Post = post

    def messages(self, task: str, payload: dict) -> list[dict]:
        """The prompt, or the payload where no template made one; then each rejected answer with its correction."""
        said = payload.get("rejected", [])
        text = payload.get("prompt") or json.dumps({"task": task} | {k: v for k, v in payload.items() if k != "rejected"})
        return [{"role": "user", "content": text}, *({"role": "user" if i % 2 else "assistant", "content": x} for i, x in enumerate(said))]

    def headers(self) -> dict:
        return {"Authorization": f"Bearer {self.key}"} if self.key else {}

    def body(self, messages: list[dict]) -> dict:
        return {"model": self.model, "messages": messages}

    def text(self, reply: dict) -> str:
        return reply["choices"][0]["message"]["content"]

    def call(self, task: str, payload: dict) -> str:
        reply = checked(*self.post(self.url, self.headers(), self.body(self.messages(task, payload)), self.timeout))
        return self.text(json.loads(reply))


#: What providers with a field for it are told beside the messages.
SYSTEM = "You return one valid JSON value and nothing else."


@dataclass
class Gemini(Http):
    """Google's own form: contents of parts in, the parts of the first candidate out; errors have a status by name."""

    url: str = "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent"
    provider: str = "google"
    thinking: str = "MEDIUM"

    #: Statuses that are worth another try, whatever the HTTP code says.
    TRANSIENT = ("RESOURCE_EXHAUSTED", "UNAVAILABLE", "DEADLINE_EXCEEDED", "INTERNAL", "ABORTED")

    def headers(self) -> dict:
        return {"x-goog-api-key": self.key}

    def body(self, messages: list[dict]) -> dict:
        contents = [{"role": "model" if m["role"] == "assistant" else "user", "parts": [{"text": m["content"]}]} for m in messages]
        # no schema of the answer: it would have to do without fields of any name
        how = {"responseMimeType": "application/json", "thinkingConfig": {"thinkingLevel": self.thinking}}
        return {"contents": contents, "systemInstruction": {"parts": [{"text": SYSTEM}]}, "generationConfig": how}

    def text(self, reply: dict) -> str:
        if not reply.get("candidates"):
            raise Fatal(f"no candidate: {json.dumps(reply.get('promptFeedback', {}))[:300]}")
        parts = reply["candidates"][0].get("content", {}).get("parts", [])
        return "".join(p.get("text", "") for p in parts if not p.get("thought"))

    def call(self, task: str, payload: dict) -> str:
        status, text = self.post(self.url.format(model=self.model), self.headers(), self.body(self.messages(task, payload)), self.timeout)
        if status >= 400:
            try:
                said = json.loads(text)["error"]["status"]
            except (ValueError, KeyError, TypeError):
                said = None
            if said in self.TRANSIENT:
                raise Transient(f"HTTP {status} {said}: {text[:300]}")
        return self.text(json.loads(checked(status, text)))


@dataclass
class Messages(Http):
    """Anthropic's own form: messages beside the system's words in, blocks of text out."""

    url: str = "https://api.anthropic.com/v1/messages"
    provider: str = "anthropic"
    most_tokens: int = 16_000

    def headers(self) -> dict:
        return {"x-api-key": self.key, "anthropic-version": "2023-06-01"}

    def body(self, messages: list[dict]) -> dict:
        return {"model": self.model, "max_tokens": self.most_tokens, "system": SYSTEM, "messages": messages}

    def text(self, reply: dict) -> str:
        return "".join(b["text"] for b in reply["content"] if b.get("type") == "text")


register("stub", lambda **_: Stub())
register("ollama", lambda **how: Http(provider="ollama", **how))
register("openai", lambda **how: Http(provider="openai", url="https://api.openai.com/v1/chat/completions", **how))
register("groq", lambda **how: Http(provider="groq", url="https://api.groq.com/openai/v1/chat/completions", **how))
register("google", Gemini)
register("anthropic", Messages)
