"""Model servers over HTTP, by the standard library alone: two common APIs and an embedding proxy.

A client is plain settings, so it travels to executors with the functions that use it; each call is one request.
Pass ``Server.generate`` users to ``clients.generate`` and ``Server.embed_texts`` to ``clients.embedder``.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

from siftwell.clients import fold_ndjson, stream_ndjson
from siftwell.errors import EmbeddingError, GenerationError


def vectors_of(answer: object) -> list[list[float]]:
    """The vectors of an embedding answer, in whichever of the common shapes it comes."""
    if isinstance(answer, dict):
        inner = next((answer[k] for k in ("embeddings", "data", "embedding") if answer.get(k)), None)
        if inner is None:
            raise EmbeddingError(f"no embedding in the answer: {json.dumps(answer)[:200]}")
        return vectors_of(inner)
    if isinstance(answer, list) and answer:
        if isinstance(answer[0], int | float):
            return [[*map(float, answer)]]
        return [v for x in answer for v in vectors_of(x)]
    raise EmbeddingError(f"no embedding in the answer: {json.dumps(answer)[:200]}")


@dataclass
class Server:
    """Requests to ``base``; ``timeout`` in seconds."""

    base: str
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 60.0

    def request(self, path: str, body: object = None, method: str | None = None) -> urllib.request.Request:
        data = None if body is None else json.dumps(body).encode()
        return urllib.request.Request(self.base.rstrip("/") + path, data, {"Content-Type": "application/json", **self.headers}, method=method or ("GET" if body is None else "POST"))

    def lines(self, path: str, body: object = None, method: str | None = None) -> Iterator[str]:
        try:
            with urllib.request.urlopen(self.request(path, body, method), timeout=self.timeout) as r:
                for line in r:
                    yield line.decode()
        except urllib.error.HTTPError as e:
            raise GenerationError(f"request failed {e.code}: {e.read().decode(errors='replace')}", status=e.code) from e
        except OSError as e:
            raise GenerationError(f"request failed: {e}") from e

    def call(self, path: str, body: object = None, method: str | None = None):
        text = "".join(self.lines(path, body, method))
        return json.loads(text) if text.strip() else {}


@dataclass
class Ollama(Server):
    base: str = "http://127.0.0.1:11434"

    def generate(self, model: str, prompt: str, **options) -> str:
        return fold_ndjson(self.lines("/api/generate", {"model": model, "prompt": prompt, "stream": False, **options}))

    def stream(self, model: str, prompt: str, **options) -> Iterator[str]:
        return stream_ndjson(self.lines("/api/generate", {"model": model, "prompt": prompt, "stream": True, **options}))

    def chat(self, model: str, messages: list[dict] | str, **options) -> str:
        said = [{"role": "user", "content": messages}] if isinstance(messages, str) else messages
        return fold_ndjson(self.lines("/api/chat", {"model": model, "messages": said, "stream": False, **options}))

    def generate_or_chat(self, model: str, prompt: str, **options) -> str:
        """By chat where the server has no plain generation."""
        try:
            return self.generate(model, prompt, **options)
        except GenerationError:
            return self.chat(model, prompt, **options)

    def embed(self, model: str, texts: str | list[str], **options) -> list[list[float]]:
        try:
            return vectors_of(self.call("/api/embed", {"model": model, "input": texts, **options}))
        except GenerationError as e:
            if e.metadata.get("status") == 404:
                raise EmbeddingError.model_not_found(model) from e
            raise EmbeddingError.network_error(str(e)) from e

    def embed_texts(self, model: str):
        return lambda texts: self.embed(model, texts)

    def list(self) -> dict:
        return self.call("/api/tags")

    def running(self) -> dict:
        return self.call("/api/ps")

    def show(self, model: str) -> dict:
        return self.call("/api/show", {"model": model})

    def pull(self, model: str) -> Iterator[dict]:
        return map(json.loads, self.lines("/api/pull", {"model": model}))

    def push(self, model: str) -> Iterator[dict]:
        return map(json.loads, self.lines("/api/push", {"model": model}))

    def create(self, model: str, **options) -> Iterator[dict]:
        return map(json.loads, self.lines("/api/create", {"model": model, **options}))

    def copy(self, source: str, destination: str) -> dict:
        return self.call("/api/copy", {"source": source, "destination": destination})

    def delete(self, model: str) -> dict:
        return self.call("/api/delete", {"model": model}, "DELETE")

    def web_search(self, query: str, **options) -> dict:
        return self.call("/api/web_search", {"query": query, **options})

    def web_fetch(self, url: str) -> dict:
        return self.call("/api/web_fetch", {"url": url})


@dataclass
class OpenAIStyle(Server):
    """Servers of the ``/v1`` kind, such as LM Studio's."""

    base: str = "http://127.0.0.1:1234"

    def generate(self, model: str, prompt: str, **options) -> str:
        got = self.call("/v1/completions", {"model": model, "prompt": prompt, **options})
        return got["choices"][0]["text"]

    def chat(self, model: str, messages: list[dict] | str, **options) -> str:
        said = [{"role": "user", "content": messages}] if isinstance(messages, str) else messages
        got = self.call("/v1/chat/completions", {"model": model, "messages": said, "temperature": 0.7, "max_tokens": 512, **options})
        return got["choices"][0]["message"]["content"]

    def embed(self, model: str, texts: str | list[str], retries: int = 1) -> list[list[float]]:
        for left in range(retries, -1, -1):
            try:
                return vectors_of(self.call("/v1/embeddings", {"model": model, "input": texts}))
            except GenerationError as e:
                if not left:
                    raise EmbeddingError.network_error(str(e)) from e
        raise AssertionError

    def embed_texts(self, model: str):
        return lambda texts: self.embed(model, texts)

    def list_models(self) -> list[str]:
        return [m["id"] for m in self.call("/v1/models")["data"]]

    def list_loaded(self) -> list[str]:
        return [m["id"] for m in self.call("/api/v0/models")["data"] if m.get("state") == "loaded"]


@dataclass
class Proxy(Server):
    """A page's own endpoints, behind which a model server stands."""

    base: str = "http://127.0.0.1:3000"
    embed_path: str = "/api/embed"
    generate_path: str = "/api/generate"

    def generate(self, model: str, prompt: str, **options) -> str:
        return fold_ndjson(self.lines(self.generate_path, {"model": model, "prompt": prompt, **options}))

    def stream(self, model: str, prompt: str, **options) -> Iterator[str]:
        return stream_ndjson(self.lines(self.generate_path, {"model": model, "prompt": prompt, "stream": True, **options}))

    def embed(self, model: str, texts: str | list[str]) -> list[list[float]]:
        try:
            return vectors_of(self.call(self.embed_path, {"model": model, "input": [texts] if isinstance(texts, str) else texts}))
        except GenerationError as e:
            raise EmbeddingError.network_error(str(e)) from e

    def embed_texts(self, model: str):
        return lambda texts: self.embed(model, texts)
