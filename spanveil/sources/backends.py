"""Language models behind an address, or in the worker's own process."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlparse

from ..errors import ModelError, PolicyError

Messages = list[dict[str, str]]


def check_address(url: str, allow_http: bool) -> str:
    """Plain http goes to this machine only, unless it is allowed."""
    parts = urlparse(url)
    if parts.scheme not in ("http", "https"):
        raise PolicyError(f"an address must begin with http:// or https://, not {url!r}")
    if parts.scheme == "http" and not allow_http and parts.hostname not in ("localhost", "127.0.0.1", "::1"):
        raise PolicyError(f"plain http to {parts.hostname} must be allowed (allow_http)")
    return url.rstrip("/")


class Backend:
    """What the layers ask of a model."""

    def complete(self, messages: Messages) -> str:
        raise NotImplementedError

    def list_models(self) -> list[str]:
        return []

    def pull_model(self, model: str) -> Iterator[dict[str, Any]]:
        raise ModelError(f"{type(self).__name__} can't fetch models")

    def is_model_available(self, model: str) -> bool:
        return model in self.list_models()


@dataclass
class HttpBackend(Backend):
    base_url: str
    model: str
    timeout: float = 60
    api_key: str = field(default="", repr=False)
    allow_http: bool = False

    def __post_init__(self) -> None:
        self.base_url = check_address(self.base_url, self.allow_http)

    def call(self, path: str, body: dict[str, Any] | None = None) -> Iterator[dict[str, Any]]:
        """The reply's JSON documents, one a line if it is a stream."""
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(self.base_url + path, json.dumps(body).encode() if body is not None else None, headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                if body and body.get("stream"):
                    yield from (json.loads(x) for x in reply if x.strip())
                else:
                    yield json.load(reply)
        except urllib.error.HTTPError as e:
            raise ModelError(f"{self.base_url} answered {e.code}" + (f"; is the model {self.model} there?" if e.code == 404 else "")) from e
        except OSError as e:
            raise ModelError(f"{self.base_url} can't be reached: {e}") from e


class OllamaBackend(HttpBackend):
    def complete(self, messages: Messages) -> str:
        prompt = "\n\n".join(f"{m['role'].upper()}: {m['content']}" for m in messages)
        return next(self.call("/api/generate", {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": 0}})).get("response", "")

    def list_models(self) -> list[str]:
        return [m["name"] for m in next(self.call("/api/tags")).get("models", [])]

    def pull_model(self, model: str) -> Iterator[dict[str, Any]]:
        for x in self.call("/api/pull", {"name": model, "stream": True}):
            done, total = x.get("completed") or 0, x.get("total") or 0
            yield {"status": x.get("status", ""), "completed": done, "total": total, "percent": 100 * done / total if total else 0.0}


class OpenAiBackend(HttpBackend):
    def complete(self, messages: Messages) -> str:
        return next(self.call("/chat/completions", {"model": self.model, "messages": messages, "temperature": 0}))["choices"][0]["message"]["content"] or ""

    def list_models(self) -> list[str]:
        return [m["id"] for m in next(self.call("/models")).get("data", [])]


class VllmBackend(OpenAiBackend):
    """The same interface; by default at port 8000."""


@dataclass
class TransformersBackend(Backend):
    """A model in the worker's process, loaded when first asked; greedy decoding."""

    model: str
    device_map: str | None = "auto"
    load_in_8bit: bool = False
    load_in_4bit: bool = False
    max_new_tokens: int = 512
    _pipeline: Any = field(default=None, repr=False)

    def complete(self, messages: Messages) -> str:
        if self._pipeline is None:
            try:
                from transformers import pipeline
            except ImportError as e:
                raise ModelError("transformers isn't installed on this worker") from e
            bits = {k: True for k in ("load_in_8bit", "load_in_4bit") if getattr(self, k)}
            self._pipeline = pipeline("text-generation", model=self.model, device_map=self.device_map, model_kwargs=bits)
        return self._pipeline(messages, max_new_tokens=self.max_new_tokens, do_sample=False)[0]["generated_text"][-1]["content"]


#: Stand-ins for a backend's name, for tests and for models of one's own.
_custom: dict[str, Callable[[], Backend]] = {}


def use_backend(name: str, make: Callable[[], Backend] | None) -> None:
    """From now on a backend's name means this; None takes it back."""
    if make is None:
        _custom.pop(name, None)
    else:
        _custom[name] = make


def backend_of(layer: Any) -> Callable[[], Backend]:
    """A maker that is sent to the workers. Addresses are checked here, on the driver."""
    if layer.backend in _custom:
        return _custom[layer.backend]
    if layer.backend == "transformers":
        return lambda: TransformersBackend(layer.model)
    kind = {"ollama": OllamaBackend, "openai_compatible": OpenAiBackend, "vllm": VllmBackend}[layer.backend]
    url = layer.base_url
    if layer.backend == "vllm" and url == "http://localhost:11434":
        url = "http://localhost:8000/v1"
    check_address(url, layer.allow_http)
    return lambda: kind(url, layer.model, layer.timeout, layer.api_key, layer.allow_http)


# Models by need of memory (GB), for choosing one.
MODELS = (
    ("llama3.1:8b", "ollama", 4.7), ("llama3.2:3b", "ollama", 2.0), ("mistral:7b", "ollama", 4.1), ("phi3:mini", "ollama", 2.5),
    ("meta-llama/Llama-3.2-1B-Instruct", "transformers", 2.5), ("meta-llama/Llama-3.2-3B-Instruct", "transformers", 6.0),
    ("meta-llama/Llama-3.1-8B-Instruct", "transformers", 16.0), ("meta-llama/Llama-3.1-70B-Instruct", "transformers", 40.0),
)
RECOMMENDED_MODEL = "llama3.1:8b"
