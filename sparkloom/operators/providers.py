"""Models behind one small interface; the default works offline and always answers alike."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ProviderError(Exception):
    """A call that failed; retryable if another try may succeed."""

    def __init__(self, message: str, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


@dataclass(frozen=True)
class Offline:
    """Answers from the text itself: generated text is extracted, vectors are hashed bags of words of unit length."""

    model: str = "offline"
    dimensions: int = 64

    def generate(self, prompt: str, max_tokens: int = 450) -> str:
        lines = [x.strip() for x in prompt.splitlines()[1:] if len(x.strip()) > 3] or [prompt.strip()]
        told = [x for x in lines if re.match(r"(?:#|//|\"\"\"|\*|[A-Z][a-z]+ )", x)] or lines
        return " ".join(told)[: 4 * max_tokens].strip()

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in re.findall(r"\w+", (t or "").lower()):
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[h[0] % self.dimensions] += 1.0 if h[1] & 1 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    def health(self) -> dict:
        return {"ok": True, "model": self.model, "detail": "offline"}


@dataclass(frozen=True)
class Http:
    """An endpoint that speaks the common chat and embedding protocol over HTTP."""

    base_url: str
    model: str
    api_key: str | None = None
    embedding_model: str | None = None
    timeout: float = 120.0

    def _head(self) -> dict:
        return {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(self.base_url.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json"} | self._head())
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            raise ProviderError(f"status {e.code}", e.code == 429 or e.code >= 500) from None
        except OSError as e:
            raise ProviderError(str(e), True) from None

    def generate(self, prompt: str, max_tokens: int = 450) -> str:
        return self._post("/chat/completions", {"model": self.model, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}]})["choices"][0]["message"]["content"]

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not self.embedding_model:
            raise ProviderError("no embedding model")
        return [x["embedding"] for x in self._post("/embeddings", {"model": self.embedding_model, "input": texts})["data"]]

    def health(self) -> dict:
        try:
            self.generate("ping", 1)
            return {"ok": True, "model": self.model, "detail": ""}
        except ProviderError as e:
            return {"ok": False, "model": self.model, "detail": str(e)}


@dataclass(frozen=True)
class Messages(Http):
    """An endpoint of the messages protocol: the key in a header of its own, the answer in blocks of text. It embeds nothing."""

    version: str = "2023-06-01"
    embeds: bool = False

    def _head(self) -> dict:
        return {"anthropic-version": self.version} | ({"x-api-key": self.api_key} if self.api_key else {})

    def generate(self, prompt: str, max_tokens: int = 450) -> str:
        got = self._post("/v1/messages", {"model": self.model, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}]})
        return "".join(x.get("text", "") for x in got["content"])


@dataclass(frozen=True)
class Contents(Http):
    """An endpoint of the contents protocol: the model is part of the address, the answer in parts of a candidate."""

    def _head(self) -> dict:
        return {"x-goog-api-key": self.api_key} if self.api_key else {}

    def generate(self, prompt: str, max_tokens: int = 450) -> str:
        got = self._post(f"/v1beta/models/{self.model}:generateContent", {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"maxOutputTokens": max_tokens}})
        return "".join(x.get("text", "") for x in got["candidates"][0]["content"]["parts"])

    def embed(self, texts: list[str]) -> list[list[float]]:
        name = f"models/{self.embedding_model or self.model}"
        got = self._post(f"/v1beta/{name}:batchEmbedContents", {"requests": [{"model": name, "content": {"parts": [{"text": t}]}} for t in texts]})
        return [x["values"] for x in got["embeddings"]]


@dataclass(frozen=True)
class Local(Http):
    """A server of local models: answers whole, without a key."""

    def generate(self, prompt: str, max_tokens: int = 450) -> str:
        return self._post("/api/chat", {"model": self.model, "stream": False, "options": {"num_predict": max_tokens}, "messages": [{"role": "user", "content": prompt}]})["message"]["content"]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._post("/api/embed", {"model": self.embedding_model or self.model, "input": texts})["embeddings"]


#: Provider by name -> maker; others can be added.
PROVIDERS: dict[str, Callable] = {"offline": Offline, "http": Http, "messages": Messages, "contents": Contents, "local": Local}

# Services by name: protocol, endpoint, environment variable of the key, whether it needs a key, whether it embeds.
SERVICES = {
    "ollama": ("local", "http://localhost:11434", None, False, True),
    "openai": ("http", "https://api.openai.com/v1", "OPENAI_API_KEY", True, True),
    "anthropic": ("messages", "https://api.anthropic.com", "ANTHROPIC_API_KEY", True, False),
    "gemini": ("contents", "https://generativelanguage.googleapis.com", "GEMINI_API_KEY", True, True),
    "groq": ("http", "https://api.groq.com/openai/v1", "GROQ_API_KEY", True, False),
    "openrouter": ("http", "https://openrouter.ai/api/v1", "OPENROUTER_API_KEY", True, False),
    "lmstudio": ("http", "http://localhost:1234/v1", None, False, True),
    "custom": ("http", None, None, False, True),
}


def resolve(service: str = "offline", model: str | None = None, api_key: str | None = None, endpoint: str | None = None, embedding_model: str | None = None, env: dict[str, str] | None = None):
    """The provider of a service: what is given counts before the environment, that before the defaults. A missing key or endpoint raises before any row is read."""
    if service in PROVIDERS and service not in SERVICES:
        return PROVIDERS[service]() if service == "offline" else PROVIDERS[service](endpoint or "", model or "", api_key)
    if service not in SERVICES:
        raise ProviderError(f"unknown provider {service}")
    protocol, default, variable, needs_key, _ = SERVICES[service]
    env = os.environ if env is None else env
    key, address = api_key or (env.get(variable) if variable else None), endpoint or default
    if needs_key and not key:
        raise ProviderError(f"{service} needs a key, such as in {variable}")
    if not address:
        raise ProviderError(f"{service} needs an endpoint")
    return PROVIDERS[protocol](address, model or "", key, embedding_model)


def resolve_synthesis(env: dict[str, str] | None = None, **given):
    """The provider of the few calls about a whole repository: that of SYNTHESIS_PROVIDER and SYNTHESIS_MODEL if they are set, else the one given."""
    env = os.environ if env is None else env
    return resolve(env.get("SYNTHESIS_PROVIDER") or given.pop("service", "offline"), env.get("SYNTHESIS_MODEL") or given.pop("model", None), env=env, **{k: v for k, v in given.items() if k not in ("service", "model")})


def can_embed(provider) -> bool:
    return bool(getattr(provider, "embeds", True)) and hasattr(provider, "embed")


# Memory in GB from which a machine belongs to a tier.
TIERS = [("minimal", 0), ("standard", 8), ("high", 16), ("workstation", 32)]


def tier(ram_gb: float | None, vram_gb: float | None = None) -> str:
    """The highest tier that the larger of both memories reaches; unknown ones count nothing."""
    most = max((x for x in (ram_gb, vram_gb) if x is not None), default=0)
    return [name for name, least in TIERS if most >= least][-1]


def memory_gb() -> float | None:
    """The memory of this machine; null where the system does not tell."""
    try:
        return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30
    except (ValueError, OSError, AttributeError):
        return None


def retried(call: Callable, tries: int = 3, first: float = 1.0, most: float = 20.0, sleep: Callable = time.sleep):
    """What the call returns; retryable errors are tried again after waits that double."""
    for i in range(tries):
        try:
            return call()
        except ProviderError as e:
            if not e.retryable or i == tries - 1:
                raise
            sleep(min(most, first * 2**i))
    return None


def generate(rows: DataFrame, prompt: str, provider, max_tokens: int = 450, at_once: int = 4, wait: float = 1.0) -> DataFrame:
    """The rows with summary, model and error: one call a row, so many at once in a task; a failed call marks its own row only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text):
            try:
                return retried(lambda: provider.generate(text or "", max_tokens), first=wait), None
            except Exception as e:  # noqa: BLE001
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                got = list(pool.map(one, b[prompt]))
                yield b.assign(summary=[g[0] for g in got], model=provider.model, error=[g[1] for g in got])

    kept = [f for f in rows.schema.fields if f.name not in ("summary", "model", "error")]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*(f.name for f in kept)).mapInPandas(run, f"{types}, summary string, model string, error string")


def embed(rows: DataFrame, text: str, provider, batch: int = 32, wait: float = 1.0) -> DataFrame:
    """The rows with vector, dimensions, model and error; a failed or short answer marks every row of its batch, other batches go on. A provider that cannot embed raises at once."""
    if not can_embed(provider):
        raise ProviderError(f"{provider.model} cannot embed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch]
                vectors, error = [None] * len(part), None
                try:
                    got = retried(lambda part=part: provider.embed(list(part[text])), first=wait)
                    if len(got) != len(part):
                        error = f"{len(got)} vectors for {len(part)} texts"
                    else:
                        vectors = got
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                yield part.assign(vector=vectors, dimensions=[len(v) if v else 0 for v in vectors], model=provider.model, error=error)

    kept = [f for f in rows.schema.fields if f.name not in ("vector", "dimensions", "model", "error")]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*(f.name for f in kept)).mapInPandas(run, f"{types}, vector array<float>, dimensions int, model string, error string")


def tokens_used(docs: DataFrame) -> DataFrame:
    """(tokens): all prompt and completion tokens; unknown ones count nothing."""
    return docs.agg(F.coalesce(F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))), F.lit(0)).alias("tokens"))
