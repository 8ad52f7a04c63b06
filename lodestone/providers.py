"""Interfaces of outside services, with deterministic defaults that need no network."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, OrderedDict
from typing import Protocol

import numpy as np

_WORD = re.compile(r"[^\W_]+")


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Expander(Protocol):
    def variants(self, query: str, mode: str) -> list[tuple[str, str | None]]: ...


class HashingEmbedder:
    """Unit vectors of signed, hashed word counts."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            for w in _WORD.findall((text or "").lower()):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                row[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1.0)


class CachedEmbedder:
    """An embedder that remembers its last texts, as many as ``size``."""

    def __init__(self, inner: Embedder, size: int = 256):
        self.inner, self.size = inner, size
        self._held: OrderedDict[str, np.ndarray] = OrderedDict()

    def embed(self, texts: list[str]) -> np.ndarray:
        missing = [t for t in dict.fromkeys(texts) if t not in self._held]
        fresh = dict(zip(missing, self.inner.embed(missing))) if missing else {}
        out = []
        for t in texts:
            if t in fresh:
                out.append(fresh[t])
            else:
                self._held.move_to_end(t)
                out.append(self._held[t])
        for t, v in fresh.items():
            self._held[t] = v
            if len(self._held) > self.size:
                self._held.popitem(last=False)
        return np.array(out)


def passage_prompt(kinds: list[str], prompts: dict[str, str], generic: str) -> str:
    """The prompt of the kind that most query hits are of; a tie, or a kind without a prompt,
    takes the generic one."""
    counts = Counter(kinds).most_common(2)
    if not counts or len(counts) > 1 and counts[0][1] == counts[1][1]:
        return generic
    return prompts.get(counts[0][0], generic)


class OverlapReranker:
    """The share of the query's words that a text holds."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        q = set(_WORD.findall(query.lower()))
        return [len(q & set(_WORD.findall((t or "").lower()))) / max(1, len(q)) for t in texts]


class TemplateExpander:
    """Typed variants of a query from templates, as where no language model answers."""

    # The variants of each kind of mode.
    BACKGROUND = (
        ("{}", "background"), ("definition and principles of {}", "background"), ("how {} works mechanism", "method"),
        ("properties and characteristics of {}", "method"),
    )
    OTHER = (("{}", None), ("methods and approaches for {}", "method"), ("experimental results of {}", "result"), ("limitations of {}", "limitation"))

    def variants(self, query: str, mode: str) -> list[tuple[str, str | None]]:
        return [(t.format(query), kind) for t, kind in (self.BACKGROUND if mode == "background" else self.OTHER)]
