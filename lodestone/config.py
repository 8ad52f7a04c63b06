"""Settings of a retrieval request, layered: request over mode over defaults."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace

from lodestone.operators.ranking import MODES


@dataclass(frozen=True)
class Retrieval:
    n_variants: int = 6
    n_retrieve: int = 60
    n_context: int = 16
    max_per_paper: int = 3
    rerank_top_n: int = 150
    rerank_weight: float = 0.6
    authority: float = 1.0
    review: float = 0.0
    bm25_weight: float = 1.0
    allowed_types: list[str] = field(default_factory=list)
    preferred_sections: list[str] = field(default_factory=list)


def effective(mode: str | None = None, **request: object) -> Retrieval:
    """The settings in force. Unknown modes add nothing; values out of range are clamped;
    unknown names are an error."""
    out = replace(Retrieval(), **MODES.get(mode or "", {}))
    out = replace(out, **{k: v for k, v in request.items() if v is not None})
    return replace(out, rerank_top_n=min(300, max(1, out.rerank_top_n)), rerank_weight=min(1.0, max(0.0, out.rerank_weight)))


def load_settings(path: str) -> dict:
    """Settings from a JSON (or, where a parser is there, YAML) file; ~ in paths is the home."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml

        out = yaml.safe_load(text)
    except ImportError:
        out = json.loads(text)
    for k, v in (out.get("paths") or {}).items():
        if isinstance(v, str):
            out["paths"][k] = os.path.expanduser(v)
    return out


NAMES = [f.name for f in fields(Retrieval)]
