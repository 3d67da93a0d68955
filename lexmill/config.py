"""Settings of the retrieval jobs, from YAML with ``${NAME:default}`` taken from the environment."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping
from typing import Any


# Names and defaults of the settings file.
@dataclasses.dataclass(frozen=True)
class Retrieval:
    """Parameters of search and ranking; a value of 0 or false in the file is kept, a missing one takes the default."""

    bm25_weight: float = 0.4
    vector_weight: float = 0.6
    query_bonus_weight: float = 0.1
    top_k: int = 8
    bm25_top_k: int = 12
    vector_top_k: int = 12
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    context_max_docs: int = 4
    context_max_chars_per_doc: int = 1400


def substituted(text: str, environment: Mapping[str, str] | None = None) -> str:
    """Text with its ``${NAME}`` and ``${NAME:default}`` replaced; one without a value or default is empty, an unclosed one stays."""
    known = os.environ if environment is None else environment
    head, *rest = text.split("${")
    out = [head]
    for part in rest:
        name, closed, tail = part.partition("}")
        name, _, default = name.partition(":")
        if closed and name.isidentifier():
            out += [known.get(name) or default, tail]
        else:
            out += ["${", part]
    return "".join(out)


def read(text: str, environment: Mapping[str, str] | None = None) -> Retrieval:
    """Settings of a YAML text; unknown keys are ignored, an empty text gives the defaults."""
    import yaml

    given: dict[str, Any] = yaml.safe_load(substituted(text, environment)) or {}
    kinds = {f.name: type(f.default) for f in dataclasses.fields(Retrieval)}
    return Retrieval(**{k: kinds[k](v) for k, v in given.items() if k in kinds and v is not None})
