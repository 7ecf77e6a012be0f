"""Configurations: JSON files (YAML where a reader for it is installed) with variables of the environment, laid over each
other."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping, Sequence
from pathlib import Path

from ravelin.operators.models import merged

VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def _yaml():
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("YAML configurations need a YAML reader") from missing
    return yaml


def filled(value, variables: Mapping[str, str]):
    """${NAME} and ${NAME:-default} in all strings; a name without value or default is an error."""
    if isinstance(value, str):
        def of(m: re.Match) -> str:
            if m[1] in variables:
                return variables[m[1]]
            if m[2] is None:
                raise KeyError(m[1])
            return m[2]

        return VARIABLE.sub(of, value)
    if isinstance(value, Mapping):
        return {k: filled(v, variables) for k, v in value.items()}
    return [filled(v, variables) for v in value] if isinstance(value, list) else value


def load(path: str, over: Sequence[Mapping] = (), settings: Mapping[str, object] | None = None, variables: Mapping[str, str] | None = None) -> dict:
    """The configuration of a file, others laid over it in order, then single settings by dotted names."""
    text = Path(path).read_text(encoding="utf-8")
    out = _yaml().safe_load(text) if path.endswith((".yaml", ".yml")) else json.loads(text)
    for more in over:
        out = merged(out, more)
    for name, value in (settings or {}).items():
        for part in reversed(name.split(".")):
            value = {part: value}
        out = merged(out, value)
    return filled(out, os.environ if variables is None else variables)


def save(config: Mapping, path: str) -> None:
    text = _yaml().safe_dump(dict(config)) if path.endswith((".yaml", ".yml")) else json.dumps(config, indent=1, sort_keys=True)
    Path(path).write_text(text, encoding="utf-8")
