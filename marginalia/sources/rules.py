"""Rule files: YAML in, typed rules out, and back."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, fields
from pathlib import Path

import yaml

from marginalia.operators.context import Rule
from marginalia.operators.matching import Norm, RegexpRule, TermRule
from marginalia.operators.segmentation import RenameRule

_ALIASES = {"regexp": "pattern", "exclusion_regexps": "exclusions", "exclusion_regexp": "exclusion", "normalizations": "norms"}


def _load(path: str, encoding: str) -> object:
    return yaml.safe_load(Path(path).read_text(encoding=encoding))


def _build(kind: type, row: dict):
    known = {f.name for f in fields(kind)}
    made = {}
    for k, v in row.items():
        k = _ALIASES.get(k, k)
        if k not in known:
            raise ValueError(f"{kind.__name__} has no field {k!r}")
        if k == "norms":
            v = tuple(Norm(n["kb_name"], str(n.get("kb_id", n.get("id"))), n.get("kb_version")) for n in v or ())
        elif isinstance(v, list):
            v = tuple(v)
        made[k] = v
    return kind(**made)


def _plain(value):
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def load_rules(path: str, kind: type = RegexpRule, encoding: str = "utf-8") -> list:
    """Rules of a file, as RegexpRule, TermRule, context Rule or RenameRule."""
    return [_build(kind, row) for row in _load(path, encoding) or []]


def save_rules(rules: Iterable, path: str, encoding: str = "utf-8") -> None:
    text = yaml.safe_dump([_plain(asdict(r)) for r in rules], allow_unicode=True, sort_keys=False)
    Path(path).write_text(text, encoding=encoding)


load_regexp_rules = lambda path: load_rules(path, RegexpRule)
load_term_rules = lambda path: load_rules(path, TermRule)
load_context_rules = lambda path: load_rules(path, Rule)


def load_sections(path: str, encoding: str = "utf-8") -> tuple[dict[str, list[str]], list[RenameRule]]:
    whole = _load(path, encoding)
    return whole["sections"], [_build(RenameRule, r) for r in whole.get("rules") or []]


def save_sections(sections: dict[str, Iterable[str]], rules: Iterable[RenameRule], path: str, encoding: str = "utf-8") -> None:
    whole = {"sections": {k: list(v) for k, v in sections.items()}, "rules": [_plain(asdict(r)) for r in rules]}
    Path(path).write_text(yaml.safe_dump(whole, allow_unicode=True, sort_keys=False), encoding=encoding)


def load_separators(path: str, encoding: str = "utf-8") -> tuple[str, ...]:
    return tuple(_load(path, encoding)["syntagmas"]["separators"])


def save_separators(separators: Iterable[str], path: str, encoding: str = "utf-8") -> None:
    Path(path).write_text(yaml.safe_dump({"syntagmas": {"separators": list(separators)}}, allow_unicode=True), encoding=encoding)


def load_verbs(path: str, encoding: str = "utf-8") -> dict[str, dict[str, dict[str, list[str]]]]:
    """Forms by verb, mood and tense."""
    return _load(path, encoding)
