"""Rule sets that come with the package: French and English, written for clinical reports."""

from __future__ import annotations

from functools import cache
from pathlib import Path

import yaml


@cache
def load(name: str):
    """The content of a file of this folder."""
    return yaml.safe_load((Path(__file__).parent / f"{name}.yml").read_text(encoding="utf-8"))


_PERSONS = {"présent": ("e", "es", "ons", "ez", "ent"), "imparfait": ("ais", "ait", "ions", "iez", "aient"), "futur": ("erai", "eras", "era", "erons", "erez", "eront"), "conditionnel": ("erais", "erait", "erions", "eriez", "eraient"), "participe": ("é", "ée", "és", "ées", "ant")}
_HARD = {"c": "ç", "g": "ge"}


def conjugated(verb: str, tenses: tuple[str, ...] = tuple(_PERSONS)) -> list[str]:
    """Forms of a French verb in -er by tense; softened stems and é before a mute ending as the regular rules have them."""
    stem, out = verb.removesuffix("er"), []
    for tense in tenses:
        for end in _PERSONS[tense]:
            base = stem
            if stem[-1] in _HARD and end[0] in "aoâ":
                base = stem[:-1] + _HARD[stem[-1]]
            mute = end in ("e", "es", "ent") if tense == "présent" else False
            if mute and len(stem) > 2 and stem[-2] == "é":
                base = stem[:-2] + "è" + stem[-1]
            out.append(base + end)
    return out


@cache
def hypothesis_verbs() -> dict[str, list[str]]:
    """Verb forms that tell a hypothesis, by verb: any form of verbs of doubt, the conditional of others, and listed forms."""
    whole = load("hypothesis")
    out = {v: [v, *conjugated(v)] for v in whole["doubt"] if v.endswith("er") and not v.endswith("ndre")}
    out |= {v: conjugated(v, ("conditionnel",)) for v in whole["conditional"] if v.endswith("er") and v not in out}
    return out | whole["irregular"]
