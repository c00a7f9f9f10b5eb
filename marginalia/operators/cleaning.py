"""Cleaners: rewrites of a text that keep track of where every character comes from."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.patterns import to_java
from marginalia.operators.kernel import Found, ReplaceOperation, Segment, TextOperation

#: Ligatures, dashes, quotes and signs that later steps expect in plain form.
PLAIN_CHARACTERS = {
    "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "’": "'", "‘": "'", "“": '"', "”": '"', "«": '"', "»": '"', "–": "-", "—": "-", "‐": "-", "…": "...", " ": " ", "­": "", "​": "", "¼": " 1/4 ", "½": " 1/2 ", "²": "2", "³": "3", "¨": "", "¥": "yen", "€": "euro", "·": " ", "•": "-",
}
TITLES = tuple("Dr M Mde Mlle Mme Mr Pr".split())
BEFORE_POINT = tuple("avec de des du la le les ou par pour un une".split())
AFTER_POINT = ("pour", "avec", "et")


class CharReplacer(ReplaceOperation):
    def __init__(self, output_label: str, rules: dict[str, str] | Iterable[tuple[str, str]] = PLAIN_CHARACTERS):
        rules = dict(rules)
        if any(len(k) != 1 for k in rules):
            raise ValueError("rules replace single characters")

        places = re.compile("[" + "".join(map(re.escape, rules)) + "]") if rules else None
        new, sizes = str.maketrans(rules), {k: len(v) for k, v in rules.items()}

        def hits(text: str) -> tuple[list[int], list[int], list[int], str]:
            at = [m.start() for m in places.finditer(text)] if places else []
            return at, [i + 1 for i in at], [sizes[text[i]] for i in at], text.translate(new) if at else text

        super().__init__("CharReplacer", {"label": output_label, "rules": rules}, output_label, hits)


def replace_characters(text: Column, rules: dict[str, str]) -> Column:
    """The text of CharReplacer as an expression: one translate for single characters, then the longer ones."""
    one = {k: v for k, v in rules.items() if len(v) == 1}
    none = [k for k, v in rules.items() if not v]
    text = F.translate(text, "".join(one) + "".join(none), "".join(one.values()))
    for k, v in rules.items():
        if len(v) > 1:
            text = F.replace(text, F.lit(k), F.lit(v))
    return text


class RegexpReplacer(ReplaceOperation):
    """Patterns and their replacements in one pass; the first rule that matches at a place wins. Groups are allowed."""

    def __init__(self, output_label: str, rules: Iterable[tuple[str, str]]):
        rules = tuple(rules)
        shifted, base = [], 1
        for i, (p, _) in enumerate(rules):
            shifted.append(f"(?P<rule__{i}>{p})")
            base += 1 + re.compile(p).groups
        rule = re.compile("|".join(shifted)) if rules else None
        new = {f"rule__{i}": r for i, (_, r) in enumerate(rules)}

        # Rules without groups of their own: the pattern splits a text into what lies between the matches and each rule's match.
        flat = re.compile("|".join(f"({p})" for p, _ in rules)) if rules and base == 1 + len(rules) else None
        put, k = [r for _, r in rules], len(rules) + 1

        def split(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
            parts = flat.split(text)
            between = parts[::k]
            which = np.array([[x is not None for x in parts[i::k]] for i in range(1, k)], bool).argmax(0).tolist() if k > 2 else [0] * (len(between) - 1)
            long = [0 if x is None else len(x) for x in parts]
            edge = np.cumsum(np.fromiter(long, np.int64, len(long)))
            out = [""] * (2 * len(between) - 1)
            out[::2], out[1::2] = between, [put[i] for i in which]
            return edge[:-1:k], edge[k - 1 : -1 : k], new_sizes[which], "".join(out)

        new_sizes = np.array([len(r) for r in put], np.int64)

        def one_by_one(text: str) -> tuple[list[int], list[int], list[int], str]:
            starts, ends, sizes, parts, at = [], [], [], [], 0
            for m in rule.finditer(text) if rule else ():
                a, b = m.span()
                made = new[m.lastgroup]  # a rule's own group is the last to close
                starts.append(a)
                ends.append(b)
                sizes.append(len(made))
                parts += (text[at:a], made)
                at = b
            parts.append(text[at:])
            return starts, ends, sizes, "".join(parts)

        hits = one_by_one if flat is None else split
        super().__init__("RegexpReplacer", {"label": output_label, "rules": rules}, output_label, hits)


def replace_patterns(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Rules one after the other as expressions in the JVM."""
    for pattern, new in rules:
        text = F.regexp_replace(text, to_java(pattern), new.replace("\\", "\\\\").replace("$", "\\$"))
    return text


class EDSCleaner(TextOperation):
    """Cleaning of French hospital reports: points, line ends, blanks, parentheses, points near small words."""

    def __init__(self, output_label="clean_text", keep_endlines=False, handle_parentheses_eds=True, handle_points_eds=True):
        def kernel(seg: Segment) -> Iterable[Found]:
            state = T.point_in_numbers(*T.point_in_capitals(seg.text, seg.spans))
            state = T.clean_blanks(*T.clean_newlines(*state, keep_endlines))
            if handle_parentheses_eds:
                state = T.clean_parentheses(*state)
            if handle_points_eds:
                state = T.point_after(*state, list(TITLES), strict=True)
                state = T.point_after(*state, list(BEFORE_POINT))
                state = T.point_before(*state, list(AFTER_POINT))
            yield Found(output_label, text=state[0], spans=state[1])

        super().__init__("EDSCleaner", {"label": output_label, "lines": keep_endlines, "parentheses": handle_parentheses_eds, "points": handle_points_eds}, kernel)


def strip_tags(html: Column) -> Column:
    """Readable text of a page: scripts, styles and tags go, common entities are resolved."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
