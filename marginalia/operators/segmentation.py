"""Segmenters: sentences, sections, clauses, and rule-driven sentence ends."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia import data
from marginalia.functions.text import strip_range
from marginalia.operators.kernel import Kind, RangeOperation, attribute

STRIPPED = ".;,?! \n\r\t"


class SentenceTokenizer(RangeOperation):
    """Sentences: lines, then runs between punctuation; a piece needs a word character."""

    def __init__(self, output_label="sentence", punct_chars=tuple(".;?!"), keep_punct=False, split_on_newlines=True, attrs_to_copy=()):
        marks = "".join(map(re.escape, punct_chars))
        line, piece = re.compile(r" *([^\n\r]+) *([\n\r]+|$)"), re.compile(rf" *([^{marks}]+) *([{marks}]+|$)")
        word = re.compile(r"\w")

        def split(text: str, rule: re.Pattern, with_mark: bool) -> Iterator[tuple[int, int]]:
            for m in rule.finditer(text):
                a, b = m.start(1), m.end(2) if with_mark else m.end(1)
                if b > a and word.search(text, a, b):
                    yield a, b

        def ranges(text: str) -> Iterator[tuple[int, int, int]]:
            lines = split(text, line, False) if split_on_newlines else [(0, len(text))]
            for a, b in lines:
                for s, e in split(text[a:b], piece, keep_punct):
                    yield a + s, a + e, 0

        super().__init__("SentenceTokenizer", {"label": output_label, "punct": list(punct_chars), "keep": keep_punct, "lines": split_on_newlines}, ranges, [Kind(output_label)], attrs_to_copy)


def sentence_texts(text: Column, punct: str = r".;?!") -> Column:
    """The texts of the default sentence rule as an array, without leaving the JVM."""
    found = F.regexp_extract_all(text, F.lit(rf" *([^{punct}\n\r]+)"), F.lit(1))
    return F.filter(found, lambda s: s.rlike(r"[\p{L}\p{N}_]"))


class SyntagmaTokenizer(RangeOperation):
    """Clauses: a separator begins the next clause. They lose `strip_chars` in front and white space at their end."""

    def __init__(self, separators: Iterable[str] | None = None, output_label="syntagma", strip_chars=STRIPPED, attrs_to_copy=()):
        separators = tuple(data.load("separators")["syntagmas"]["separators"] if separators is None else separators)
        rule = re.compile(rf" *(.+?)(?P<mark__>{'|'.join([*separators, '$'])})", re.DOTALL)

        def ranges(text: str) -> Iterator[tuple[int, int, int]]:
            begin = None
            for m in rule.finditer(text):
                a, b = strip_range(text, m.start(1) if begin is None else begin, m.end(1), strip_chars)
                begin = m.start("mark__")
                if a < b:
                    yield a, b, 0

        super().__init__("SyntagmaTokenizer", {"label": output_label, "separators": list(separators), "strip": strip_chars}, ranges, [Kind(output_label)], attrs_to_copy)


@dataclass(frozen=True)
class RenameRule:
    """section_name becomes new_section_name where one of other_sections comes later (BEFORE) or earlier (AFTER)."""

    section_name: str
    new_section_name: str
    other_sections: tuple[str, ...]
    order: str = "BEFORE"


def keyword_pattern(words: Iterable[str]) -> re.Pattern | None:
    """A pattern for keywords as whole words, the longest at each place; white space begins none."""
    known = sorted((w for w in words if w and not w[0].isspace()), key=lambda w: (-len(w), w))
    return re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, known))})(?!\w)") if known else None


def find_keywords(text: str, table: dict[str, str], longest: int, pattern: re.Pattern | None = None) -> list[tuple[str, int, int]]:
    """(name, start, end) of keywords as whole words, the longest at each place, from left to right."""
    pattern = pattern or keyword_pattern(w for w in table if len(w) <= longest)
    return [(table[m.group()], m.start(), m.end()) for m in pattern.finditer(text)] if pattern else []


def renamed(names: list[str], rules: Iterable[RenameRule]) -> list[str]:
    """Section names after the rules; they look at the names before, and later rules win."""
    out = list(names)
    for rule in rules:
        order = range(len(names)) if rule.order == "BEFORE" else range(len(names) - 1, -1, -1)
        waiting: list[int] = []
        for i in order:
            if names[i] == rule.section_name:
                waiting.append(i)
            if names[i] in rule.other_sections:
                for w in waiting:
                    out[w] = rule.new_section_name
                waiting.clear()
    return out


class SectionTokenizer(RangeOperation):
    """Sections from heading keywords; what comes before the first is 'head'. They lose `strip_chars` in front and white space at their end; one without text is left out."""

    def __init__(self, sections: dict[str, Iterable[str]] | None = None, output_label="section", rules: Iterable[RenameRule] = (), strip_chars=STRIPPED, keep_empty=False):
        if sections is None:
            whole = data.load("sections")
            sections, rules = whole["sections"], [*rules, *(RenameRule(r["section_name"], r["new_section_name"], tuple(r["other_sections"]), r["order"]) for r in whole["rules"])]
        table = {k: name for name, words in sections.items() for k in words}
        pattern, longest, rules = keyword_pattern(table), max(map(len, table), default=0), tuple(rules)
        names = list(dict.fromkeys(["head", *sections, *(r.new_section_name for r in rules)]))
        number = {name: k for k, name in enumerate(names)}

        def ranges(text: str) -> Iterator[tuple[int, int, int]]:
            found = find_keywords(text, table, longest, pattern)
            if not found or found[0][1]:
                found.insert(0, ("head", 0, 0))
            ends = [f[1] for f in found[1:]] + [len(text)]
            for name, (_, a, _), b in zip(renamed([f[0] for f in found], rules), found, ends):
                a, b = strip_range(text, a, b, strip_chars)
                if a < b or keep_empty:
                    yield a, b, number[name]

        kinds = [Kind(output_label, metadata={"name": name}, attrs=[attribute(output_label, name)]) for name in names]
        super().__init__("SectionTokenizer", {"label": output_label, "sections": {k: list(v) for k, v in sections.items()}, "rules": [r.__dict__ for r in rules]}, ranges, kinds)


def section_bounds(matches: DataFrame, length: str = "length") -> DataFrame:
    """The end of each section: the start of the next, else the end of the text. Columns: doc_id, start, length."""
    return matches.withColumn("end", F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")))\
        .withColumn("end", F.coalesce("end", length))


def rename_sections(matches: DataFrame, rule: RenameRule) -> DataFrame:
    """The same renaming as a window: a row takes the new name if a listed section follows or precedes it."""
    at = Window.partitionBy("doc_id").orderBy("start")
    at = at.rowsBetween(0, Window.unboundedFollowing) if rule.order == "BEFORE" else at.rowsBetween(Window.unboundedPreceding, 0)
    near = F.max(F.col("name").isin(list(rule.other_sections)).cast("int")).over(at) == 1
    return matches.withColumn("name", F.when((F.col("name") == rule.section_name) & near, rule.new_section_name).otherwise(F.col("name")))


def gate(pattern: str) -> re.Pattern | None:
    """What the pattern needs from its last point on, where that is simple to say: a text without it has no match."""
    at, depth, i = None, 0, 0
    while i < len(pattern):
        two, c = pattern[i : i + 2], pattern[i]
        if c == "\\":
            if two[1:].isdigit():
                return None
            if two == "\\." and not depth and pattern[i + 2 : i + 3] not in tuple("*+?{"):
                at = i
            i += 2
            continue
        if c == "[":
            i += 2 if pattern[i + 1 : i + 2] == "^" else 1
            i += pattern[i : i + 1] == "]"
            while i < len(pattern) and pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            return None
        i += 1
    return re.compile(pattern[at:]) if at and "(?P" not in pattern and not re.search(r"\(\?(?:\(|[aiLmsux])", pattern) else None


class RuleSentenceTokenizer(RangeOperation):
    """Sentences from end rules: (pattern, is_end); the last rule that matches at a mark decides."""

    DEFAULT = (
        (r"[.!?…]+[\"')\]»”’]*(?=\s|$)", True),  # a mark, and what closes after it
        (r"[.!?]+(?=[A-ZÀ-Þ][a-zà-ÿ])", True),  # a mark without the space that should follow
        (r"\n[ \t]*\n\s*", True),  # an empty line
        (r"\n(?=[ \t]*(?:[-•*–▪◦]|\d{1,2}[.)/]|[a-z]\))\s)", True),  # the next item of a list
        (r"\n(?=[ \t]*[A-ZÀ-Þ][^\n:]{1,60}:[ \t]*(?:\n|$))", True),  # before a heading on a line of its own
        (r"(?<=:)[ \t]*\n(?=\s*\S)", True),  # after it
        (r"\n(?=[ \t]*[A-ZÀ-Þ0-9][A-ZÀ-Þ0-9 ]{4,60}(?:\n|$))", True),  # before a line of capitals
        (r"\b(?:M|MM|Mme|Mmes|Mlle|Mlles|Mr|Mrs|Ms|Messrs|Dr|Drs|Dre|Pr|Prs|Prof|St|Ste|Me|Jr|Sr|Mgr)\.", False),  # titles
        (r"\b(?:cf|etc|vs|e\.g|i\.e|p\.ex|c\.-à-d|c\.à\.d|env|approx|resp|al|ca|viz|ibid|op\.cit|éd|ed|vol|chap|fig|tab|no|n°|num|réf|ref|p|pp|art|al)\.(?=\s*[a-zà-ÿ0-9(,;])", False),
        (r"\b(?:av|bd|boul|tél|tel|ext|apt|bât|bat|dept|dép|inc|ltd|corp|co|univ|hôp|hop|serv)\.(?=\s*[A-Za-zÀ-ÿ0-9])", False),  # addresses and firms
        (r"\b(?:janv|févr|fév|avr|juil|sept|oct|nov|déc|jan|feb|mar|apr|jun|jul|aug|sep|dec|lun|mar|mer|jeu|ven|sam|dim|mon|tue|wed|thu|fri|sat|sun)\.(?=\s*\d|\s+[a-z])", False),
        (r"\b(?:min|sec|hr|hrs|h|j|sem|mo|kg|mg|ml|cm|mm|gtt|cp|cps|comp|amp|inj|sol|susp|gél|caps|tab|max|moy|mini|maxi|q|b\.i\.d|t\.i\.d|q\.i\.d|p\.o|i\.v|i\.m|s\.c|p\.r\.n|h\.s)\.(?=\s*[a-zà-ÿ0-9(,;/])", False),  # units and doses
        (r"(?<=[0-9])[.](?=[0-9])", False),  # numbers
        (r"(?:^|(?<=\n))[ \t]*\d{1,2}\.(?=\s)", False),  # numbers of list items
        (r"(?<=\d\.\d)\.(?=\d)", False),
        (r"\b[A-ZÀ-Þ]\.(?=[ \t]?[A-ZÀ-Þ][.\w])", False),  # initials
        (r"\b(?:[A-Za-z]\.){2,}(?=\s*[a-zà-ÿ0-9,;)])", False),  # abbreviations of letters
        (r"\.{2,}(?=\s*[a-zà-ÿ])", False),  # dots that trail off
        (r"[!?]+[)»\"](?=\s*[a-zà-ÿ])", False),  # a mark within a remark
        (r"\.(?=[a-z]{2,4}\b)", False),  # names of files and hosts
    )

    def __init__(self, output_label="sentence", rules=DEFAULT, keep_newlines=True, attrs_to_copy=()):
        compiled, word = [(re.compile(p), gate(p), end) for p, end in rules], re.compile(r"\w")

        def ranges(text: str) -> Iterator[tuple[int, int, int]]:
            if not keep_newlines:
                text = text.replace("\n", " ")
            ends: dict[int, bool] = {}
            for rule, needed, is_end in compiled:
                if needed is None or needed.search(text):
                    for m in rule.finditer(text):
                        ends[m.end()] = is_end
            at = 0
            for cut in [*(e for e in sorted(ends) if ends[e]), len(text)]:
                a, b = strip_range(text, at, cut)
                at = cut
                if a < b and word.search(text, a, b):
                    yield a, b, 0

        super().__init__("RuleSentenceTokenizer", {"label": output_label, "rules": [list(r) for r in rules], "lines": keep_newlines}, ranges, [Kind(output_label)], attrs_to_copy)
