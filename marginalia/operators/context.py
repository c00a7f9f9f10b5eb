"""Context of segments: negation, family, hypothesis. Rules become one CASE expression, so nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import data
from marginalia.functions.patterns import to_java
from marginalia.functions.text import _EXTRA, _fold
from marginalia.schema import ATTR, op_id, uid_column


@dataclass(frozen=True)
class Rule:
    pattern: str
    exclusions: tuple[str, ...] = field(default=())
    id: str | None = None
    unicode_sensitive: bool = False
    case_sensitive: bool = False

    def __post_init__(self):
        if not self.unicode_sensitive and not all(p.isascii() for p in (self.pattern, *self.exclusions)):
            raise ValueError("a rule for folded text must be ASCII")


def check_rules(rules: Iterable[Rule]) -> None:
    ids = [r.id for r in rules]
    if any(i is None for i in ids) and any(i is not None for i in ids):
        raise ValueError("either all rules have an id or none")
    if len({i for i in ids if i is not None}) != sum(i is not None for i in ids):
        raise ValueError("ids of rules must differ")


_ONE_TO_ONE = {c: f for c in map(chr, range(0x80, 0x250)) if len(f := _fold(c)) == 1} | {c: f for c, f in _EXTRA.items() if len(f) == 1}


def folded(text: Column) -> Column:
    """ASCII form of the letters that have one of the same length; offsets stay."""
    return F.translate(text, "".join(_ONE_TO_ONE), "".join(_ONE_TO_ONE.values()))


_FOLDS = str.maketrans(_ONE_TO_ONE)


def fold_text(text: str) -> str:
    """The same of a text in lower case, outside the JVM."""
    return text.translate(_FOLDS).lower()


def first_rule(text: Column, ascii_text: Column, rules: list[Rule]) -> Column:
    """Id (or index) of the first rule that matches and isn't excluded; null if none does."""
    chosen: Column | None = None
    for n, r in enumerate(rules):
        on = text if r.unicode_sensitive else ascii_text
        hit = on.rlike(to_java(r.pattern, not r.case_sensitive))
        if r.exclusions:
            hit = hit & ~on.rlike(to_java("|".join(f"(?:{e})" for e in r.exclusions), not r.case_sensitive))
        name = F.lit(r.id if r.id is not None else str(n))
        chosen = F.when(hit, name) if chosen is None else chosen.when(hit, name)
    return F.when(text.rlike("(?i)[a-z]"), chosen) if chosen is not None else F.lit(None).cast("string")


class ContextDetector:
    """Adds a true or false attribute to every segment; where it is true the metadata tell the rule."""

    def __init__(self, output_label: str, rules: Iterable[Rule], name: str = "ContextDetector"):
        self.rules, self.output_label, self.name = list(rules), output_label, name
        check_rules(self.rules)
        self.op_id = op_id(name, {"label": output_label, "rules": [r.__dict__ for r in self.rules]})

    def why(self, text: Column, ascii_text: Column) -> tuple[Column, Column]:
        """Metadata key and value of the reason, null if there is none."""
        return F.lit("rule_id"), first_rule(text, ascii_text, self.rules)

    def flags(self, segments: DataFrame) -> DataFrame:
        """Segments with the columns `reason_key`, `reason`, `flag`."""
        with_ascii = segments.withColumn("ascii_", folded(F.col("text")))
        key, why = self.why(F.col("text"), F.col("ascii_"))
        return with_ascii.withColumn("reason_key", key).withColumn("reason", why).withColumn("flag", F.col("reason").isNotNull()).drop("ascii_")

    def extra(self) -> Column:
        return F.create_map(F.col("reason_key"), F.col("reason"))

    def run(self, segments: DataFrame) -> DataFrame:
        """The segments with the attribute added to their own."""
        found = self.flags(segments)
        attr = F.struct(
            uid_column(F.lit(self.op_id), F.col("uid")).alias("uid"), F.lit("Attribute").alias("attr_class"), F.lit(self.output_label).alias("label"), F.col("flag").cast("string").alias("value"), F.lit("bool").alias("value_type"),
            F.lit(None).cast("struct<kb_name: string, kb_id: string, kb_version: string, term: string, score: double>").alias("norm"), F.when(F.col("flag"), self.extra()).alias("metadata"),
        )
        none = F.array().cast(f"array<{ATTR}>")
        return found.withColumn("attrs", F.concat(F.coalesce("attrs", none), F.array(attr).cast(f"array<{ATTR}>"))).drop("reason_key", "reason", "flag")


def default_rules(name: str) -> list[Rule]:
    """The rules of a set that comes with the package: negation, family or hypothesis."""
    rows = data.load(name)
    return [Rule(r["regexp"], tuple(r.get("exclusion_regexps") or ()), r["id"]) for r in (rows["rules"] if isinstance(rows, dict) else rows)]


class NegationDetector(ContextDetector):
    def __init__(self, output_label="negation", rules: Iterable[Rule] | None = None):
        super().__init__(output_label, default_rules("negation") if rules is None else rules, "NegationDetector")


class FamilyDetector(ContextDetector):
    def __init__(self, output_label="family", rules: Iterable[Rule] | None = None):
        super().__init__(output_label, default_rules("family") if rules is None else rules, "FamilyDetector")


class HypothesisDetector(ContextDetector):
    """Verb forms first, then rules; segments longer than max_length are never hypotheses."""

    def __init__(self, output_label="hypothesis", rules: Iterable[Rule] | None = None, verbs: dict[str, list[str]] | None = None, modes_and_tenses: Iterable[tuple[str, str]] = (), max_length=150):
        super().__init__(output_label, default_rules("hypothesis") if rules is None else rules, "HypothesisDetector")
        verbs = data.hypothesis_verbs() if verbs is None else verbs
        wanted = tuple(modes_and_tenses)
        # A verb's forms are a list, or lists by mood and tense.
        pick = lambda forms: [f for mood, tense in wanted for f in forms.get(mood, {}).get(tense, [])] if isinstance(forms, dict) else forms
        self.verbs, self.max_length = {v: pick(f) for v, f in verbs.items() if pick(f)}, max_length
        self.op_id = op_id(self.name, {"rules": self.op_id, "verbs": self.verbs, "max": max_length})

    def why(self, text: Column, ascii_text: Column) -> tuple[Column, Column]:
        import re

        holds = lambda forms: text.rlike(to_java(rf"\b(?:{'|'.join(map(re.escape, forms))})\b", True))
        verb: Column | None = None
        for name, forms in self.verbs.items():
            verb = F.when(holds(forms), F.lit(name)) if verb is None else verb.when(holds(forms), F.lit(name))
        # One pass for all forms first: few texts hold any.
        verb = F.lit(None).cast("string") if verb is None else F.when(holds([f for forms in self.verbs.values() for f in forms]), verb)
        able = (F.length(text) <= self.max_length) & text.rlike("(?i)[a-z]")
        verb, rule = F.when(able, verb), F.when(able, first_rule(text, ascii_text, self.rules))
        return F.when(verb.isNotNull(), "matched_verb").otherwise("rule_id"), F.coalesce(verb, rule)

    def extra(self) -> Column:
        kind = F.when(F.col("reason_key") == "matched_verb", "verb").otherwise("rule")
        return F.create_map(F.lit("type"), kind, F.col("reason_key"), F.col("reason"))
