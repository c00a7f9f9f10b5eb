"""Entity matchers: regular expressions, fuzzy dictionaries, terminologies, token sequences."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia import data
from marginalia.functions import spans as S
from marginalia.functions import text as T
from marginalia.operators.context import fold_text, folded
from marginalia.operators.kernel import Found, Kind, RangeOperation, Rows, Segment, TextOperation, attribute, norm_attribute, pieces
from marginalia.plans.tables import written
from marginalia.schema import ANN, op_id, uid_column


@dataclass(frozen=True)
class Norm:
    kb_name: str
    kb_id: str
    kb_version: str | None = None


@dataclass(frozen=True)
class RegexpRule:
    pattern: str
    label: str
    term: str | None = None
    id: str | None = None
    version: str | None = None
    unicode_sensitive: bool = True
    case_sensitive: bool = True
    index_extract: int = 0
    exclusion: str | None = None
    norms: tuple[Norm, ...] = field(default=())

    def __post_init__(self):
        if not self.unicode_sensitive and not (self.pattern.isascii() and (self.exclusion or "").isascii()):
            raise ValueError("a rule for folded text must be ASCII")


def default_rules() -> list[RegexpRule]:
    """The rules that come with the package: measures, disorders, symptoms, procedures, drugs."""
    known = {"regexp": "pattern", "exclusion_regexp": "exclusion"}
    return [RegexpRule(**{known.get(k, k): v for k, v in row.items()}) for row in data.load("entities")]


class RegexpMatcher(RangeOperation):
    """All matches of all rules, overlaps included; an exclusion that occurs in the segment silences its rule there."""

    def __init__(self, rules: Iterable[RegexpRule] | None = None, attrs_to_copy=(), name="RegexpMatcher"):
        rules = default_rules() if rules is None else list(rules)
        ids = [r.id for r in rules]
        if any(i is None for i in ids) and any(ids) or len(set(filter(None, ids))) != len(list(filter(None, ids))):
            raise ValueError("either all rules have an id or none, and ids differ")
        flags = [0 if r.case_sensitive else re.IGNORECASE for r in rules]
        compiled = [(r, re.compile(r.pattern, f), re.compile(r.exclusion, f) if r.exclusion else None) for r, f in zip(rules, flags)]
        fold = any(not r.unicode_sensitive for r in rules)

        def ranges(text: str) -> Iterator[tuple[int, int, int]]:
            plain = T.to_ascii(text) if fold else text
            for n, (r, pattern, exclusion) in enumerate(compiled):
                on = text if r.unicode_sensitive else plain
                silenced = None
                for m in pattern.finditer(on):
                    if silenced is None:
                        silenced = exclusion is not None and exclusion.search(on) is not None
                    if silenced:
                        break
                    a, b = m.span(r.index_extract)
                    if a < b:
                        yield a, b, n

        kinds = []
        for n, r in enumerate(rules):
            attrs = [norm_attribute(kb_name=x.kb_name, kb_id=x.kb_id, kb_version=x.kb_version) for x in r.norms]
            if r.term is not None:
                attrs.append(norm_attribute(kb_name="rules", kb_id=r.id, kb_version=r.version, term=r.term))
            kinds.append(Kind(r.label, "entity", {"rule_id": r.id if r.id is not None else str(n), "version": r.version or ""}, attrs))
        super().__init__(name, {"rules": [r.__dict__ for r in rules]}, ranges, kinds, attrs_to_copy)


@dataclass(frozen=True)
class TermRule:
    term: str
    label: str
    unicode_sensitive: bool = False
    case_sensitive: bool = False
    norms: tuple[Norm, ...] = field(default=())


class TermIndex:
    """Trigrams of folded terms, for candidates of a similarity at or above a threshold."""

    def __init__(self, rules: Iterable[TermRule]):
        self.rules: dict[str, list[TermRule]] = {}
        for r in rules:
            self.rules.setdefault(T.to_ascii(r.term.lower(), keep_length=False), []).append(r)
        self.grams = {t: T.ngrams(t) for t in self.rules}
        self.by_gram: dict[str, list[str]] = {}
        for t, grams in self.grams.items():
            for g in grams:
                self.by_gram.setdefault(g, []).append(t)

    def similar(self, text: str, threshold: float, kind: str) -> list[str]:
        grams = T.ngrams(text)
        common: dict[str, int] = {}
        # Rarest grams first would prune more; a dictionary that is shipped to workers is small enough for all.
        for g in grams:
            for t in self.by_gram.get(g, ()):
                common[t] = common.get(t, 0) + 1
        return sorted(t for t in common if T.similarity(grams, self.grams[t], kind) >= threshold)


def best_matches(matches: list[tuple[float, int, int, object]], touching: bool = True) -> list[tuple[float, int, int, object]]:
    """Best score, then longest, first; what overlaps (or, by default, touches) a kept match goes. In text order."""
    kept: list[tuple[float, int, int, object]] = []
    for m in sorted(matches, key=lambda m: (-m[0], -(m[2] - m[1]))):
        apart = (lambda k: m[2] < k[1] or k[2] < m[1]) if touching else (lambda k: m[2] <= k[1] or k[2] <= m[1])
        if all(apart(k) for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[1])


class SimilarityMatcher(TextOperation):
    """Entities that are similar to terms of a dictionary that travels with the kernel."""

    def __init__(self, rules: Iterable[TermRule], threshold=0.9, min_length=3, max_length=50, similarity="jaccard", blacklist: Iterable[str] = (), same_beginning=False, attrs_to_copy=(), name="SimilarityMatcher", touching=True):
        rules, blacklist = list(rules), frozenset(blacklist)
        index = TermIndex(rules)

        def kernel(seg: Segment) -> Iterable[Found]:
            found = []
            memo: dict[str, list[str]] = {}
            for a, b in T.candidate_ranges(seg.text, min_length, max_length):
                raw = seg.text[a:b]
                plain = T.to_ascii(raw.lower(), keep_length=False)
                if plain not in memo:
                    memo[plain] = index.similar(plain, threshold, similarity)
                for term in memo[plain]:
                    if same_beginning and term[:1] != plain[:1]:
                        continue
                    for r in index.rules[term]:
                        if not r.case_sensitive and not r.unicode_sensitive:
                            mine, theirs = plain, term
                        else:
                            adapt = (lambda t: t) if r.case_sensitive and r.unicode_sensitive else (lambda t: t.lower()) if r.unicode_sensitive else (lambda t: T.to_ascii(t, keep_length=False))
                            mine, theirs = adapt(raw), adapt(r.term)
                        score = T.similarity(T.ngrams(theirs), T.ngrams(mine), similarity)
                        if theirs not in blacklist and score >= threshold:
                            found.append((score, a, b, r))
            for score, a, b, r in best_matches(found, touching):
                attrs = [norm_attribute(kb_name=x.kb_name, kb_id=x.kb_id, kb_version=x.kb_version, term=r.term, score=float(score)) for x in r.norms]
                yield Found(r.label, (a, b), kind="entity", attrs=attrs)

        super().__init__(name, {"rules": [r.__dict__ for r in rules], "threshold": threshold, "similarity": similarity}, kernel, attrs_to_copy)


#: Distinct grams up to which their frequencies are broadcast rather than shuffled.
MAX_GRAMS = 200_000


def fuzzy_join(candidates: DataFrame, terms: DataFrame, threshold: float = 0.9, text: str = "text", term: str = "term") -> DataFrame:
    """Pairs of candidate texts and terms of trigram Jaccard similarity at or above the threshold.

    Grams are ordered by how many texts have them, the rarest first, so that common grams rarely
    lie in the prefixes that the equi join is on.  A pair is scored where the first gram that
    their prefixes share brings it together, hence once; sizes that can't reach the threshold
    are left out before.
    """
    def grams_of(df: DataFrame, col: str) -> DataFrame:
        plain = df.select(F.col(col).alias("t")).where(F.col(col).isNotNull() & (F.length(col) > 0)).distinct().withColumn("plain", F.lower(folded(F.col("t"))))
        return plain.select("t", T.ngrams_column(F.col("plain")).alias("grams"))

    both = [written(grams_of(df, col), "grams") for df, col in ((candidates, text), (terms, term))]
    known = both[0].unionByName(both[1]).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("times"))
    known = written(known, "gram-counts")
    known = F.broadcast(known) if known.count() <= MAX_GRAMS else known

    def side(df: DataFrame, tag: str) -> DataFrame:
        ordered = df.select("t", F.explode("grams").alias("gram")).join(known, "gram").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("times", "gram"))).alias("o"))
        ordered = ordered.select("t", F.col("o.gram").alias("grams")).withColumn("n", F.size("grams"))
        prefix = F.slice("grams", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int") + 1)
        found = ordered.select(F.col("t").alias(tag), F.col("grams").alias(f"{tag}_grams"), F.col("n").alias(f"{tag}_n"), prefix.alias(f"{tag}_prefix"))
        return found.withColumn("gram", F.explode(f"{tag}_prefix"))

    left, right = side(both[0], "c_text"), side(both[1], "c_term")
    near = (F.col("c_text_n") * threshold <= F.col("c_term_n")) & (F.col("c_term_n") * threshold <= F.col("c_text_n"))
    first = F.get(F.array_intersect("c_text_prefix", "c_term_prefix"), 0) == F.col("gram")
    score = F.round(T.similarity_column(F.col("c_text_grams"), F.col("c_term_grams")), 6)
    pairs = left.join(right, "gram").where(near & first)
    return pairs.select(F.col("c_text").alias(text), F.col("c_term").alias(term), score.alias("score")).where(F.col("score") >= threshold)


def ngram_candidates(texts: DataFrame, longest: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, candidate, n: runs of up to `longest` words, as expressions."""
    words = texts.select(F.col(doc_id), F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("w"))
    at = words.select(doc_id, "w", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).where(F.size("w") >= F.col("n"))
    at = at.select(doc_id, "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice(F.col("w"), i, F.col("n")), " "))).alias("candidate"))
    return at.groupBy(doc_id, "candidate").agg(F.first("n").alias("n"), F.count("*").alias("times"))


# Terminologies.

GROUPS = dict(
    pair.split("=")
    for pair in """
    ACTI=activity
    ANAT=anatomy
    CHEM=chemical
    CONC=concept
    DEVI=device
    DISO=disorder
    GENE=genes_sequence
    GEOG=geographic_area
    LIVB=living_being
    OBJC=object
    OCCU=occupation
    ORGA=organization
    PHEN=phenomenon
    PHYS=physiology
    PROC=procedure
    """.split()
)


def terminology_rules(entries: Iterable[dict], labels: dict[str, str] | None = None, groups: Iterable[str] | None = None, lowercase=True, normalize_unicode=False, version: str | None = None) -> list[TermRule]:
    """Rules of terminology entries (cui, term, semgroups): the label is that of the first allowed group."""
    labels, allowed = GROUPS | (labels or {}), set(groups) if groups is not None else set(GROUPS)
    out = []
    for e in entries:
        mine = [g for g in e.get("semgroups") or [] if g in allowed]
        if not mine:
            continue
        term = T.acronym_of(e["term"]) or T.clean_term(e["term"])
        capitals = term.isupper()
        out.append(TermRule(term, labels[mine[0]], case_sensitive=capitals or not lowercase, unicode_sensitive=not normalize_unicode, norms=(Norm("umls", e["cui"], version),)))
    return out


class TerminologyMatcher(SimilarityMatcher):
    def __init__(self, entries: Iterable[dict], threshold=0.9, labels=None, groups=None, version=None, **settings):
        super().__init__(terminology_rules(entries, labels, groups, version=version), threshold, name="TerminologyMatcher", **settings)


#: Letters and signs of which Python and the JVM make the same lower case.
_FOREIGN = re.compile("[^\\x00-\\u024f\\u2000-\\u206f]")


class TermFilter:
    """Which sets of grams can be similar to a term: by the terms' own sets where these are few, else by the grams that occur in any."""

    def __init__(self, terms: list[list[str]] | None, vocabulary: Iterable[str] | None, least: int, most: int):
        self.terms = None if terms is None else [frozenset(t) for t in terms]
        self.known = None if vocabulary is None else frozenset(vocabulary)
        self.least, self.most, self.places = least, most, {}
        if terms is not None:
            for n, t in enumerate(self.terms):
                for g in t:
                    self.places.setdefault(g, []).append(n)
            self.known = frozenset(self.places)
            self.least, self.most = min(map(len, self.terms), default=0), max(map(len, self.terms), default=0)

    def near(self, grams: set[str], threshold: float) -> bool:
        """Whether a term is similar; True where the terms aren't at hand. One of the rarest grams that can't all be missing is common."""
        if self.terms is None:
            return True
        n = len(grams)
        rare = sorted(grams, key=lambda g: len(self.places.get(g, ())))[: n - math.ceil(n * threshold - 1e-3) + 1]
        for term in {t for g in rare for t in self.places.get(g, ())}:
            common = len(grams & self.terms[term])
            if common >= (threshold - 1e-5) * (n + len(self.terms[term]) - common):
                return True
        return False


def similar_ranges(text: str, shortest: int, longest: int, filter_: TermFilter, threshold: float) -> Iterator[tuple[int, int]]:
    """Candidate ranges but those that can't be similar to any term.

    With c common grams a similarity of t needs c >= t * n of the n grams of a candidate and of those of the term.  Grams are
    counted while a range grows, which only adds to them.  Texts are compared here where folding leaves their length and letters
    whose lower case is beyond doubt; others stay.
    """
    plain, known = fold_text(text), filter_.known
    foreign = _FOREIGN.search(plain) is not None
    at, seen, inside, end, over = -1, set(), 0, 0, False
    widest = filter_.most / threshold + 1e-3 if threshold > 0 else math.inf
    narrowest = filter_.least * threshold - 1e-3
    for a, b in T.candidate_ranges(text, shortest, longest):
        if len(plain) != len(text) or b - a < 3 or threshold <= 0 or (foreign and _FOREIGN.search(plain, a, b)):
            yield a, b
            continue
        if a != at:
            at, seen, inside, end, over = a, set(), 0, a, False
        if over:
            continue
        for i in range(end, b - 2):
            gram = plain[i : i + 3]
            if gram not in seen:
                seen.add(gram)
                inside += known is None or gram in known
        end = b - 2
        over = len(seen) > widest or len(seen) - inside > widest * (1 - threshold) + 1e-3
        if not over and len(seen) >= narrowest and inside >= threshold * len(seen) - 1e-3 and filter_.near(seen, threshold):
            yield a, b


class TerminologyJoin:
    """Entities similar to terms of a terminology of any size: both sides are tables, so nothing of it passes the driver or a closure.

    `entries` has cui, term and semgroups.  Candidate texts meet terms in `fuzzy_join`; the best
    matches of each segment are then chosen as the kernel matchers choose them.
    """

    def __init__(self, threshold: float = 0.9, min_length: int = 3, max_length: int = 50, labels: dict[str, str] | None = None, groups: Iterable[str] | None = None, version: str | None = None):
        self.threshold, self.lengths, self.version = threshold, (min_length, max_length), version
        self.labels = {g: name for g, name in (GROUPS | (labels or {})).items() if groups is None or g in set(groups)}
        self.op_id = op_id("TerminologyJoin", {"threshold": threshold, "lengths": self.lengths, "labels": self.labels, "version": version})

    def run(self, segments: DataFrame, entries: DataFrame) -> DataFrame:
        shortest, longest = self.lengths
        label = F.create_map(*(F.lit(x) for pair in self.labels.items() for x in pair))
        group = F.get(F.filter("semgroups", lambda g: g.isin(list(self.labels))), 0)
        terms = entries.select("cui", "term", label[group].alias("label")).where("label IS NOT NULL AND term <> ''").distinct()

        # What a candidate needs to be similar to any term is looked up where it is found: most candidates go no further.
        grams = written(terms.select("term").distinct().select(T.ngrams_column(F.lower(folded(F.col("term")))).alias("grams")).distinct(), "term-grams")
        size = grams.agg(F.min(F.size("grams")).alias("least"), F.max(F.size("grams")).alias("most"), F.sum(F.size("grams")).alias("all")).first()
        if (size["all"] or 0) <= MAX_GRAMS:
            filter_ = TermFilter(grams.toArrow().column(0).to_pylist(), None, 0, 0)
        else:
            vocabulary = grams.select(F.explode("grams").alias("gram")).distinct().limit(MAX_GRAMS + 1).toArrow().column(0).to_pylist()
            filter_ = TermFilter(None, vocabulary if len(vocabulary) <= MAX_GRAMS else None, size["least"], size["most"])
        sent = segments.sparkSession.sparkContext.broadcast(filter_)
        threshold = self.threshold

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in pieces(batches):
                found = [(u, a, b, t[a:b]) for u, t in zip(*(c.to_pylist() for c in batch.columns)) for a, b in similar_ranges(t or "", shortest, longest, known, threshold)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found) if found else ((), (), (), ()), (pa.string(), pa.int32(), pa.int32(), pa.string()))], ["uid", "a", "b", "text"])

        places = written(segments.select("uid", "text").mapInArrow(ranges, "uid string, a int, b int, text string"), "candidates")
        pairs = fuzzy_join(places, terms, self.threshold)
        hits = places.join(pairs, "text").join(terms, "term").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("a", "b", "score", "label", "cui", "term"))).alias("hits"))
        rows, version = Rows(self.op_id), self.version

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                for r in batch.to_pylist():
                    best = best_matches([(h["score"], h["a"], h["b"], h) for h in r["hits"]])
                    norms = ((a, b, score, h, norm_attribute(kb_name="umls", kb_id=h["cui"], kb_version=version, term=h["term"], score=score)) for score, a, b, h in best)
                    rows.add(Segment.of(r), (Found(h["label"], (a, b), kind="entity", attrs=[norm]) for a, b, _, h, norm in norms))
                yield rows.batch()

        found = segments.join(hits, "uid")
        return found.select("doc_id", "uid", "label", "text", "spans", "attrs", "hits").mapInArrow(choose, ANN)


class BestCandidateMatcher(SimilarityMatcher):
    """One candidate per place, as the best score and then the longest text decide; matches may touch."""

    def __init__(self, entries: Iterable[dict], threshold=0.7, similarity="jaccard", **settings):
        super().__init__(terminology_rules(entries), threshold, similarity=similarity, name="BestCandidateMatcher", touching=False, **settings)


class KeywordMatcher(TextOperation):
    """Keywords as sequences of tokens that may be up to `window` apart; skipped words leave a gap in the spans."""

    def __init__(self, keywords: Iterable[tuple[str, str, str | None]], window=1, stopwords: Iterable[str] = (), normalise: Callable[[str], str] | None = None, label_provider: Callable[[list], str] | None = None, attrs_to_copy=()):
        stop = frozenset(stopwords)
        fold = normalise or (lambda w: T.to_ascii(w.lower(), keep_length=False))
        table: dict[str, list[tuple[list[str], str, str | None, str]]] = {}
        for phrase, label, kb in keywords:
            words = [fold(w) for w in re.findall(r"\w+", phrase) if fold(w) not in stop]
            if words:
                table.setdefault(words[0], []).append((words, label, kb, phrase))

        def kernel(seg: Segment) -> Iterable[Found]:
            tokens = [(m.start(), m.end(), fold(m.group())) for m in re.finditer(r"\w+", seg.text)]
            tokens = [t for t in tokens if t[2] not in stop]
            for i, (_, _, w) in enumerate(tokens):
                for words, label, kb, phrase in table.get(w, ()):
                    at, places = i, [i]
                    for want in words[1:]:
                        nxt = next((j for j in range(at + 1, min(at + 1 + window, len(tokens))) if tokens[j][2] == want), None)
                        if nxt is None:
                            break
                        places.append(nxt)
                        at = nxt
                    if len(places) < len(words):
                        continue
                    text, spans = seg.text[tokens[i][0] : tokens[i][1]], S.cut(seg.spans, tokens[i][0], tokens[i][1])
                    for j, k in zip(places, places[1:]):
                        a = tokens[j][1] if k == j + 1 else tokens[k][0]
                        between = seg.text[a : tokens[k][0]] if k == j + 1 else " "
                        spans = spans + (S.cut(seg.spans, a, tokens[k][0]) if k == j + 1 else [S.Mod(1)]) + S.cut(seg.spans, tokens[k][0], tokens[k][1])
                        text += between + seg.text[tokens[k][0] : tokens[k][1]]
                    name = label_provider([phrase, label, kb]) if label_provider else label
                    attrs = [norm_attribute(kb_name="keywords", kb_id=kb, term=phrase)] if kb else []
                    yield Found(name, text=text, spans=spans, kind="entity", attrs=attrs)

        super().__init__("KeywordMatcher", {"keywords": [list(k) for k in keywords] if isinstance(keywords, (list, tuple)) else None, "window": window}, kernel, attrs_to_copy)


# Dates and tumour stagings.

_MONTHS = {w: n for n, ws in enumerate((("janvier", "january", "jan"), ("fevrier", "february", "feb"), ("mars", "march", "mar"), ("avril", "april", "apr"), ("mai", "may"), ("juin", "june", "jun"), ("juillet", "july", "jul"), ("aout", "august", "aug"), ("septembre", "september", "sept", "sep"), ("octobre", "october", "oct"), ("novembre", "november", "nov"), ("decembre", "december", "dec")), 1) for w in ws}
_UNIT = r"(?P<n>\d+|une?|deux|trois|one|two|three|a)\s+(?P<unit>ans?|annees?|mois|semaines?|jours?|heures?|minutes?|years?|months?|weeks?|days?|hours?)"
_DATE = re.compile(
    rf"\b(?P<iso>(?P<y1>\d{{4}})-(?P<m1>\d{{1,2}})-(?P<d1>\d{{1,2}}))\b|\b(?P<num>(?P<d2>\d{{1,2}})[/.](?P<m2>\d{{1,2}})(?:[/.](?P<y2>\d{{4}}|\d\d))?)\b"
    rf"|\b(?P<named>(?:(?P<d3>\d{{1,2}})(?:er|st|nd|rd|th)?\s+)?(?P<m3>{'|'.join(sorted(_MONTHS, key=len, reverse=True))})\b(?:\s+(?P<y3>\d{{4}}))?)"
    rf"|\b(?P<rel>(?P<dir>il y a|depuis|dans|in)\s+{_UNIT}|(?P<n2>\d+)\s+(?P<unit2>years?|months?|weeks?|days?)\s+ago)\b|\b(?P<dur>(?:pendant|durant|for)\s+(?P<n3>\d+)\s+(?P<unit3>ans?|mois|semaines?|jours?|years?|months?|weeks?|days?))\b",
    re.IGNORECASE,
)
_UNITS = {"an": "years", "annee": "years", "year": "years", "mois": "months", "moi": "months", "month": "months", "semaine": "weeks", "week": "weeks", "jour": "days", "day": "days", "heure": "hours", "hour": "hours", "minute": "minutes"}
_NUMBERS = {"un": 1, "une": 1, "one": 1, "a": 1, "deux": 2, "two": 2, "trois": 3, "three": 3}


class DateMatcher(TextOperation):
    """Dates (parts may be missing), durations and relative dates, with their parts as a typed attribute."""

    def __init__(self, output_label="date", attrs_to_copy=()):
        from marginalia.functions.dates import format_date, format_duration, format_relative

        def kernel(seg: Segment) -> Iterable[Found]:
            plain = T.to_ascii(seg.text)
            for m in _DATE.finditer(plain):
                g = m.groupdict()
                if g["rel"] or g["dur"]:
                    unit = (g["unit"] or g["unit2"] or g["unit3"]).lower()
                    unit = _UNITS.get(unit) or _UNITS[unit.rstrip("s")]
                    n = g["n"] or g["n2"] or g["n3"]
                    amount = {unit: int(n) if n.isdigit() else _NUMBERS[n.lower()]}
                    if g["dur"]:
                        attr = attribute(output_label, format_duration(**amount), "DurationAttribute", metadata=amount)
                    else:
                        way = "future" if (g["dir"] or "").lower() in ("dans", "in") else "past"
                        attr = attribute(output_label, format_relative(way, **amount), "RelativeDateAttribute", metadata=amount | {"direction": way})
                else:
                    y, mo, d = (g["y1"] or g["y2"] or g["y3"]), (g["m1"] or g["m2"] or g["m3"]), (g["d1"] or g["d2"] or g["d3"])
                    y = int(y) + (2000 if len(y) == 2 else 0) if y else None
                    mo = _MONTHS.get(mo.lower()) or int(mo)
                    if mo > 12 or (g["m3"] and not d and not y):
                        continue
                    parts = {"year": y, "month": mo, "day": int(d) if d else None}
                    attr = attribute(output_label, format_date(**parts), "DateAttribute", metadata={k: v for k, v in parts.items() if v is not None})
                yield Found(output_label, m.span(), kind="entity", attrs=[attr])

        super().__init__("DateMatcher", {"label": output_label}, kernel, attrs_to_copy)


_TNM = re.compile(r"\b(?P<prefix>[cpyramu]{0,2})T\s?(?P<tumour>is|[0-4x])(?P<suffix>[a-d]?)[\s,]*(?:(?:[cp]?)N\s?(?P<node>[0-3x])(?P<nspec>[a-c]?))?[\s,]*(?:(?:[cp]?)M\s?(?P<metastasis>[01x]))?(?:[\s,]*R\s?(?P<resection>[0-2]))?\b", re.IGNORECASE)


class TNMMatcher(TextOperation):
    def __init__(self, output_label="TNM", attrs_to_copy=()):
        from marginalia.functions.dates import tnm_string

        def kernel(seg: Segment) -> Iterable[Found]:
            for m in _TNM.finditer(seg.text):
                g = m.groupdict()
                if g["node"] is None and g["metastasis"] is None and not g["prefix"]:
                    continue
                parts = {"prefix": g["prefix"], "tumour": g["tumour"], "tumour_suffix": g["suffix"], "node": g["node"], "node_specification": g["nspec"], "metastasis": g["metastasis"], "resection": g["resection"]}
                yield Found(output_label, m.span(), kind="entity", attrs=[attribute(output_label, tnm_string(parts), "TNMAttribute", metadata={k: v for k, v in parts.items() if v})])

        super().__init__("TNMMatcher", {"label": output_label}, kernel, attrs_to_copy)


_ADICAP = re.compile(r"\b(?P<sampling_mode>[A-Z])(?P<technic>[A-Z])(?P<organ>[A-Z]{2})(?P<pathology>(?P<pathology_type>[0-9A-Z])(?P<lesion>[A-Z0-9])(?P<behaviour_type>[A-Z0-9])[A-Z0-9])\b")


class AdicapMatcher(TextOperation):
    """Codes of pathological anatomy: eight characters for sampling, technique, organ and lesion.

    `tables` has the meanings of the parts by their names (sampling_mode, technic, organ, pathology,
    pathology_type, behaviour_type); a part whose table lacks it keeps its code, and a code whose
    part isn't in a table that is given isn't one.
    """

    def __init__(self, tables: dict[str, dict[str, str]] | None = None, output_label="adicap", strict: bool = True, attrs_to_copy=()):
        tables = tables or {}

        def kernel(seg: Segment) -> Iterable[Found]:
            for m in _ADICAP.finditer(seg.text):
                parts = {k: v for k, v in m.groupdict().items() if k != "lesion"}
                if m.group().isalpha() and not tables or (strict and any(parts[k] not in known for k, known in tables.items() if k in parts)):
                    continue
                shown = {k: tables.get(k, {}).get(v, v) for k, v in parts.items()}
                attr = norm_attribute(kb_name="adicap", kb_id=m.group())
                yield Found(output_label, m.span(), kind="entity", attrs=[attr | {"attr_class": "ADICAPNormAttribute", "metadata": shown}])

        super().__init__("AdicapMatcher", {"label": output_label, "tables": tables, "strict": strict}, kernel, attrs_to_copy)


# Embeddings.


#: Bytes of term vectors that are broadcast at once.
MAX_VECTORS = 64 << 20
#: Multiplications of a task, and terms that a block of entities meets at once.
PRODUCTS_PER_TASK, TERMS_AT_ONCE = 40_000_000_000, 4096


def best_products(rows: np.ndarray, data: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The `top` largest products of each row, rounded to 4 decimals, and where in `data` they are; of equal ones the first count.

    Products are made a tile at a time; beyond the first tile only those that beat a row's last are looked at.
    """
    at = min(max(512, 4 * top), len(data))
    s = np.round(rows @ data[:at].T, 4)
    place = np.argsort(-s, axis=1, kind="stable")[:, :top]
    score = np.take_along_axis(s, place, 1)
    while at < len(data):
        s = rows @ data[at : at + TERMS_AT_ONCE].T
        last = np.where(np.isnan(score[:, -1]), -np.inf, score[:, -1])
        if score.shape[1] < top:
            last[:] = -np.inf
        row, col = np.nonzero(s > last[:, None] + 4e-5)  # what is rounded to more than the last exceeds it by 5e-5
        if len(row):
            who, k = np.unique(row), score.shape[1]
            r = np.concatenate([np.repeat(who, k), row])
            v = np.concatenate([score[who].ravel(), np.round(s[row, col], 4)])
            p = np.concatenate([place[who].ravel(), at + col])
            order = np.lexsort((p, np.where(np.isnan(v), np.inf, -v), r))
            r, v, p = r[order], v[order], p[order]
            first = np.searchsorted(r, who)
            best = first[:, None] + np.arange(k)
            score[who], place[who] = v[best], p[best]
        at += TERMS_AT_ONCE
    return score, place


def link_embeddings(entities: DataFrame, terms: DataFrame, top: int = 1, threshold: float | None = None, entity_id="vec_id", term_id="vec_id", vector="embedding", max_bytes: int = MAX_VECTORS) -> DataFrame:
    """entity_id, term_id, score (cosine, 4 decimals), rank of the `top` terms of each entity.

    Terms go in groups of at most about `max_bytes`, which every task of a pass over the entities
    gets as a broadcast; with several groups a window merges their lists.
    """
    spark = terms.sparkSession
    known = terms.where(F.col(vector).isNotNull()).select(F.col(term_id).alias("t"), F.col(vector).cast("array<double>").alias("v"))
    size = known.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).collect()[0]
    own = entities.where(F.col(vector).isNotNull()).select(F.col(entity_id).alias("e"), F.col(vector).cast("array<double>").alias("v"))
    shape = f"entity_id {own.schema['e'].dataType.simpleString()}, term_id {known.schema['t'].dataType.simpleString()}, score double"
    if not size["n"]:
        return spark.createDataFrame([], shape + ", rank int")
    groups = math.ceil(size["n"] * size["d"] * 8 / max_bytes)
    tasks = min(math.ceil(own.count() * size["n"] * size["d"] / groups / PRODUCTS_PER_TASK), 10_000)
    own = own.repartition(tasks) if tasks > spark.sparkContext.defaultParallelism else own

    def unit(rows: np.ndarray) -> np.ndarray:
        norm = np.sqrt((rows * rows).sum(1, keepdims=True))
        return rows / np.where(norm > 0, norm, 1)

    found = None
    for group in range(groups):
        part = (known if groups == 1 else known.where(F.pmod(F.xxhash64("t"), F.lit(groups)) == group)).orderBy("t").toArrow()
        if not part.num_rows:
            continue
        ids = part.column("t").combine_chunks()
        sent = spark.sparkContext.broadcast((ids, unit(np.asarray(part.column("v").combine_chunks().flatten()).reshape(part.num_rows, -1))))
        del part, ids

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            t, data = sent.value
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    rows = batch.slice(a, 256)
                    score, place = best_products(unit(np.asarray(rows.column(1).flatten()).reshape(rows.num_rows, -1)), data, top)
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(np.repeat(np.arange(rows.num_rows), score.shape[1]))), t.take(pa.array(place.ravel())), pa.array(score.ravel())], ["entity_id", "term_id", "score"])

        some = own.mapInArrow(run, shape)
        if groups > 1:  # one group after the other, so that workers and driver hold the vectors of one
            some = written(some, "links")
            sent.destroy()
        found = some if found is None else found.unionByName(some)
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("score"), "term_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return found if threshold is None else found.where(F.col("score") >= threshold)


def norm_rows(links: DataFrame, kb_name: str) -> DataFrame:
    """Attribute rows of linked entities, to be attached to them."""
    kb = F.col("term_id").cast("string")
    norm = F.struct(F.lit(kb_name).alias("kb_name"), kb.alias("kb_id"), F.lit(None).cast("string").alias("kb_version"), F.lit(None).cast("string").alias("term"), F.col("score"))
    return links.select(F.col("entity_id").cast("string").alias("owner_id"), uid_column(F.lit("norm"), F.col("entity_id"), kb).alias("uid"), F.lit("EntityNorm").alias("attr_class"), F.lit("NORMALIZATION").alias("label"), F.concat_ws(":", F.lit(kb_name), kb).alias("value"), F.lit("string").alias("value_type"), norm.alias("norm"))
