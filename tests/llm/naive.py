"""The corpus operators written out without tables, kernels or shortcuts: what the fast ones are held against.

Nothing here uses a computation of the package; only its parameters, its patterns of protected
entities and the (separately tested) lanes of a signature are taken from it.
"""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex

from marginalia.llm import decontaminate, language, neardup, private, quality

WORD = re.compile("[0-9A-Za-z_\u0080-\U0010ffff]+")


def words_of(text):
    return WORD.findall((text or "").lower())


# language


class Backoff:
    def __init__(self, rows):
        """rows: (text, language) of the labelled documents."""
        counts = defaultdict(Counter)
        for text, lang in rows:
            if lang is not None:
                counts[lang].update(words_of(text))
        self.languages = sorted(lang for lang in counts if counts[lang])
        total = Counter()
        for lang in self.languages:
            total.update(counts[lang])
        self.known = {w for w, n in total.items() if n >= language.MIN_WORD}
        self.words, self.size = counts, {lang: sum(counts[lang].values()) for lang in self.languages}
        self.grams = {n: {lang: Counter() for lang in self.languages} for n in range(1, 5)}
        for lang in self.languages:
            for w, times in counts[lang].items():
                padded = "\2" + w + "\3"
                for n in range(1, 5):
                    for a in range(len(padded) - n + 1):
                        self.grams[n][lang][padded[a : a + n]] += times
        self.of_n = {n: {lang: sum(self.grams[n][lang].values()) for lang in self.languages} for n in self.grams}
        self.memo = {}

    def word(self, w):
        """Scores by language, and whether the word is supported."""
        if w in self.memo:
            return self.memo[w]
        if w in self.known:
            out = [math.log((self.words[lang][w] + 0.1) / (self.size[lang] + 1)) for lang in self.languages], True
        else:
            padded, scores, support = "\2" + w + "\3", [0.0] * len(self.languages), 0
            for a in range(len(padded)):
                for n in range(4, 0, -1):
                    g = padded[a : a + n]
                    if len(g) == n and sum(self.grams[n][lang][g] for lang in self.languages) >= language.MIN_GRAM:
                        scores = [s + math.log((self.grams[n][lang][g] + 0.1) / (self.of_n[n][lang] + 1)) for s, lang in zip(scores, self.languages)]
                        support += n > 1
                        break
            out = [s / len(padded) for s in scores], support * 2 >= len(padded)
        self.memo[w] = out
        return out

    def decide(self, text):
        """language or 'und', confidence, coverage, keep."""
        found = [self.word(w) for w in words_of(text)]
        if not found or not self.languages:
            return "und", None, 0.0, False
        totals = [sum(f[0][k] for f in found) for k in range(len(self.languages))]
        best = max(range(len(totals)), key=lambda k: (totals[k], -k))
        confidence = 1 / sum(math.exp(t - totals[best]) for t in totals)
        coverage = sum(f[1] for f in found) / len(found)
        keep = confidence >= language.MIN_CONFIDENCE and coverage >= language.MIN_COVERAGE
        return self.languages[best] if keep else "und", confidence, coverage, keep


# near duplicates


def near_groups(texts, radius=neardup.RADIUS):
    """The group (smallest index) of each text; texts without words are alone."""
    lanes, has = neardup.signatures(pa.array(texts, pa.string()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if has[i] and has[j] and sum(a != b for a, b in zip(lanes[i].tolist(), lanes[j].tolist())) <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


# benchmark passages


def holds_item(text, item):
    """'phrase', 'proximity' or None, by trying every diagonal."""
    terms, own = [re.findall("[0-9a-z_\u0080-\U0010ffff]+", t.lower()) for t in (item or "", text or "")]
    n = len(terms)
    if not n:
        return None
    places = defaultdict(list)
    for p, w in enumerate(own):
        places[w].append(p)
    if any(own[a : a + n] == terms for a in places[terms[0]]):
        return "phrase"
    if n < decontaminate.SHORT:
        return None
    near = defaultdict(set)
    votes = {p - i for i, t in enumerate(terms) for p in places[t]}
    for i, t in enumerate(terms):
        for p in places[t]:
            for d in range(p - i - decontaminate.SLACK, p - i + decontaminate.SLACK + 1):
                near[d].add(i)
    need = math.ceil(decontaminate.RATIO * n - 1e-9)
    return "proximity" if any(len(near[d]) >= need for d in votes) else None


# personal data

TERM = re.compile(r"[^\W_]+")
SPLIT = regex.compile(r"[^\p{L}\p{N}]+")


def _mentions(text):
    """(entity, terms near it) of each mention."""
    found = private.entities(text or "")
    plain = text or ""
    for s, e, _, _ in found:
        plain = plain[:s] + " " * (e - s) + plain[e:]
    terms = [(m.start(), m.group().lower()) for m in TERM.finditer(plain)]
    for s, _, kind, value in found:
        before = [t for at, t in terms if at < s][-private.WINDOW :]
        after = [t for at, t in terms if at >= s][: private.WINDOW]
        yield f"{kind}:{value.lower()}", set(before + after)


def disclosing(texts):
    """{(entity, term)} whose smoothed PMI reaches the share of the entity's information content."""
    distinct = {t for t in texts if t is not None}
    mention, together, has = defaultdict(set), defaultdict(set), Counter()
    for t in distinct:
        for entity, terms in _mentions(t):
            mention[entity].add(t)
            for w in terms:
                together[entity, w].add(t)
        has.update({w for w in SPLIT.split(t.lower()) if w})
    n, out = max(len(distinct), 1), set()
    for (entity, w), docs in together.items():
        p_e, p_t, p_et = len(mention[entity]) / n, (max(has[w], len(docs)) + private.SMOOTHING) / n, len(docs) / n
        if math.log2(p_et / (p_e * p_t)) >= private.ALPHA * -math.log2(p_e) - 1e-9:
            out.add((entity, w))
    return out


def sanitised(text, pairs):
    if text is None:
        return None
    found = private.entities(text)
    hidden = {w for _, _, kind, value in found for e, w in pairs.get(f"{kind}:{value.lower()}", ())}
    out, at = "", 0
    for s, e, kind, _ in [*found, (len(text), len(text), None, None)]:
        piece, done = text[at:s], ""
        last = 0
        for m in TERM.finditer(piece):
            w = m.group()
            done += piece[last : m.start()]
            if w.lower() not in hidden:
                done += w
            elif any(c.isdigit() for c in w):
                done += "[NUMBER]"
            elif w[0].isupper():
                done += "[NAME]"
            last = m.end()
        out += done + piece[last:] + (f"[{kind}]" if kind else "")
        at = e
    return out


# pieces


class Pieces:
    def __init__(self, vocabulary):
        self.scores, self.bytes_of = vocabulary.scores, vocabulary.byte_ids
        self.ids = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.normal[i]}
        self.longest, self.memo = max(map(len, self.ids)), {}

    def encode(self, text):
        """Ids of the best segmentation: one dynamic programme over the bytes of the whole text."""
        if not text:
            return None if text is None else []
        out = []
        for unit in re.findall(r"\n| +[^ \n]*|[^ \n]+", " " + text):
            if unit not in self.memo:
                self.memo[unit] = self._best(unit.encode())
            out += self.memo[unit]
        return out

    def _best(self, raw):
        lead = [i for i, b in enumerate(raw) if b & 0xC0 != 0x80]
        char_end = dict(zip(lead, [*lead[1:], len(raw)]))
        bare = {k for i in lead if raw[i : char_end[i]] not in self.ids for k in range(i, char_end[i])}
        best: list = [(0.0, None, None)] + [None] * len(raw)
        for end in range(1, len(raw) + 1):
            for begin in range(max(0, end - self.longest), end):  # the widest of equal ones comes first and stays
                if best[begin] is None:
                    continue
                piece = self.ids.get(raw[begin:end]) if begin in char_end else None
                if piece is None and end == begin + 1 and begin in bare:
                    piece = int(self.bytes_of[raw[begin]])
                if piece is not None and (best[end] is None or best[begin][0] + self.scores[piece] > best[end][0]):
                    best[end] = best[begin][0] + self.scores[piece], begin, piece
        ids, at = [], len(raw)
        while at:
            ids.append(best[at][2])
            at = best[at][1]
        return ids[::-1]


# quality


def statistics(text, toxic, poor):
    """The row of quality.FEATURES of one text."""
    raw, found = (text or "").encode(), words_of(text)
    size, many = max(len(raw), 1), max(len(found), 1)
    share = lambda test: sum(map(test, raw)) / size
    kinds = [b" \t\n\v\f\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:!?'-"]
    rest = [b for b in range(33, 127) if not any(b in k for k in kinds)]
    beyond = lambda b: b > 127
    control = lambda b: b < 128 and not any(b in k for k in kinds) and b not in rest
    hits = [sum(any(w == t or (t.endswith("-") and w.startswith(t[:-1]) and len(w) > len(t) - 1 and len(t) - 1 in quality.STEMS) for t in terms) for w in found) for terms in (toxic, poor)]
    return [
        math.log1p(len(raw)), math.log1p(len(found)), sum(len(w.encode()) for w in found) / many, *(share(lambda b, k=k: b in k) for k in kinds), share(lambda b: b in rest), share(beyond), share(control), raw.count(b"\n") / size,
        len(set(found)) / many, max(Counter(found).values(), default=0) / many, sum(a == b for a, b in zip(found, found[1:])) / many, sum(len(w.encode()) > 20 for w in found) / many, hits[0], hits[0] / many, hits[1], hits[1] / many,
    ]


def tied(rows):
    """rows: (text, class): words and stems whose share of documents in class 1 is significantly higher."""
    n, found = [0, 0], defaultdict(lambda: [0, 0])
    for text, k in rows:
        n[k] += 1
        for t in {f for w in words_of(text) for f in [w, *(w[:s] + "-" for s in quality.STEMS if len(w) > s)]}:
            found[t][k] += 1
    out = set()
    for t, (a, b) in found.items():
        if a + b < quality.MIN_DOCS:
            continue
        pool = (a + b) / sum(n)
        z = (b / max(n[1], 1) - a / max(n[0], 1)) / math.sqrt(max(pool * (1 - pool) * (1 / max(n[0], 1) + 1 / max(n[1], 1)), 1e-12))
        if z >= quality.MIN_Z and b >= quality.MIN_SHARE * (a + b):
            out.add(t)
    return out


def boosted(x, y, trees, depth):
    """Margins after boosting, every cut of every node tried by summing over its rows."""
    p = min(max(np.mean(y), 1e-3), 1 - 1e-3)
    margin = np.full(len(y), math.log(p / (1 - p)))
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1]).tolist())) for f in range(x.shape[1])]
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        add = np.zeros(len(y))

        def grow(rows, level):
            add[rows] = -quality.RATE * g[rows].sum() / (h[rows].sum() + quality.L2)
            if level == depth:
                return
            best = (1e-6, None, None)
            whole = g[rows].sum() ** 2 / (h[rows].sum() + quality.L2)
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    low = x[rows, f] <= c
                    a, b = rows[low], rows[~low]
                    if min(len(a), len(b)) >= quality.MIN_LEAF:
                        gain = g[a].sum() ** 2 / (h[a].sum() + quality.L2) + g[b].sum() ** 2 / (h[b].sum() + quality.L2) - whole
                        if gain > best[0] + 1e-9:
                            best = (gain, f, c)
            if best[1] is not None:
                low = x[rows, best[1]] <= best[2]
                grow(rows[low], level + 1)
                grow(rows[~low], level + 1)

        grow(np.arange(len(y)), 0)
        margin += add
    return margin
