"""An entity matcher that learns: a softmax tagger over hashed features of words, for the training loop.

Words are tagged B-label, I-label or O from their own form and that of their neighbours;
weights are one numpy table.  Trained weights are saved as a file and loaded once per worker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from pathlib import Path

import numpy as np

from marginalia.operators.kernel import Found, attribute
from marginalia.operators.models import ModelOperation
from marginalia.operators.training import Batch

_WORD = re.compile(r"\w+|[^\w\s]")
BUCKETS = 1 << 16


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(text) % BUCKETS


def word_features(words: list[str]) -> list[list[int]]:
    """Hashed features of each word: forms, ends, shape, and the words around it."""
    low = [w.lower() for w in words]
    at = lambda i: low[i] if 0 <= i < len(low) else "\0"
    shape = lambda w: re.sub(r"[A-ZÀ-Þ]+", "X", re.sub(r"[a-zß-ÿ]+", "x", re.sub(r"\d+", "9", w)))
    rows = []
    for i, w in enumerate(words):
        names = [f"w={low[i]}", f"s={low[i][-3:]}", f"p={low[i][:3]}", f"f={shape(w)}", f"-1={at(i - 1)}", f"+1={at(i + 1)}", f"-2={at(i - 2)}", f"+2={at(i + 2)}", f"-1w={at(i - 1)} {low[i]}", f"w+1={low[i]} {at(i + 1)}"]
        rows.append([_hash(n) for n in names])
    return rows


class TrainableTagger:
    """The component of a `Trainer`: rows of text and entities (label, start, end) in, a model file out."""

    def __init__(self, labels: Iterable[str], text: str = "text", entities: str = "entities"):
        self.labels, self.names = sorted(labels), (text, entities)
        self.tags = ["O", *(f"{m}-{x}" for x in self.labels for m in "BI")]
        self.weights = np.zeros((BUCKETS, len(self.tags)), np.float32)
        self.slope, self.seen = {}, 0

    def preprocess(self, row: dict) -> dict:
        text, entities = row[self.names[0]] or "", row[self.names[1]] or []
        places = [m.span() for m in _WORD.finditer(text)]
        tags = [0] * len(places)
        for e in sorted(entities, key=lambda e: (e["start"], -e["end"])):
            inside = [k for k, (a, b) in enumerate(places) if a < e["end"] and b > e["start"]]
            for n, k in enumerate(inside):
                if tags[k] == 0:
                    tags[k] = self.tags.index(("I-" if n else "B-") + e["label"])
        return {"features": word_features([text[a:b] for a, b in places]), "tags": tags}

    def forward(self, batch: Batch, train: bool) -> tuple[dict, float]:
        features = np.array([f for row in batch["features"] for f in row], np.int64).reshape(-1, 10)
        tags = np.array([t for row in batch["tags"] for t in row], np.int64)
        if not len(tags):
            return {"predicted": [[] for _ in batch["tags"]]}, 0.0
        scores = self.weights[features].sum(1)
        scores -= scores.max(1, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(np.maximum(p[np.arange(len(tags)), tags], 1e-12)).mean())
        cuts = np.cumsum([len(row) for row in batch["tags"]])[:-1]
        out = {"predicted": [x.tolist() for x in np.split(p.argmax(1), cuts)]}
        if train:
            p[np.arange(len(tags)), tags] -= 1
            self.seen += len(tags)
            for row, g in zip(features, p):
                for f in row.tolist():
                    self.slope[f] = self.slope.get(f, 0) + g
        return out, loss

    def step(self, rate: float) -> None:
        for f, g in self.slope.items():
            self.weights[f] -= np.float32(rate) * (g / max(self.seen, 1) ** 0.5)
        self.slope, self.seen = {}, 0

    def predict(self, text: str) -> list[tuple[str, int, int, float]]:
        """label, start, end, least probability of a word, of the entities found."""
        places = [m.span() for m in _WORD.finditer(text or "")]
        if not places:
            return []
        scores = self.weights[np.array(word_features([text[a:b] for a, b in places]), np.int64)].sum(1)
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        out: list[list] = []
        before = "O"
        for (a, b), k, sure in zip(places, p.argmax(1), p.max(1)):
            tag = self.tags[k]
            if tag[0] == "I" and before[1:] == tag[1:]:
                out[-1][2], out[-1][3] = b, min(out[-1][3], float(sure))
            elif tag != "O":
                out.append([tag[2:], a, b, float(sure)])
            before = tag
        return [tuple(x) for x in out]

    def save(self, path: str) -> None:
        Path(path).mkdir(parents=True, exist_ok=True)
        rows = np.flatnonzero(self.weights.any(1))
        np.savez(Path(path, "weights.npz"), rows=rows, values=self.weights[rows])
        Path(path, "config.json").write_text(json.dumps({"task": "token-classification", "labels": self.labels}))

    @classmethod
    def load(cls, path: str) -> "TrainableTagger":
        check_task(path, "token-classification")
        made = cls(json.loads(Path(path, "config.json").read_text())["labels"])
        with np.load(Path(path, "weights.npz")) as held:
            made.weights[held["rows"]] = held["values"]
        return made


def check_task(path: str, task: str) -> None:
    """Raise unless the model in this folder was made for the task; its config.json names it, or its architectures do."""
    config = json.loads(Path(path, "config.json").read_text())
    named = config.get("task") or config.get("pipeline_tag")
    built = "".join(config.get("architectures") or ()).lower()
    if named != task and task.replace("-", "") not in built:
        raise ValueError(f"the model in {path} is for {named or config.get('architectures')!r}; {task!r} is needed")


class TaggerMatcher(ModelOperation):
    """Entities by a trained tagger, whose folder executors and driver share."""

    def __init__(self, path: str, attrs_to_copy=()):
        def load() -> Callable[[list[str]], list[Iterable[Found]]]:
            model = TrainableTagger.load(path)
            return lambda texts: [[Found(label, (a, b), kind="entity", attrs=[attribute("confidence", sure)]) for label, a, b, sure in model.predict(t)] for t in texts]

        super().__init__("TaggerMatcher", {"path": path}, load, 64, attrs_to_copy)
