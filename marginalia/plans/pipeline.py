"""Pipelines: named steps that compose DataFrames into one lazy plan for all documents."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.plans.provenance import Edges, edges_of
from marginalia.schema import op_id, raw_segments


class WiringError(ValueError):
    """The keys of a pipeline don't fit together."""


@dataclass
class PipelineStep:
    """An operation (run(*frames) -> frame, tuple of frames, or None) and the keys of what it takes and gives."""

    operation: object
    input_keys: list[str]
    output_keys: list[str] = field(default_factory=list)
    aggregate_input_keys: bool = False


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def add_keys(anns: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Annotations with further keys, each once."""
    new = F.array(*map(F.lit, keys)).cast("array<string>")
    return anns.withColumn("keys", F.array_union(F.coalesce("keys", F.array().cast("array<string>")), new))


def keep_keys(anns: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Only those of the annotations' keys that the pipeline gives out."""
    return anns.withColumn("keys", F.array_intersect("keys", F.array(*map(F.lit, keys)).cast("array<string>")))


class Pipeline:
    """Steps in their order. A pipeline is an operation itself, so pipelines nest."""

    def __init__(self, steps: Iterable[PipelineStep], input_keys: list[str], output_keys: list[str], name: str = "Pipeline"):
        self.steps, self.input_keys, self.output_keys, self.name = list(steps), list(input_keys), list(output_keys), name
        self.op_id = op_id(name, {"steps": [[getattr(s.operation, "op_id", type(s.operation).__name__), s.input_keys, s.output_keys] for s in self.steps]})

    def check_sanity(self) -> None:
        """Inputs are used, outputs are made, steps take what is there by then, and steps that give something have keys for it."""
        used = {k for s in self.steps for k in s.input_keys}
        made = {k for s in self.steps for k in s.output_keys}
        if missing := [k for k in self.input_keys if k not in used]:
            raise WiringError(f"input keys that no step takes: {missing}")
        if missing := [k for k in self.output_keys if k not in made and k not in self.input_keys]:
            raise WiringError(f"output keys that no step gives: {missing}")
        if missing := sorted(used - made - set(self.input_keys)):
            raise WiringError(f"keys that no step gives: {missing}")
        there = set(self.input_keys)
        for n, s in enumerate(self.steps):
            if late := [k for k in s.input_keys if k not in there]:
                raise WiringError(f"step {n} takes {late} before they are there")
            there.update(s.output_keys)

    def run(self, *inputs: DataFrame) -> DataFrame | tuple[DataFrame, ...] | None:
        outputs, _ = self.trace(*inputs)
        return outputs

    def trace(self, *inputs: DataFrame) -> tuple[DataFrame | tuple[DataFrame, ...] | None, list[Edges]]:
        """Outputs, and the provenance edges of each step (lazy: they cost nothing unless they are read)."""
        if len(inputs) != len(self.input_keys):
            raise WiringError(f"{len(self.input_keys)} inputs are needed, {len(inputs)} were given")
        frames: dict[str, list[DataFrame]] = {}
        for key, df in zip(self.input_keys, inputs):
            frames.setdefault(key, []).append(df)
        edges: list[Edges] = []
        for step in self.steps:
            taken = [union_all(frames[k]) for k in step.input_keys]
            if step.aggregate_input_keys:
                taken = [union_all(taken)]
            sub: list[Edges] = []
            if isinstance(step.operation, Pipeline):
                given, sub = step.operation.trace(*taken)
            else:
                given = step.operation.run(*taken)
            outs = () if given is None else given if isinstance(given, tuple) else (given,)
            if not step.output_keys and len(outs) == 1 and "uid" in outs[0].columns:
                # An operation that adds attributes returns its input with them: later steps see those.
                for key in step.input_keys[:1]:
                    frames[key] = [outs[0]]
                continue
            if len(outs) != len(step.output_keys):
                raise WiringError(f"{len(step.output_keys)} outputs have keys, {len(outs)} were given")
            for key, df in zip(step.output_keys, outs):
                if "keys" in df.columns:
                    df = add_keys(df, [key])
                frames.setdefault(key, []).append(df)
                if "parent_uid" in df.columns:
                    edges.append(Edges(getattr(step.operation, "op_id", type(step.operation).__name__), edges_of(df, getattr(step.operation, "op_id", "")), sub))
        results = []
        for key in self.output_keys:
            df = union_all(frames[key])
            results.append(keep_keys(df, self.output_keys) if "keys" in df.columns else df)
        if not results:
            return None, edges
        return results[0] if len(results) == 1 else tuple(results), edges


class DocPipeline:
    """A pipeline over documents: its inputs are annotations by label, or the whole text; its outputs join the annotations."""

    def __init__(self, pipeline: Pipeline, labels_by_input_key: dict[str, list[str]] | None = None):
        if labels_by_input_key is None and len(pipeline.input_keys) > 1:
            raise WiringError("with several inputs each needs its labels")
        if labels_by_input_key is not None and set(labels_by_input_key) != set(pipeline.input_keys):
            raise WiringError("labels are needed for the pipeline's input keys, and no others")
        self.pipeline, self.labels = pipeline, labels_by_input_key
        self.op_id = op_id("DocPipeline", {"pipeline": pipeline.op_id, "labels": labels_by_input_key})

    def run(self, docs: DataFrame, anns: DataFrame | None = None) -> DataFrame:
        """All annotations of the documents after the pipeline."""
        raw = raw_segments(docs)
        if self.labels is None:
            inputs = [raw]
        else:
            there = raw if anns is None else raw.unionByName(anns, allowMissingColumns=True)
            inputs = [there.where(F.col("label").isin(labels)) for labels in (self.labels[k] for k in self.pipeline.input_keys)]
        given = self.pipeline.run(*inputs)
        outs = () if given is None else given if isinstance(given, tuple) else (given,)
        parts = [*([anns] if anns is not None else []), *outs]
        return union_all(parts) if parts else raw.limit(0)


def in_label_order(anns: DataFrame, labels: list[str]) -> list[Column]:
    """Sort columns that put annotations of several labels in the order of the labels."""
    return [F.col("doc_id"), F.array_position(F.lit(labels), F.col("label")), F.col("seq")]
