"""Pipelines as ordered DataFrame transforms, with hooks and registries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Transform = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """Named stages, applied in order; hooks see (name, DataFrame) before or after a stage and may return another."""

    stages: list[tuple[str, Transform]] = field(default_factory=list)
    before: list[Callable] = field(default_factory=list)
    after: list[Callable] = field(default_factory=list)

    def add(self, name: str, stage: Transform) -> Pipeline:
        return Pipeline([*self.stages, (name, stage)], self.before, self.after)

    def add_if(self, condition: bool, name: str, stage: Transform) -> Pipeline:
        return self.add(name, stage) if condition else self

    def insert(self, index: int, name: str, stage: Transform) -> Pipeline:
        return Pipeline([*self.stages[:index], (name, stage), *self.stages[index:]], self.before, self.after)

    def remove(self, name: str) -> Pipeline:
        return Pipeline([s for s in self.stages if s[0] != name], self.before, self.after)

    def hook(self, when: str, f: Callable) -> Pipeline:
        return Pipeline(self.stages, [*self.before, f] if when == "before" else self.before, [*self.after, f] if when == "after" else self.after)

    def run(self, df: DataFrame) -> DataFrame:
        for name, stage in self.stages:
            for f in self.before:
                df = f(name, df) or df
            df = df.transform(stage)
            for f in self.after:
                df = f(name, df) or df
        return df


class Registry:
    """Factories by name; an unknown name lists those there are."""

    def __init__(self):
        self.made: dict[str, Callable] = {}

    def register(self, name: str):
        def add(f):
            self.made[name] = f
            return f

        return add

    def create(self, name: str, **options):
        if name not in self.made:
            raise ValueError(f"unknown: {name}; there are {', '.join(sorted(self.made))}")
        return self.made[name](**options)


def default_pipeline(chunk_size: int = 1000) -> Pipeline:
    """Pages to chunks: parse, keep pages with words, chunk the Markdown."""
    from pyspark.sql import functions as F

    from tessella.operators import chunks, page

    return (
        Pipeline()
        .add("parse", page.parse_pages)
        .add("filter", lambda df: df.where("word_count > 0"))
        .add("chunk", lambda df: chunks.sized(df.select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text")), "topic", chunk_size))
    )
