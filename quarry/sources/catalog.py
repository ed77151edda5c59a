"""Named data sets: where the documents, queries and judgements of a split lie, and how a run over it is set up."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Split:
    """``judgements`` is None for a split without judgements, such as a test split."""

    documents: str
    queries: str
    judgements: str | None = None

    def tables(self, spark: SparkSession, root: str) -> dict[str, DataFrame]:
        named = {"documents": self.documents, "queries": self.queries, "judgements": self.judgements}
        return {k: spark.read.parquet(f"{root}/{path}") for k, path in named.items() if path}


@dataclass(frozen=True)
class Preset:
    """Settings of a run over a split: depth of each retriever, depth after fusion, queries (None: all)."""

    split: str
    depth: int = 1000
    fused: int = 1000
    queries: int | None = None


@dataclass
class Catalog:
    root: str
    splits: dict[str, Split] = field(default_factory=dict)

    def tables(self, spark: SparkSession, split: str) -> dict[str, DataFrame]:
        if split not in self.splits:
            raise KeyError(f"no split {split}; there are {sorted(self.splits)}")
        return self.splits[split].tables(spark, self.root)

    def register(self, spark: SparkSession, split: str) -> list[str]:
        """Temporary views ``split_table``; their names."""
        return [df.createOrReplaceTempView(name) or name for k, df in self.tables(spark, split).items() for name in [f"{split}_{k}"]]


PRESETS = {"sample": Preset("dev", 100, 100, 10), "dev": Preset("dev"), "test": Preset("test")}
