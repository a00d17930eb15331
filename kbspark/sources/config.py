"""The configuration of a knowledge base, read by the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Project:
    name: str
    type: str = "java"
    role: str = "backend"
    source: str = ""
    branch: str = "main"
    modules: list[str] = field(default_factory=list)
    apps: list[str] = field(default_factory=list)


@dataclass
class Config:
    output_dir: str
    projects: list[Project] = field(default_factory=list)
    relations: list[dict] = field(default_factory=list)
    branches: dict[str, dict[str, str]] = field(default_factory=dict)
    embedding: dict = field(default_factory=dict)

    @classmethod
    def of(cls, values: dict) -> Config:
        known = Project.__dataclass_fields__
        projects = [Project(**{k: v for k, v in p.items() if k in known}) for p in values.get("projects", [])]
        return cls(values["output_dir"], projects, values.get("relations", []), values.get("branches", {}), values.get("embedding", {}))

    def chosen(self, project: str | None = None, branch: str | None = None) -> list[Project]:
        """Projects by name and branch; without a name all of them."""
        return [p for p in self.projects if project in (None, p.name) and branch in (None, p.branch)]

    def default_project(self) -> Project | None:
        """The first backend that is no gateway."""
        return next((p for p in self.projects if p.role == "backend" and p.type != "gateway"), None)


def load(path: str) -> dict:
    """JSON, or YAML where a parser for it is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise ValueError("YAML needs a YAML parser; JSON does not") from error
    return yaml.safe_load(text)


GOLDEN = "query_id int, query string, last_verified_commit string, expected_hits array<string>, expected_graph_symbols array<struct<symbol:string,from_file:string>>, verify_provenance boolean"


def golden_queries(spark: SparkSession, path: str) -> DataFrame:
    """A small set of queries with what they should find."""
    rows = load(path)["queries"]
    return spark.createDataFrame([(i, q["query"], q.get("last_verified_commit"), q.get("expected_hits") or [], [(s["symbol"], s.get("from_file")) for s in q.get("expected_graph_symbols") or []], bool(q.get("verify_provenance"))) for i, q in enumerate(rows)], GOLDEN)
