"""An update run over projects: the same steps for each, in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Pull, scan, find flows for the second level, index, rebuild the graph.
STEPS = ["pull", "scan", "level2", "vectors", "graph"]


def run(spark: SparkSession, projects: list[str], steps: dict[str, Callable[[str], None]]) -> DataFrame:
    """project, step, place, status (done, failed, skipped), error. A step that fails skips what is left of
    its own project; others go on. The steps are Spark jobs of their own; the list of projects is the
    configuration's. The run as a whole failed where a row did."""
    rows = []
    for project in projects:
        failed = False
        for place, (name, step) in enumerate(steps.items(), 1):
            if failed:
                rows.append((project, name, place, "skipped", None))
                continue
            try:
                step(project)
                rows.append((project, name, place, "done", None))
            except Exception as error:  # whatever a step raises is reported, and ends its project's run
                failed = True
                rows.append((project, name, place, "failed", str(error)))
    return spark.createDataFrame(rows, "project string, step string, place int, status string, error string")
