"""Plan text and run-time counters."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@dataclass
class Profile:
    """A node of the executed plan with its counters, such as rows, files and spilled bytes."""

    name: str
    metrics: dict[str, int]
    children: list[Profile] = field(default_factory=list)

    def total(self, metric: str) -> int:
        return self.metrics.get(metric, 0) + sum(c.total(metric) for c in self.children)

    def find(self, prefix: str) -> list[Profile]:
        return [p for p in [self] if self.name.startswith(prefix)] + [x for c in self.children for x in c.find(prefix)]

    def rows(self, depth: int = 1) -> list[tuple[int, str, str, int]]:
        """(depth, node, counter, value) of this node and those below it."""
        own = [(depth, self.name, k, v) for k, v in sorted(self.metrics.items())] or [(depth, self.name, "", 0)]
        return own + [r for c in self.children for r in c.rows(depth + 1)]


def _walk(node) -> Profile:  # noqa: ANN001
    if "AdaptiveSparkPlanExec" in node.getClass().getSimpleName():
        node = node.executedPlan()
    metrics, it = {}, node.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        metrics[pair._1()] = int(pair._2().value())
    kids = node.children()
    children = [_walk(kids.apply(i)) for i in range(kids.size())]
    if "QueryStageExec" in node.getClass().getSimpleName():
        children = [_walk(node.plan())]
    return Profile(node.nodeName(), metrics, children)


def profile(df: DataFrame) -> tuple[Profile, float]:
    """Run a query without keeping its rows; counters of its plan and the seconds it took."""
    start = time.perf_counter()
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return _walk(execution.executedPlan()), time.perf_counter() - start
