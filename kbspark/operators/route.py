"""Classifiers over paths and texts: ordered rules of which the first that matches counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is skipped, what is only indexed, and the layer of each other path, in order.
SKIP = [r"[/\\](test|tests|__tests__|spec)[/\\]", r"[/\\](target|build|dist|node_modules)[/\\]", r"\.(class|jar|war)$"]
INDEX_ONLY = [r"Constants?\.(java|kt)$", r"Utils?\.(java|kt)$", r"Config(uration)?\.(java|kt)$", r"application\.(yml|yaml|properties)$"]
LAYERS = [
    (r"[/\\](entity|po|model)[/\\]", "domain", "entities"),
    (r"[/\\](enums?|constant)[/\\]", "domain", "enums"),
    (r"[/\\]migration[/\\]|\.sql$", "domain", "state-machines"),
    (r"[/\\](controller|web|rest)[/\\]", "contracts", "internal"),
    (r"Callback|Webhook", "contracts", "external"),
    (r"Client\.(java|kt)$", "contracts", "external"),
    (r"[/\\](mapper|repository|dao)[/\\]", "code", "method-index"),
    (r"[/\\]service[/\\]", None, None),
]
# Kinds of sources, and kinds of stale documents, by what a path holds, in order.
SOURCE_TYPES = [("external-systems", "external"), ("flows/", "flow"), ("domain/", "domain"), ("contracts/", "contract"), ("code/", "code"), ("shared/", "shared")]
STALE_TYPES = [
    ("domain/entities/", "entity"), ("domain/enums/", "enum"), ("domain/state-machines/", "state-machine"), ("domain/rules/", "rules"),
    ("domain/error-codes", "error-codes"), ("contracts/", "contract"), ("code/", "method-index"),
]
BRANCH_FLOW_HEADING = "## 条件分支流程"
MAIN_BRANCHES = ["main", "master", "release_prd", "develop"]
# Phases that a changed path touches; (?i) where case does not matter, and one rule
# for added files only.
PHASES = [
    (r"(pom\.xml|build\.gradle|settings\.gradle|package\.json|go\.mod|Cargo\.toml)", ["1", "2", "4"], False),
    (r"src/main/(java|kotlin)/.*\.(java|kt)$", ["3"], True),
    (r"(?i)(controller|api|endpoint|rest)/.*\.(java|kt)$", ["5"], False),
    (r"(?i)(entity|model|po|mapper|repository|dao|migration|changelog)/", ["6"], False),
    (r"(bootstrap|application).*\.(yml|yaml|properties)$", ["6B", "8"], False),
    (r"(?i)(service|biz|task|job|schedule|listener|consumer)/.*\.(java|kt)$", ["7"], False),
    (r"^(frontend|src)/.*package\.json$", ["10"], False),
    (r"(?i)(router|routes)/.*\.(ts|js|tsx)$", ["11"], False),
    (r"(?i)(api|services|request)/.*\.(ts|js|tsx)$", ["12"], False),
    (r"(?i)(store|stores|slices)/.*\.(ts|js|tsx)$", ["13"], False),
    (r"(?i)components/.*\.(vue|tsx|jsx)$", ["14"], False),
    (r"(vite\.config|vue\.config|\.env)", ["15"], False),
]


def _any(path: Column, patterns: list[str]) -> Column:
    return path.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def route(path: Column) -> Column:
    """struct(action, layer, subtype): skip, index-only, lm-judge or generate."""
    path = F.regexp_replace(path, r"\\", "/")

    def told(action: str, layer: str | None = None, subtype: str | None = None) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(layer).cast("string").alias("layer"), F.lit(subtype).cast("string").alias("subtype"))

    out = F.when(_any(path, SKIP), told("skip")).when(_any(path, INDEX_ONLY), told("index-only"))
    for pattern, layer, subtype in LAYERS:
        out = out.when(_any(path, [pattern]), told("generate", layer, subtype) if layer else told("lm-judge"))
    return out.otherwise(told("index-only"))


def route_counts(paths: DataFrame, path_col: str = "path") -> DataFrame:
    return paths.select(route(F.col(path_col)).alias("r")).groupBy("r.action").agg(F.count("*").alias("n")).select("action", "n")


def source_type(path: Column) -> Column:
    out = None
    for part, kind in SOURCE_TYPES:
        out = (F if out is None else out).when(F.contains(path, F.lit(part)), kind)
    return out.otherwise("doc")


def stale_type(path: Column, content: Column) -> Column:
    """struct(type, needs_lm)."""
    def told(kind: str, lm: bool = False) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(lm).alias("needs_lm"))

    path = F.regexp_replace(path, r".*/kb/", "")
    flow = F.contains(path, F.lit("flows/"))
    out = F.when(flow & F.coalesce(F.contains(content, F.lit(BRANCH_FLOW_HEADING)), F.lit(False)), told("flow-level2", True)).when(flow, told("flow-level1"))
    for part, kind in STALE_TYPES:
        out = out.when(F.contains(path, F.lit(part)), told(kind))
    return out.otherwise(told("unknown"))


def affected_phases(changed: DataFrame, path_col: str = "path", added_col: str = "added") -> DataFrame:
    """The distinct phases that changed paths touch, sorted. Each row gives its own phases, so no rule
    table is joined; a phase is kept once by partial aggregation."""
    found = F.array_distinct(F.flatten(F.array(*(F.when(F.col(path_col).rlike(pattern) & (F.col(added_col) if added else F.lit(True)), F.array(*map(F.lit, phases))).otherwise(F.array().cast("array<string>")) for pattern, phases, added in PHASES))))
    return changed.select(F.explode(found).alias("phase")).distinct()


def on_main_branch(branch: Column) -> Column:
    return branch.isin(MAIN_BRANCHES)


def complexity(text: Column) -> Column:
    """high: four services; three and a status change; a status change in a transaction or by
    messages. Else normal."""
    services = F.coalesce(F.nullif(F.regexp_extract(text, r"调用服务数[：:]\s*\**\s*(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    status = text.rlike(r"触发状态变更[：:]\s*\**\s*是")
    linked = text.rlike("事务|@Transactional|MQ|消息队列|EventBus")
    return F.when((services >= 4) | ((services >= 3) & status) | (status & linked), "high").otherwise("normal")


def is_level2_candidate(text: Column) -> Column:
    """At least two services or a status change, and not yet described at the second level."""
    services = F.coalesce(F.nullif(F.regexp_extract(text, r"调用服务数[：:]\s*\**\s*(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    return ((services >= 2) | text.rlike(r"触发状态变更[：:]\s*\**\s*是")) & ~F.contains(text, F.lit(BRANCH_FLOW_HEADING))


def triggers_flow(calls: DataFrame) -> DataFrame:
    """entry, services, changes_status of entry methods worth a flow: they call at least two services or
    change a status. calls: entry, service, changes_status."""
    sums = calls.groupBy("entry").agg(F.countDistinct("service").alias("services"), F.coalesce(F.bool_or("changes_status"), F.lit(False)).alias("changes_status"))
    return sums.filter((F.col("services") >= 2) | F.col("changes_status"))
