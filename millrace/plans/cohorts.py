"""How columns may be pooled over questionnaire versions, and a check that no table pools what it must not.

``tagged`` notes a column's policy in its metadata, which projections keep. ``pools`` follows tagged
columns, and those named by the policy, through a table's analysed plan, renamed and derived ones
too, and tells where an aggregate or a window puts rows of several users and versions together.
Nothing runs for that: the plan is read, no row is.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION, USER, KEY = "instrument_version", "user_id", "cohort_policy"
# --- fixed values: how columns may be pooled over questionnaire versions ---------------
SPLIT = ["nationality_canon", "nationality_clean"]
V1_ONLY = ["away_duration_canon", "away_duration_order", "would_recommend", "recommendation_text"]
V2_ONLY = ["no_usefulness_reason", "reason_is_valid", "language", "registration_status", "attempts", "is_returning", "safety_alert", "escalation_status"]
POOLED = [
    "user_id", "ts", "instrument_version", "gender_clean", "age_num", "age_flag", "age_range", "age_range_order", "minors", "destination_country",
    "intends_to_stay", "city_canon", "city_clean", "department", "city_duration_canon", "city_duration_order", "n_questions", "n_msgs_user", "has_text",
    "first_seen", "registered_at", "is_repeat_asker", "cluster_id", "subcluster_id", "subcluster_name", "session_minutes", "last_message_ts",
    "usefulness_rating", "rating_num", "discovery_channel", "discovery_other",
]
COHORT_MARK = "Migrated From v1"


class CohortError(ValueError):
    """A column is pooled over questionnaires that can't be compared, or has no policy."""


def policy(column: str) -> str:
    """How a column may be pooled; a column without a policy can't be aggregated."""
    for name, columns in (("split", SPLIT), ("v1_only", V1_ONLY), ("v2_only", V2_ONLY), ("poolable", POOLED)):
        if column in columns:
            return name
    raise CohortError(f"{column} has no cohort policy: class it before pooling it")


def pooled(df: DataFrame, name: str) -> DataFrame:
    """Rows over which a column may be aggregated: those of the questionnaire that asks it. Raises for one that must be split by cohort."""
    kind = policy(name)
    if kind == "split" and VERSION in df.columns:
        raise CohortError(f"{name} must be split by cohort; group by {VERSION}")
    return df.where(F.col(VERSION) == kind[:2]) if kind in ("v1_only", "v2_only") else df


def tagged(df: DataFrame) -> DataFrame:
    """df whose columns carry their policy as metadata, where they have one."""
    kinds = {c: policy(c) for c in df.columns if c in {*SPLIT, *V1_ONLY, *V2_ONLY}}
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={**df.schema[c].metadata, KEY: kinds[c]}) if c in kinds else F.col(f"`{c}`") for c in df.columns])


@dataclass
class Known:
    """What is known of the columns below a plan node: their order, origins by id, and the only version left by filters."""

    output: list[int] = field(default_factory=list)
    origins: dict[int, frozenset[tuple[str, str]]] = field(default_factory=dict)  # (column, policy)
    only: str | None = None


def expressions(value) -> list[list[dict]]:
    """Expression trees of a field: one, or a list of them."""
    if isinstance(value, list) and value:
        return [value] if isinstance(value[0], dict) else [x for x in value if isinstance(x, list)]
    return []


def origins_of(tree: list[dict], known: Known) -> frozenset[tuple[str, str]]:
    """Origins of the attributes of an expression: found below, named by the policy, or tagged."""
    out: set[tuple[str, str]] = set()
    for x in tree:
        if not x["class"].endswith(".AttributeReference"):
            continue
        name, kind = x["name"], (x.get("metadata") or {}).get(KEY)
        if name in (VERSION, USER):
            out.add((name, "key"))
        elif kind:
            out.add((name, kind))
        elif name in {*SPLIT, *V1_ONLY, *V2_ONLY}:
            out.add((name, policy(name)))
        out |= known.origins.get(x["exprId"]["id"], frozenset())
    return frozenset(out)


def versions_in(condition: list[dict]) -> list[str]:
    """Versions that a condition asks for by equality, all its parts holding together."""
    kinds = [x["class"].rpartition(".")[2] for x in condition]
    if any(k in ("Or", "Not", "CaseWhen", "If") for k in kinds):
        return []
    return [condition[i + 2 - (kinds[i + 2] != "Literal")]["value"] for i, k in enumerate(kinds) if k in ("EqualTo", "EqualNullSafe") and {*kinds[i + 1 : i + 3]} == {"AttributeReference", "Literal"} and VERSION in (condition[i + 1].get("name"), condition[i + 2].get("name"))]


def ids_of(trees: list[list[dict]]) -> list[int]:
    return [t[0]["exprId"]["id"] for t in trees if isinstance(t[0].get("exprId"), dict)]


def pools(df: DataFrame) -> list[str]:
    """Columns that the plan of df pools over versions against their policy, each with the reason; empty if none."""
    nodes = json.loads(df._jdf.queryExecution().analyzed().toJSON())
    found: list[str] = []

    def judge(used: frozenset, keys: frozenset, known: Known) -> None:
        if (USER, "key") in keys or (VERSION, "key") in keys:
            return  # a user's own values, or each version by itself
        for column, kind in sorted(used):
            if kind == "split" and known.only is None:
                found.append(f"{column} must be split by cohort: group by {VERSION} or keep one version")
            elif kind in ("v1_only", "v2_only") and known.only != kind[:2]:
                found.append(f"{column} is asked by {kind[:2]} alone: keep that version")

    def walk(i: int) -> tuple[Known, int]:
        node, below, at = nodes[i], [], i + 1
        for _ in range(node["num-children"]):
            k, at = walk(at)
            below.append(k)
        kind = node["class"].rpartition(".")[2]
        known = Known([o for k in below for o in k.output], {o: s for k in below for o, s in k.origins.items()}, below[0].only if len(below) == 1 else None)
        if kind in ("Join", "LateralJoin"):
            known.only = below[0].only
        elif kind in ("Union",) and below:
            known.output = below[0].output
            for column in zip(*(k.output for k in below), strict=False):
                known.origins[column[0]] = frozenset().union(*(k.origins.get(o, frozenset()) for k, o in zip(below, column, strict=True)))
            known.only = below[0].only if len({k.only for k in below}) == 1 else None
        elif kind == "Filter":
            known.only = next(iter(versions_in(node["condition"])), known.only)
        elif kind in ("Project", "Aggregate", "Window"):
            made = expressions(node.get("projectList") or node.get("aggregateExpressions") or node.get("windowExpressions"))
            keys = expressions(node.get("groupingExpressions") or node.get("partitionSpec"))
            if kind != "Project":
                used = frozenset().union(*[origins_of(t, known) for t in [*made, *keys]], frozenset())
                judge(used, frozenset().union(*[origins_of(t, known) for t in keys], frozenset()), known)
            new = {t[0]["exprId"]["id"]: origins_of(t, known) for t in made if isinstance(t[0].get("exprId"), dict)}
            known.origins |= new
            known.output = (known.output if kind == "Window" else []) + ids_of(made)
        elif kind == "Generate":
            made = ids_of(expressions(node.get("generatorOutput")))
            source = frozenset().union(*[origins_of(t, known) for t in expressions(node.get("generator"))], frozenset())
            known.output, known.origins = known.output + made, known.origins | dict.fromkeys(made, source)
        elif not below:
            leaf = expressions(node.get("output"))
            known.output, known.origins = ids_of(leaf), {t[0]["exprId"]["id"]: origins_of(t, known) for t in leaf}
        return known, at

    walk(0)
    return sorted(set(found))


def check(tables: dict[str, DataFrame]) -> None:
    """Raises if the plan of any table pools a column against its policy, and names all that do."""
    wrong = [f"{name}: {what}" for name in sorted(tables) for what in pools(tables[name])]
    if wrong:
        raise CohortError("; ".join(wrong))
