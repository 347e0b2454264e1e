"""Declarative screening rules folded into Spark columns.

A rule is plain data. ``rule_filter`` and ``rule_score`` turn it into one ``Column`` each, so a
whole screen stays one projection, one filter and one ranking for Catalyst to plan.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, is_dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARISONS = ("eq", "ne", "lt", "lte", "gt", "gte")
CROSSINGS = ("crosses_above", "crosses_below")
OPERATORS = (*COMPARISONS, "between", "is_null", *CROSSINGS)
NUMERIC_KINDS = ("numeric", "integer")
ORDERED_KINDS = (*NUMERIC_KINDS, "date")


class RuleError(ValueError):
    """The rule does not fit the catalog."""


@dataclass(frozen=True)
class Metric:
    """Catalog entry: where a logical metric lives and what a rule may do with it."""

    name: str
    table: str
    column: str
    kind: str = "numeric"
    allow_filter: bool = True
    allow_scoring: bool = True
    operators: tuple[str, ...] = OPERATORS
    previous: str | None = None


@dataclass(frozen=True)
class Catalog:
    metrics: tuple[Metric, ...]

    def require(self, name: str) -> Metric:
        for metric in self.metrics:
            if metric.name == name:
                return metric
        raise RuleError(f"unknown metric: {name}")


@dataclass(frozen=True)
class Ref:
    """The value of a metric."""

    name: str


@dataclass(frozen=True)
class Times:
    """A product of operands, as in ``0.8 * volume_ma_5``."""

    left: object
    right: object


@dataclass(frozen=True)
class Between:
    low: object
    high: object


@dataclass(frozen=True)
class Compare:
    left: object
    op: str
    right: object = None


@dataclass(frozen=True)
class All:
    conditions: tuple


@dataclass(frozen=True)
class Any_:
    conditions: tuple


@dataclass(frozen=True)
class Not:
    condition: object


@dataclass(frozen=True)
class Points:
    name: str
    condition: object
    points: float


@dataclass(frozen=True)
class Weighted:
    name: str
    metric: str
    weight: float


@dataclass(frozen=True)
class Universe:
    exclude_st: bool = False
    exclude_suspend: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    filters: object
    scoring: tuple = ()
    clamp: tuple[float, float] = (0.0, 100.0)
    top_n: int = 10
    universe: Universe = field(default_factory=Universe)
    outputs: tuple[str, ...] = ()


def operand(value) -> Column:
    if isinstance(value, Ref):
        return F.col(value.name)
    if isinstance(value, Times):
        return operand(value.left) * operand(value.right)
    return F.lit(value)


def crosses(left: Column, right: Column, left_prev: Column, right_prev: Column, direction: str) -> Column:
    """Crossing between the previous and the current day."""
    if direction == "above":
        return (left > right) & (left_prev <= right_prev)
    return (left < right) & (left_prev >= right_prev)


def rule_filter(node, catalog: Catalog | None = None) -> Column:
    """Filter tree as a boolean column; NULL means no match at the ``where``."""
    if isinstance(node, All):
        result = F.lit(True)
        for part in node.conditions:
            result = result & rule_filter(part, catalog)
        return result
    if isinstance(node, Any_):
        result = F.lit(False)
        for part in node.conditions:
            result = result | rule_filter(part, catalog)
        return result
    if isinstance(node, Not):
        return ~rule_filter(node.condition, catalog)
    left = operand(node.left)
    if node.op == "is_null":
        return left.isNull()
    if node.op == "between":
        return left.between(operand(node.right.low), operand(node.right.high))
    right = operand(node.right)
    if node.op in CROSSINGS:
        left_prev = F.col(catalog.require(node.left.name).previous)
        right_prev = (
            F.col(catalog.require(node.right.name).previous) if isinstance(node.right, Ref) else right
        )
        return crosses(left, right, left_prev, right_prev, node.op.removeprefix("crosses_"))
    return {
        "eq": left == right,
        "ne": left != right,
        "lt": left < right,
        "lte": left <= right,
        "gt": left > right,
        "gte": left >= right,
    }[node.op]


def score_terms(rule: Rule, catalog: Catalog | None = None) -> dict[str, Column]:
    terms = {}
    for term in rule.scoring:
        if isinstance(term, Points):
            terms[term.name] = F.when(rule_filter(term.condition, catalog), float(term.points)).otherwise(0.0)
        else:
            terms[term.name] = F.coalesce(F.col(term.metric).cast("double"), F.lit(0.0)) * float(term.weight)
    return terms


def rule_score(rule: Rule, catalog: Catalog | None = None) -> Column:
    """Sum of the scoring terms clamped to the rule's bounds."""
    total = F.lit(0.0)
    for term in score_terms(rule, catalog).values():
        total = total + term
    low, high = rule.clamp
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), total))


def rule_json(rule: Rule, catalog: Catalog | None = None) -> dict[str, Column]:
    """Score breakdown, chosen metrics and raw values as JSON text."""
    def as_json(pairs: dict[str, Column]) -> Column:
        if not pairs:
            return F.lit("{}")
        flat = [x for name, value in pairs.items() for x in (F.lit(name), value)]
        return F.to_json(F.create_map(*flat))

    used = sorted(dependencies(rule, catalog))
    return {
        "score_breakdown": as_json(score_terms(rule, catalog)),
        "selected_metrics": as_json({m: F.col(m).cast("double") for m in rule.outputs}),
        "raw_values": as_json({m: F.col(m).cast("double") for m in used}),
    }


def apply_universe(df: DataFrame, spec: Universe) -> DataFrame:
    """Leave out special-treatment and suspended rows, keep or drop listed codes (P10)."""
    if spec.exclude_st:
        df = df.where(~F.coalesce(F.col("is_st"), F.lit(False)))
    if spec.exclude_suspend:
        df = df.where(~F.coalesce(F.col("is_suspend"), F.lit(False)))
    if spec.include:
        df = df.where(F.col("security_code").isin(*spec.include))
    if spec.exclude:
        df = df.where(~F.col("security_code").isin(*spec.exclude))
    return df


def _operand_metrics(value) -> set[str]:
    if isinstance(value, Ref):
        return {value.name}
    if isinstance(value, Times):
        return _operand_metrics(value.left) | _operand_metrics(value.right)
    if isinstance(value, Between):
        return _operand_metrics(value.low) | _operand_metrics(value.high)
    return set()


def filter_metrics(node, catalog: Catalog | None = None) -> set[str]:
    if isinstance(node, (All, Any_)):
        return set().union(*[filter_metrics(c, catalog) for c in node.conditions])
    if isinstance(node, Not):
        return filter_metrics(node.condition, catalog)
    names = _operand_metrics(node.left) | _operand_metrics(node.right)
    if node.op in CROSSINGS and catalog is not None:
        names |= {catalog.require(n).previous for n in names if catalog.require(n).previous}
    return names


def dependencies(rule: Rule, catalog: Catalog | None = None) -> set[str]:
    """Every metric a rule reads, previous-day metrics of crossings included."""
    names = set(rule.outputs) | filter_metrics(rule.filters, catalog)
    for term in rule.scoring:
        if isinstance(term, Points):
            names |= filter_metrics(term.condition, catalog)
        else:
            names.add(term.metric)
    return names


def _kind(value, catalog: Catalog) -> str:
    if isinstance(value, Ref):
        return catalog.require(value.name).kind
    if isinstance(value, Times):
        if any(_kind(v, catalog) not in NUMERIC_KINDS for v in (value.left, value.right)):
            raise RuleError("a product needs numeric operands")
        return "numeric"
    if isinstance(value, Between):
        low, high = _kind(value.low, catalog), _kind(value.high, catalog)
        if not _compatible(low, high):
            raise RuleError("range bounds have different kinds")
        return low
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "numeric"
    return "string"


def _compatible(a: str, b: str) -> bool:
    return a == b or (a in NUMERIC_KINDS and b in NUMERIC_KINDS)


def _check_filter(node, catalog: Catalog, scoring: bool) -> None:
    if isinstance(node, (All, Any_)):
        if not node.conditions:
            raise RuleError("a group needs at least one condition")
        for part in node.conditions:
            _check_filter(part, catalog, scoring)
        return
    if isinstance(node, Not):
        _check_filter(node.condition, catalog, scoring)
        return
    if node.op not in OPERATORS:
        raise RuleError(f"unknown operator: {node.op}")
    if not isinstance(node.left, Ref):
        raise RuleError("the left side of a comparison must be a metric")
    metric = catalog.require(node.left.name)
    allowed = metric.allow_scoring if scoring else metric.allow_filter
    if not allowed or node.op not in metric.operators:
        raise RuleError(f"metric {metric.name} does not allow {node.op} here")
    if node.op == "is_null":
        return
    if node.right is None:
        raise RuleError(f"{node.op} needs a right side")
    if (node.op == "between") != isinstance(node.right, Between):
        raise RuleError("a range goes with between, and only with it")
    kind = _kind(node.right, catalog)
    if not _compatible(metric.kind, kind):
        raise RuleError(f"metric {metric.name} is {metric.kind}, the right side is {kind}")
    if node.op in ("lt", "lte", "gt", "gte", "between") and metric.kind not in ORDERED_KINDS:
        raise RuleError(f"metric {metric.name} has no order")
    if node.op in CROSSINGS:
        if metric.kind not in NUMERIC_KINDS or metric.previous is None:
            raise RuleError(f"metric {metric.name} has no previous-day metric to cross with")
        catalog.require(metric.previous)
        if isinstance(node.right, Ref):
            if catalog.require(node.right.name).previous is None:
                raise RuleError(f"metric {node.right.name} has no previous-day metric to cross with")
        elif isinstance(node.right, bool) or not isinstance(node.right, (int, float)):
            raise RuleError("a crossing compares with a metric or a number")


def validate_rule(rule: Rule, catalog: Catalog) -> set[str]:
    """Check a rule against the catalog and give the metrics it reads (P25)."""
    _check_filter(rule.filters, catalog, scoring=False)
    names = [term.name for term in rule.scoring]
    if len(set(names)) != len(names):
        raise RuleError("scoring rule names must be unique")
    for term in rule.scoring:
        if isinstance(term, Points):
            _check_filter(term.condition, catalog, scoring=True)
        else:
            metric = catalog.require(term.metric)
            if not metric.allow_scoring or metric.kind not in NUMERIC_KINDS:
                raise RuleError(f"metric {metric.name} cannot be weighted")
    if rule.top_n <= 0:
        raise RuleError("top_n must be positive")
    low, high = rule.clamp
    if not 0 <= low <= high <= 100:
        raise RuleError("the clamp must lie within [0, 100]")
    for name in rule.outputs:
        catalog.require(name)
    return dependencies(rule, catalog)


def rule_hash(rule: Rule) -> str:
    """Content hash that does not depend on field order."""
    def plain(value):
        if is_dataclass(value) and not isinstance(value, type):
            body = {k: plain(getattr(value, k)) for k in asdict(value)}
            return {"type": type(value).__name__, **body}
        if isinstance(value, (list, tuple)):
            return [plain(v) for v in value]
        return value

    return hashlib.sha256(json.dumps(plain(rule), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def kind_of(data_type: T.DataType) -> str:
    """Metric kind of a Spark column type."""
    if isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "numeric"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.DateType):
        return "date"
    return "string"


def catalog_from(tables: dict[str, DataFrame], skip=("security_code", "trade_date")) -> Catalog:
    """Catalog of every column of the given marts; ``prev_x`` becomes the previous metric of ``x``."""
    metrics = []
    for table, df in tables.items():
        for f in df.schema.fields:
            if f.name not in skip:
                previous = f"prev_{f.name}" if f"prev_{f.name}" in df.columns else None
                metrics.append(
                    Metric(f.name, table, f.name, kind_of(f.dataType), previous=previous)
                )
    return Catalog(tuple(metrics))
