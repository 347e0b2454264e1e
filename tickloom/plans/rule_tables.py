"""Screening rules as rows: hundreds of rules are data, and the plan is the same for any number.

A rule is a row of ``rules``, its filter and the conditions of its points are trees of rows in
``nodes``, its scoring terms rows of ``terms``. The rules are packed to a row each and broadcast. On every
row of the metrics, which are looked up by name, the verdicts of comparisons are folded up the trees one
level at a time by counting children that hold and children that are NULL. The plan is the same for any
number of rules, and metrics are not moved.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.rules import CROSSINGS, NUMERIC_KINDS, OPERATORS, ORDERED_KINDS, All, Any_, Between, Catalog, Not, Points, Ref, Rule, Times

KEYS = ("security_code", "trade_date")
FILTER = "filter"
BOUND = "struct<kind:string,factor:double,metrics:array<string>,text:string>"
RULES = "rule_id string, low double, high double, top_n int, exclude_st boolean, exclude_suspend boolean, include array<string>, exclude array<string>, outputs array<string>"
NODES = f"rule_id string, tree string, node int, parent int, depth int, kind string, children int, metric string, op string, low {BOUND}, high {BOUND}"
TERMS = "rule_id string, position int, tree string, metric string, weight double"
CATALOG = "name string, kind string, allow_filter boolean, allow_scoring boolean, operators array<string>, previous string"


@dataclass(frozen=True)
class RuleTables:
    """Tables of the rules and of the catalog they are checked against."""

    rules: DataFrame
    nodes: DataFrame
    terms: DataFrame
    catalog: DataFrame


def bound(value) -> tuple | None:
    """(kind, factor, metrics, text) of an operand; a product is a factor times metrics."""
    if value is None:
        return None
    if isinstance(value, bool):
        return ("boolean", float(value), [], None)
    if isinstance(value, (int, float)):
        return ("numeric", float(value), [], None)
    if isinstance(value, Ref):
        return ("metric", 1.0, [value.name], None)
    if isinstance(value, Times):
        sides = [bound(value.left), bound(value.right)]
        if any(side is None or side[0] in ("string", "boolean") for side in sides):
            return ("invalid", math.nan, [], None)
        return ("product", sides[0][1] * sides[1][1], [*sides[0][2], *sides[1][2]], None)
    return ("string", None, [], str(value))


def tree_rows(rule_id: str, tree: str, root) -> list[tuple]:
    """Rows of one tree, numbered from its root."""
    rows: list[tuple] = []

    def add(item, parent: int | None, depth: int) -> None:
        number = len(rows)
        if isinstance(item, (All, Any_, Not)):
            inner = (item.condition,) if isinstance(item, Not) else tuple(item.conditions)
            kind = {All: "all", Any_: "any", Not: "not"}[type(item)]
            rows.append((rule_id, tree, number, parent, depth, kind, len(inner), None, None, None, None))
            for child in inner:
                add(child, number, depth + 1)
            return
        low, high = (item.right.low, item.right.high) if isinstance(item.right, Between) else (item.right, None)
        name = item.left.name if isinstance(item.left, Ref) else None
        rows.append((rule_id, tree, number, parent, depth, "compare", 0, name, item.op, bound(low), bound(high)))

    add(root, None, 0)
    return rows


def tables_of(spark: SparkSession, rules: Mapping[str, Rule], catalog: Catalog) -> RuleTables:
    """The rules as tables; nothing is checked yet."""
    heads, nodes, terms = [], [], []
    for rule_id, rule in rules.items():
        u = rule.universe
        heads.append((rule_id, *map(float, rule.clamp), rule.top_n, u.exclude_st, u.exclude_suspend, list(u.include), list(u.exclude), list(rule.outputs)))
        nodes += tree_rows(rule_id, FILTER, rule.filters)
        for position, term in enumerate(rule.scoring):
            if isinstance(term, Points):
                terms.append((rule_id, position, f"points:{term.name}", None, float(term.points)))
                nodes += tree_rows(rule_id, f"points:{term.name}", term.condition)
            else:
                terms.append((rule_id, position, f"weighted:{term.name}", term.metric, float(term.weight)))
    known = [(m.name, m.kind, m.allow_filter, m.allow_scoring, list(m.operators), m.previous) for m in catalog.metrics]
    return RuleTables(*[spark.createDataFrame(rows, schema) for rows, schema in ((heads, RULES), (nodes, NODES), (terms, TERMS), (known, CATALOG))])


# --- verdicts on rules -----------------------------------------------------------------------


def kind_group(kind: Column) -> Column:
    return F.when(kind.isin(*NUMERIC_KINDS), "numeric").otherwise(kind)


def rule_verdicts(tables: RuleTables) -> DataFrame:
    """rule_id, valid, reason, place of every rule (P25): the first fault in order of tree, node and check."""
    names = tables.catalog
    metric = names.select(F.col("name").alias("metric"), kind_group(F.col("kind")).alias("group"), F.col("kind").alias("own_kind"), "allow_filter", "allow_scoring", "operators", "previous")
    nodes = tables.nodes.join(metric, "metric", "left").withColumn("known", F.col("own_kind").isNotNull())
    # metrics on the right side, one row each
    sides = tables.nodes.select("rule_id", "tree", "node", F.explode(F.array(F.struct(F.lit("low").alias("side"), F.col("low").alias("b")), F.struct(F.lit("high").alias("side"), F.col("high").alias("b")))).alias("s"))
    used = sides.where("s.b IS NOT NULL").select("rule_id", "tree", "node", "s.side", F.col("s.b.kind").alias("bound"), F.explode_outer("s.b.metrics").alias("name"))
    used = used.join(names.select("name", kind_group(F.col("kind")).alias("of"), F.col("previous").alias("before")), "name", "left")
    right = used.groupBy("rule_id", "tree", "node", "side").agg(
        F.first("bound").alias("bound"), F.bool_and(F.col("name").isNull() | F.col("of").isNotNull()).alias("found"), F.first("of", ignorenulls=True).alias("of"),
        F.bool_and(F.col("of") == "numeric").alias("numbers"), F.first("before", ignorenulls=True).alias("before"), F.count("name").alias("refs"),
    ).withColumn("group", F.when(F.col("bound") == "metric", F.col("of")).when(F.col("bound") == "product", "numeric").otherwise(F.col("bound")))
    fields = ("bound", "found", "numbers", "group", "before", "refs")
    low = right.where("side = 'low'").select("rule_id", "tree", "node", F.struct(*fields).alias("lo"))
    high = right.where("side = 'high'").select("rule_id", "tree", "node", F.struct(*fields).alias("hi"))
    full = nodes.join(low, ["rule_id", "tree", "node"], "left").join(high, ["rule_id", "tree", "node"], "left")
    of_filter = F.col("tree") == FILTER
    op, compare = F.col("op"), F.col("kind") == "compare"
    crossing = op.isin(*CROSSINGS)

    def broken(side: str) -> Column:
        s = F.col(side)
        return s.isNotNull() & (~s["found"] | ((s["bound"] == "product") & ~F.coalesce(s["numbers"], F.lit(True))) | (s["bound"] == "invalid"))

    def other(side: str) -> Column:
        return F.col(side).isNotNull() & (F.col(side)["group"] != F.col("group"))

    faults = [
        (~compare & (F.col("children") == 0), "empty_group"),
        (compare & ~op.isin(*OPERATORS), "unknown_operator"),
        (compare & F.col("metric").isNull(), "left_side_is_no_metric"),
        (compare & ~F.col("known"), "unknown_metric"),
        (compare & (~F.when(of_filter, F.col("allow_filter")).otherwise(F.col("allow_scoring")) | ~F.array_contains("operators", op)), "not_allowed"),
        (compare & (op != "is_null") & F.col("lo").isNull(), "no_right_side"),
        (compare & ((op == "between") != F.col("hi").isNotNull()) & (op != "is_null"), "range_without_between"),
        (compare & (broken("lo") | broken("hi")), "right_side_is_no_number_or_metric"),
        (compare & (op != "is_null") & (other("lo") | other("hi")), "kinds_differ"),
        (compare & op.isin("lt", "lte", "gt", "gte", "between") & ~F.col("own_kind").isin(*ORDERED_KINDS), "no_order"),
        (compare & crossing & (F.col("previous").isNull() | ((F.col("lo")["bound"] == "metric") & F.col("lo")["before"].isNull())), "no_previous_metric"),
        (compare & crossing & ~F.col("lo")["bound"].isin("metric", "numeric"), "crossing_needs_metric_or_number"),
    ]
    found = F.lit(None).cast("string")
    for wrong, reason in reversed(faults):
        found = F.when(wrong, reason).otherwise(found)
    at_node = full.withColumn("reason", found).where("reason IS NOT NULL").select("rule_id", F.struct((~of_filter).cast("int").alias("a"), F.col("tree").alias("place"), F.col("node").alias("b"), "reason").alias("fault"))
    weighted = tables.terms.where("metric IS NOT NULL").join(metric, "metric", "left").where(~F.coalesce(F.col("allow_scoring") & F.col("own_kind").isin(*NUMERIC_KINDS), F.lit(False)))
    # a name counts once, whether its term gives points or a weight
    twice = tables.terms.groupBy("rule_id", F.substring_index("tree", ":", -1).alias("name")).count().where("count > 1")

    def rule_fault(df: DataFrame, order: int, place: Column, reason: str) -> DataFrame:
        return df.select("rule_id", F.struct(F.lit(order).alias("a"), place.alias("place"), F.lit(0).alias("b"), F.lit(reason).alias("reason")).alias("fault"))

    outputs = tables.rules.select("rule_id", F.explode("outputs").alias("name")).join(names.select("name"), "name", "left_anti")
    parts = [
        at_node, rule_fault(twice, 2, F.col("name"), "name_used_twice"), rule_fault(weighted, 3, F.col("tree"), "cannot_be_weighted"),
        rule_fault(tables.rules.where("top_n <= 0"), 4, F.lit("top_n"), "top_n_not_positive"),
        rule_fault(tables.rules.where("NOT (0 <= low AND low <= high AND high <= 100)"), 5, F.lit("clamp"), "clamp_out_of_range"),
        rule_fault(outputs, 6, F.col("name"), "unknown_output"),
    ]
    faults_of = parts[0]
    for part in parts[1:]:
        faults_of = faults_of.unionByName(part)
    first = faults_of.groupBy("rule_id").agg(F.min("fault").alias("fault"))
    return tables.rules.select("rule_id").join(first, "rule_id", "left").select("rule_id", F.col("fault").isNull().alias("valid"), "fault.reason", "fault.place")


# --- verdicts on rows ------------------------------------------------------------------------


def with_values(metrics: DataFrame) -> tuple[DataFrame, list[str]]:
    """Keys, ``numbers`` and ``texts`` by metric name, and the names; booleans are 1 and 0, dates days."""
    fields = {f.name: f.dataType.typeName() for f in metrics.schema.fields if f.name not in KEYS}
    texts = [n for n, t in fields.items() if t == "string"]
    numbers = {n: t for n, t in fields.items() if t in ("double", "float", "decimal", "byte", "short", "integer", "long", "boolean", "date")}

    def number(name: str, kind: str) -> Column:
        return F.unix_date(name).cast("double") if kind == "date" else F.col(name).cast("double")

    def listed(pairs: list[Column], kind: str) -> Column:
        return F.create_map(*pairs) if pairs else F.lit(None).cast(f"map<string,{kind}>")

    flags = [c for c in ("is_st", "is_suspend") if c in metrics.columns]
    return metrics.select(
        *KEYS, *flags, listed([x for n, t in numbers.items() for x in (F.lit(n), number(n, t))], "double").alias("numbers"),
        listed([x for n in texts for x in (F.lit(n), F.col(n))], "string").alias("texts"),
    ), [*numbers, *texts]


def compared(leaf: Column) -> Column:
    """Verdict of a comparison on a row that carries ``numbers`` and ``texts``; NULL where an operand is."""
    def side(b: Column) -> Column:
        return F.aggregate(b["metrics"], b["factor"], lambda total, m: total * F.try_element_at("numbers", m))

    left, text, op = F.try_element_at("numbers", leaf["metric"]), F.try_element_at("texts", leaf["metric"]), leaf["op"]
    low, high = side(leaf["low"]), side(leaf["high"])
    other_text = F.when(F.size(leaf["low"]["metrics"]) > 0, F.try_element_at("texts", F.get(leaf["low"]["metrics"], F.lit(0)))).otherwise(leaf["low"]["text"])
    before = F.try_element_at("numbers", leaf["previous"])
    low_before = F.when(leaf["low"]["kind"] == "metric", F.try_element_at("numbers", leaf["low_previous"])).otherwise(low)
    worded = leaf["own_kind"] == "string"
    same = F.when(worded, text == other_text).otherwise(left == low)
    return (
        F.when(op == "is_null", F.when(worded, text.isNull()).otherwise(left.isNull()))
        .when(op == "eq", same).when(op == "ne", ~same).when(op == "lt", left < low).when(op == "lte", left <= low).when(op == "gt", left > low).when(op == "gte", left >= low)
        .when(op == "between", (left >= low) & (left <= high))
        .when(op == "crosses_above", (left > low) & (before <= low_before)).when(op == "crosses_below", (left < low) & (before >= low_before))
    )


#: Verdict of a node whose comparisons all test metrics that the rows don't have; such a node is no child that counts.
ABSENT = -1


def tree_holds(tree: Column, depth: int) -> Column:
    """Whether the root of ``tree``, the nodes of ``planned``, holds on a row; folded a level at a time, without leaving the row.

    Verdicts are 1, 0, NULL and ``ABSENT``.
    """
    def folded(node: Column, verdicts: Column) -> Column:
        below = F.transform(node["kids"], lambda k: F.get(verdicts, k))
        yes, unknown = F.size(F.filter(below, lambda v: v == 1)), F.size(F.filter(below, lambda v: v.isNull()))
        every = F.when(yes == node["children"], 1).when(yes + unknown < node["children"], 0)
        some = F.when(yes > 0, 1).when(unknown == 0, 0)
        none = F.when(unknown == 0, (yes == 0).cast("int"))
        by_kind = F.when(node["kind"] == "all", every).when(node["kind"] == "any", some).otherwise(none)
        return F.when(F.forall(below, lambda v: F.coalesce(v == ABSENT, F.lit(False))), ABSENT).otherwise(by_kind)

    verdicts = F.transform(tree, lambda n: F.when(n["kind"] != "compare", None).when(n["present"], compared(n).cast("int")).otherwise(ABSENT))
    if depth:
        levels = F.array(*[F.lit(d) for d in range(depth - 1, -1, -1)])
        verdicts = F.aggregate(levels, verdicts, lambda held, d: F.transform(
            tree, lambda n, i: F.when((n["kind"] != "compare") & (n["depth"] == d), folded(n, held)).otherwise(F.get(held, i))
        ))
    return F.exists(F.arrays_zip(tree["depth"].alias("depth"), verdicts.alias("verdict")), lambda x: (x["depth"] == 0) & F.coalesce(x["verdict"] == 1, F.lit(False)))


def resolved(tables: RuleTables) -> DataFrame:
    """Nodes with the kind of their metric and the previous-day metrics a crossing needs."""
    names = tables.catalog.select(F.col("name").alias("metric"), F.col("kind").alias("own_kind"), "previous")
    other = tables.catalog.select(F.col("name").alias("low_metric"), F.col("previous").alias("low_previous"))
    with_low = tables.nodes.withColumn("low_metric", F.get(F.col("low.metrics"), F.lit(0)))
    return with_low.join(names, "metric", "left").join(other, "low_metric", "left")


def planned(tables: RuleTables, names: Sequence[str]) -> DataFrame:
    """A row per valid rule: its head, the nodes of its filter and, in order, its scoring terms with their nodes.

    ``names`` are the metrics that the rows have; ``kids`` are places of a node's children.
    """
    here = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    fields = ("node", "parent", "depth", "kind", "children", "metric", "op", "low", "high", "own_kind", "previous", "low_previous", "present")
    marked = resolved(tables).withColumn("present", F.coalesce(F.array_contains(here, F.col("metric")), F.lit(False)))
    trees = marked.groupBy("rule_id", "tree").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("nodes"))
    trees = trees.withColumn("nodes", F.transform("nodes", lambda n: n.withField(
        "kids", F.filter(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: F.get("nodes", i)["parent"] == n["node"])
    )))
    points = trees.where(F.col("tree") != FILTER).join(tables.terms.select("rule_id", "tree", "position", "weight"), ["rule_id", "tree"], "left")
    weighted = tables.terms.where(F.array_contains(here, F.col("metric")) & F.col("weight").isNotNull()).select("rule_id", "position", "weight", "metric")
    terms = points.unionByName(weighted, allowMissingColumns=True).groupBy("rule_id").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("position", F.lit(-1)).alias("position"), "weight", "metric", "nodes"))).alias("terms")
    )
    filters = trees.where(F.col("tree") == FILTER).select("rule_id", F.col("nodes").alias("filter"))
    valid = rule_verdicts(tables).where("valid").select("rule_id")
    return tables.rules.drop("outputs").join(valid, "rule_id", "left_semi").join(filters, "rule_id").join(terms, "rule_id", "left")


def screen_all(metrics: DataFrame, tables: RuleTables, depth: int | None = None) -> DataFrame:
    """security_code, trade_date, rule_id, score, top_n of every row that a valid rule accepts.

    Invalid rules give no rows. ``depth`` of the deepest tree is looked up if not given. The rules are
    broadcast, a row each, and every tree is folded on the row it is asked of, so that nothing is placed
    or grouped by row and rule.
    """
    if depth is None:
        depth = tables.nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    values, names = with_values(metrics)
    asked = values.where(F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull()).crossJoin(F.broadcast(planned(tables, names)))
    accepted = asked.where(tree_holds(F.col("filter"), depth))

    inside = ((F.size("include") == 0) | F.array_contains("include", F.col("security_code"))) & ~F.array_contains("exclude", F.col("security_code"))
    for flag in [c for c in ("is_st", "is_suspend") if c in values.columns]:
        inside = inside & ~(F.col(f"exclude_{flag.removeprefix('is_')}") & F.coalesce(F.col(flag), F.lit(False)))

    def part(term: Column) -> Column:
        return F.when(term["nodes"].isNull(), F.coalesce(F.try_element_at("numbers", term["metric"]), F.lit(0.0)) * term["weight"]).otherwise(term["weight"])

    # added up in the order of the terms, so that equal scores are equal to the last bit
    total = F.when(F.col("terms").isNull(), 0.0).otherwise(F.aggregate("terms", F.lit(0.0), lambda total, t: F.when(
        t["nodes"].isNull() | tree_holds(t["nodes"], depth), total + part(t)
    ).otherwise(total)))
    return accepted.where(inside).select(*KEYS, "rule_id", F.greatest("low", F.least("high", total)).alias("score"), "top_n")
