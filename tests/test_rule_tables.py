"""Rules as rows against the same rules compiled to columns, and verdicts against the driver-side check."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tickloom.functions import rules as r
from tickloom.plans import rule_tables

CATALOG = r.Catalog((
    r.Metric("a", "t", "a", previous="prev_a"), r.Metric("b", "t", "b", previous="prev_b"), r.Metric("prev_a", "t", "prev_a"), r.Metric("prev_b", "t", "prev_b"),
    r.Metric("n", "t", "n", kind="integer"), r.Metric("word", "t", "word", kind="string"), r.Metric("flag", "t", "flag", kind="boolean"),
    r.Metric("day", "t", "day", kind="date"), r.Metric("day2", "t", "day2", kind="date"), r.Metric("hidden", "t", "hidden", allow_filter=False), r.Metric("plain", "t", "plain", allow_scoring=False, operators=("eq",)),
))
D0 = dt.date(2024, 1, 1)


def metrics(spark):
    rnd = random.Random(4)

    def maybe(value):
        return None if rnd.random() < 0.15 else value

    rows = []
    for i in range(200):
        pick = lambda: maybe(float(rnd.randrange(-3, 4)))
        rows.append((f"S{i % 10}", D0 + dt.timedelta(days=i // 10), pick(), pick(), pick(), pick(), maybe(rnd.randrange(5)), maybe(rnd.choice("xyz")), maybe(rnd.random() < 0.5),
                     maybe(D0 + dt.timedelta(days=rnd.randrange(5))), maybe(D0 + dt.timedelta(days=rnd.randrange(5))), pick(), pick(), maybe(rnd.random() < 0.2), rnd.random() < 0.2))
    return spark.createDataFrame(rows, "security_code string, trade_date date, a double, b double, prev_a double, prev_b double, n int, word string, flag boolean, day date, day2 date, hidden double, plain double, is_st boolean, is_suspend boolean")


def leaf(rnd):
    R, C = r.Ref, r.Compare
    return rnd.choice([
        lambda: C(R("a"), rnd.choice(r.COMPARISONS), rnd.choice([R("b"), 1.0, 2, r.Times(2.0, R("b")), r.Times(R("b"), r.Times(0.5, R("n")))])),
        lambda: C(R("a"), "between", r.Between(-1.0, rnd.choice([R("b"), r.Times(R("n"), 2)]))), lambda: C(R(rnd.choice("ab")), rnd.choice(r.CROSSINGS), rnd.choice([R("b"), R("a"), 0.5])),
        lambda: C(R("word"), rnd.choice(("eq", "ne")), rnd.choice(["x", R("word")])), lambda: C(R("flag"), rnd.choice(("eq", "ne")), True), lambda: C(R("day"), rnd.choice(r.COMPARISONS), R("day2")),
        lambda: C(R(rnd.choice(["word", "n", "a", "day", "flag"])), "is_null"), lambda: C(R("n"), "gt", 1),
    ])()


def tree(rnd, depth):
    if depth == 0 or rnd.random() < 0.3:
        return leaf(rnd)
    kind = rnd.randrange(3)
    if kind == 2:
        return r.Not(tree(rnd, depth - 1))
    return (r.All, r.Any_)[kind](tuple(tree(rnd, depth - 1) for _ in range(rnd.randrange(1, 4))))


def grid():
    rnd = random.Random(9)
    rules = {}
    for i in range(40):
        terms = [r.Points(f"p{k}", tree(rnd, 2), rnd.choice([5, 12.5, -3])) for k in range(rnd.randrange(3))] + [r.Weighted("w", rnd.choice("abn"), 1.5)] * rnd.randrange(2)
        universe = rnd.choice([r.Universe(), r.Universe(exclude_st=True), r.Universe(exclude_suspend=True, exclude=("S1",)), r.Universe(include=("S2", "S3", "S4"))])
        rules[f"r{i}"] = r.Rule(filters=tree(rnd, 3), scoring=tuple(terms), clamp=rnd.choice([(0, 100), (0, 10), (2, 60)]), top_n=rnd.randrange(1, 6), universe=universe)
    return rules


GOOD = r.Compare(r.Ref("a"), "gt", 0.0)
BAD = {
    "unknown": r.Rule(r.Compare(r.Ref("zzz"), "gt", 0.0)), "op": r.Rule(r.Compare(r.Ref("a"), "like", 0.0)), "empty": r.Rule(r.All(())), "kinds": r.Rule(r.Compare(r.Ref("a"), "eq", "x")),
    "order": r.Rule(r.Compare(r.Ref("word"), "lt", "x")), "hidden": r.Rule(r.Compare(r.Ref("hidden"), "gt", 0.0)), "allowed": r.Rule(r.Compare(r.Ref("plain"), "gt", 0.0)),
    "right": r.Rule(r.Compare(r.Ref("a"), "gt")), "range": r.Rule(r.Compare(r.Ref("a"), "between", 1.0)), "range2": r.Rule(r.Compare(r.Ref("a"), "gt", r.Between(1.0, 2.0))),
    "cross": r.Rule(r.Compare(r.Ref("n"), "crosses_above", 1.0)), "cross2": r.Rule(r.Compare(r.Ref("a"), "crosses_above", r.Ref("n"))), "cross3": r.Rule(r.Compare(r.Ref("a"), "crosses_above", r.Times(2.0, r.Ref("b")))),
    "left": r.Rule(r.Compare(3.0, "gt", 1.0)), "product": r.Rule(r.Compare(r.Ref("a"), "gt", r.Times(2.0, r.Ref("word")))), "product2": r.Rule(r.Compare(r.Ref("a"), "gt", r.Times(2.0, "x"))),
    "other": r.Rule(r.Compare(r.Ref("a"), "gt", r.Ref("nope"))), "twice": r.Rule(GOOD, (r.Points("p", GOOD, 1), r.Weighted("p", "a", 1))), "points": r.Rule(GOOD, (r.Points("p", r.Compare(r.Ref("plain"), "eq", 1.0), 1),)),
    "weight": r.Rule(GOOD, (r.Weighted("w", "word", 1),)), "weight2": r.Rule(GOOD, (r.Weighted("w", "nope", 1),)), "top": r.Rule(GOOD, top_n=0), "clamp": r.Rule(GOOD, clamp=(10, 5)), "clamp2": r.Rule(GOOD, clamp=(0, 101)),
    "outputs": r.Rule(GOOD, outputs=("nope",)), "deep": r.Rule(r.All((GOOD, r.Any_((GOOD, r.Not(r.Compare(r.Ref("word"), "gt", "x"))))))),
}


def test_hits_and_scores_equal_compiled_rules(spark):
    table, rules = metrics(spark).cache(), grid()
    for rule in rules.values():
        r.validate_rule(rule, CATALOG)
    got = rule_tables.screen_all(table, rule_tables.tables_of(spark, rules | BAD, CATALOG))
    shown = {(x.rule_id, x.security_code, x.trade_date): (round(x.score, 9), x.top_n) for x in got.collect()}
    want = {}
    for name, rule in rules.items():
        hits = r.apply_universe(table, rule.universe).where(r.rule_filter(rule.filters, CATALOG))
        for x in hits.select("security_code", "trade_date", r.rule_score(rule, CATALOG).alias("score")).collect():
            want[name, x.security_code, x.trade_date] = (round(x.score, 9), rule.top_n)
    assert shown == want and len({k[0] for k in want}) > 30


def test_verdicts_equal_the_check_on_the_driver(spark):
    rules = grid() | BAD
    got = {x.rule_id: x for x in rule_tables.rule_verdicts(rule_tables.tables_of(spark, rules, CATALOG)).collect()}
    assert set(got) == set(rules)
    for name, rule in rules.items():
        try:
            r.validate_rule(rule, CATALOG)
            fine = True
        except r.RuleError:
            fine = False
        assert got[name].valid == fine and (got[name].reason is None) == fine, name
    assert fine is False and got["deep"].reason == "no_order" and got["twice"].reason == "name_used_twice"


def test_plan_does_not_grow_with_rules(spark):
    table = metrics(spark)

    def size(n):
        rules = {f"r{i}": replace(grid()["r1"], top_n=i + 1) for i in range(n)}
        plan = rule_tables.screen_all(table, rule_tables.tables_of(spark, rules, CATALOG), 3)._jdf.queryExecution().optimizedPlan()
        return plan.toString().count("\n")

    assert size(1) == size(60)


def test_no_rules_and_no_rows(spark):
    table = metrics(spark)
    assert rule_tables.screen_all(table, rule_tables.tables_of(spark, {}, CATALOG)).count() == 0
    assert rule_tables.screen_all(table.where("false"), rule_tables.tables_of(spark, grid(), CATALOG)).count() == 0
    assert pytest.approx(0) == rule_tables.rule_verdicts(rule_tables.tables_of(spark, {}, CATALOG)).agg(F.count("*")).first()[0]


def test_metrics_are_judged_where_they_lie(spark):
    """No step places the metrics, by row and rule or by metric name; only the small rule tables are shuffled."""
    found = rule_tables.screen_all(metrics(spark), rule_tables.tables_of(spark, grid(), CATALOG), 3)
    placed = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in placed if "security_code" in line or "numbers" in line]
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Join Cross")[0]
    assert "Aggregate" not in above and "Generate" not in above


def test_metrics_that_rows_lack_and_rows_without_a_key(spark):
    """A comparison of a metric that the catalog has and the table has not is no child; a weighted one adds nothing."""
    day = D0
    table = spark.createDataFrame([("S1", day, 1.0), ("S2", day, -1.0), (None, day, 1.0), ("S3", None, 1.0)], "security_code string, trade_date date, a double")
    gone = r.Compare(r.Ref("b"), "gt", 0.0)
    rules = {
        "any": r.Rule(r.Any_((GOOD, gone)), (r.Weighted("w", "b", 2.0), r.Weighted("v", "a", 3.0))), "all": r.Rule(r.All((GOOD, gone))), "not": r.Rule(r.Not(gone)),
        "none": r.Rule(r.Not(r.Any_((GOOD, gone)))), "alone": r.Rule(gone), "points": r.Rule(GOOD, (r.Points("p", gone, 5), r.Points("q", r.Not(r.All((GOOD, gone))), 7))),
    }
    got = {(x.rule_id, x.security_code, x.score) for x in rule_tables.screen_all(table, rule_tables.tables_of(spark, rules, CATALOG)).collect()}
    assert got == {("any", "S1", 3.0), ("none", "S2", 0.0), ("points", "S1", 7.0)}
