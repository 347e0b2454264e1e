"""Rule validation, contracts, writers and run modes."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tickloom.functions import codes, rules, scalars
from tickloom.sources import contracts, io, versions
from tickloom.sources.versions import read_published
from tickloom.streaming import incremental as inc

CATALOG = rules.Catalog((
    rules.Metric("close", "quotes", "close", previous="prev_close"), rules.Metric("prev_close", "quotes", "prev_close"),
    rules.Metric("name", "quotes", "name", kind="string"), rules.Metric("flag", "quotes", "flag", kind="boolean"),
))
R = rules
GOOD = R.Rule(filters=R.Compare(R.Ref("close"), "crosses_above", 3.0), scoring=(R.Points("p", R.Compare(R.Ref("close"), "gt", 1.0), 5),))


def test_valid_rule_lists_what_it_reads():
    assert rules.validate_rule(GOOD, CATALOG) == {"close", "prev_close"}


@pytest.mark.parametrize("bad", [
    replace(GOOD, top_n=0),
    replace(GOOD, clamp=(50.0, 10.0)),
    replace(GOOD, clamp=(0.0, 120.0)),
    replace(GOOD, filters=R.Compare(R.Ref("unknown"), "gt", 1.0)),
    replace(GOOD, filters=R.Compare(R.Ref("name"), "gt", "x")),
    replace(GOOD, filters=R.Compare(R.Ref("close"), "eq", "x")),
    replace(GOOD, filters=R.Compare(R.Ref("prev_close"), "crosses_above", 1.0)),
    replace(GOOD, filters=R.Compare(R.Ref("close"), "crosses_above", R.Ref("prev_close"))),
    replace(GOOD, filters=R.Compare(R.Ref("close"), "between", 1.0)),
    replace(GOOD, filters=R.All(())),
    replace(GOOD, scoring=(GOOD.scoring[0], GOOD.scoring[0])),
    replace(GOOD, scoring=(R.Weighted("w", "name", 1.0),)),
])
def test_invalid_rules(bad):
    with pytest.raises(rules.RuleError):
        rules.validate_rule(bad, CATALOG)


def test_rule_hash():
    assert rules.rule_hash(GOOD) == rules.rule_hash(replace(GOOD))
    assert rules.rule_hash(GOOD) != rules.rule_hash(replace(GOOD, top_n=3))


def test_null_means_no_match_and_scores_zero(spark):
    df = spark.createDataFrame([(None, 1.0), (5.0, 1.0)], "close double, prev_close double")
    assert df.where(rules.rule_filter(GOOD.filters, CATALOG)).count() == 1
    rule = R.Rule(filters=GOOD.filters, scoring=(R.Weighted("w", "close", 2.0),), clamp=(1.0, 8.0))
    assert [r[0] for r in df.select(rules.rule_score(rule)).collect()] == [1.0, 8.0]


def test_code_layouts(spark):
    row = spark.createDataFrame([("830001",)], "c string").select(
        codes.normalize_code("c", codes.LOCAL).alias("a"), codes.normalize_code(F.lit("600000.sh")).alias("b"),
        codes.normalize_code(F.lit("999999"), codes.LOCAL).alias("n"),
    ).first()
    assert tuple(row) == ("830001.BJ", "600000.SH", None)
    with pytest.raises(ValueError):
        codes.normalize_code("c", "other")


def test_rounding_of_limit_prices(spark):
    df = spark.createDataFrame([(0.125 / 1.1, "sse_main_board")], "prev_close_price double, security_board string").select(
        "*", F.lit(False).alias("is_st"), F.lit("2020-01-01").cast("date").alias("trade_date")
    )
    assert scalars.price_limits(df).first().limit_up_price == 0.12
    assert scalars.price_limits(df, rounding="half_up").first().limit_up_price == 0.13


def test_strict_types_fail(spark):
    df = spark.createDataFrame([("x",)], "v string")
    for kind in ("date32", "float64", "bool", "int8", "timestamp", "time32"):
        with pytest.raises(Exception, match=f"v is not {kind}"):
            contracts.to_typed(df, {"v": kind}).collect()
        assert contracts.to_typed(df, {"v": kind}, strict=False).first().v is None
    assert contracts.to_typed(spark.createDataFrame([("200",)], "v string"), {"v": "int8"}, strict=False).first().v is None


def quotes(spark):
    return spark.createDataFrame(
        [("A", "2020-01-02", 1.0), ("A", "2020-12-31", 2.0), ("B", "2020-06-01", 5.0), ("A", "2021-01-04", 3.0)], "security_code string, d string, v double"
    ).select("security_code", F.to_date("d").alias("trade_date"), "v")


def rows(df):
    return sorted((r.security_code, r.trade_date.isoformat(), r.v) for r in df.collect())


def test_empty_snapshot_is_refused(spark, tmp_path):
    df = quotes(spark).where("false")
    with pytest.raises(io.DataError):
        io.write_snapshot(df, str(tmp_path / "a"))
    io.write_snapshot(df, str(tmp_path / "a"), allow_empty=True)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 0


def test_partitioned_write_replaces_only_touched(spark, tmp_path):
    path = str(tmp_path / "p")
    q = quotes(spark).withColumn("year", F.year("trade_date"))
    io.write_partitioned(q, path, "year")
    counts = io.write_partitioned(q.where("year = 2021").withColumn("v", F.lit(9.0)), path, "year").collect()
    assert [tuple(r) for r in counts] == [(2021, 1)]
    assert rows(spark.read.parquet(path))[-1] == ("B", "2020-06-01", 5.0) and spark.read.parquet(path).where("v = 9").count() == 1


def test_sync_checks(spark, tmp_path):
    contract = contracts.contract_of(quotes(spark), "q", grain=("security_code",))
    with pytest.raises(io.DataError, match="years 2020 to 2021"):
        io.sync_year(quotes(spark), str(tmp_path / "y"), 2020, contract, "trade_date")
    with pytest.raises(io.DataError, match="duplicate keys"):
        io.sync_snapshot(quotes(spark), str(tmp_path / "s"), contract)
    with pytest.raises(ValueError, match="missing columns"):
        contracts.reconcile_schema(quotes(spark).drop("v"), contract)
    with pytest.raises(io.DataError, match="days without data"):
        days = spark.createDataFrame([("2020-03-03",)], "d string").select(F.to_date("d").alias("trade_date"))
        io.compact_year(quotes(spark), days, 2020, contract, ["security_code", "trade_date"], ["trade_date"])
    with pytest.raises(io.DataError, match="outside the requested set"):
        io.split_by_date(quotes(spark), quotes(spark).where("security_code = 'B'"))


def test_append_latest_refuses_overlap(spark, tmp_path):
    path = str(tmp_path / "t")
    inc.append_latest(quotes(spark), path, "2021-01-01")
    with pytest.raises(io.DataError, match="already exist"):
        inc.append_latest(quotes(spark), path, "2021-01-01")


def test_cascade_keeps_other_rows_and_drops_stale_ones(spark, tmp_path):
    path = str(tmp_path / "t")
    inc.rebuild_table(quotes(spark), path)
    new = quotes(spark).where("security_code = 'A' and year(trade_date) = 2020").withColumn("v", F.col("v") * 10)
    inc.replace_cascade(new, path, "2020-06-01")
    assert rows(read_published(spark, path)) == [("A", "2020-01-02", 1.0), ("A", "2020-12-31", 20.0), ("B", "2020-06-01", 5.0)]


def test_dry_run_and_unknown_mode(spark, tmp_path):
    path = str(tmp_path / "t")
    assert inc.materialize(lambda: quotes(spark), path, "dry_run").count() == 4
    assert not io.path_exists(spark, path)
    with pytest.raises(io.DataError):
        inc.materialize(lambda: quotes(spark), path, "other")


def test_date_chunks():
    assert inc.date_chunks("2020-03-01", "2020-05-01") == [("2020-03-01", "2020-05-01")]
    assert inc.date_chunks("2020-03-01", "2022-02-01") == [("2020-03-01", "2020-12-31"), ("2021-01-01", "2021-12-31"), ("2022-01-01", "2022-02-01")]
    assert inc.date_chunks("2020-03-02", "2020-03-01") == []


def test_upsert_keeps_the_later_version(spark, tmp_path):
    path = str(tmp_path / "u")
    base = spark.createDataFrame([("r", "2020-01-01", "A", 1.0, 1), ("r", "2020-01-02", "A", 2.0, 1)], "run_id string, d string, code string, v double, version int").select(
        "run_id", F.to_date("d").alias("trade_date"), "code", "v", "version"
    )
    io.upsert_results(base, path, ["run_id", "trade_date", "code"])
    io.upsert_results(base.where("v = 2").withColumn("v", F.lit(7.0)).withColumn("version", F.lit(2)), path, ["run_id", "trade_date", "code"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1.0, 7.0]


@pytest.mark.parametrize("rows, message", [
    ([("2020-01-02", "c", "1.5"), ("2020-01-03", "c", "n/a")], "not a number"),
    ([("2020-01-02", "c", "1.5"), ("2020-01-02", "c", "1.6")], "repeated"),
    ([("2020-01-02", "d", "1.5")], "another curve"),
])
def test_strict_yield_curve_raises(spark, rows, message):
    from tickloom.operators import normalize

    df = spark.createDataFrame(rows, "work_date string, curve_name string, y string").selectExpr("cast(work_date as date) work_date", "curve_name", "y")
    with pytest.raises(Exception, match=message):
        normalize.normalize_yield_curve(df, {"y": "y1"}, "c", 2020).collect()


def test_failed_sync_keeps_the_old_snapshot(spark, tmp_path):
    """Duplicate keys are found in the staged copy: the table stays readable and no staging folder is left."""
    from tickloom.sources import contracts, io

    path = str(tmp_path / "table")
    good = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    contract = contracts.contract_of(good, "table", grain=("k",))
    io.sync_snapshot(good, path, contract)
    with pytest.raises(io.DataError):
        io.sync_snapshot(spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), path, contract)
    assert sorted(map(tuple, read_published(spark, path).collect())) == [("a", 1), ("b", 2)]
    assert [f.name for f in tmp_path.iterdir()] == ["table"] and len([f for f in (tmp_path / "table").iterdir() if f.is_dir()]) == 1


class Stopped(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "check", "pointer", "rename"])
def test_a_fault_at_any_step_leaves_the_old_table(spark, tmp_path, monkeypatch, step):
    """What a run leaves behind when it stops between two steps: the old table, and no staging folder."""
    path = str(tmp_path / "t")
    inc.rebuild_table(quotes(spark), path)
    old = rows(read_published(spark, path))
    before = sorted(f.name for f in (tmp_path / "t").iterdir())

    def stop(*_args, **_more):
        raise Stopped

    new = quotes(spark).where("security_code = 'A'").withColumn("v", F.col("v") * 10)
    if step == "write":
        new = new.withColumn("v", F.raise_error(F.lit("stopped")).cast("double"))
    elif step == "check":
        monkeypatch.setattr(inc, "check_unique", stop)
    elif step == "pointer":
        monkeypatch.setattr(versions.json, "dumps", stop)
    else:
        monkeypatch.setattr(versions.Storage, "replace", stop)
    for run in (lambda: inc.replace_cascade(new, path, "2020-06-01"), lambda: inc.rebuild_table(new, path)):
        with pytest.raises(Exception):  # noqa: B017
            run()
        assert rows(read_published(spark, path)) == old
        assert sorted(f.name for f in (tmp_path / "t").iterdir()) == before


def test_published_versions_keep_one_before(spark, tmp_path):
    """A reader of the version before still finds its files; older ones are gone."""
    path = str(tmp_path / "t")
    inc.rebuild_table(quotes(spark), path)
    reader = read_published(spark, path)
    inc.rebuild_table(quotes(spark).withColumn("v", F.col("v") + 1), path)
    assert rows(reader) == rows(quotes(spark))
    inc.rebuild_table(quotes(spark).withColumn("v", F.col("v") + 2), path)
    assert len([f for f in (tmp_path / "t").iterdir() if f.is_dir()]) == 2
    inc.append_latest(quotes(spark).withColumn("security_code", F.lit("C")).dropDuplicates(["trade_date"]), path, "2020-01-01")
    assert read_published(spark, path).where("security_code = 'C'").count() == quotes(spark).select("trade_date").distinct().count()


def test_counts_are_observed_on_the_write(spark, tmp_path):
    """The input is evaluated once for the table and its counts."""
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = quotes(spark)
    counts = inc.observed_run(
        source, lambda df: df.mapInArrow(touch, df.schema), lambda out: inc.rebuild_table(out, str(tmp_path / "o")), "v", value="v")
    total = source.count()
    assert seen.value == total and counts == {"input_rows": total, "valid_input_rows": total, "output_rows": total, "null_indicator_rows": 0}
    parts = io.write_partitioned(source.mapInArrow(touch, source.schema).withColumn("year", F.year("trade_date")), str(tmp_path / "p"), "year")
    written = seen.value
    assert {r.year: r.row_count for r in parts.collect()} == {r.year: r["count"] for r in source.groupBy(F.year("trade_date").alias("year")).count().collect()}
    assert seen.value == written


def test_flatten_payload_of_any_shape(spark):
    """Shapes differ by row, a leaf changes its type, texts are no object or no JSON."""
    from tickloom.operators import normalize

    texts = ['{"a":1,"b":{"x":"t","y":[1,2]},"z":[{"k":1},{"k":2,"m":{"n":true}}]}', '{"a":"s","q":5,"z":[],"id":9}', "[1]", "nope", None, "{}", '{"e":{},"w":null}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, p string")
    got = {r.id: r.asDict() for r in normalize.flatten_payload(df, "p", ["id"]).collect()}
    nothing = dict.fromkeys(("a", "x", "y", "k", "n", "q", "e", "w"))
    assert got[0] == {**nothing, "id": 0, "a": "1", "x": "t", "y": [1, 2], "k": [1, 2], "n": [None, True]}
    assert got[1] == {**nothing, "id": 1, "a": '"s"', "q": 5, "k": [], "n": []}
    assert all(got[i] == {**nothing, "id": i} for i in (2, 3, 4, 5)) and got[6]["w"] is None
    assert normalize.flatten_payload(df.where("id IN (2, 3)"), "p", ["id"]).columns == ["id"]
