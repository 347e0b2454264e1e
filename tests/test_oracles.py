"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from compare import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def registered(spark):
    from tickloom.catalog import load

    return load()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def names():
    import re

    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tickloom", "catalog")
    found = []
    for file in sorted(os.listdir(root)):
        if file.endswith(".py"):
            with open(os.path.join(root, file)) as text:
                found += re.findall(r'@query\(\s*"([A-Z][0-9]{2}_\w+)"', text.read())
    return found


@pytest.mark.parametrize("name", names())
def test_query_agrees_with_sql(spark, con, registered, name):
    queries, oracles = registered
    message = compare(spark, con, FOLDER, name, queries[name], oracles.get(name))
    assert not message.startswith("DIFF"), message


def test_every_query_is_listed(registered):
    queries, _ = registered
    generated = {n for n in queries if n.startswith(("table_", "T07_nearest"))}
    assert set(names()) | generated == set(queries)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["security_code", "trade_date", "score", "rank_no"]
    assert df.count() > 0
