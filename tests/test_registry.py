"""The registry and the driver's entry points."""

import pytest

import __spark_entry__ as driver
from conftest import SMALL
from lanefold.plans import registry


def test_every_query_has_a_name_and_most_have_sql():
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries) and set(registry.registered()) <= set(queries)
    assert set(registry.registered()) - set(sql) == {
        "pseudo_embed", "stub_backend_eval", "token_mean_pool",
    }


def test_names():
    with pytest.raises(ValueError, match="already registered"):
        registry.query("vector_topk_exact")(lambda *_: None)
    with pytest.raises(KeyError, match="vector_topk_exact"):
        registry.resolve("no_such_query")


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["qid", "pk", "video_id", "frame_id", "score", "rank"]
    assert df.count() == 100


@pytest.mark.parametrize("name", registry.known())
def test_runs_on_the_smallest_tables(spark, name):
    df = driver.queries()[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()
