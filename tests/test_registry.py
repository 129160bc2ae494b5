import pytest

from tidelake.operators.registry import QueryRegistry, profile


def test_registry(spark):
    q = QueryRegistry(spark, history=2, slow_seconds=0)
    assert q.run("SELECT 5", lambda: spark.range(5).count(), "a") == 5
    with pytest.raises(Exception):
        q.run("SELECT 'x'", lambda: spark.sql("select assert_true(false)").collect())
    assert [r.state for r in q.done] == ["done", "failed"] and q.done[1].text == "SELECT '?'" and q.done[0].text == "SELECT ?"
    assert len(q.slow()) == 2 and not q.active and not q.cancel("a")


def test_profile(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey = 5").select("o_custkey")
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,5)]" in profile(df)
