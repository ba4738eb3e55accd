import pytest

from rillmark.plans import workload


@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_query_equals_its_sql(name, same):
    same(workload.QUERIES[name], workload.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(workload.QUERIES) - set(workload.ORACLES)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert workload.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_module_registers_everything():
    import __spark_entry__ as entry

    assert set(workload.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_segment_scan_is_pushed_down(spark, sf_dir):
    from rillmark.operators.retention import retention_from_events
    from rillmark.sources.canonical import facts

    plan = retention_from_events(facts(spark, sf_dir), workload.RETENTION)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    schema = [line for line in plan.splitlines() if "ReadSchema" in line][0]
    assert "value" not in schema and "event_type" in schema


def test_user_buckets_take_keys_beyond_64_bits(spark, tmp_path):
    import duckdb

    ids = [0, 6, 7, 1_164_745, 1_164_746, 5_999_999, 35_999_999]
    path = str(tmp_path / "events.parquet")
    duckdb.sql(f"COPY (SELECT unnest({ids})::BIGINT AS event_id) TO '{path}' (FORMAT parquet)")
    keys = [(i * 7_919 - 50_000) * 1_000_000_007 for i in ids]
    expected = {}
    for b in ((k + (1 << 64) * (k < 0)) % 10_000 for k in keys):
        n, total = expected.get(b % 100, (0, 0))
        expected[b % 100] = (n + 1, total + b)
    assert {r["bucket"]: (r["n"], r["total"]) for r in workload.QUERIES["user_buckets"](spark, str(tmp_path)).collect()} == expected
