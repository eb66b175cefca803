"""The registered queries against their SQL at the smallest scale; sources, streams and evaluation."""

from pathlib import Path
import duckdb
import pytest
from pyspark.sql import functions as F

from spanveil.operators.analytics import evaluate
from spanveil.operators.scan import scan
from spanveil.plans import queries as plans
from spanveil.plans.policy import Policy
from spanveil.sources.tables import guard_requests, json_leaves, read_texts, texts, write_safe
from spanveil.streaming.scan import findings_by_window

DATA = Path("/root/testdata")

SF = DATA / "sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(columns, data):
    order = sorted(columns)
    return sorted(repr([r[columns.index(c)] for c in order]) for r in data)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.queries()[name](spark, str(SF))
    sql = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in sql.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, sql.fetchall())


def test_every_query_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    for name in set(plans.queries()) - set(plans.oracle_sql()):
        assert plans.queries()[name](spark, str(SF)).count() > 0


def test_evaluation(spark):
    kind = "k int, entity_type string, value string"
    gold = spark.createDataFrame([(1, "A", "x"), (1, "A", "x"), (2, "B", "y")], kind)
    found = spark.createDataFrame([(1, "A", "x"), (2, "A", "z")], kind)
    got = {r.entity_type: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in evaluate(gold, found, "k").collect()}
    assert got == {"A": (1, 1, 1, 0.5, 0.5), "B": (0, 0, 1, 1.0, 0.0), "MICRO": (1, 1, 2, 0.5, 1 / 3)}


def test_json_and_requests(spark):
    df = spark.createDataFrame([(1, '{"a": ["x", {"b": "m@n.org"}], "c": 3}'), (2, "no json"), (3, None)], "n int, j string")
    assert sorted((r.n, r.path, r.text) for r in json_leaves(df, "n", "j").collect()) == [(1, "$.a[0]", "x"), (1, "$.a[1].b", "m@n.org")]
    policy = Policy().with_entity("EMAIL", "redact", ["regex"])
    got = {r.n: r.status for r in guard_requests(df, policy, "n", "j").collect()}
    assert got == {1: 422, 2: 200, 3: 200}
    assert guard_requests(df, policy, "n", "j", "sanitize").filter("n = 1").first().sanitized["$.a[1].b"] == "[EMAIL]"


def test_files(spark, tmp_path):
    policy = Policy().with_entity("EMAIL", "redact", ["regex"])
    (tmp_path / "t.txt").write_text("a@b.com\nx\n", encoding="utf-8")
    lines = read_texts(spark, str(tmp_path / "t.txt"), "text")
    write_safe(scan(lines, policy), str(tmp_path / "out"), "json")
    stored = spark.read.json(str(tmp_path / "out"))
    assert "text" not in stored.columns and sorted(r.s for r in stored.select(F.col("scan.sanitized_text").alias("s")).collect()) == ["[EMAIL]", "x"]
    assert [r.text for r in texts(spark, ["p", None]).orderBy("n").collect()] == ["p", None]
    with pytest.raises(ValueError, match="unknown format"):
        read_texts(spark, "x", "xml")


def test_windows_over_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("2024-01-01 00:00:10", "a@b.com"), ("2024-01-01 00:00:40", "c@d.org x@y.org"), ("2024-01-01 02:00:00", "none@n.org")], "t string, text string").select(F.to_timestamp("t").alias("ts"), "text").write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(src))
    counted = findings_by_window(scan(stream, Policy().with_entity("EMAIL", "warn", ["regex"])), "ts", "1 minute", "10 minutes")
    q = counted.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["count"] for r in spark.table("windows").collect()) == [1, 3]


def test_findings_stay_the_same_on_any_partitioning(spark):
    df = spark.read.parquet(str(SF / "documents.parquet"))
    policy = plans.everything()
    total = lambda d: d.agg(F.sum(F.xxhash64("scan.sanitized_text", "doc_id") % 1000)).first()[0]
    assert total(scan(df.repartition(7), policy)) == total(scan(df.coalesce(1), policy))
