"""Operators with small fixtures, the dialect, and the plans they should have."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import plans
from tessera.dialect import SqlError, parse, render, shim, tokenize, validate
from tessera.functions import cast_boolean, cast_vector, l2_distance, trim_space
from tessera.operators.recursive import fixpoint
from tessera.operators.relational import not_in, range_join, salted_join, set_chain, top
from tessera.operators.window import ranking, spec
from tessera.sources import decrypt_column, encrypt_column, scan, write_clustered
from tessera.streaming import event_stream, windowed_counts


def test_pushdown(spark, sf):
    df = scan(spark, sf, "orders", ["o_orderkey"], F.col("o_totalprice") > 100000)
    text = plans.explain(df, "formatted")
    assert "GreaterThan(o_totalprice,100000.0)" in text and "o_orderpriority" not in text.split("ReadSchema")[1]
    assert plans.shuffles(df) == 0
    assert "TakeOrderedAndProject" in plans.explain(top(df, 10, "o_orderkey"), "formatted")


def test_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    some = spark.createDataFrame([(2,)], "r long")
    ids = lambda df: sorted((r[0] for r in df.collect()), key=str)
    assert ids(not_in(left, some, "k", "r")) == [1]
    assert ids(not_in(left, some.limit(0), "k", "r")) == [1, 2, None]
    assert ids(not_in(left, spark.createDataFrame([(2,), (None,)], "r long"), "k", "r")) == []


def test_joins(spark):
    p = spark.createDataFrame([(k, float(k)) for k in range(50)], "id long, x double")
    r = spark.createDataFrame([(1, 3.5, 9.0), (2, 10.0, 10.0), (3, 8.0, 7.0 + 30)], "rid long, lo double, hi double")
    got = sorted((a.id, a.rid) for a in range_join(p, r, "x", "lo", "hi", 4).collect())
    assert got == sorted((k, i) for k in range(50) for i, lo, hi in ((1, 3.5, 9), (2, 10, 10), (3, 8, 37)) if lo <= k <= hi)
    big = spark.range(1000).select(F.lit(1).alias("k"), "id")
    assert salted_join(big, spark.createDataFrame([(1, "x")], "k int, v string"), "k", 4).count() == 1000


def test_chain(spark):
    f = lambda *x: spark.createDataFrame([(v,) for v in x], "a long")
    assert sorted(r.a for r in set_chain(f(1, 2, 3, 3), ("except", f(2)), ("except", f(3)), ("union all", f(1))).collect()) == [1, 1]
    assert sorted(r.a for r in set_chain(f(1, 1, 2), ("intersect all", f(1, 1, 1))).collect()) == [1, 1]


def test_fixpoint(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a long, b long")
    out = fixpoint(spark.createDataFrame([(1,)], "n long"), lambda new: edges.join(new, F.col("a") == F.col("n")).select("b"))
    assert sorted(r.n for r in out.collect()) == [1, 2, 3]
    # more rounds than tables are kept apart; nulls and repeated rows count once
    start = spark.createDataFrame([(1, None), (1, None)], "n long, x string")
    out = fixpoint(start, lambda new: new.where("n < 20").select(F.col("n") + 1, "x"))
    assert sorted(r.n for r in out.collect()) == list(range(1, 21))


def test_windows(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id long, val long")
    assert [r.a for r in t.select("id", F.avg("val").over(spec(None, ["id"], rows=(-1, 1))).alias("a")).orderBy("id").collect()] == [15, 20, 25]
    with pytest.raises(ValueError):
        ranking(["id"], [])


def test_functions(spark):
    one = spark.range(1)
    assert one.select(trim_space(F.lit(" \t x y \n"))).first()[0] == "x y"
    assert one.select(l2_distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))).first()[0] == 5.0
    for bad in (cast_boolean(F.lit("maybe")), cast_vector(F.lit("[1]"), 2), l2_distance(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))):
        with pytest.raises(Exception):
            one.select(bad).collect()


def test_encryption_is_bound(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    aad = F.concat(F.lit("t/"), F.col("id").cast("string"))
    enc = encrypt_column(df, "v", b"k" * 16, aad)
    assert {r.v for r in enc.collect()} != {"a", None}
    assert {r.v for r in decrypt_column(enc, "v", b"k" * 16, aad).collect()} == {"a", None}
    with pytest.raises(Exception):
        decrypt_column(enc, "v", b"k" * 16, F.lit("other")).collect()


def test_clustered_layout(spark, tmp_path):
    write_clustered(spark.range(1000), str(tmp_path / "c"), "id", 4)
    assert spark.read.parquet(str(tmp_path / "c")).where("id = 77").count() == 1


def test_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    counts = windowed_counts(event_stream(spark, str(tmp_path / "in"), events.schema))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("tessera_counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.sql("SELECT * FROM tessera_counts")) == key(windowed_counts(events))


def test_shim_leaves_literals_alone():
    sql = "SELECT '<-> $1 CURRENT_USER' AS \"<->\", v <-> $1 /* $2 */ FROM t WHERE u = CURRENT_USER -- $3"
    out = shim(validate(sql), user="o'neil", params=[[1, 2]])
    assert "'<-> $1 CURRENT_USER' AS `<->`" in out and "$2" in out and "$3" not in out and "'o\\'neil'" in out and "struct(CAST(v" in out and "array(1.0D, 2.0D) AS b" in out


@given(st.text(alphabet="ab'\"`;-/*$1<> \n.(),=", max_size=30))
@settings(max_examples=200, deadline=None)
def test_tokens_keep_the_text(text):
    try:
        tokens = tokenize(text)
    except SqlError:
        return
    assert render(tokens) == text


@pytest.mark.parametrize("sql", ["INSERT t VALUES (1)", "UPDATE t SET", "DELETE t", "CREATE TABLE t (a DECIMAL)", "CREATE TABLE t (a INT, A INT)", "CREATE INDEX i ON t(a, b)", "CREATE TABLE t (a VECTOR)", "DROP t", "ALTER TABLE t DROP c", "EXECUTE q (a)", "START TRANSACTION", "SET ROLE", "COMMIT now"])
def test_bad_statements(sql):
    with pytest.raises(SqlError):
        parse(sql)
