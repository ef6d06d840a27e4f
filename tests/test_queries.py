"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest
from conftest import SF

from papyr.plans import registry

ROWS_ONLY = sorted(set(registry.QUERIES) - set(registry.SQL))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(name, spark, duck, same):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(registry.SQL[name]).df()
    for c in got.columns:  # a nullable whole number comes as a float
        if got[c].dtype == "float64" and str(want[c].dtype).lower() in ("int64", "float64") and got[c].isna().any() and (got[c].dropna() % 1 == 0).all():
            got[c], want[c] = got[c].astype("Int64").astype(object), want[c].astype("Int64").astype(object)
    same(got.where(got.notna(), None), want.where(want.notna(), None))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_stream_equals_batch(spark):
    a = registry.QUERIES["stream_rate_limit"](spark, SF).toPandas().sort_values("event_id").reset_index(drop=True)
    b = registry.QUERIES["rate_limit_accept"](spark, SF).toPandas().sort_values("event_id").reset_index(drop=True)
    assert a.equals(b)


def test_buffered_rows_join_to_the_text(spark):
    from papyr.operators.chains import buffered_rows

    rows = [(k, i, None if i == 3 else f"{k}-{i} " * (i % 5)) for k in range(6) for i in range(20)]
    got = buffered_rows(spark.createDataFrame(rows, "k long, i long, text string"), 30, "k", "i").orderBy("k", "flush").collect()
    for k in range(6):
        mine = [r.content for r in got if r.k == k]
        assert "".join(mine) == "".join(x or "" for a, _, x in rows if a == k)
        assert all(len(x) >= 30 for x in mine[:-1])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cleaning_queries_read_whole_texts(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sum(len(x) > 400 for x in docs.values()) > 100
    for r in registry.QUERIES["xml_escape"](spark, SF).collect():
        text = docs[r.doc_id].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
        assert text in r.result


def test_stream_counts_equal_batch(spark, duck):
    got = {(r.start, r.event_type, r.n) for r in registry.QUERIES["stream_counter"](spark, SF).collect()}
    want = duck.sql("SELECT date_trunc('day', ts::TIMESTAMP), event_type, count(*) FROM events GROUP BY ALL").fetchall()
    assert got == {(str(d), k, n) for d, k, n in want}


def test_element_counts_without_a_kind(spark, duck, tmp_path):
    """A document whose paragraphs are neither headings nor list items has null counts in the SQL."""
    c = duck.cursor()
    c.execute(f"copy (select * replace (case when o_custkey % 2 = 0 then 16 else o_orderkey end as o_orderkey) from orders) to '{tmp_path}/orders.parquet'")
    c.execute(f"create temp view orders as select * from '{tmp_path}/orders.parquet'")
    want = sorted(c.sql(registry.SQL["element_counts"]).fetchall(), key=str)
    assert {x[1] is None for x in want} == {True, False}
    assert sorted((tuple(r) for r in registry.QUERIES["element_counts"](spark, str(tmp_path)).collect()), key=str) == want
