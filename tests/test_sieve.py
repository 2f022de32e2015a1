"""Records that nothing asks for go before anything is shuffled, and none that is asked for does."""

import duckdb
from pyspark.sql import functions as F

from corpusloom.operators import resolve as Z
from corpusloom.operators import spread
from corpusloom.plans import registry


def rows(spark, schema, *dicts):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], schema)


def test_a_day_alone_pairs_no_journeys(spark):
    ride = lambda k, number, start: {"id": k, "kind": "transport", "state": "booked", "start": start, "fields": {"number": number}}
    day = [ride(k, f"S{k}", "2024-05-01") for k in range(30)]
    more = [ride(100, "S7", "2024-05-02"), ride(101, "S7", None), ride(102, "ABC", "2024-05-01"), ride(103, None, "2024-05-01T10:05"), ride(104, None, "2024-05-01T10:35"), ride(105, None, "2024-05-02T10:05")]
    asks = [{"q": 1, "kind": "transport", "number": "S7", "date": "2024-05-01"}, {"q": 2, "kind": "transport", "number": "S7"}, {"q": 3, "kind": "transport", "number": "abc", "date": "2024-05-01"}, {"q": 4, "kind": "transport", "date": "2024-05-01T10:20"}, {"q": 5, "kind": "transport", "date": "2024-05-01"}]
    records, queries = Z.read_records(rows(spark, Z.RECORDS, *day, *more)), Z.read_queries(rows(spark, Z.QUERIES, *asks))
    met = {tuple(x) for x in Z.candidates(records, queries).collect()}
    assert met == {(1, 7), (1, 101), (2, 7), (2, 100), (2, 101), (3, 102), (4, 103), (4, 104)}


def test_sieved_keeps_what_is_asked_for(spark, monkeypatch):
    a, b = spark.range(1000).withColumn("x", F.col("id") % 7), spark.range(0, 1000, 10).withColumn("x", F.lit(3).cast("long"))
    for sieve, n in ((2_000_000, 15), (5, 1000)):
        monkeypatch.setattr(spread, "SIEVE", sieve)
        got = spread.sieved(a, b, ["id", "x"])
        assert got.count() == n and got.join(b, ["id", "x"], "left_semi").count() == 15


def test_lines_that_are_there_twice_count_once(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE VIEW l AS SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet'")
    con.execute(f"COPY (SELECT * FROM l UNION ALL SELECT * REPLACE (l_suppkey + 1 AS l_suppkey) FROM l WHERE l_orderkey % 3 = 0 UNION ALL SELECT * REPLACE (70 AS l_linenumber) FROM l WHERE l_linenumber = 7) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.execute(registry.oracle_sql()["rec_resolve_leg"]).fetchall()
    got = [tuple(x) for x in registry.queries()["rec_resolve_leg"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 100
