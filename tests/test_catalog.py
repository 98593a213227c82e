"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quarrymill.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, DATA)
    made = pd.DataFrame([r.asDict() for r in got.collect()], columns=got.columns).astype(object)
    want = con.execute(catalog.ORACLES[name]).df().astype(object)
    assert sorted(made.columns) == sorted(want.columns)
    number = lambda x: tuple(v[:-7] if v is not None and v.endswith(".000000") else v for v in x)
    assert list(map(number, rows(made))) == list(map(number, rows(want)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_nation_paths_use_every_edge(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = {r[0] for r in con.execute("SELECT DISTINCT s_nationkey * 100 + c_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey").fetchall()}
    assert max(want) >= 800 and {r.edge_id for r in catalog.nation_edges(spark, DATA).collect()} == want
    met = {int(e) for r in catalog.QUERIES["path_expansion_all_nations"](spark, DATA).collect() for e in r.path.split(">")}
    assert {e for e in want if 1 in divmod(e, 100) and e != 101} <= met


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_part_is_on_a_side_and_expansion_tries_again(spark):
    edges = catalog.part_edges(spark, DATA)
    assert edges.filter("required").count() + edges.filter("not required").count() == 200
    ends = {k for r in catalog.QUERIES["alignment_all_parts"](spark, DATA).collect() for k in (r.r_edge, r.m_edge)}
    old = edges.filter("subject % 5 > 1").collect()
    assert ends & {r.edge_id for r in old}
    one, more = ({r.event_id for r in catalog.QUERIES[q](spark, DATA).collect()} for q in ("one_hop_events", "dynamic_expansion_retries"))
    assert one < more


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["alignment_theta_join", "alignment_all_parts"])
def test_alignment_of_copies_of_parts_stays_off_the_driver(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (p_partkey + 1000 * k AS p_partkey) FROM '{DATA}/part.parquet', range(5) t(k)) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(catalog.ORACLES[name]).fetchall())
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
