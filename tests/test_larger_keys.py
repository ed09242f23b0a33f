"""Registered queries against their SQL on tables made for it: keys of more digits, figures halfway between two cents."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from ledgerline.plans import registry

from test_queries import SF, plain


def compared(spark, folder, name):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    result = con.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted(repr(list(map(plain, r))) for r in result.fetchall())
    got = registry.QUERIES[name](spark, str(folder))
    assert want
    assert sorted(repr([plain(r[c]) for c in names]) for r in got.collect()) == want


def test_codes_of_four_digits(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT * REPLACE (l_suppkey + 995 AS l_suppkey) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    duckdb.execute(f"COPY (SELECT * FROM '{SF}/part.parquet') TO '{tmp_path}/part.parquet'")
    compared(spark, tmp_path, "l1_resolved_companies")


@pytest.mark.parametrize("name", ["b5_plain_number", "b14_b20_tokens", "b22_formats"])
def test_figures_halfway_between_cents(spark, tmp_path, name):
    day = datetime.datetime(1996, 2, 1)
    rows = [(i, 1, i, 1, 1.0, 36_250.0 * (1 if i % 2 else 69), 0.05, 0.08, "A", "O", day) for i in range(1, 41)]  # net profits of 0.145 and 10.005
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/raw")
    duckdb.execute(f"COPY (SELECT * REPLACE (l_shipdate::TIMESTAMP AS l_shipdate) FROM '{tmp_path}/raw/*.parquet') TO '{tmp_path}/lineitem.parquet'")
    duckdb.execute(f"COPY (SELECT * FROM '{SF}/part.parquet') TO '{tmp_path}/part.parquet'")
    compared(spark, tmp_path, name)
