"""The driver's contract: every query runs, and agrees with its SQL where it has one."""

import datetime
import decimal
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tallyfold import storage

DATA = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted("|".join(plain(r[i]) for i in order) for r in data)


@there
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, DATA)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
        cur = con.execute(sql)
        theirs = rows([c[0] for c in cur.description], cur.fetchall())
        assert mine == theirs


@there
def test_the_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_read_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


def test_the_named_folder_is_used(tmp_path):
    code = f"""
import os
from pyspark.sql import SparkSession
from tallyfold import storage
spark = SparkSession.builder.master("local[1]").config("{storage.KEY}", "file://{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
df = storage.written(spark.range(5), "five")
assert df.count() == 5 and os.listdir("{tmp_path}/tallyfold")
storage.discard(df)
assert not os.listdir("{tmp_path}/tallyfold")
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))
