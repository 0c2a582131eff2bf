import os

import duckdb
import pytest

from cohortlens.operators import index
from cohortlens.plans import catalog
from cohortlens.sources.manifests import load_descriptor, read_manifest, recipe_hash, write_manifest
from cohortlens.streaming.manifests import append_manifest, cell_counts

SF = "/root/testdata/sf0.001"


def same(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want, got = con.sql(catalog.ORACLE_SQL[name]).df(), catalog.QUERIES[name](spark, SF).toPandas()
    keys = sorted(want.columns)
    assert keys == sorted(got.columns)

    def rows(df):
        df = df[keys].copy()
        for c in keys:
            if df[c].dtype.kind in "ifb":
                df[c] = df[c].astype(float).round(6)
        return sorted(map(str, df.astype(str).replace({"None": "nan", "<NA>": "nan"}).values.tolist()))

    assert rows(want) == rows(got)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, name)


def test_names_decode(spark):
    names = ["CASE-1_he.svs", "CASE-1_cd8.svs", "CASE-1_cd8_s02.svs", "BLOCK_12_A_cd8_s03.svs", "notes.txt"]
    rows = {r.name: r.slide_uid for r in index.decoded(spark.createDataFrame([(f"/a/{n}", n) for n in names], "path string, name string")).collect()}
    assert rows["CASE-1_he.svs"] == "CASE-1__he__s01" and rows["CASE-1_cd8_s02.svs"] == "CASE-1__cd8__s02"
    assert rows["BLOCK_12_A_cd8_s03.svs"] == "BLOCK_12_A__cd8__s03" and rows["notes.txt"] is None


def test_manifest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5)], "uid string, n long, x double")
    write_manifest(df, str(tmp_path / "m"), "patches", {"size": 3, "name": "one"})
    assert sorted(map(tuple, read_manifest(spark, str(tmp_path / "m"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    assert recipe_hash({"size": 3, "version": "1"}) == recipe_hash({"size": 3, "version": "2"}) != recipe_hash({"size": 4})
    assert load_descriptor("[stains.HE]\nrole='reference'\n[sources]\nroot='/x'") == {"stains": {"he": {"role": "reference"}}, "sources": [{"root": "/x"}]}


def test_stream_appends_what_the_batch_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    cell = events["user_id"] % 16
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parque*")
    append_manifest(cell_counts(stream, stream["user_id"] % 16, late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    done = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert done and done <= {tuple(r) for r in cell_counts(events, cell).collect()}
