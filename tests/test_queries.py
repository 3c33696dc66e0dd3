"""Each registered query against its SQL on the smallest tables, and the sample files where they are at hand."""

import os

import duckdb
import pytest

import __spark_entry__
from seaward.jobs import queries
from seaward.operators import qc, series
from seaward.sources import ctf

SF = "/root/testdata/sf0.001"
#: A folder with two days of hourly radial files of one site, and its wave files (optional).
SAMPLES = os.environ.get("RADAR_SAMPLES", "")


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, bool) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(found.fetchall(), names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SAMPLES), reason="no sample files")
def test_sample_hours(spark):
    parsed = ctf.read_files(spark, SAMPLES, "RDLi_*_2019_01_0[12]_*.ruv")
    radials, files = ctf.read_radials(parsed).cache(), ctf.file_table(parsed)
    assert radials.count() == 32_710 and series.valid_files(files).count() == 48
    flagged = qc.qc_radials(radials, files, qc.Thresholds()).filter("hour(time) = 1 AND day(time) = 1").cache()
    count = lambda c: {r[0]: r[1] for r in flagged.groupBy(c).count().collect()}
    assert count("Q201") == {1: 733} and count("Q203") == {1: 397, 4: 336} and count("Q205") == {1: 723, 4: 10}
    assert count("Q206") == {1: 588, 2: 138, 3: 5, 4: 2} and count("Q207") == {4: 733} and count("Q209") == {2: 733} and count("PRIM") == {4: 733}


@pytest.mark.skipif(not os.path.isdir(SAMPLES), reason="no sample files")
def test_sample_waves(spark):
    parsed = ctf.read_files(spark, SAMPLES, "WVLM*.wls")
    assert ctf.read_waves(parsed).count() == 8524
