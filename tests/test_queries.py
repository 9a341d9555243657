"""Every registered query against its SQL on the smallest tables; those without SQL must give rows."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from obsline import plans

SF = "/root/testdata/sf0.001"
#: Queries beyond SQL; tests of their own compare them with slow versions.
WITHOUT_SQL = {"st6_verified_timeline", "st6_timeline_ahead", "j15_join_interiors"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    return str(v)


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in plans.ORACLE_SQL:
        assert rows and name in WITHOUT_SQL
        return
    cursor = con.execute(plans.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert lines(df.columns, rows) == lines(columns, cursor.fetchall())


@pytest.mark.parametrize("kind", [np.float32, np.float64])
@pytest.mark.parametrize("name", ["p2_grid_means", "p3_p5_cell_flags", "p6_active_side", "s15_read_frames"])
def test_components_keep_their_precision(spark, tmp_path, name, kind):
    near = np.unique(np.array([kind(n / 255 - 0.5) for n in range(256)])[:, None] + np.spacing(kind(0.25)) * np.arange(-3, 4, dtype=kind))
    # Floats that single and double precision put on two sides of a whole number, a vector each; of doubles all near one.
    single = np.floor((near + kind(0.5)) * kind(255))
    told = near[single != np.floor((near.astype(float) + 0.5) * 255)] if kind is np.float32 else near
    assert len(told) > 50 and told.dtype == kind
    vectors = [[x] * 64 for x in told.tolist()] + [near[i : i + 64].tolist() for i in range(0, len(near) - 63, 64)] + [[math.nan, math.inf, -math.inf, None] * 16, [None, math.nan] * 32]
    column = pa.array(vectors, pa.list_(pa.float32() if kind is np.float32 else pa.float64()))
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": column}), tmp_path / "embeddings.parquet")
    df = plans.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    cursor = con.execute(plans.ORACLE_SQL[name])
    assert lines(df.columns, df.collect()) == lines([d[0] for d in cursor.description], cursor.fetchall())
