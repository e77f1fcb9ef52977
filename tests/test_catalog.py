"""Every registered radar query against its SQL in DuckDB, on the smallest tables."""

import itertools
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from sweepframe import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def same(a, b):
    if a is None or b is None or a != a or b != b:
        return (a is None or a != a) == (b is None or b != b)
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6) if isinstance(a, float) or isinstance(b, float) else a == b


def key(row):
    return [(x is None, x if isinstance(x, str) else 0.0 if x is None else round(float(x), 4)) for x in row]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, duck):
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(([r[c] for c in columns] for r in found.select(*columns).collect()), key=key) if name in registry.oracle_sql() else found.collect()
    assert rows
    if name in registry.oracle_sql():
        sql = duck.sql(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})")
        expected = sorted(map(list, sql.fetchall()), key=key)
        assert len(rows) == len(expected)
        for a, b in zip(rows, expected):
            assert all(map(same, a, b)), (a, b)


def spectra_of_frames():
    """Range spectra of cube E in numpy alone: (frames, chirps, receivers, bins)."""
    rows = duckdb.sql(f"select embedding from read_parquet('{SF}/embeddings.parquet') order by vec_id").fetchall()
    x = np.array([r[0] for r in rows], float)
    x = x[: len(x) // 32 * 32].reshape(-1, 16, 2, 32, 2)
    z = x[..., 0] + 1j * x[..., 1]
    return np.fft.fft((z - z.mean(axis=-1, keepdims=True)) * np.hanning(32), axis=-1)


def test_capon_map_against_numpy(spark):
    """All rows of the query against the formula, a solved system for each angle."""
    z = spectra_of_frames()[..., :17].reshape(-1, 8, 4, 17)
    z = z - z.mean(axis=1, keepdims=True)
    places = 0.5 * (np.arange(4) - 1.5)
    expected = {}
    for f in range(len(z)):
        p = np.empty((17, 181))
        for k in range(17):
            cov = sum(np.outer(v.conj(), v) for v in z[f, :, :, k]) / 8
            loaded = cov + (0.01 * np.trace(cov).real + 1e-9) * np.eye(4)
            for a in range(181):
                s = np.exp(2j * np.pi * places * math.sin(math.radians(a - 90)))
                p[k, a] = 1 / ((s @ np.linalg.solve(loaded, s.conj())).real + 1e-12)
        p = np.roll(p, 90, axis=1)
        db = 10 * np.log10(np.maximum(p, 1e-12))
        expected |= {(f, k, a): v for (k, a), v in np.ndenumerate(db - db.max())}
    got = {(r.frame, r.range_idx, r.angle_idx): r.db for r in registry.queries()["a12_range_azimuth_capon"](spark, SF).collect()}
    assert got.keys() == expected.keys() and max(abs(got[k] - expected[k]) for k in got) < 1e-3


def test_antenna_order_against_all_permutations(spark):
    z = spectra_of_frames()[0, ::2, :, 9]
    strongest = z[(np.abs(z) ** 2).sum(axis=1).argmax()]
    tried = []
    for conjugated in (False, True):
        for order in itertools.permutations(range(2)):
            s = (strongest.conj() if conjugated else strongest)[list(order)]
            p = [abs(sum(v * np.exp(-2j * np.pi * x * math.sin(math.radians(a))) for v, x in zip(s, (-0.25, 0.25)))) ** 2 for a in range(-90, 91)]
            tried.append((max(p) - np.median(p), ",".join(map(str, order)), conjugated))
    found = registry.queries()["a8_antenna_order"](spark, SF).collect()
    best = max(t[0] for t in tried)
    assert len(found) == 1 and any(abs(t[0] - best) < 1e-9 * best and t[1:] == tuple(found[0])[1:] for t in tried)


def test_line_cfar_of_zero_signals(spark, tmp_path):
    """A cell without signal is minus infinity dB below its noise, as the SQL has it."""
    con = duckdb.connect()
    con.sql(f"copy (select i as event_id, timestamp '2024-01-01' + interval 1 second * i as ts, i % 2 as user_id, case when i % 7 = 0 then 0.0 else i * 37 % 101 / 4 end::double as value from range(90) t(i)) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as from '{tmp_path}/events.parquet'")
    found = registry.queries()["x3_cfar_line"](spark, str(tmp_path)).select("capture_id", "frame", "signal", "noise", "hit", "snr_db")
    expected = con.sql(f"select capture_id, frame, signal, noise, hit, snr_db from ({registry.oracle_sql()['x3_cfar_line']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert sum(r[-1] == -math.inf for r in expected) > 5
