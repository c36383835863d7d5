import math
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from braidlake.llm import negatives, queries

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, label string, embedding array<double>, id int, block string, ids int"


def plain(rows, every=100, positives=5, wanted=5, low=80):
    """All scores of all anchors, in Python's integers."""
    seen = {}
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = tuple(math.floor(256 * y) if abs(y) < 1e300 else 1 << 70 for y in v)
        if sum(y * y for y in x) <= 1 << 62:
            seen[i, label, x] = None
    out = Counter()
    for anchor in seen:
        if anchor[0] % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(anchor[2], r[2], strict=False)), r[0], r[1]) for r in seen if r != anchor)
        same = [(-s, i) for s, i, label in scored if label == anchor[1]][:positives]
        other = [(-s, i) for s, i, label in scored if label != anchor[1]]
        for score, i in same:
            hard = [(t, j) for t, j in other if low * score <= 100 * t <= 100 * score][:wanted]
            out.update((anchor[0], i, rank, j, score, t) for rank, (t, j) in enumerate(hard, 1))
    return out


def mined(spark, rows, every=100, **kwargs):
    df = spark.createDataFrame([(i, label, None if v is None else [None if x is None else float(x) for x in v], 1, "b", 2) for i, label, v in rows], KIND)
    return Counter(tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, **kwargs).collect())


def clusters(rng, n, dim, groups, labels=3, noise=0.2):
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(groups, size=n)] + noise * rng.normal(size=(n, dim))
    return [(int(i), str(rng.integers(labels)), v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]


@pytest.fixture
def small(monkeypatch):
    """Several chunks and blocks of few rows."""
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 24)
    monkeypatch.setattr(negatives, "BLOCK", 4)
    monkeypatch.setattr(negatives, "NEAREST", 2)
    monkeypatch.setattr(negatives, "HELD", 50)


def test_clusters(spark, small):
    rows = clusters(np.random.default_rng(1), 900, 12, 15)
    want = plain(rows, 20)
    assert len(want) > 500 and mined(spark, rows, 20) == want


def test_odd_rows(spark, small):
    """Copies, ties, repeats, nulls, other lengths, lengths that few pivots fit, negative and zero scores."""
    rng = np.random.default_rng(2)
    rows = clusters(rng, 150, 4, 4) + [(1000 + k, "0", [0.5, 0.5, 0.5, 0.5]) for k in range(90)] + [(2000 + k, "1", [0.5, 0.5, 0.5, 0.5]) for k in range(40)]
    rows += [(3000 + k, str(k % 2), [float(rng.integers(-1, 2)) for _ in range(4)]) for k in range(60)]
    rows += [(4000 + 10 * k, "0", [0.25 * k]) for k in range(-3, 4)] + [(5000, "0", []), (5010, "1", []), (5020, "2", [0.1] * 6), (5030, "alone", [0.3, 0.1, 0.2, 0.9])]
    rows += [(None, "0", [1.0, 0, 0, 0]), (5040, None, [1.0, 0, 0, 0]), (5050, "0", None), (5060, "0", [1.0, None, 0.0, 0.0]), (5070, "0", [math.nan] * 4), (5080, "0", [math.inf] * 4), (5090, "0", [1e300] * 4), (5100, "1", [1e308] * 4)]
    rows += [rows[0], rows[10], rows[10], (10, "2", [0.5, 0.5, 0.5, 0.4]), (20, "1", [0.5, -0.5, 0.5, 0.4])]
    want = plain(rows, 10)
    assert len(want) > 200 and mined(spark, rows, 10) == want


@pytest.mark.parametrize("scale", [40.0, 1e5, 4e6])
def test_long_vectors_stay_exact(spark, small, scale):
    """Products beyond what 32- and 64-bit floats hold exactly."""
    rng = np.random.default_rng(3)
    rows = [(i, label, [scale * x for x in v]) for i, label, v in clusters(rng, 120, 6, 3, noise=1e-7)]
    want = plain(rows, 10)
    assert len(want) > 50 and mined(spark, rows, 10) == want


def test_other_numbers(spark, small):
    rows = clusters(np.random.default_rng(4), 300, 8, 6)
    for kwargs in ({"positives": 2, "wanted": 7, "low": 95}, {"positives": 8, "wanted": 1, "low": 0}):
        want = plain(rows, 30, **kwargs)
        kwargs["negatives"] = kwargs.pop("wanted")
        assert mined(spark, rows, 30, **kwargs) == want


def test_no_rows(spark):
    assert not mined(spark, []) and not mined(spark, [(1, "a", [1.0])]) and not mined(spark, [(0, "a", [1.0])]) and not mined(spark, [(0, None, None)])


def test_brackets_rule_out_far_chunks(spark, small, monkeypatch):
    """Of separate clusters, blocks meet few chunks, and the result is whole all the same."""
    rng = np.random.default_rng(5)
    rows = clusters(rng, 1200, 16, 8, noise=0.02)
    seen, pairs = [], negatives._pairs
    monkeypatch.setattr(negatives, "_pairs", lambda tasks, chunks, pivots, nearest=None: seen.append((tasks.count() * chunks.count(), pairs(tasks, chunks, pivots, nearest).count(), nearest)) or pairs(tasks, chunks, pivots, nearest))
    assert mined(spark, rows, 20) == plain(rows, 20)
    assert [x[2] for x in seen] == [2, None, 2, None]
    assert all(met < 0.6 * all_ for all_, met, nearest in seen if nearest is None), seen


def test_query_equals_its_sql(spark):
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = db.execute(queries.oracle_sql()["op12_hard_negatives"])
    got = queries.op12_hard_negatives(spark, SF)
    assert got.columns == [c[0] for c in want.description]
    rows = Counter(want.fetchall())
    assert Counter(tuple(r) for r in got.collect()) == rows and rows.total() > 100
