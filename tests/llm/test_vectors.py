"""Operators 12 and 13 against brute force, with ties, repeated rows, nulls and odd vectors."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("spaxelflow.llm")
from spaxelflow.llm import clustering, hard_negatives, vectors  # noqa: E402

DIMS = 6
SCHEMA = "vec_id long, embedding array<float>, label int, id string, v double, cluster int, score long, w int, aid string"


def rows():
    """Few different components, so that many distances and scores are equal; a third of all rows is one row."""
    rng = np.random.default_rng(4)
    out = [(i, (rng.integers(-2, 3, DIMS) / 2 + rng.choice([0, 0.013])).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(260)]
    out += [(100, out[100][1], out[100][2])] * 130 + [(300, out[7][1], 1)] * 2
    odd = [(400, None, 1), (401, [], 1), (402, [1.0] * (DIMS - 1), 1), (403, [1.0] * (DIMS + 1), 1), (404, [None] + [1.0] * (DIMS - 1), 2), (500, [math.nan] * DIMS, 2), (501, [math.inf] + [0.0] * (DIMS - 1), 2), (503, [0.5] * DIMS, None), (None, [0.5] * DIMS, 1), (600, [0.0] * DIMS, 3)]
    return [(*r, "x", 0.5, 1, 2, 3, "y") for r in [*out, *odd]]


def proper(all_rows):
    return [(i, [math.floor(256 * float(x)) for x in v], label) for i, v, label, *_ in all_rows if v is not None and len(v) == DIMS and all(x is not None and math.isfinite(x) for x in v)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


def brute_clusters(kept, k, rounds):
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i4").tobytes())
    centroids = [list(r[1]) for r in sorted(kept, key=key)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, own in groups.items():
            centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)[::-1]) for i, v, _ in kept]
    total = {n: sum(d for _, m, d in found if m == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, total[n], sum(total.values()), digest[n]) for i, n, d in found), key=repr)


@pytest.mark.parametrize("k, rounds", [(1, 1), (9, 4), (40, 5), (600, 2)])
def test_clusters_equal_brute_force(frame, k, rounds):
    out = clustering.cluster(frame, k, rounds, DIMS)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute_clusters(proper(rows()), k, rounds)


def test_orchard_skips_far_centroids_and_keeps_ties():
    rng = np.random.default_rng(1)
    centroids = np.concatenate([rng.integers(-5, 6, (30, 3)), rng.integers(500, 510, (30, 3))])
    v = rng.integers(-6, 7, (5000, 3))
    gaps = ((v[:, None].astype(np.int64) - centroids) ** 2).sum(axis=2)
    best, distance = clustering.Orchard(centroids).nearest(v)
    assert (best == gaps.argmin(axis=1)).all() and (distance == gaps.min(axis=1)).all()


def brute_negatives(kept, every, low=80, positives=5, negatives=5):
    out = []
    kept = [r for r in kept if r[0] is not None and r[2] is not None]
    for k, (i, v, label) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, own, n) for n, (j, w, own) in enumerate(kept))
        for s, j, _, _ in [x for x in scored if x[2] == label and x[3] != k][:positives]:
            hard = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(i, j, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("opening", [1, 50, 4096])
def test_negatives_equal_brute_force(frame, opening, monkeypatch):
    monkeypatch.setattr(hard_negatives, "OPENING", opening)
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "ROWS_A_CELL", 10)
    monkeypatch.setattr(hard_negatives, "CHUNK", 3)
    monkeypatch.setattr(hard_negatives, "HELD", 10)
    out = hard_negatives.mine(frame, F.col("vec_id") % 20 == 0, DIMS)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect())) == brute_negatives(proper(rows()), 20)


@pytest.mark.parametrize("part_bytes", [800, 1 << 20])
def test_anchors_go_to_parts_and_not_through_the_driver(frame, part_bytes, monkeypatch):
    """Parts and lanes of any size give the same rows; an anchor goes to a part once for all its blocks, and requests and blocks meet by no
    broadcast."""
    for name, value in (("OPENING", 50), ("BLOCK", 4), ("ROWS_A_CELL", 10), ("CHUNK", 7), ("PART_BYTES", part_bytes)):
        monkeypatch.setattr(hard_negatives, name, value, raising=False)
    visit, requests, visits, asked = hard_negatives.visit, hard_negatives.requests, [], []
    monkeypatch.setattr(hard_negatives, "visit", lambda *a: visits.append(visit(*a)) or visits[-1])
    monkeypatch.setattr(hard_negatives, "requests", lambda *a: asked.append((a[1].value, requests(*a))) or asked[-1][1])
    out = hard_negatives.mine(frame, F.col("vec_id") % 20 == 0, DIMS)
    assert sorted(map(tuple, out.collect())) == brute_negatives(proper(rows()), 20)
    for found in visits:
        found.collect()
        lines = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
        depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in lines]
        for k, line in enumerate(lines):
            if "BroadcastHashJoin" in line:
                below = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
                assert "MapInArrow" not in "".join(lines[k:below])
    for books, sent in asked:
        seen = [(r.part, i) for r in sent.collect() for i in np.frombuffer(r.ids, "<i8").tolist()]
        assert len(seen) == len(set(seen)) and sum(books.blocks.values()) > books.parts > 1


def test_cells_come_in_falling_order_and_bound_their_rows():
    rng = np.random.default_rng(3)
    v = rng.integers(-90, 90, (2000, 8)).astype(np.int32)
    books = [hard_negatives._fit(v[:, :4], 7), hard_negatives._fit(v[:, 4:], 5)]
    (a, da), (b, db) = (clustering.Orchard(k).nearest(part) for k, part in zip(books, (v[:, :4], v[:, 4:])))
    radii = tuple(np.array([np.sqrt(d[c == k].max(initial=0)) for k in range(len(book))]) for c, d, book in ((a, da, books[0]), (b, db, books[1])))
    cells = a * len(books[1]) + b
    made = hard_negatives.Books(*books, radii, dict(zip(*map(np.ndarray.tolist, np.unique(cells, return_counts=True)))), {})
    order = hard_negatives.CellOrder(made, v[:20])
    for k in range(20):
        listed = list(order.cells(k))
        assert [x[0] for x in listed] == sorted((x[0] for x in listed), reverse=True)
        assert sorted(x[1] for x in listed) == sorted(made.rows)
        for bound, cell in listed:
            assert (v[cells == cell].astype(np.int64) @ v[k].astype(np.int64)).max() <= bound


def test_empty_tables_and_limits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert clustering.cluster(empty, 40, 5, DIMS).collect() == []
    assert hard_negatives.mine(empty, F.col("vec_id") % 20 == 0, DIMS).collect() == []
    one = spark.createDataFrame([(0, [1.0] * DIMS, 1)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(one, F.col("vec_id") % 20 == 0, DIMS).collect() == []
    assert [tuple(r)[:5] for r in clustering.cluster(one, 40, 5, DIMS).collect()] == [(0, 0, 0, 0, 0)]
    with pytest.raises(ValueError, match="k must"):
        clustering.cluster(one, clustering.MAX_CENTROIDS + 1, 5, DIMS)
    with pytest.raises(Exception, match="component"):
        clustering.cluster(one.withColumn("embedding", F.array(*[F.lit(70000.0)] * DIMS)), 1, 1, DIMS)


def test_scores_are_exact_beyond_floats():
    q = np.full((1, 64), vectors.LIMIT - 1, np.int32)
    assert hard_negatives.scores_of(q, q)[0, 0] == 64 * (vectors.LIMIT - 1) ** 2
