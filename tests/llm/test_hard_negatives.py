"""Hard negatives against a plain search over all pairs of a small table."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from corvane.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, key string"


def brute(rows, scale=256):
    taken = []
    for vec_id, vector, label, *_ in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        taken.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in vector], label))
    key = lambda s, i: (-s, i is None, i)
    out = []
    for a, (anchor, x, label) in enumerate(taken):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(p * q for p, q in zip(x, y, strict=False)), i, m, b) for b, (i, y, m) in enumerate(taken)]
        positives = sorted((key(s, i) for s, i, m, b in scored if m == label and b != a))[:5]
        for top, _, positive in positives:
            fits = sorted(key(s, i) for s, i, m, _ in scored if m != label and 80 * -top <= 100 * s <= 100 * -top)[:5]
            out += [(anchor, positive, r + 1, i, -top, -s) for r, (s, _, i) in enumerate(fits)]
    return out


def clustered(rng, n, width, spread):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    return [[c + rng.gauss(0, spread) for c in centres[rng.randrange(12)]] for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vectors = clustered(rng, 900, 6, 0.1)
    found = [(i, v, rng.choice((0, 1, 1, 2, 9)), "clash", "clash") for i, v in enumerate(vectors)]
    copy = found[50][1]
    found += [(1000 + i, copy, i % 3, "", "") for i in range(200)]  # many equal vectors, ties by id
    found += [
        (1300, None, 1, "", ""),
        (1301, [0.1] * 6, None, "", ""),
        (1302, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1, "", ""),
        (1400, [float("nan")] + [0.0] * 5, 1, "", ""),
        (1500, [float("inf")] + [0.0] * 5, 1, "", ""),
        (1600, [0.5, 0.5], 1, "", ""),  # shorter
        (1700, [], 2, "", ""),
        (1800, [0.0] * 6, 9, "", ""),
        (None, copy, 0, "", ""),
        (None, [0.3] * 6, 2, "", ""),
        (100, found[100][1], found[100][2], "", ""),  # an anchor again
        (500, [1.0] * 6, 2, "", ""),  # its id again
        (-200, [0.7] * 6, 0, "", ""),
    ]
    return found


def table(spark, tmp_path, rows, parts=5):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("small", [False, True])
def test_query(spark, tmp_path, rows, monkeypatch, small):
    """With the usual sizes one leaf holds all; with small ones trees are deep and leaves are cut into blocks."""
    if small:
        for name, value in (("SAMPLE", 128), ("LEAF_ROWS", 40), ("BLOCK_ROWS", 16), ("GROUP_ROWS", 3), ("CHUNK", 2), ("FEW", 1)):
            monkeypatch.setattr(hn, name, value)
    got = hn.query(spark, table(spark, tmp_path, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows))


def test_oracle(spark, tmp_path, rows):
    """Without rows whose ids are null or repeated, which SQL does not tell apart."""
    first = list({r[0]: r for r in reversed(rows) if r[0] is not None and r[1] is not None and len(r[1]) == 6}.values())
    path = table(spark, tmp_path, first)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    assert Counter(map(tuple, hn.query(spark, path).collect())) == Counter(connection.execute(hn.ORACLE_SQL).fetchall())


def test_empty_table(spark, tmp_path):
    assert hn.query(spark, table(spark, tmp_path, [], 1)).collect() == []


def test_only_unusable_rows(spark, tmp_path):
    assert hn.query(spark, table(spark, tmp_path, [(0, None, 1, "", ""), (100, [1.0], None, "", "")])).collect() == []


def test_large_components(spark, tmp_path):
    """Scores beyond what a double holds exactly are still whole numbers."""
    rng = random.Random(1)
    rows = [(i * 50, [rng.uniform(0.9, 1) * 2.0**21 for _ in range(4)], i % 3, "", "") for i in range(60)]
    got = hn.query(spark, table(spark, tmp_path, rows)).collect()
    assert max(r.positive_score for r in got) > 1 << 53
    assert Counter(map(tuple, got)) == Counter(brute(rows))


def test_groups_are_pruned():
    """On clustered vectors a group descends into few leaves once it has good results, and never misses one."""
    rng = random.Random(9)
    data = np.floor(256 * np.array(clustered(rng, 4000, 8, 0.05))).astype(np.int64)
    tree = hn.fit_tree(data[::4].astype(float), 64)
    leaf = tree.route(data.astype(float))
    assert tree.n_leaves == 64 and len(set(leaf.tolist())) == 64
    nodes, below = tree.spans()
    radius = np.full(len(tree.centre), -1.0)
    for node, j in zip(nodes.tolist(), below.tolist()):
        mine = data[leaf == j]
        radius[node] = max(radius[node], np.linalg.norm(mine - tree.centre[node], axis=1).max() + 1e-6)
    group = data[leaf == leaf[0]][:40]
    scores = group @ data.T
    low = np.sort(scores, axis=1)[:, -5:-4].copy()
    visited = hn.Descent(tree, radius).leaves(group.astype(float), low, np.full_like(low, 1 << 62))
    needed = {int(j) for i in range(len(group)) for j in leaf[scores[i] >= low[i, 0]]}
    assert needed <= visited and len(visited) <= 32
    window = (low - 300, low - 200)  # an interval below the best: leaves above it are pruned as well
    needed = {int(j) for i in range(len(group)) for j in leaf[(scores[i] >= window[0][i, 0]) & (scores[i] <= window[1][i, 0])]}
    assert needed <= hn.Descent(tree, radius).leaves(group.astype(float), *window)
