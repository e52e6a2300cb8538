"""Exact and approximate search against brute force."""

import duckdb
import numpy as np
import pytest
from tests.llm.conftest import SAMPLE

from tallyhouse.llm import exact_search, neighbours, queries
from tallyhouse.llm.exact_search import BallTree, exact_top_k

SCHEMA = "id long, vec array<double>"


def brute(points, queries, k, score):
    out = {}
    for qid, q in queries:
        best = {}
        for cid, c in points:
            if cid != qid and len(c) == len(q):
                best[cid] = max(best.get(cid, -np.inf), score(q, c))
        merged = out.setdefault(qid, {})
        for cid, s in best.items():
            merged[cid] = max(merged.get(cid, -np.inf), s)
    return {(q, r + 1, c, s) for q, found in out.items() for r, (c, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k])}


def whole(n, dim, seed=0, low=-9):
    return [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(seed).integers(low, 10, (n, dim)))]


@pytest.mark.parametrize("shard_rows", [16, 1000])
def test_exact_equals_brute_force(table, shard_rows):
    points = whole(300, 4)  # small numbers: many ties
    points += [(1000 + i, points[7][1]) for i in range(150)]  # a third of all rows are one vector
    points += [(7, points[7][1]), (2000, [1.0, 2.0])]
    queries = [p for p in points if p[0] % 25 == 0]
    frame = table(SCHEMA, points + [(None, [1.0] * 4), (3000, None), (3001, [1.0, None, 2.0, 3.0]), (3002, [float("nan")] * 4), (3003, [float("inf")] * 4), (3004, [])])
    found = exact_top_k(frame, frame.where("id % 25 = 0"), 5, shard_rows)
    dot = lambda q, c: int(np.dot(q, c))
    assert {tuple(r) for r in found.collect()} == brute(points, queries, 5, dot)


def test_large_numbers_stay_exact(table):
    points = [(i, [float(2**30 + i), float(i - 5)]) for i in range(12)]
    frame = table(SCHEMA, points)
    found = exact_top_k(frame, frame.where("id = 0"), 3, 4)
    assert {tuple(r) for r in found.collect()} == brute(points, points[:1], 3, lambda q, c: sum(int(a) * int(b) for a, b in zip(q, c, strict=True)))


def test_nothing_to_search(table):
    empty = table(SCHEMA, [])
    assert exact_top_k(empty, empty, 5).collect() == []
    assert neighbours.nearest(empty, empty, 5).collect() == []
    alone = table(SCHEMA, [(0, [1.0, 2.0])])
    assert exact_top_k(alone, alone, 5).collect() == []


def test_tree_bounds_hold_and_balls_are_left_out():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.1, (200, 3)) for c in rng.normal(0, 10, (10, 3))])
    tree = BallTree(points, 8)
    q = rng.normal(size=(1, 3))
    scores, bound = (points[tree.order] @ q[0]), tree.bounds(q)[0]
    for node, (lo, hi) in enumerate(zip(tree.start, tree.stop, strict=True)):
        assert scores[lo:hi].max() <= bound[node]
    opened = sum(1 for _ in exact_search._opened(tree, bound[None], np.sort(scores)[-5:-4]))
    assert opened < 0.3 * sum(c[0] < 0 for c in tree.children)


def test_sql_and_operator_agree_on_repeated_rows(spark, tmp_path):
    rows = spark.read.parquet(f"{SAMPLE}/embeddings.parquet").limit(150)
    other = rows.withColumn("vec_id", (rows.vec_id + 1).cast("long"))  # ids with two vectors
    rows.union(rows).union(other).coalesce(1).write.parquet(str(tmp_path / "out"))
    file = next((tmp_path / "out").glob("*.parquet"))
    file.rename(tmp_path / "embeddings.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view embeddings as select * from read_parquet('{tmp_path / 'embeddings.parquet'}')")
    cursor = connection.execute(queries.ORACLES["op1_exact_search"])
    columns = [d[0] for d in cursor.description]
    expected = sorted(cursor.fetchall())
    assert sorted(tuple(r) for r in queries.op1_exact_search(spark, str(tmp_path)).select(columns).collect()) == expected and expected


def test_components_are_floored(table):
    frame = table("id long, vec array<float>", [(0, [0.1, -0.1, None])]).select(exact_search.whole_components("vec", 256).alias("v"))
    assert frame.first()[0][:2] == [25.0, -26.0]


def cosine(q, c):
    q, c = np.array(q), np.array(c)
    return float((c * q).sum() / (np.sqrt((c * c).sum()) * np.sqrt((q * q).sum())))


def test_recall(table):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 24))
    vectors = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 24)) * 0.6
    points = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = table(SCHEMA, points)
    found = neighbours.nearest(frame, frame.where("id % 50 = 0"), 5, 1500).collect()
    truth = {(q, c): s for q, _, c, s in brute(points, points[::50], 5, cosine)}
    assert len(found) == len(truth)
    hit = [r for r in found if (r.query_id, r.vec_id) in truth]
    assert len(hit) >= 0.9 * len(truth)
    assert all(abs(r.score - truth[r.query_id, r.vec_id]) < 1e-12 for r in hit)


def test_few_neighbours_are_found_whole(table):
    points = [(i, v) for i, v in whole(40, 3, low=1)] + [(100 + i, [1.0, 1.0, 1.0]) for i in range(30)]
    odd = [(None, [1.0] * 3), (200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 1.0]), (203, [float("nan")] * 3), (204, [1.0, 2.0])]
    frame = table(SCHEMA, points + odd)
    found = neighbours.nearest(frame, frame.where("id % 10 = 0"), 5)
    queries = [p for p in points if p[0] % 10 == 0]
    got = {(q, r, c, round(s, 9)) for q, r, c, s in map(tuple, found.collect())}
    expected = brute(points, queries, 5, lambda q, c: round(cosine(q, c), 12))
    assert got == {(q, r, c, round(s, 9)) for q, r, c, s in expected}


@pytest.mark.parametrize("shard_rows", [16, 1000])
def test_repeated_rows_take_no_places(table, shard_rows):
    points = whole(60, 3, low=1) * 2 + [(1, [9.0, 9.0, 9.0])] * 9 + [(100 + i, [9.0, 9.0, 9.0]) for i in range(9)]
    queries = [p for p in points if p[0] % 10 == 0]
    frame = table(SCHEMA, points)
    found = exact_top_k(frame, frame.where("id % 10 = 0"), 5, shard_rows)
    assert {tuple(r) for r in found.collect()} == brute(points, queries, 5, lambda q, c: int(np.dot(q, c)))
    near = neighbours.nearest(frame, frame.where("id % 10 = 0"), 5, shard_rows)
    expected = brute(points, queries, 5, lambda q, c: round(cosine(q, c), 12))
    assert {(q, r, c, round(s, 9)) for q, r, c, s in map(tuple, near.collect())} == {(q, r, c, round(s, 9)) for q, r, c, s in expected}


def test_vectors_of_one_id_take_one_place(table):
    rng = np.random.default_rng(4)
    many = [(500, [float(40 + i % 20), float(40 + i // 20), 40.0]) for i in range(300)]  # one id fills any view of the nearest points
    points = [(0, [50.0, 48.0, 40.0]), *many, *((i, [float(x) for x in rng.integers(-9, 10, 3)]) for i in range(1, 30))]
    points = [p for p in points if any(p[1])]
    frame = table(SCHEMA, points)
    found = exact_top_k(frame, frame.where("id = 0"), 5, 1000)
    assert {tuple(r) for r in found.collect()} == brute(points, points[:1], 5, lambda q, c: int(np.dot(q, c)))
    near = neighbours.nearest(frame, frame.where("id = 0"), 5, 1000).collect()
    assert len(near) == 5 and len({r.vec_id for r in near}) == 5
