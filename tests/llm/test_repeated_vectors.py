"""Rows that repeat an id with another vector, ties, and the cells of the hash functions."""

import numpy as np

from vigilday.llm import ann, neardup


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_links_of_a_repeated_id_belong_to_its_rows(spark):
    # 1 and 5 are near, and so are, far from them, the other 5 and 9
    rows = [(1, [1.0, 0.0, 0.0], 0), (5, [0.99, 0.01, 0.0], 0), (5, [0.0, 0.0, 1.0], 0), (9, [0.0, 0.01, 0.99], 0)]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [
        (1, 1, 1, True), (5, 1, 1, False), (5, 1, 5, True), (9, 1, 5, False)
    ]
    # one id under two labels, and repeated rows
    rows = [(3, [1.0, 0.0], 0), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (7, [1.0, 0.0], None)]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [
        (2, 2, 2, True), (3, 0, 3, True), (3, 2, 2, False), (3, 2, 2, False), (7, 0, 7, True)
    ]


def test_neighbours_of_a_repeated_id(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (1, [0.9, 0.1], 0), (2, [0.2, 0.8], 0)]
    got = ann.nearest(frame(spark, rows), lambda i: i == 5, k=2).collect()
    own = sorted((r["rank"], r["vec_id"], round(r["score"], 6)) for r in got)
    # each of the two rows of 5 has its own two nearest
    assert own == [(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.1), (2, 2, 0.2)]


def test_equal_scores_go_to_the_smaller_ids(spark):
    # vectors that differ but have one inner product with the query, one of them held by many rows
    rows = [(0, [1.0, 0.0, 0.0], 0)] + [(i, [0.5, 0.5, 0.0], 0) for i in (1, *range(10, 40))]
    rows += [(i, [0.5, 0.0, 0.5], 0) for i in (2, 3, 50)] + [(4, [0.5, 0.0, -0.5], 0)]
    got = ann.nearest(frame(spark, rows), lambda i: i == 0, k=4).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4]


def test_cells_split_the_vectors_in_more_than_two(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for near in (0.2, 0.6, 0.95):
        tables = ann.Tables(16, 1_000_000, float(np.linalg.norm(x, axis=1).max()), near)
        cells = np.floor((tables.lifted(x) @ tables.lines[0] + tables.offsets[0]) / tables.width)
        for j in range(tables.hashes):
            _, n = np.unique(np.clip(cells[:, j], -4, 3), return_counts=True)
            assert len(n) > 2 and n.max() < 0.75 * len(x)


def test_buckets_in_order_of_their_chance_hold_the_near_vectors():
    # the chances of the buckets visited add up to the share of near vectors found in them
    rng = np.random.default_rng(2)
    q = rng.standard_normal(24)
    q /= np.linalg.norm(q)
    tables = ann.Tables(24, 100_000, 1.0, 0.9)
    noise = rng.standard_normal((4000, 25))
    lifted = np.r_[q, 0.0]
    noise -= np.outer(noise @ lifted, lifted)
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    near = 0.9 * lifted + np.sqrt(1 - 0.81) * noise
    found = tables.key(0, np.floor((near @ tables.lines[0] + tables.offsets[0]) / tables.width))
    _, visited = tables.probes(0, q[None, :], np.array([0.9]), 0.8)
    assert abs(np.isin(found, visited).mean() - 0.8) < 0.1
