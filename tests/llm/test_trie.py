"""The trie of conversation prefixes against a trie of nested dictionaries."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from vigilday.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(paths):
    members, ended = defaultdict(list), defaultdict(list)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
        ended[path].append(conv)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * (len(p[-1][1]) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ended[p]))).encode()).hexdigest()
    return sorted(
        (min(own), len(p), min(members[p[:-1]]) if p else -(10**9), len(own), children[p], leaves[p], saved[p], digest(p))
        for p, own in members.items()
    )


def found(nodes, ends):
    rows = trie.with_ends(nodes, ends).collect()
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_chars ends_sha256".split()
    return sorted(tuple(-(10**9) if r[c] is None else r[c] for c in columns) for r in rows)


def made(seed, convs, longest):
    """Conversations that share beginnings, some of them whole, some much longer than a block."""
    rng = random.Random(seed)
    paths = {}
    for conv in rng.sample(range(-3000, 3000), convs):
        head = rng.choice(list(paths.values())) if paths and rng.random() < 0.8 else ()
        head = head[: rng.randrange(len(head) + 1)]
        paths[conv] = head + tuple(
            (rng.choice(["user", "assistant"]), rng.choice(["", "é", "hi", "12:x", "some words"])) for _ in range(rng.randrange(longest))
        )
    return paths


def test_trie_equals_brute_force(spark):
    paths = made(1, 120, 30)
    rows = [(c, i, *t) for c, p in paths.items() for i, t in enumerate(p)]
    random.Random(2).shuffle(rows)
    convs = spark.createDataFrame([(c,) for c in paths], "conv long")
    turns = spark.createDataFrame(rows, SCHEMA)
    got = found(*trie.prefix_trie(turns, convs=convs))
    assert got == brute(paths) and max(len(p) for p in paths.values()) > 3 * trie.WIDTH


def test_block_boundaries_and_copies(spark):
    turn = ("user", "same")
    paths = {c: (turn,) * n for c, n in enumerate([7, 8, 9, 16, 16, 17, 17, 8, 1])}
    paths |= {2000 + i: (turn,) * 8 + (("user", f"end {i % 3}"),) for i in range(40)}
    rows = [(c, i, *t) for c, p in paths.items() for i, t in enumerate(p)]
    got = found(*trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(paths)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "a"), (1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"),
        (2, 5, "user", "a"), (2, 9, "", ""), (None, 0, "user", "a"), (3, 0, "user", "a"), (-1, 0, "user", "long " * 50000),
    ]
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({"place": F.lit("x"), "prior": F.lit(1), "key": F.lit(2)})
    # turn 0 of conversation 1 stands three times; its order is that of the hashes of role and text
    hashed = lambda role: hashlib.sha256(role.encode()).hexdigest()
    ties = [("", "")] * (hashed("") < hashed("user")) + [("user", "b")] * 2 + [("", "")] * (hashed("") > hashed("user"))
    paths = {
        1: (("user", "a"), *ties), 2: (("user", "a"), ("", "")), 3: (("user", "a"),), -1: (("user", "long " * 50000),),
    }
    assert found(*trie.prefix_trie(turns)) == brute(paths)
    assert found(*trie.prefix_trie(turns.limit(0))) == []


def test_many_ends_of_one_node_stream_in_slices(spark, monkeypatch):
    monkeypatch.setattr(trie, "SLICE_IDS", 7)
    convs = spark.range(-50, 300).select(F.col("id").alias("conv"))
    empty = spark.createDataFrame([], SCHEMA)
    assert found(*trie.prefix_trie(empty, convs=convs)) == brute({c: () for c in range(-50, 300)})


def test_rebuilt_conversations(spark):
    import zlib

    rng = random.Random(6)
    paths = {c: tuple(("user", f"{c} {i}") for i in range(rng.randrange(1, 9))) for c in [*range(0, 40), 150, 151, 200, 201, -7, -130]}
    rows = [(c, i, *t) for c, p in paths.items() for i, t in enumerate(p)]
    told = trie.turn_ids(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text")
    want = {}
    for c in paths:
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        want[c] = paths.get(head, ())[:h] + paths[c][h:]
    got = found(*trie.build(trie.rebuilt(told), told.select("conv").distinct()))
    assert got == brute(want)
