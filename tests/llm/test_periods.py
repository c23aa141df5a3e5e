"""Runs of repeated words against brute force over all periods."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from vigilday.llm import periods
from vigilday.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words, least=6):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, 4 * q):
                part = words[i : i + length]
                if all(any(part[k] != part[k + r] for k in range(length - r)) for r in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def made(rng):
    size, n, words = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 1, 5, 6, 7, 30, 60, 120, 200]), []
    while len(words) < n:
        if rng.random() < 0.5:
            words += [rng.randrange(size) for _ in range(rng.randrange(1, 9))]
        else:
            words += ([rng.randrange(size) for _ in range(rng.randrange(1, 12))] * rng.randrange(2, 9))[: rng.randrange(1, 90)]
    return words[:n]


def check_many(trials, seed):
    rng = random.Random(seed)
    for _ in range(trials):
        texts = [made(rng) for _ in range(rng.randrange(1, 8))]
        counts = np.array(list(map(len, texts)), np.int64)
        got = periods.find_runs(np.array([w for t in texts for w in t], np.uint64), counts)
        first = np.concatenate(([0], np.cumsum(counts + 1)))
        want = [(int(first[i]) + s, n, q) for i, t in enumerate(texts) for s, n, q in brute(t)]
        assert list(map(tuple, got.tolist())) == want


def test_runs_equal_brute_force():
    check_many(150, 1)


def test_runs_equal_brute_force_in_small_steps(monkeypatch):
    monkeypatch.setattr(periods, "POINTS", 16)
    check_many(40, 2)


def test_words_are_compared_where_sums_are_not_exact(monkeypatch):
    # primes so small that many sums are zero by chance: every occurrence is then compared word by word
    monkeypatch.setattr(periods, "PRIMES", (257, 641))
    check_many(60, 3)


def test_correlation_is_exact():
    rng = np.random.default_rng(4)
    for width in (1, 2, 8, 64):
        blocks, windows = rng.integers(0, 1 << 30, (3, width), np.uint64), rng.integers(0, 1 << 30, (3, 2 * width), np.uint64)
        for prime in periods.PRIMES:
            want = [[sum(int(b[j]) * int(w[j + s]) for j in range(width)) % prime for s in range(width)] for b, w in zip(blocks, windows)]
            assert periods.correlate(blocks, windows, prime).tolist() == want


def test_long_and_hard_texts():
    same = periods.find_runs(np.ones(60000, np.uint64), np.array([60000]))
    assert same.tolist() == [[0, 60000, 1]]
    mixed = np.array(([0] * 512 + [1]) * 50, np.uint64)
    got = periods.find_runs(mixed, np.array([len(mixed)])).tolist()
    assert [0, len(mixed), 513] in got and len(got) == 51


def test_collapse_of_odd_rows(spark):
    text = "a b c " * 5 + "x y " * 2 + "q " * 7
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, text), (4, text), (None, text), (5, "É  É\tÉ\nÉ\rÉ\x0cÉ"), (6, "z " * 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "runs": F.lit(1)})
    got = sorted(((r["doc_id"] or -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.collapse_runs(docs).collect()))
    found = (26, [(0, 15, 3), (19, 7, 1)], "a b c x y x y q")
    assert got == [
        (-1, *found), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, *found), (4, *found),
        (5, 6, [(0, 6, 1)], "É"), (6, 40000, [(0, 40000, 1)], "z"),
    ]
    assert periods.collapse_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    def expected(doc_id, text):
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        return (
            doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
        )

    docs = duckdb.connect().sql(f"select doc_id, text from '{SF}/documents.parquet' order by length(text) limit 120").fetchall()
    want = {d: expected(d, t) for d, t in docs}
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == 200 and {d: got[d] for d in want} == want
    assert sum(w[1] > 0 for w in want.values()) > 5
