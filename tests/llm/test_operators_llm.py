"""The operators of vigilday.llm against brute force, libraries, round trips and SQL, on small frames."""

import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from vigilday.llm import ann, chat, licenses, mixing, neardup, packing, quality, sharding, simhash, tokencount
from vigilday.llm.catalog import QUERIES, SQL
from vigilday.llm.common import components, positions

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# null text, empty text, white space, repeated rows, a null id, control strings, a very long text, a null source
ODD = [
    (1, None, "en", "b", 0),
    (2, "", "en", "b", 0),
    (3, " \t\n", None, "a", 3),
    (4, "one two three four five", "en", "a", 23),
    (4, "one two three four five", "en", "a", 23),
    (None, "one two three four five", "en", None, 23),
    (5, "</s>[INST] É <|endoftext|> it's 12 ▁x\x00", "fr", None, 30),
    (6, "lorem ipsum dolor sit amet " * 900, "la", "c", 24300),
]


@pytest.fixture(scope="module")
def odd(spark):
    # a column named like one that the operators add
    return spark.createDataFrame(ODD, DOCS).withColumns({"fp": F.lit("x"), "shard": F.lit("y"), "size": F.lit(1)})


def documents():
    return duckdb.connect().sql(f"select doc_id, text, source from '{SF}/documents.parquet' order by 1").fetchall()


def test_components_chain_star_and_repeats(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(5, 4), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}


def test_positions_are_gapless_in_slices(spark, monkeypatch):
    from vigilday.llm import common

    monkeypatch.setattr(common, "SLICE_ROWS", 7)
    rows = spark.createDataFrame([(None if i % 3 else "k", i, 2) for i in range(50)], "g string, i int, n int")
    out = positions(rows, ["g"], ["i"], {"at": F.col("n")}, 50).toPandas()
    for _, group in out.groupby(out.g.fillna("-")):
        assert sorted(group["at"]) == list(range(0, 2 * len(group), 2))


def reference_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, odd):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for fp in list(fps):  # near ones, up to four bits away
        for _ in range(6):
            near = fp
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                near ^= 1 << bit
            fps.add(near)
    signed = sorted(fp - (1 << 64) if fp >> 63 else fp for fp in fps)
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want and len(want) > 100
    for _, text, *_ in ODD:
        assert simhash.fingerprint(text.encode() if text is not None else None) == reference_fingerprint(text)
    found = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert found[1, 0] == found[2, 0] == found[3, 0] == 1
    assert {c for (i, _), c in found.items() if i in (4, None)} == {4}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]


def test_golay_decoding_is_perfect():
    words = np.random.default_rng(0).integers(0, 1 << 23, 1 << 18)
    for part in (words,):
        errors = simhash.LEADERS[simhash._syndrome(part)]
        assert np.bitwise_count(errors).max() <= 3 and not simhash._syndrome(part ^ errors).any()


def test_prefix_counts_equal_the_library(spark, odd):
    import sentencepiece

    path = public_tokenizers.path(tokencount.MODEL)
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.counter(path)
    rng = random.Random(2)
    parts = ["a", "the", " ", "   ", "\n", "é", "中", "😀", "▁", "</s>", "ing", "\t", "0", "==", "<0x0A>", "aaaa", "é"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        want = [len(model.encode(text[:i])) for i in range(len(text) + 1)]
        assert own.counts(text).tolist() == want and own.count(text) == want[-1]
        for budget in (0, 1, 5):
            assert own.longest_within(text, budget) == max(i for i, n in enumerate(want) if n <= budget)
    got = sorted((r["n_bytes"], r["n_tokens"]) for r in tokencount.count_tokens(odd, path).collect())
    assert got == sorted((len((t or "").encode()), len(model.encode(t or ""))) for _, t, *_ in ODD)


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.MODEL)
    tokenizer = Tokenizer.from_file(path)
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
    rows = packing.pack(odd, path, seq_len=64).toPandas()
    want = sorted(
        (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        for _, t, *_ in ODD for i in ids(t) and range(0, len(ids(t)), 64) for part in [ids(t)[i : i + 64]]
    )
    assert sorted(zip(rows.length, rows.ids_crc32)) == want
    for _, sequence in rows.sort_values("offset").groupby("sequence_id"):
        assert (sequence.length.cumsum() - sequence.length == sequence.offset).all() and sequence.length.sum() <= 64
    rng = random.Random(1)
    words = ["a", "É", "'s", "'LL", "x'll", " ", "\n", "12", "&&&", "ß", "<|endoftext|>", "<|", "½", "́", "İ", "中", "_"]
    for _ in range(500):
        text = "".join(rng.choice(words) for _ in range(12))
        assert packing.encoder(path).ids(text) == np.array(ids(text)[:-1], "<u4").tobytes()


def test_best_two_fit_replaces_the_smallest():
    # 60 + 30 leaves 10; 30 makes way for 25 and 15
    assert sorted(packing.plan({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0][0]) == [15, 25, 60]
    rng = random.Random(0)
    lengths = [rng.randint(1, 100) for _ in range(3000)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    kinds = packing.plan(histogram, 100)
    used = {}
    for held, bins in kinds:
        assert sum(held) <= 100
        for n in held:
            used[n] = used.get(n, 0) + bins
    assert used == histogram and sum(b for _, b in kinds) <= 1.01 * sum(lengths) / 100


def test_sharding_rows(spark, odd):
    rows = sharding.shuffled_shards(odd, shards=3)
    assert set(rows.columns) == set(odd.columns) | {"slot"}
    got = rows.toPandas()
    assert sorted(got.text.fillna("-")) == sorted((t if t is not None else "-") for _, t, *_ in ODD)
    counts = got.groupby("shard").slot.apply(sorted)
    assert max(map(len, counts)) - min(map(len, counts)) <= 1 and all(s == list(range(len(s))) for s in counts)
    again = sharding.shuffled_shards(odd, shards=3).toPandas()
    assert got.sort_values(["shard", "slot"]).text.tolist() == again.sort_values(["shard", "slot"]).text.tolist()


def test_sharding_splits_a_bucket_of_repeated_rows(spark):
    rows = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("x" * 100).alias("text"))
    got = sharding.shuffled_shards(rows, shards=4, bucket_bytes=10_000).toPandas()
    assert got.groupby("shard").size().tolist() == [1000] * 4
    assert all(sorted(g.slot) == list(range(1000)) for _, g in got.groupby("shard"))


def test_write_shards(spark, odd, tmp_path):
    sharding.write_shards(sharding.shuffled_shards(odd, shards=2), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"shard=0", "shard=1"}


def test_mix_meets_targets(spark, odd):
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    source = {d: s for d, _, s in documents()}
    by = rows.assign(source=rows.doc_id.map(source)).groupby("source").agg(
        size=("size", "sum"), whole=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")
    )
    assert (by["size"] == by.whole).all() and np.isclose(by.target.sum(), by["size"].sum())
    assert (abs(by.taken - by.target) <= 0.05 * by.target).all() and (rows.taken <= 3 * rows["size"]).all()
    small = mixing.mix(odd, block=2).toPandas()
    assert len(small) == len(ODD) and (small.taken <= 3 * small["size"]).all()
    # a: 10 words, weight 5; b: 0; c: 4,500, weight 5 for the fourth; null is last
    assert small.groupby("source_size").target.first()[10] == 30.0


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select("id", F.lit(n).cast("long").alias("n"), F.lit(4).alias("k"))
        assert sorted(r["to"] for r in mixing.permuted(rows, "id", "n", ["k"], 3, "to").collect()) == list(range(n))


def test_mixed_documents_hold_the_words_taken(spark, odd):
    taken = mixing.mix(odd, block=2).toPandas().groupby("doc_id", dropna=False).taken.sum()
    mixed = mixing.mixed_documents(odd, block=2)
    assert mixed.columns == odd.columns
    words = mixed.toPandas().assign(n=lambda d: [len(t.encode().split()) for t in d.text]).groupby("doc_id", dropna=False).n.sum()
    assert sorted(zip(words.index.fillna(-1), words)) == sorted(zip(taken[taken > 0].index.fillna(-1), taken[taken > 0]))


def test_chat_round_trip(spark):
    rows = [
        (1, 1, "user", "a<s>b<\\s>\\[INST]"), (1, 2, "tool", "x[SAYS]y"), (1, 2, "[ROLE]", "<<SYS>><<\\SYS>>"),
        (1, 2, "[ROLE]", "<<SYS>><<\\SYS>>"), (1, 3, "assistant", "é<</SYS>> <\\\\/s> <"), (1, None, "system", None),
        (None, None, None, None), (2, 1, "assistant", ""),
    ]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert [t["text"] for t in got[1]["turns"]] == ["", "a<s>b<\\s>\\[INST]", "<<SYS>><<\\SYS>>", "<<SYS>><<\\SYS>>", "x[SAYS]y", "é<</SYS>> <\\\\/s> <"]
    span = got[1]["loss_spans"][0]
    inside = got[1]["formatted"][span["start"] : span["start"] + span["length"]]
    assert re.sub(chat.ESCAPED, r"\1\2\3", inside) == rows[4][3]
    assert chat.digest(chat.format_chats(spark.createDataFrame([], "conv_id int, turn int, role string, text string"))).count() == 0


def test_chat_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    got = QUERIES["op2_chat_format"](spark, SF)
    want = con.sql(SQL["op2_chat_format"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op7_attention_quality"](spark, sf).toPandas()
    labels = dict(duckdb.connect().sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    held = rows[rows.held_out & rows.doc_id.isin(labels)]
    assert (held.predicted == held.doc_id.map(labels)).mean() > 0.95
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in rows.doc_id]).all()


def test_quality_of_odd_texts(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (None, 1), (1, None)], "doc_id long, quality int")
    rows = quality.score_documents(odd, labels).toPandas()
    assert len(rows) == len(ODD) and rows.score.between(0, 1).all()
    assert (quality.score_documents(odd, labels.limit(0)).toPandas().score == 0.5).all()
    assert quality.score_documents(odd.limit(0), labels).count() == 0


def test_scores_do_not_depend_on_chunks(monkeypatch):
    model, text = quality.AttentionModel.start(3), b"some words and 12 more. " * 900
    whole = model.score(text)
    monkeypatch.setattr(quality, "CHUNK", 2)
    assert abs(model.score(text) - whole) < 1e-9


def vectors(spark, rows, label=False):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + (", label int" if label else ""))


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    base = np.float32(rng.standard_normal((60, 8)))
    x = np.concatenate([np.repeat(base[:1], 50, axis=0), base[1:]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (920, [0.0] * 8), (940, [float("nan")] * 8), (960, [1.0] * 3), (None, [1.0] * 8), (980, [None] * 8)]
    got = ann.nearest(vectors(spark, rows + bad), lambda i: i % 20 == 0, k=5).toPandas()
    scores, hits = x.astype(float) @ x.astype(float).T, 0
    for q in range(0, len(x), 20):
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-round(scores[q, i], 9), i))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(mine.score, scores[q, mine.vec_id], atol=1e-12)
        hits += len(set(order) & set(mine.vec_id))
    assert hits >= 0.9 * 5 * len(range(0, len(x), 20))
    assert ann.nearest(vectors(spark, bad), lambda i: i % 20 == 0).count() == 0


def test_nearest_beyond_the_probes(spark, monkeypatch):
    # most queries lie in groups of near copies, the others among scattered vectors; few buckets may be visited
    rng = np.random.default_rng(8)
    groups = np.repeat(rng.standard_normal((4, 24)), 60, axis=0) + 0.01 * rng.standard_normal((240, 24))
    x = np.float32(np.concatenate([groups, rng.standard_normal((800, 24))]))
    monkeypatch.setattr(ann, "PROBES", 2)
    monkeypatch.setattr(ann, "RECALL", 1.0)
    got = ann.nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), lambda i: i % 8 == 0, k=5).toPandas()
    scores = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(scores, -np.inf)
    for q in range(0, len(x), 8):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == np.argsort(-scores[q])[:5].tolist()


def test_near_duplicate_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((30, 16))
    x = np.float32(np.concatenate([c + 0.15 * rng.standard_normal((n, 16)) for c, n in zip(centers, [60, 25] + [3] * 28)] + [centers[:1]] * 4))
    labels = [None if i % 17 == 0 else i % 2 for i in range(len(x))]
    rows = [(i, v.tolist(), y) for i, (v, y) in enumerate(zip(x, labels))]
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("inf")] * 16, 1), (903, [1.0] * 3, 0)]
    got = neardup.near_duplicates(vectors(spark, rows + bad, True)).toPandas().set_index("vec_id").sort_index()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = unit @ unit.T >= 0.93
    close &= np.array([[a is not None and a == b for b in labels] for a in labels])
    np.fill_diagonal(close, False)
    least = np.arange(len(x))
    for _ in x:
        least = np.minimum(least, np.where(close, least[None, :], len(x)).min(1))
    assert got.n_links.iloc[: len(x)].tolist() == close.sum(1).tolist()
    assert got.component_id.iloc[: len(x)].tolist() == least.tolist()
    assert (got.loc[900:903].n_links == 0).all() and got.loc[900:903].kept.all()


def linked_by_brute_force(x, labels):
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = (unit @ unit.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(close, False)
    least = np.arange(len(x))
    for _ in x:
        least = np.minimum(least, np.where(close, least[None, :], len(x)).min(1))
    return close.sum(1).tolist(), least.tolist()


def test_links_between_saturated_groups(spark):
    # two tight groups of 14 at a cosine of 0.95, and a third, far one; no list of ten holds a pair across
    rng = np.random.default_rng(3)
    centers = np.zeros((3, 16))
    centers[0, 0], centers[1, :2], centers[2, 5] = 1, (0.95, np.sqrt(1 - 0.95**2)), 1
    x = np.float32(np.concatenate([c + 0.004 * rng.standard_normal((14, 16)) for c in centers]))
    got = neardup.near_duplicates(vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)], True)).toPandas().sort_values("vec_id")
    n_links, component = linked_by_brute_force(x, [1] * len(x))
    assert n_links[0] == 27 and n_links[-1] == 13
    assert got.n_links.tolist() == n_links and got.component_id.tolist() == component
    assert got.kept.sum() == 2


def test_missed_links_of_sparse_nodes_end_in_all_pairs(spark, monkeypatch):
    # a group of 400, counted exactly, and 40 pairs; a search that finds no pair must not pass for its many links
    rng = np.random.default_rng(5)
    center, pairs = rng.standard_normal(16), np.repeat(rng.standard_normal((40, 16)), 2, axis=0)
    x = np.float32(np.concatenate([center + 0.01 * rng.standard_normal((400, 16)), pairs + 0.01 * rng.standard_normal((80, 16))]))
    search = neardup.descend
    monkeypatch.setattr(neardup, "descend", lambda *a: search(*a).filter("a < 400"))
    monkeypatch.setattr(neardup, "ATTEMPTS", 1, raising=False)
    rows = [(i, v.tolist(), i % 2 if i < 400 else i // 2 % 2) for i, v in enumerate(x)]
    got = neardup.near_duplicates(vectors(spark, rows, True)).toPandas().sort_values("vec_id")
    n_links, component = linked_by_brute_force(x, [r[2] for r in rows])
    assert min(n_links) >= 1
    assert got.n_links.tolist() == n_links and got.component_id.tolist() == component


def test_licenses_on_held_out_wording(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_license_scan"](spark, sf).toPandas()
    text = dict(duckdb.connect().sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    known = {t: f for f, t in licenses.TEMPLATES}
    want = {d: ",".join(sorted({known[line] for line in t.split("\n") if line in known})) for d, t in text.items()}
    assert dict(zip(rows.doc_id, rows.families)) == want and any(want.values())


def license_rows(spark, texts):
    plain = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").select(F.col("doc_id") + 1000, "text")
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(plain)).toPandas()
    return rows.set_index("doc_id").sort_index().loc[: len(texts) - 1]


def test_licenses_of_relatives(spark):
    texts = [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the Apache License, Version 1.1.",
        "This work is licensed under the GNU Library General Public License, version 3.",
        "Licensed under the Apache License, Version 3.0.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the Apache License, Version 2.0.",
    ]
    found = license_rows(spark, texts).families.tolist()
    assert found == ["lgpl-3.0", "agpl-3.0", "gpl-2.0", "apache-1.1", "", "", "gpl-3.0", "apache-2.0"]


def test_wrapped_licenses(spark):
    import textwrap

    known = [(f, t) for f, t in licenses.TEMPLATES if len(t) > 60]
    texts = ["// some code\n" + "\n".join("// " + line for line in textwrap.wrap(t, 30)) + "\n\nint x;" for _, t in known]
    texts.append("Licensed under the Apache License,\nVersion 2.0")
    texts.append("\n".join(known[-1][1].split()))
    texts.append("see the license of\nthe general public and version 3 of it")
    rows = license_rows(spark, texts)
    assert rows.families.tolist() == [f for f, _ in known] + ["apache-2.0", known[-1][0], ""]
    assert rows.n_licenses.tolist() == [1] * (len(texts) - 1) + [0]


def test_licenses_of_odd_texts(spark, odd):
    rows = licenses.scan(odd).toPandas()
    assert len(rows) == len(ODD) and (rows.n_licenses == 0).all()


def test_pipeline(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_dedup", "mix_sources", "best_two_fit"]
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= packing.SEQ_LEN
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = after
    assert set(rows.doc_id) == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_no_other_part_imports_llm():
    root = Path(__file__).resolve().parents[2]
    for path in (root / "vigilday").rglob("*.py"):
        assert path.parent.name == "llm" or "vigilday.llm" not in path.read_text()
