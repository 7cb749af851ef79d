"""Near-duplicates against all pairs, on small fixtures; the paths for large nodes and groups by small limits."""

import random
import re

import pytest

from motifline.llm import near_dup
from motifline.llm.common import Scratch
from motifline.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, extra string"


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingle_set(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    out = set()
    for i, (doc_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        component = doc_id if not sets[i] else (min(ids) if ids else None)
        out.add((doc_id, len(sets[i]), component, doc_id is not None and doc_id == component))
    return out


def fixture(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 30, 120]))] for _ in range(12)]
    rows = [(100 - k, " ".join(w), "x") for k, w in enumerate(base)]
    for k in range(60):
        w = list(rng.choice(base[:8]))
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((200 + k, "  ".join(w).upper() if k % 3 else "\n".join(w), None))
    rows += [(1, None, None), (2, "", None), (3, " \t\n", None), (None, rows[0][1], None), (None, None, None), (5, "one two", None), (4, "One\ttwo", None), (6, rows[3][1], None), (6, rows[3][1], None)]
    return rows


@pytest.mark.parametrize("options", [{}, {"limit": 4, "block": 5, "pivots": 2}])
def test_classes_are_those_of_all_pairs(spark, options):
    rows = fixture()
    got = {tuple(r) for r in near_dup.classes(spark, spark.createDataFrame(rows, SCHEMA), **options).collect()}
    assert got == brute(rows)


def loose(seed=3):
    """Two chains of texts, each like its neighbours alone, and texts that share most of their shingles with no link."""
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(5000)]
    rows = []
    for c in range(2):
        w = [rng.choice(vocab) for _ in range(100)]
        for k in range(45):
            rows.append((1000 * c + k, " ".join(w), None))
            w[2 * k % 96 : 2 * k % 96 + 2] = rng.sample(vocab, 2)
    common = [rng.choice(vocab) for _ in range(80)]
    rows += [(5000 + k, " ".join(common + [rng.choice(vocab) for _ in range(30)]), None) for k in range(40)]
    return rows


@pytest.mark.parametrize("options", [{"limit": 30, "block": 12}, {"limit": 16, "block": 10, "parts": 1}])
def test_loose_components_lose_no_link(spark, options):
    rows = loose()
    got = {tuple(r) for r in near_dup.classes(spark, spark.createDataFrame(rows, SCHEMA), **options).collect()}
    assert got == brute(rows)


def test_words_that_polynomial_hashes_confuse(spark):
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2**64 for every base."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word, None), (2, other, None), (3, word, None)]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.classes(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_names_keep_the_order_of_ids(spark):
    from pyspark.sql import functions as F

    ids = [-(2**63), -5, 0, 7, 2**63 - 1, None]
    rows = spark.createDataFrame([(k,) for k in ids], "doc_id long").withColumn("name", near_dup._name(F.col("doc_id"), F.lit(b"x" * 16)))
    found = rows.withColumn("back", near_dup._id_of(F.col("name"))).collect()
    assert [r["doc_id"] for r in sorted(found, key=lambda r: bytes(r["name"]))] == ids
    assert all(r["doc_id"] == r["back"] and len(r["name"]) == 25 for r in found)


def test_extra_columns_with_clashing_names(spark):
    names = ["_id", "_key", "_many", "key", "set", "name", "root", "group", "_n", "n"]
    rows = [(k, f"some text of six words {k // 2}", *["x"] * len(names)) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = near_dup.keep_one(spark, docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4]
    assert {r["component_id"] for r in near_dup.classes(spark, docs).collect()} == {0, 2, 4}


def test_empty_table(spark):
    assert near_dup.classes(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one_keeps_a_row_of_each_class_with_its_columns(spark):
    rows = fixture(2)
    kept = near_dup.keep_one(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    want = {doc_id for doc_id, _, _, k in brute(rows) if k}
    assert sorted(r["doc_id"] for r in kept) == sorted(want)
    assert set(kept[0].asDict()) == {"doc_id", "text", "extra"}


def test_keep_one_keeps_classes_without_ids_and_one_row_of_shared_ids(spark):
    rng = random.Random(6)
    a, b, c = ([f"{x}{rng.randrange(900)}" for _ in range(60)] for x in "abc")
    near = " ".join([*b[:-1], "changed"])
    rows = [(None, " ".join(a), "x"), (None, " ".join([*a[:-1], "changed"]), "y"), (1, " ".join(b), "x"), (2, near, "x"), (2, " ".join(c), "x"), (None, " ", "blank")]
    kept = near_dup.keep_one(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["text"]) for r in kept if r["doc_id"] is not None} == {(1, rows[2][1]), (2, rows[4][1])}
    assert sorted(len(r["text"]) > 1 for r in kept if r["doc_id"] is None) == [False, True]


def test_long_text_and_sketches(spark):
    words = [f"v{k}" for k in range(60_000)]
    rows = [(1, " ".join(words), None), (2, " ".join(words[:59_000]), None), (3, " ".join(words[:30_000]), None)]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.classes(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100)] + [(1000, 1000 + k) for k in range(1, 80)] + [(2000 + rng.randrange(50), 2000 + rng.randrange(50)) for _ in range(40)]
    rng.shuffle(edges)
    found = components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long").repartition(7), "t")
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert {(r["node"], r["root"]) for r in found.collect()} == {(x, root(x)) for x in up}
    assert found.count() == len(up)


def test_few_links_are_joined_at_once_and_many_in_rounds(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    once, rounds = Scratch(spark, "test"), Scratch(spark, "test")
    found = [{tuple(r) for r in components(scratch, df, "t", most=most).collect()} for scratch, most in ((once, 1000), (rounds, 0))]
    assert found[0] == found[1] == {(k, 0) for k in range(61)} | {(k, 100) for k in range(100, 140)}
    assert len(once.names) == 2 < len(rounds.names)  # tables, each of which takes a job


def test_levels_are_compared_in_one_job(spark):
    scratch = near_dup.linked(spark, spark.createDataFrame(fixture(), SCHEMA), limit=4, pivots=2)[0]
    assert "tree-large1" in scratch.names  # some nodes are large, so there are several tables of buckets
    assert len([n for n in scratch.names if n.startswith("pairs")]) == 1
