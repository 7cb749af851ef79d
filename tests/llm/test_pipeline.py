"""The pipeline's stages against plain versions on a small fixture."""

import random
import re
from collections import Counter

import corpus_pipeline
from motifline.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(8)
    vocab = [f"word{k}" for k in range(500)]
    rows = []
    for k in range(60):
        text = " ".join(rng.choice(vocab) for _ in range(rng.choice([20, 80])))
        rows.append((k, text + (" token=abcdef0123456789" if k % 10 == 0 else ""), "en", "abc"[k % 3]))
    rows += [(100 + k, rows[k][1], "en", "a") for k in range(10)]  # copies
    rows += [(200, "too short", "en", "a"), (201, "same words again and again " * 20, "en", "b"), (202, None, "en", "c"), (203, "", None, None)]
    return [(*r, len(r[1]) if r[1] else 0) for r in rows]


def test_stages(spark, tmp_path):
    scratch, docs = Scratch(spark, "stages"), spark.createDataFrame(fixture(), SCHEMA)
    docs.write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mix", "pack"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.put(stage(spark, docs, f"file://{tmp_path}/sf"), name)
        kept[name] = docs.collect()
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept["quality"]} == {*range(60), *range(100, 110)}
    assert {r["doc_id"] for r in kept["near_duplicates"]} == set(range(60))
    masked = {r["doc_id"]: r for r in kept["secrets"]}
    for r in kept["near_duplicates"]:
        want = re.sub(r"token=\w+", "[SECRET]", r["text"])
        assert masked[r["doc_id"]]["text"] == want and masked[r["doc_id"]]["n_chars"] == len(want)
    size = Counter()
    for r in kept["secrets"]:
        size[r["source"]] += len(WORD.findall(r["text"]))
    taken = Counter()
    for r in kept["mix"]:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    total = sum(size.values())
    for s, w in zip("abc", (1, 2, 3)):
        assert abs(taken[s] - total * w / 6) <= 81
    assert Counter(r["doc_id"] for r in kept["pack"] if r["piece"] == 0) == Counter(r["doc_id"] for r in kept["mix"])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/sf").count() == len(kept["pack"])


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)
