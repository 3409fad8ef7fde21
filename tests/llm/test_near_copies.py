"""Near copies of the pipeline against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from corvane.llm import near_copies, simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stage_keeps_no_near_copy(spark):
    """Copies with a few words changed: 0.8 or more of the 5-word shingles in common, beyond 3 bits apart."""
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(80, 400))]
        rows.append(" ".join(words))
        for changes in (1, 2, 3):
            new = list(words)
            for _ in range(changes):
                new[rng.randrange(len(new))] = "other"
            rows.append(" ".join(new))
    rows += [None, "", " \n", "one two", "ONE two", "one two three", rows[0]]
    sets = [shingles(t) for t in rows]
    fps = np.array([simhash.fingerprint(t) for t in rows], np.uint64)
    root = list(range(len(rows)))
    beyond = 0
    for i in range(len(rows)):
        for j in range(i):
            far = int(np.bitwise_count(fps[i] ^ fps[j])) > simhash.RADIUS
            near = jaccard(sets[i], sets[j]) >= 0.8
            beyond += near and far
            if near or not far:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert beyond > 50
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], schema).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


@pytest.mark.parametrize("keep", [simhash.keep_representatives, near_copies.keep_distinct])
def test_repeated_and_null_ids_lose_no_text(spark, keep):
    """Rows that share an id, or have none, are documents of their own; one row of each text stays, copies go."""
    texts = [" ".join(f"t{k}w{j}" for j in range(30)) for k in range(6)]
    ids = [1, 7, 7, 7, None, None, 9, 7, None]
    said = [0, 0, 1, 2, 3, 4, 5, 1, 3]
    rows = [(i, texts[k], f"source{n}", {"n": n}) for n, (i, k) in enumerate(zip(ids, said, strict=True))]
    schema = "doc_id long, text string, source string, extra map<string,int>"
    docs = spark.createDataFrame(rows, schema).withColumnRenamed("source", "a.b")
    kept = keep(docs.repartition(3))
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(r.text for r in got) == sorted(texts)
    assert {r.doc_id for r in got if r.text == texts[0]} == {1}
    assert all((r.doc_id, r.text, r["a.b"], r.extra) in rows for r in got)


@pytest.mark.parametrize("block", [3, 1024])
def test_runs_that_the_smallest_does_not_join(spark, block):
    """Chains of sets: each is near the next one only, and all of a chain share a band."""
    chain = [" ".join(f"v{c}x{i}" for i in range(20 * k, 20 * k + 204)) for c in range(3) for k in range(9)]
    docs = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    marks = docs.selectExpr("doc_id", "xxhash64(text)", "text").mapInArrow(
        near_copies._marks, "id long, th long, fp long, set long, bands array<long>"
    )
    heads = marks.selectExpr("set", "th", "array(1L) AS bands")
    edges = near_copies.overlap_edges(heads, docs, "text", block).collect()
    number = {r["set"]: r["id"] for r in marks.collect()}
    sets = [shingles(t) for t in chain]
    assert {frozenset((number[r.a], number[r.b])) for r in edges} == {
        frozenset((i, i + 1)) for i in range(len(chain) - 1) if jaccard(sets[i], sets[i + 1]) >= 0.8
    }
