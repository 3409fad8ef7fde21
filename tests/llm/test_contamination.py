"""The gate of the decontamination against the word check on every passage."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corvane.llm import decontaminate as D

ITEM = "item_id long, text string"


def brute(text, item):
    """Whether the word check takes a passage of the text, each with what lies around it."""
    words, item = D.fold(text).split(), D.fold(item).split()
    size = next((p for p in D.PASSAGES if p >= len(item)), D.PASSAGES[-1])
    stride = size // 2
    margin = max(stride, len(item) - stride)
    answer = f" {b' '.join(item[-D.ANSWER_WORDS:]).decode()} "
    for lo in range(0, max(1, len(words) - size + stride), stride):
        near = words[max(0, lo - margin) : lo + size + margin]
        share = D.lcs_length(item, near) / len(item)
        if share >= D.LCS_ALONE or (share >= D.LCS_WITH_ANSWER and answer in f" {b' '.join(near).decode()} "):
            return True
    return False


def found(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    marked = D.find_contamination(docs, spark.createDataFrame(items, ITEM)).selectExpr("doc_id", "explode(matches) m")
    return {(r.doc_id, r.m.item) for r in marked.collect()}


@pytest.mark.parametrize("copies", [1, 40])
def test_paraphrases(spark, copies):
    """Paraphrases in words found nowhere else, in a small and in a larger corpus: found as the word check says."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    prose = lambda n: [rng.choice(common) for _ in range(n)]
    items = [[rng.choice(common) if rng.random() < 0.5 else f"r{i}x{j}" for j in range(15 + i % 45)] for i in range(40)]
    docs = []
    for i, item in enumerate(items):
        for share in (0.1, 0.2, 0.3, 0.4, 0.5):
            new = [f"n{rng.random()}" if rng.random() < share and j < len(item) - 5 else w for j, w in enumerate(item)]
            if i % 3 == 0:
                new[-2] = "broken"
            fresh = [f"f{rng.random()}" for _ in range(80)]
            docs.append(" ".join(fresh[:40] + prose(i) + new + fresh[40:]))
    texts = [" ".join(i) for i in items]
    want = {(d, i) for d, t in enumerate(docs) for i in range(len(items)) if brute(t, texts[i])}
    assert len(want) > 120
    rest = [" ".join(prose(40)) for _ in range(200 * (copies - 1))]
    assert found(spark, docs + rest, list(enumerate(texts))) == want


def test_long_and_short_items(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(0, text(1000)), (1, text(2000)), (2, text(70)), (3, "alpha beta"), (4, "Gamma"), (5, "one two three four")]
    items += [(6, text(20_000)), (7, "  ")]
    docs = [f"{text(300)} {t} {text(300)}" for _, t in items[:6]] + [f"{text(50)} {items[6][1]}"]
    docs += ["beta alpha", "alphabeta gammas", text(500), "", items[0][1][:2000], "one two, THREE. four"]
    assert found(spark, docs, items) == {(i, i) for i in range(7)} | {(12, 5)}


def test_nothing_is_sampled(spark, monkeypatch):
    """Every word of every document is in the sketch of the space, however the rows are dealt."""
    rng = random.Random(10)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(200))) for _ in range(300)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n, df, sketch = D.corpus_sketch(docs.repartition(2), "text")
    again = D.corpus_sketch(docs.repartition(7), "text")
    assert n == again[0] == 302 and (df == again[1]).all() and (sketch == again[2]).all()
    plain = np.zeros((D.FEATURES, D.SKETCH), np.int64)
    for text in texts:
        words = D.fold(text).split()
        for k in range(0, len(words), 64):
            h, owner, *_ = D._hashes([b" ".join(words[k : k + 64])])
            D._add_signs(plain, h, owner)
    assert (sketch == plain).all() and len(set(" ".join(filter(None, texts)).split())) <= (abs(sketch).sum(1) > 0).sum() + 20

    def sampled(*_):
        raise AssertionError("a sample was drawn")

    monkeypatch.setattr(D, "sample_passages", sampled)
    assert found(spark, ["one two three four five six seven", "other"], [(1, "one two three four five six seven")]) == {(0, 1)}


def test_what_stands_around_takes_nothing_away():
    """Three quarters of a part reach its floor among the words that point most against it, in any space."""
    rng = np.random.default_rng(11)
    space = D.Space(rng.standard_normal((D.FEATURES, 8)).astype(np.float32))
    for n in (5, 16, 33, 64):
        part = rng.integers(0, D.FEATURES, n)
        latent = D.unit(space.project(part, np.array([0]), np.array([n])))
        around = np.argsort(space.words @ latent[0])[:200]
        held = part[np.sort(rng.permutation(n)[: n - n // 4])]
        text = np.concatenate([around[:100], held, around[100:]])
        reach = space.reach(text, np.array([0]), np.array([len(text)]), latent, np.array([0]))
        assert reach[0] >= space.floor(part, latent[0])
