"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import random
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from test_operators import WORD, components_brute, fingerprint_brute, jump, mix_brute, quality_brute

import corpus_pipeline
from corvane.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by_quality(rows):
    """Mean histograms of what passes the counts, and the distance of each text to them."""
    measured = {r[0]: quality.measure(r[1]) for r in rows}
    passing = [r for r in rows if not quality_brute(r[1])[5]]
    share = lambda h: np.array(h) / max(sum(h), 1)
    mean = {
        (lang, k): np.mean([share(measured[r[0]][k]) for r in passing if r[2] == lang], axis=0)
        for lang in {r[2] for r in passing}
        for k in (5, 6)
    }

    def distance(doc, lang, k):
        p, q = share(measured[doc][k]), mean[lang, k] / mean[lang, k].sum()
        m = (p + q) / 2
        part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        return ((part(p) + part(q)) / 2) ** 0.5

    for r in passing:
        n_chars, n_words = sum(measured[r[0]][5]), measured[r[0]][0]
        junk = n_chars >= quality.MIN_CHARS and distance(r[0], r[2], 5) > quality.MAX_CLASS_DISTANCE
        odd = n_words >= quality.MIN_WORDS and distance(r[0], r[2], 6) > quality.MAX_WORD_DISTANCE
        if not junk and not odd:
            yield r


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    common = quality.COMMON_WORDS["en"]
    fresh = lambda: "".join(rng.choice("aeiounrstlm") for _ in range(rng.randint(4, 9)))
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.3 else fresh() for _ in range(n))
    items = [(i, " ".join(fresh() for _ in range(20))) for i in range(6)]
    texts = [prose(rng.randint(60, 300)) for _ in range(70)]
    texts += [texts[3]] * 5 + [texts[4] + " end"] * 2  # copies
    texts += [f"{prose(40)} {t} {prose(40)}" for _, t in items]  # benchmark items
    texts += ["### $$$ " * 200, " ".join(fresh() + "###$$" for _ in range(150)), "short text", "", None]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = list(kept_by_quality(rows))
    assert len(good) == 83
    ids = [r[0] for r in good]
    heads = set(components_brute(ids, [fingerprint_brute(r[1]) for r in good]))
    clean = [r for r in good if r[0] in heads and not any(t in r[1] for _, t in items)]

    docs, expect = spark.read.parquet(f"{tmp_path}/documents.parquet"), [ids, sorted(heads), [r[0] for r in clean]]
    for (_, stage), want in zip(corpus_pipeline.STAGES, expect, strict=False):
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
        assert sorted(r.doc_id for r in docs.collect()) == want

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_id = {r[0]: r for r in clean}
    times = Counter(r.doc_id for r in got)
    assert set(times) <= set(by_id) and max(times.values()) <= 2
    _, size, target = mix_brute(clean)
    words = Counter()
    for r in got:
        assert (r.text, r.source) == (by_id[r.doc_id][1], by_id[r.doc_id][3])
        words["0" + r.source] += len(WORD.findall(r.text))
        assert r.shard == jump(xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42), 40)
    for k in size:
        assert words[k] == pytest.approx(target[k], abs=160)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_empty_corpus(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
