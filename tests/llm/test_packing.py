"""Packing against the tokenizers library, the rules of a packing, and one bin after the other."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import packing


def pieces_brute(rows, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc_id, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            yield doc_id, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity])


def gapless(rows, capacity):
    """Every sequence is filled from 0 without gaps, up to the capacity; returns the number of sequences."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= capacity
    return len(held)


def test_query(spark, docs_dir, doc_rows):
    rows = [r.asDict() for r in packing.query(spark, docs_dir).collect()]
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[c] for c in names) for r in rows) == Counter(pieces_brute(doc_rows, 4096))
    total = sum(r["length"] for r in rows)
    assert gapless(rows, 4096) == -(-total // 4096)


@pytest.mark.parametrize("capacity", [7, 64])
def test_small_sequences_hold_the_ids(spark, docs_dir, doc_rows, capacity):
    """The sequences' ids, cut at their spans, are the documents' ids; clashing columns come to nothing."""
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet").withColumnsRenamed({"lang": "task", "source": "length", "n_chars": "nth"})
    want = Counter(pieces_brute(doc_rows, capacity))
    got, n = Counter(), 0
    for r in packing.pack_documents(docs, capacity).collect():
        ids, end = np.array(r.ids, "<u4"), 0
        for p in r.pieces:
            assert p.offset == end
            end += p.length
            got[p.doc_id, p.piece, p.start, p.length, zlib.crc32(ids[p.offset : end])] += 1
        assert end == len(ids) <= capacity
        n += 1
    assert got == want
    assert n <= 1.02 * sum(k[3] * v for k, v in want.items()) / capacity + 1


def one_by_one(lengths, capacity):
    """Bins made one after the other by the rule that the docstring states."""
    left, bins = sorted(lengths), []
    while left:
        held, gap = [], capacity
        for n in reversed(left):
            if n <= gap:
                held.append(n)
                gap -= n
        free = list((Counter(left) - Counter(held)).elements())
        smallest = min(held)
        if gap:
            pairs = [(a + b) for i, a in enumerate(free) for b in free[i + 1 :] if smallest < a + b <= gap + smallest]
            if pairs:
                best = max(pairs)
                a = max(a for i, a in enumerate(sorted(free)) if best - a in Counter(free) - Counter([a]) or best - a in free[:i])
                held.remove(smallest)
                held += [a, best - a]
        bins.append(sorted(held))
        left = sorted((Counter(left) - Counter(held)).elements())
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=40))
def test_runs_hold_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=25)
    runs = packing.best_two_fit(counts, 24)
    held = Counter()
    for times, run in runs:
        assert times > 0 and sum(n * k for n, k in run.items()) <= 24
        for n, k in run.items():
            held[n] += times * k
    assert held == Counter(lengths)
    plain = one_by_one(lengths, 24)
    assert abs(sum(t for t, _ in runs) - len(plain)) <= max(1, len(plain) // 10)


def test_two_pieces_replace_the_smallest():
    """10 and 5 leave a gap of 1, nothing of length 1 is there; 3 and 3 fill what 5 and the gap take."""
    counts = np.bincount([10, 5, 3, 3], minlength=17)
    assert packing.best_two_fit(counts, 16) == [(1, {10: 1, 3: 2}), (1, {5: 1})]


def test_runs_are_few():
    """The table that goes to every task does not grow with the number of pieces."""
    rng = np.random.default_rng(3)
    shape = np.clip(rng.lognormal(5.5, 1.2, 200_000), 1, 4096).astype(int)
    counts = np.bincount(shape, minlength=4097)
    for scale in (1, 1000):
        runs = packing.best_two_fit(counts * scale, 4096)
        assert len(runs) < 4096 * 9.4
        assert sum(t for t, _ in runs) <= 1.001 * scale * int(shape.sum()) / 4096 + 1


def test_a_length_that_a_third_shares(spark):
    """Placing needs no sort by length, and copies by the thousand fill sequences of their own."""
    rows = [(i, "a b c" if i % 3 == 0 else " ".join("word" for _ in range(i % 90))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [r.asDict() for r in packing.place_pieces(packing.encode_pieces(docs, 128), 128).collect()]
    assert Counter((r["doc_id"], r["piece"]) for r in got) == Counter((r[0], r[1]) for r in pieces_brute(rows, 128))
    assert gapless(got, 128) <= 1.01 * sum(r["length"] for r in got) / 128 + 1
