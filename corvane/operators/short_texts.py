"""Pairs of short texts that may be near, of all pairs of a group, in blocks.

Rare pieces rule out little where texts are short or made of few syllables: most of the pieces that near ones must share are
frequent. For texts of up to ``WORD`` characters it is cheaper to look at all pairs of a group by bits. Blocks of about
``BLOCK`` texts meet in tasks of their own; a task holds two blocks. Two bounds of the Ratcliff-Obershelp ratio leave few pairs:

1. Characters in common, by a unary code of their counts: one ``AND`` and one population count of four words a pair. Counts
   beyond the code are added up in one number, whose lesser is added.
2. The longest common subsequence, bit by bit in one word, of what is left.

Neither loses a pair: matching blocks are a common subsequence, which has its characters in common. Characters beyond a-z and 0-9
share a few numbers, which only lets more pairs through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.storage import materialise

#: Characters of the shorter text of a pair at most, and of the longer one at a ratio of 0.9.
WORD, LONGER = 64, 78
#: Texts of a block, about.
BLOCK = 1 << 13
#: Numbers of characters (the last one is no character), and how often one counts in the code.
KINDS, TIMES = 42, 6
#: Pairs that are passed on as they are, and rows and pairs that are looked at together.
_FEW, _ROWS, _PAIRS = 64, 32, 1 << 17


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and a matrix of the numbers of characters, filled up with ``KINDS``."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = 36 + points % (KINDS - 36)
    for first, last, at in ((48, 57, 0), (97, 122, 10)):
        here = (points >= first) & (points <= last)
        kinds[here] = points[here] - first + at
    codes = np.full((len(texts), int(sizes.max(initial=0))), KINDS, np.uint8)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = kinds
    return sizes, codes


class Block:
    """Texts by length, with the bits that both bounds need."""

    def __init__(self, ids: np.ndarray, texts: list[str]) -> None:
        order = np.argsort(np.fromiter(map(len, texts), np.int64, len(texts)), kind="stable")
        self.ids = ids[order]
        self.sizes, self.codes = _codes([texts[i] for i in order])
        n, width = self.codes.shape
        row = np.repeat(np.arange(n), width)
        counts = np.bincount(row * (KINDS + 1) + self.codes.ravel(), minlength=n * (KINDS + 1)).reshape(n, KINDS + 1)[:, :KINDS]
        unary = np.zeros((n, 256), bool)
        unary[:, : KINDS * TIMES] = (counts[:, :, None] > np.arange(TIMES)).reshape(n, -1)
        self.bits = np.packbits(unary, axis=1).view(np.uint64).T.copy()
        self.beyond = np.maximum(counts - TIMES, 0).sum(1)
        self.masks = np.zeros((n, KINDS + 1), np.uint64)
        for i in range(min(width, WORD)):
            self.masks[np.arange(n), self.codes[:, i]] |= np.uint64(1 << i)
        self.masks[:, KINDS] = 0


def _subsequence(short: Block, i: np.ndarray, long: Block, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of texts ``i`` of up to WORD characters and texts ``j``."""
    row = np.full(len(i), ~np.uint64(0))
    for k in range(int(long.sizes[j].max(initial=0))):
        met = row & short.masks[i, long.codes[j, k]]
        row = (row + met) | (row - met)
    size = short.sizes[i].astype(np.uint64)
    inside = ~np.uint64(0) >> (np.uint64(64) - np.maximum(size, np.uint64(1)))
    return np.where(size > 0, np.bitwise_count(~row & inside), 0)


def possible(a: Block, b: Block, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of pairs whose bounds reach ``least``; each pair once where both blocks are the same."""
    whole = np.arange(2 * LONGER + 1)
    ratio = lambda common: 2.0 * common / np.maximum(whole, 1)
    # The least number of common characters that is enough, by the length of both.
    need = np.array([next((m for m in range(t // 2 + 1) if t == 0 or ratio(m)[t] >= least), t) for t in whole])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(a.ids), _ROWS):
        rows = np.arange(start, min(start + _ROWS, len(a.ids)))
        lo = start + 1 if same else 0
        low, high = a.sizes[rows[0]], a.sizes[rows[-1]]
        # Of lengths beyond these the shorter one is not enough.
        lo = max(lo, int(np.searchsorted(b.sizes, int(low * least / (2 - least)))))
        hi = int(np.searchsorted(b.sizes, int(high * (2 - least) / least) + 1, "right"))
        if lo >= hi:
            continue
        common = np.minimum.outer(a.beyond[rows], b.beyond[lo:hi]).astype(np.int16)
        for word_a, word_b in zip(a.bits, b.bits, strict=True):
            common += np.bitwise_count(word_a[rows, None] & word_b[None, lo:hi])
        enough = common >= need[a.sizes[rows, None] + b.sizes[None, lo:hi]]
        i, j = np.nonzero(enough)
        i, j = i + start, j + lo
        fits = np.minimum(a.sizes[i], b.sizes[j]) <= WORD
        if same:
            fits &= i < j
        held.append((i[fits], j[fits]))
        if sum(len(x) for x, _ in held) >= _PAIRS:
            yield _checked(a, b, held, need)
            held = []
    if held:
        yield _checked(a, b, held, need)


def _checked(a: Block, b: Block, held: list[tuple[np.ndarray, np.ndarray]], need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = (np.concatenate(x) for x in zip(*held, strict=True))
    kept = np.zeros(len(i), bool)
    first = a.sizes[i] <= WORD
    for here, (short, s, long, t) in ((first, (a, i, b, j)), (~first, (b, j, a, i))):
        for at in np.array_split(np.flatnonzero(here), max(1, here.sum() // _PAIRS)):
            kept[at] = _subsequence(short, s[at], long, t[at]) >= need[a.sizes[i[at]] + b.sizes[j[at]]]
    return a.ids[i[kept]], b.ids[j[kept]]


def possible_pairs(texts: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """(a, b): ids of all pairs of short ``texts`` (id long, g, text) in linked groups that may be near, each pair once.

    ``links`` (ga, gb) has each pair of different groups once, and a group with itself. Only pairs are looked at whose shorter
    text has up to ``WORD`` characters. ``least`` is 0.9 or more."""
    short = texts.filter(F.length("text") <= LONGER)
    # One group of BLOCK rows or more in each BLOCK rows at most.
    large = short.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    number = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))
    numbered = short.join(F.broadcast(large), "g", "left").select("g", F.coalesce(number, F.lit(0)).alias("block"), "id", "text")
    blocks = materialise(numbered.groupBy("g", "block").agg(F.collect_list(F.struct("id", "text")).alias("rows")), "short-blocks")
    keys = blocks.select("g", "block", F.size("rows").alias("n"))
    side = lambda rows, s: rows.select(*[F.col(c).alias(f"{c}{s}") for c in rows.columns])
    own = F.col("ga") == F.col("gb")
    met = links.join(side(keys, "a"), "ga").join(side(keys, "b"), "gb")
    met = met.filter(~own | (F.col("blocka") < F.col("blockb")) | ((F.col("blocka") == F.col("blockb")) & (F.col("na") > 1)))
    both = met.drop("na", "nb").join(side(blocks, "a"), ["ga", "blocka"]).join(side(blocks, "b"), ["gb", "blockb"])
    dealt = both.repartition("ga", "blocka", "gb", "blockb")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        few: list[np.ndarray] = []
        for batch in batches:
            for k, same in enumerate(batch.column("same").to_pylist()):
                a, b = (batch.column(c)[k].values for c in ("rowsa", "rowsb"))
                x, y = a.field("id").to_numpy(), b.field("id").to_numpy()
                if len(a) * len(b) <= _FEW:
                    i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
                    kept = i < j if same else i >= 0
                    few.append(np.stack([x[i[kept]], y[j[kept]]]))
                    continue
                one = Block(x, a.field("text").to_pylist())
                for found in possible(one, one if same else Block(y, b.field("text").to_pylist()), same, least):
                    yield out(*found)
            if few:
                yield out(*np.concatenate(few, axis=1))
                few = []

    same = own & (F.col("blocka") == F.col("blockb"))
    return dealt.select("rowsa", "rowsb", same.alias("same")).mapInArrow(find, "a long, b long")
