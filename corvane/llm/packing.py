"""Packing token sequences: best-two-fit over the histogram of lengths.

Lengths are whole numbers up to the capacity, so how documents are packed is settled by how many pieces there are of each
length: at most ``capacity`` numbers, whatever the size of the corpus. The packing is worked out on those
(:func:`best_two_fit`), and Spark then deals the pieces of each length to the places made for that length:

1. Documents are encoded once, in the task that scans them; longer ones are cut. A task counts, for each length, which of its
   own pieces of that length a piece is.
2. Pieces are counted by (task, length); a running sum over tasks turns a piece's number within its task
   into its rank among all pieces of its length. No piece is sorted, whatever length is frequent.
3. A bin is filled greedily, longest piece first. If a gap is left, the bin's smallest piece comes out and the two unpacked
   pieces that fill the wider gap best go in, if they fill it better. The same bin is then made as often as the counts allow;
   that is what making one bin after the other would give, as its choices depend on the lengths left alone.
4. A rank is looked up among the runs of equal bins by binary search; it gives the sequence and the offset.

A length that limits a run has fewer pieces left than the bin holds of it, so it limits at most capacity / length runs:
there are at most capacity * (1 + ln capacity) runs, some 38,000 at 4,096, and a few of their lengths each. That table alone
goes to every task.

Edge cases: a null text is empty: one piece with only the end id. Null ids pack like others. Repeated rows are
pieces of their own; which of two equal rows comes first is open. An empty table gives an empty result. Extra columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.token_files import END_ID, TOKENIZER, _encoder
from corvane.storage import materialise

CAPACITY = 4096
#: Texts that are encoded together.
STEP = 256
_RANK_BITS = 44
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def _piece_maker(tokenizer: str, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        task = TaskContext.get().partitionId()
        end = np.array([end_id], encoder.kind)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                texts = batch.column(1).slice(i, STEP).fill_null("")
                docs = batch.column(0).slice(i, STEP)
                owner, piece, start, length, crc, nth, kept = [], [], [], [], [], [], []
                for at, raw in enumerate(encoder.encode(texts)):
                    ids = np.concatenate([np.frombuffer(raw, encoder.kind), end]).astype("<u4")
                    for k, s in enumerate(range(0, len(ids), capacity)):
                        part = ids[s : s + capacity]
                        n = len(part)
                        owner.append(at)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(part))
                        nth.append(int(seen[n]))
                        seen[n] += 1
                        if keep_ids:
                            kept.append(part.astype(np.int32))
                columns = [docs.take(pa.array(owner, pa.int32())), pa.array(piece, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                columns += [pa.array([task] * len(owner), pa.int32()), pa.array(nth, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                if keep_ids:
                    bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    values = np.concatenate(kept) if kept else np.empty(0, np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents, stored: (doc_id, piece, start, length, ids_crc32, task, nth), and their ids if
    ``keep_ids``. ``nth`` numbers the pieces of equal length within a task; being stored, it stays as it is when
    a task is repeated."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = PIECES + ", ids array<int>" * keep_ids
    return materialise(rows.mapInArrow(_piece_maker(tokenizer, end_id, capacity, keep_ids), schema), "packing-pieces")


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Runs of equal bins, as (number of bins, {length: pieces in a bin}), that hold ``counts[n]`` pieces of each
    length n."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    runs: list[tuple[int, dict[int, int]]] = []
    lengths = np.flatnonzero(left)
    while len(lengths):
        gap, held = capacity, {}
        at = len(lengths) - 1
        while at >= 0:
            n = int(lengths[at])
            take = min(gap // n, int(left[n]))
            if take:
                held[n] = take
                gap -= take * n
            at = min(at, int(np.searchsorted(lengths, gap, "right"))) - 1
        if gap:
            _swap_smallest(lengths, left, held, gap)
        times = min(int(left[n]) // k for n, k in held.items())
        for n, k in held.items():
            left[n] -= times * k
        runs.append((times, held))
        lengths = lengths[left[lengths] > 0]
    return runs


def _swap_smallest(lengths: np.ndarray, left: np.ndarray, held: dict[int, int], gap: int) -> None:
    """Put the two unpacked lengths that fill the gap without the bin's smallest piece best in its place, if they fill
    more than it did."""
    smallest = min(held)
    room = gap + smallest
    free = left[lengths]  # a copy
    for n, k in held.items():
        free[np.searchsorted(lengths, n)] -= k
    can = free > 0
    first, spare = lengths[can], free[can]
    if not len(first):
        return
    partner = np.searchsorted(first, room - first, "right") - 1
    # A length cannot be its own partner unless two of it are free; the next smaller one is.
    own = (partner == np.arange(len(first))) & (spare < 2)
    partner = partner - own
    sums = np.where(partner >= 0, first + first[np.maximum(partner, 0)], 0)
    best = int(np.argmax(sums))
    if sums[best] > smallest:
        held[smallest] -= 1
        if not held[smallest]:
            del held[smallest]
        for n in (int(first[best]), int(first[partner[best]])):
            held[n] = held.get(n, 0) + 1


def _places(runs: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length of each run: the key of the first rank that it takes, the run's first sequence, the pieces of this
    length in a bin, and where in the bin they begin. Sorted by key."""
    rows, base, taken = [], 0, {}
    for times, held in runs:
        offset = 0
        for n in sorted(held, reverse=True):
            rows.append(((n << _RANK_BITS) + taken.get(n, 0), base, held[n], offset))
            taken[n] = taken.get(n, 0) + times * held[n]
            offset += n * held[n]
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("key", "base", "each", "offset"), table.T.copy(), strict=True))


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add (sequence_id, offset) to stored pieces. ``pieces`` has (task, length, nth): ``nth`` counts from 0 the pieces of
    a length within a task. Lengths are from 1 to ``capacity``."""
    spark = pieces.sparkSession
    counts = materialise(pieces.groupBy("task", "length").agg(F.count("*").alias("pieces")), "packing-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for n, k in counts.groupBy("length").agg(F.sum("pieces")).collect():  # at most one row a length
        histogram[n] = k
    places = spark.sparkContext.broadcast(_places(best_two_fit(histogram, capacity)))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def placed(length, rank):
        import pandas as pd

        at, n, r = places.value, length.to_numpy(), rank.to_numpy()
        row = np.searchsorted(at["key"], (n << _RANK_BITS) + r, "right") - 1
        inside = r - (at["key"][row] - (n << _RANK_BITS))
        each = at["each"][row]
        return pd.DataFrame(
            {"sequence_id": at["base"][row] + inside // each, "offset": at["offset"][row] + inside % each * n}
        )

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"])
    found = ranked.withColumn("place", placed("length", F.col("base") + F.col("nth")))
    return found.select(*pieces.columns, "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **encoding) -> DataFrame:
    """The sequences to train on: (sequence_id, ids, pieces), ``ids`` with at most ``capacity`` ids and ``pieces`` their
    spans (offset, doc_id, piece, start, length) in order. A sequence holds at most ``capacity`` pieces."""
    placed = place_pieces(encode_pieces(docs, capacity, keep_ids=True, **encoding), capacity)
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))
    grouped = placed.groupBy("sequence_id").agg(held.alias("held"))
    spans = F.transform("held", lambda h: F.struct(*(h[c].alias(c) for c in ("offset", "doc_id", "piece", "start", "length"))))
    return grouped.select("sequence_id", F.flatten("held.ids").alias("ids"), spans.alias("pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    placed = place_pieces(encode_pieces(docs))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: SQL has no tokenizer; tests/llm holds the query against the tokenizers library and a plain packing.
ORACLE_SQL = None
