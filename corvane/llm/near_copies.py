"""Near copies by the overlap of their word shingles, for the pipeline.

Two texts are linked if the Jaccard index of their sets of 5-word shingles is 0.8 or more. At this index
64-bit SimHashes differ in about 10 bits, far beyond the radius that balls can search, so candidates come from
MinHash: ``BANDS`` bands of ``ROWS`` minima each, of which a pair at 0.8 shares one with a probability of
1 - (1 - 0.8**5)**20 = 0.9996. Every candidate is verified on the whole sets, so no link is made up.

Texts of one set of shingles are one row here, so a group of copies, however large, is no group. In each run of
rows that share a band, all are first verified against the smallest, in distinct pairs. Runs that this
joins end there; the others are verified pair by pair inside a task, dealt out by pairs of blocks.

:func:`keep_distinct` links texts by this rule and, as operator 8 does, by fingerprints within its radius.

Edge cases: null, empty and blank texts have the empty set and are linked like any other. Fewer than five words
make one shingle of what there is. Rows are told apart by id and text, so repeated and null ids lose no text; a row
without an id stays only if its component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import simhash
from corvane.llm.substrings import rolling, word_hashes
from corvane.operators.components import connected_components
from corvane.storage import materialise

WIDTH = 5
#: Least Jaccard index, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 20, 5
_DRAW = np.random.default_rng(20)
_TIMES = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
#: Shingles of one text that are counted at a time.
CHUNK = 1 << 12


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct 5-word shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = word_hashes(b" ".join(words), starts, ends)
    return np.unique(rolling(h, min(WIDTH, len(words))) ^ np.uint64(min(WIDTH, len(words))))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of minima; equal sets have equal keys."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), CHUNK):
        least = np.minimum(least, ((hashes[i : i + CHUNK] ^ _FLIP[:, None]) * _TIMES[:, None]).min(axis=1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64)


def _digest(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), simhash.SEED)).view(np.int64))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, sets, keys = [], [], []
        for text in batch.column(2):
            text = text.as_py()
            hashes = shingle_set(text)
            fps.append(simhash.fingerprint(text))
            sets.append(_digest(hashes))
            keys.append(bands(hashes).view(np.int64))
        made = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sets, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "th", "fp", "set", "bands"])
    pa.default_memory_pool().release_unused()  # a worker waits for other tasks with what it holds


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [shingle_set(t.as_py()) for t in batch.column(0)]
        names = pa.array([_digest(r) for r in rows], pa.int64())
        hashes = pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([names, hashes], names=["set", "hashes"])
    pa.default_memory_pool().release_unused()


def span(names: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join exactly the sets joined by links: a spanning forest. Each set is sorted."""
    up, down = LEAST
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(rest, sizes)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            alive = np.zeros(len(sets), bool)
            alive[rest] = True
            of = alive[owner]
            flat, owner = flat[of], owner[of]
            at = np.searchsorted(sets[here], flat)
            at[at == len(sets[here])] = 0
            same = sets[here][at] == flat if len(sets[here]) else np.zeros(len(flat), bool)
            shared = np.bincount(owner[same], minlength=len(sets))[rest]
            near = shared * (up + down) >= up * (sizes[rest] + len(sets[here]))
            found = rest[near].tolist()
            edges += [(names[here], names[i]) for i in found]
            queue += found
            rest = rest[~near]
    return edges


def _edges_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, lo, hi, set, hashes), sorted by the first three: edges within each run of equal keys."""
    held: dict[int, np.ndarray] = {}
    key: tuple | None = None

    def close() -> pa.RecordBatch:
        edges = np.array(span(list(held), list(held.values())), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    for batch in batches:
        run, lo, hi, name = (batch.column(i).to_pylist() for i in range(4))
        for i, this in enumerate(zip(run, lo, hi, strict=True)):
            if this != key:
                yield close()
                held, key = {}, this
            held[name[i]] = batch.column(4)[i].values.to_numpy().view(np.uint64)
    yield close()


def overlap_edges(heads: DataFrame, docs: DataFrame, text: str, block: int = 1024, id_col: str | None = None) -> DataFrame:
    """Edges (a, b) between the sets of ``heads`` (set, th, bands): enough of the links found to join all that they
    join. ``th`` is the hash of a text in ``docs`` that has the set. With ``id_col``, ``heads`` has the ``id`` of one such
    row, too, and a text's other copies stay where they are: they are no hot key."""
    up, down = LEAST
    exploded = heads.select("set", F.posexplode("bands").alias("band", "key"))
    marks = F.sum(F.xxhash64("set").bitwiseAND(F.lit((1 << 40) - 1)))
    # Runs of the same members in several bands are one run.
    runs = exploded.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("set").alias("least"), marks.alias("run"))
    members = exploded.join(runs.filter("n > 1"), ["band", "key"]).select("run", "n", "least", "set").distinct()
    shared = materialise(members, "overlap-shared")
    wanted = heads.join(shared.select("set").distinct(), "set", "left_semi").alias("w")
    rows = docs.select(F.col(id_col or text).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).alias("r")
    same = F.col("r.th") == F.col("w.th")
    if id_col:
        same &= F.col("r.id").eqNullSafe(F.col("w.id"))
    texts = rows.join(wanted, same, "left_semi").groupBy("th").agg(F.any_value("text").alias("text")).select("text")
    sets = materialise(texts.mapInArrow(_sets, "set long, hashes array<long>").dropDuplicates(["set"]), "overlap-sets")

    pairs = shared.filter("set <> least").select(F.col("least").alias("a"), F.col("set").alias("b")).distinct()
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    linked = F.size(F.array_intersect("x", "y")) * (up + down) >= (F.size("x") + F.size("y")) * up
    stars = materialise(both.filter(linked).select("a", "b"), "overlap-stars")

    joined = connected_components(stars).select(F.col("node").alias("set"), "component")
    many = shared.filter("n > 2").join(joined, "set", "left").withColumn("component", F.coalesce("component", "set"))
    open_runs = many.groupBy("run", "n").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    rest = many.join(open_runs.select("run", "n"), ["run", "n"], "left_semi").withColumn(
        "blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")
    )
    own = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    dealt = rest.select("run", "set", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    ends = dealt.select("run", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "set")
    spread = ends.join(sets, "set").select("run", "lo", "hi", "set", "hashes")
    spread = spread.repartition("run", "lo", "hi").sortWithinPartitions("run", "lo", "hi")
    return stars.union(spread.mapInArrow(_edges_of_runs, "a long, b long"))


def near_copy_members(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns (id, th, root), one row for each row of ``docs``: its id, the hash of its text, and a name of the
    component, by both kinds of links, that it is in."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    marked = materialise(rows.mapInArrow(_marks, f"id {kind}, th long, fp long, set long, bands array<long>"), "overlap-marks")
    heads = materialise(
        marked.groupBy("set")
        .agg(F.min(F.struct("th", "id")).alias("one"), F.any_value("bands").alias("bands"))
        .select("set", "one.id", "one.th", "bands"),
        "overlap-heads",
    )
    # One set stands for all of a fingerprint; links between fingerprints are links between these.
    fps = marked.select("fp", "set").distinct()
    first = materialise(fps.groupBy("fp").agg(F.min("set").alias("first")), "overlap-fps")
    same = fps.join(first, "fp").filter("set <> first").select(F.col("set").alias("a"), F.col("first").alias("b"))
    dealt = first.select("fp").repartition(docs.sparkSession.sparkContext.defaultParallelism * 4, "fp")
    near = simhash.near_fingerprint_edges(dealt)
    near = near.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select("x", "y")
    edges = same.union(near).union(overlap_edges(heads, docs, text, id_col=id_col))
    nodes = materialise(
        connected_components(edges).select(F.col("node").alias("set"), F.col("component").alias("root")), "overlap-nodes"
    )
    joined = marked.select("id", "th", "set").join(nodes, "set", "left")
    return joined.select("id", "th", F.coalesce("root", "set").alias("root"))


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, that of its smallest id; all columns stay."""
    return simhash.keep_heads(docs, near_copy_members(docs, id_col, text), id_col, text)
