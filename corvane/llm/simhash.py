"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within the radius of 3 differ in at most 3 of 64 bits. The radius is odd, so it does
not halve evenly; the bits are therefore cut into thirds, and one third is left out at a time. If two
fingerprints are within 3, one third holds at least one of the differing bits (or none differ), and
without it they are within 2. Each fingerprint emits, for each third left out, all variants of the
other bits within half of that radius: the bits themselves and every single flip, 132 variants in
all. Both emit the variant that lies half way between them. Variants are shuffled; those that only
one fingerprint emitted end there. Candidates are verified on all 64 bits, so no link is lost or made up.

Copies share a fingerprint, and fingerprints are made distinct first, so a group of copies, however
large, is one row here. A variant of two fingerprints is verified by itself. The few of more are sorted
into runs and verified in blocks, each run giving edges that span it (at most one less than it has
members), never all pairs. Runs longer than ``block`` are dealt out by pairs of blocks.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like any other. Fewer
than three words make one shingle of what there is. Repeated rows fall in one component; rows that share an id but
not a text are documents of their own. Null ids never become a component's id unless it has no other.
:func:`keep_representatives` keeps exactly one row of each component, all its columns. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.components import connected_components
from corvane.storage import materialise

RADIUS = 3
SEED = 42
#: Bits of each third: 22, 21 and 21.
THIRDS = (((1 << 22) - 1), ((1 << 21) - 1) << 22, ((1 << 21) - 1) << 43)
#: Hashes of one text that are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the 3-word shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= 3:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - 2].tolist()
    ends = ends[2:].tolist()
    total = n - 2
    counts = np.zeros(64, np.int64)
    for i in range(0, total, CHUNK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0]
    return int(value)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        values = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values)], names=[*batch.schema.names[:-1], "fp"])
    pa.default_memory_pool().release_unused()  # a worker waits for other tasks with what it holds


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns (id_col, th, fp): a hash of each row's text, and its fingerprint as a signed 64-bit number."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(_fingerprints, f"id {kind}, th long, fp long").withColumnRenamed("id", id_col)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def ball_variants(fps: DataFrame) -> DataFrame:
    """Rows (variant, fp): for each third left out, the other bits and each of their single flips."""
    balls = []
    for third in THIRDS:
        mask = ~third & ((1 << 64) - 1)
        flips = [0] + [1 << i for i in range(64) if mask >> i & 1]
        # The third left out holds its number, so that variants of different thirds differ.
        tag = (third & -third) * (1 + THIRDS.index(third))
        balls += [(_signed(mask), _signed(flip | tag)) for flip in flips]
    pairs = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(x).cast("long").alias("mark")) for m, x in balls])
    exploded = fps.select("fp", F.explode(pairs).alias("v"))
    return exploded.select(F.col("fp").bitwiseAND(F.col("v.mask")).bitwiseXOR(F.col("v.mark")).alias("variant"), "fp")


def _span(fps: np.ndarray, radius: int, step: int = 512) -> list[tuple[int, int]]:
    """Edges that join exactly the fingerprints joined by links within ``radius``: a spanning forest."""
    n = len(fps)
    root = np.arange(n)
    edges = []
    for i in range(0, n, step):
        left = fps[i : i + step]
        for j in range(i, n, step):
            near = np.bitwise_count(left[:, None] ^ fps[None, j : j + step]) <= radius
            for x, y in zip(*np.nonzero(near), strict=True):
                x, y = x + i, y + j
                if x < y and root[x] != root[y]:
                    edges.append((int(fps[x]), int(fps[y])))
                    root[root == root[y]] = root[x]
            if (root == root[0]).all():
                return edges
    return edges


def _edges_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (variant, lo, hi): edges within each run of equal keys."""
    held: list[np.ndarray] = []
    key: tuple | None = None
    out: set[tuple[int, int]] = set()

    def close() -> None:
        if held:
            fps = np.unique(np.concatenate(held))
            out.update(_span(fps.view(np.uint64), RADIUS))

    def flush() -> pa.RecordBatch:
        both = np.array(sorted(out), np.uint64).reshape(-1, 2).view(np.int64)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        keys = np.stack(columns[:3], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            this = tuple(keys[start])
            if this != key:
                close()
                held, key = [], this
            held.append(columns[3][start:stop])
        if len(out) > 100_000:
            yield flush()
    close()
    yield flush()


def near_fingerprint_edges(fps: DataFrame, block: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp): enough of the links within the radius to join
    all that links join. Every link lies in some run, and each run's edges span its links."""
    # One exchange of all variants; what two or more fingerprints emit is kept, all else ends here.
    number = F.count("*").over(Window.partitionBy("variant"))
    shared = materialise(
        ball_variants(fps).repartition(F.col("variant")).withColumn("n", number).filter("n > 1"), "simhash-shared"
    )
    ends = shared.filter("n = 2").groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    twos = ends.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    members = shared.filter("n > 2").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own).select(
        "variant", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "fp"
    )
    runs = dealt.select("variant", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    spread = runs.repartition("variant", "lo", "hi").sortWithinPartitions("variant", "lo", "hi")
    return twos.union(spread.mapInArrow(_edges_of_runs, "a long, b long"))


def _rooted(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id_col, th, fp) of each row of ``docs``, and (fp, head, root) of each fingerprint: the smallest id that has
    it and the component that it is in."""
    marked = materialise(fingerprint_documents(docs, id_col, text), "simhash-fps")
    heads = materialise(marked.groupBy("fp").agg(F.min(id_col).alias("head")), "simhash-heads")
    # A table of fingerprints is small in bytes and large in variants: dealt out before it is exploded.
    dealt = heads.select("fp").repartition(docs.sparkSession.sparkContext.defaultParallelism * 4, "fp")
    nodes = materialise(
        connected_components(near_fingerprint_edges(dealt)).select(
            F.col("node").alias("fp"), F.col("component").alias("root")
        ),
        "simhash-nodes",
    )
    return marked, heads.join(nodes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns (id_col, fp, component_id), one row for each row of ``docs``."""
    marked, rooted = _rooted(docs, id_col, text)
    least = rooted.groupBy("root").agg(F.min("head").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(id_col, "fp", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component; all columns stay. It is a row of the smallest id (nulls last) and,
    among rows of this id in this component, of the smallest text hash."""
    marked, rooted = _rooted(docs, id_col, text)
    members = marked.join(rooted.select("fp", "root"), "fp").select(F.col(id_col).alias("id"), "th", "root")
    return keep_heads(docs, members, id_col, text)


def keep_heads(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``members`` (id, th, root), which holds the id and the text hash of
    every row. Rows are told apart by both, so an id that repeats or is null stands for no other text. Where rows
    equal in both remain, the one with the smallest hash of all its columns stays: an aggregate, combined before
    the shuffle, over these rows alone."""
    rows = members.groupBy("root", "id", "th").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "n")).alias("head"))
    kept = first.select(F.struct("head.id").alias("__id"), F.col("head.th").alias("__th"), F.col("head.n").alias("__n"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    keyed = keyed.withColumns({"__id": F.struct(F.col(f"__row.`{id_col}`").alias("id")), "__th": F.xxhash64(F.col(f"__row.`{text}`"))})
    found = keyed.join(kept, ["__id", "__th"])
    hashable = [f"__row.`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    single = found.filter("__n = 1").select("__row.*")
    equal = found.filter("__n > 1").groupBy("__id", "__th").agg(F.min_by("__row", F.xxhash64(*hashable)).alias("__row"))
    return single.union(equal.select("__row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = simhash_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: DuckDB has no XXH64; tests/llm holds the query against a brute-force version.
ORACLE_SQL = None
