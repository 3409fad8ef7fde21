"""Hard-negative mining by dual-tree search.

For every anchor the nearest rows of its own label are its positives; for each positive, the best rows of other labels
whose score lies within a share of the positive's are the hard negatives. Scores are exact inner products of whole numbers.

* **Trees.** A tree of splits along principal directions is fitted on a bounded sample (:data:`SAMPLE` rows) of the candidates, another on
  one of the anchors. Every row is routed to a leaf; the rows of one leaf and label make *blocks* of bounded size, cut by
  number, so equal vectors, a hot label or a third of all rows in one leaf make more blocks and not larger ones. Each
  node's ball (the sample's centre, and the largest distance of any row below it) is measured over all rows.
* **Pruning.** A group of anchors descends the candidates' tree and halves itself on its way: for two balls the inner product
  lies within ``c1.c2 +- (|c1| r2 + |c2| r1 + r1 r2)``. A pair of nodes whose interval misses what every anchor below still wants
  is dropped with all its anchors. What an anchor wants is an interval of scores for each of its searches (one for positives; one
  for each positive for negatives), whose lower end rises to the worst of its best so far.
* **Leaf pairs** become pairs of a group and a block. A block meets a bounded chunk of groups in a task, leaves out anchors
  whose interval with the block's own ball misses, and scores the others exactly in one matrix product.
* Each search visits each group's most promising leaves first, raises the lower ends, and then visits the
  rest that is still wanted. Nothing is dropped but what a bound rules out, so results are exact; on vectors without any clusters
  bounds rule out little and the work is that of all anchors against all rows, in blocks.

Edge cases: rows with a null label, a null vector, or a null, NaN or infinite component take no part. Shorter vectors are
filled up with zeros. Components beyond what lets scores fit a long are clamped to it. Rows with equal ids are rows of
their own; a row is never its own positive, but a repeated row is one for its twin. Null ids take part, sort last, and are
never anchors. Rows that tie in score and id are interchangeable. An anchor without positives, and a positive without
negatives, give no row. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.storage import materialise

#: Rows that a tree is fitted on; rows that a leaf should hold; leaves at most (and so nodes in a task's closure).
SAMPLE, LEAF_ROWS, MAX_LEAVES = 1 << 14, 8192, 2048
#: Rows of a block and of a group of anchors, if vectors have 64 components; fewer if more.
BLOCK_ROWS, GROUP_ROWS = 4096, 256
#: Groups that meet a block in one task; leaves that a group visits before the others; anchors that are not halved further.
CHUNK, FIRST_LEAVES, FEW = 16, 2, 16
_LOW, _HIGH, _LAST_ID = -(1 << 62), 1 << 62, (1 << 63) - 1
_EXACT = 1 << 53


# Trees


@dataclass
class Tree:
    """Splits in order of making; a child of -1-i is leaf i. ``centre`` has a row for each split, then for each leaf."""

    direction: np.ndarray
    threshold: np.ndarray
    children: np.ndarray
    centre: np.ndarray
    n_leaves: int

    def route(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(rows), np.int64) if len(self.children) else np.full(len(rows), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            right = np.einsum("ij,ij->i", rows[inner], self.direction[n]) > self.threshold[n]
            at[inner] = self.children[n, right.astype(int)]
        return -1 - at

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, leaves) as arrays: which leaf lies below which node. Node i is split i; node n_splits + j is leaf j."""
        n_splits, node, leaf = len(self.children), [], []
        for j in range(self.n_leaves):
            node.append(n_splits + j)
            leaf.append(j)
        above = {(-1 - c if c < 0 else c, c < 0): i for i in range(n_splits) for c in self.children[i].tolist()}
        for j in range(self.n_leaves):
            at = above.get((j, True))
            while at is not None:
                node.append(at)
                leaf.append(j)
                at = above.get((at, False))
        return np.array(node), np.array(leaf)


def fit_tree(sample: np.ndarray, leaves: int) -> Tree:
    """Halve the largest node at the median of its main direction until there are ``leaves`` leaves or nothing to part."""
    direction, threshold, children, centres = [], [], [], []
    open_nodes = [(np.arange(len(sample)), None)]
    done: list[tuple[np.ndarray, tuple[int, int] | None]] = []
    while open_nodes and len(open_nodes) + len(done) < leaves:
        open_nodes.sort(key=lambda x: len(x[0]))
        rows, slot = open_nodes.pop()
        x = sample[rows]
        centre = x.mean(0) if len(x) else np.zeros(sample.shape[1])
        if len(x) < 2:
            done.append((rows, slot))
            continue
        axis = x[int(np.argmax(((x - centre) ** 2).sum(1)))] - centre
        for _ in range(4):  # a few power steps find the main direction well enough
            axis = (x - centre).T @ ((x - centre) @ axis)
            axis /= np.linalg.norm(axis) or 1
        at = x @ axis
        cut = float(np.median(at))
        right = at > cut
        if right.all() or not right.any():
            done.append((rows, slot))
            continue
        number = len(children)
        direction.append(axis)
        threshold.append(cut)
        children.append([0, 0])
        centres.append(centre)
        if slot:
            children[slot[0]][slot[1]] = number
        open_nodes += [(rows[~right], (number, 0)), (rows[right], (number, 1))]
    last = done + open_nodes
    for j, (_, slot) in enumerate(last):
        if slot:
            children[slot[0]][slot[1]] = -1 - j
    width = sample.shape[1]
    middles = [sample[r].mean(0) if len(r) else np.zeros(width) for r, _ in last]
    return Tree(
        np.array(direction).reshape(-1, width),
        np.array(threshold),
        np.array(children, np.int64).reshape(-1, 2),
        np.array(centres + middles).reshape(-1, width),
        len(last),
    )


# Rows, blocks and groups


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix, short ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    if len(column) and ((ends[1:] - ends[:-1]) == width).all():
        return values[ends[0] : ends[-1]].reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    for i, (s, e) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
        out[i, : e - s] = values[s:e]
    return out


def usable_rows(rows: DataFrame, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(uid, vec_id, label, vec) of the rows that take part, stored; vec has the components' floors of ``scale`` times
    their value."""
    parts = F.col(vector).cast("array<double>")
    sound = F.forall(parts, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    taken = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(sound)
    most = taken.agg(F.max(F.size(vector))).first()[0] or 1
    bound = float(math.isqrt((1 << 61) // most))
    whole = F.transform(parts, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(bound)), F.lit(-bound))).cast("long"))
    picked = taken.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole.alias("vec"))
    return materialise(picked.withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")


def _fit(rows: DataFrame, n: int, leaf_rows: int, width: int) -> Tree:
    """A tree on a sample of bounded size; which rows it holds bears on speed alone."""
    share = min(1.0, 1.2 * SAMPLE / max(1, n))
    sample = rows if share == 1.0 else rows.sample(share, 7)
    picked = sample.select("vec").limit(SAMPLE).toArrow().column("vec")
    leaves = min(MAX_LEAVES, math.ceil(n / leaf_rows))
    return fit_tree(_matrix(picked, width).astype(float), leaves)


def _router(tree: Tree, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.route(_matrix(batch.column("vec"), width).astype(float))
            yield batch.append_column("leaf", pa.array(leaf, pa.int32()))

    return run


def _measurer(tree: Tree, width: int):
    """The largest distance of the task's rows from the centre of each node above them."""
    nodes, leaves = tree.spans()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius = np.full(len(tree.centre), -1.0)
        for batch in batches:
            rows = _matrix(batch.column("vec"), width).astype(float)
            at = batch.column("leaf").to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            starts = np.searchsorted(at[order], np.arange(tree.n_leaves + 1))
            for node, leaf in zip(nodes.tolist(), leaves.tolist()):
                mine = order[starts[leaf] : starts[leaf + 1]]
                if len(mine):
                    far = np.linalg.norm(rows[mine] - tree.centre[node], axis=1).max()
                    radius[node] = max(radius[node], far)
        held = np.flatnonzero(radius >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(radius[held])], names=["node", "radius"])

    return run


def _packer(width: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        rows = _matrix(table.column("vec"), width)
        centre = rows.mean(0)
        radius = float(np.linalg.norm(rows - centre, axis=1).max())
        ids = table.column("vec_id").fill_null(_LAST_ID).to_numpy()
        cells = [np.ascontiguousarray(x).tobytes() for x in (ids, table.column("uid").to_numpy(), rows, centre)]
        names = ["leaf", "label", "part", "ids", "uids", "rows", "centre", "radius", "n"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.float64(), pa.int64()]
        values = [*(k.as_py() for k in key), *cells, radius, len(rows)]
        return pa.table([pa.array([v], kind) for v, kind in zip(values, kinds)], names=names)

    return pack


_BLOCK = "leaf int, label long, part long, ids binary, uids binary, rows binary, centre binary, radius double, n long"


def _blocks(routed: DataFrame, most: int, width: int, name: str) -> DataFrame:
    """One row for each block: at most about ``most`` rows of one leaf and label, dealt by number."""
    parts = routed.groupBy("leaf", "label").agg(F.ceil(F.count("*") / most).alias("parts"))
    dealt = routed.join(parts, ["leaf", "label"]).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")))
    packed = dealt.groupBy("leaf", "label", "part").applyInArrow(_packer(width), _BLOCK)
    return materialise(packed.withColumn("key", F.monotonically_increasing_id()), name)


# Search


def _ends(cell: bytes, n: int) -> np.ndarray:
    """An array of scores, with a row for each anchor and a column for each of its searches."""
    return np.frombuffer(cell, np.int64).reshape(n, -1)


def _wanted(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which rows have a search whose interval meets [least, most]; rounding is allowed for."""
    slack = 1 + 1e-9 * np.maximum(np.abs(least), np.abs(most))
    return ((low <= (most + slack)[:, None]) & (high >= (least - slack)[:, None]) & (low <= high)).any(1)


class Descent:
    """Descends a tree with a group of anchors."""

    def __init__(self, tree: Tree, radius: np.ndarray) -> None:
        self.children, self.centre, self.radius = tree.children, tree.centre, radius
        self.splits, self.norm = len(tree.children), np.linalg.norm(tree.centre, axis=1)

    def leaves(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> set[int]:
        """The leaves that some anchor still wants."""
        found: set[int] = set()
        stack = [(0, np.arange(len(rows)))]
        while stack:
            node, mine = stack.pop()
            if self.radius[node] < 0 or (node >= self.splits and node - self.splits in found):
                continue
            x = rows[mine]
            centre = x.mean(0)
            r = np.linalg.norm(x - centre, axis=1).max()
            product = centre @ self.centre[node]
            reach = np.linalg.norm(centre) * self.radius[node] + self.norm[node] * r + r * self.radius[node]
            wants = low[mine] <= high[mine]
            if not wants.any():
                continue
            lowest, highest = low[mine][wants].min(), high[mine][wants].max()
            slack = 1 + 1e-9 * (abs(product) + reach)
            if product + reach + slack < lowest or product - reach - slack > highest:
                continue
            if len(mine) > FEW:
                along = (x - centre) @ (x[int(np.argmax(((x - centre) ** 2).sum(1)))] - centre)
                order = np.argsort(along, kind="stable")
                stack += [(node, mine[half]) for half in np.array_split(order, 2)]
                continue
            near, far = x @ self.centre[node], np.linalg.norm(x, axis=1) * self.radius[node]
            still = mine[_wanted(low[mine], high[mine], near - far, near + far)]
            if not len(still):
                continue
            if node >= self.splits:
                found.add(node - self.splits)
            else:
                stack += [(c if c >= 0 else self.splits - 1 - c, still) for c in self.children[node].tolist()]
        return found

    def best(self, rows: np.ndarray, high: np.ndarray) -> list[int]:
        """The leaves that promise most: whose centres score highest with the group's, without passing what it wants."""
        at = self.centre[self.splits :] @ rows.mean(0)
        top = high.max() if high.size else 0
        there = self.radius[self.splits :] >= 0
        order = np.lexsort((-at, at > top, ~there))
        return [int(j) for j in order[:FIRST_LEAVES] if there[j]]


def _visitor(tree: Tree, radius: np.ndarray, width: int, first: bool):
    """Adds the leaves that each group is to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        descent = Descent(tree, radius)
        for batch in batches:
            visits = []
            for row in batch.select(["rows", "n", "low", "high", "seen"]).to_pylist():
                rows = np.frombuffer(row["rows"], np.int64).reshape(row["n"], width).astype(float)
                low, high = _ends(row["low"], row["n"]), _ends(row["high"], row["n"])
                if first:
                    visits.append(descent.best(rows, high) if (low <= high).any() else [])
                else:
                    visits.append(sorted(descent.leaves(rows, low, high).difference(row["seen"])))
            yield batch.append_column("visits", pa.array(visits, pa.list_(pa.int32())))

    return run


def _scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products: as doubles where every partial sum is a whole number that a double holds."""
    size = np.linalg.norm(left, axis=1).max() * np.linalg.norm(right, axis=1).max()
    if size < _EXACT // 2:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    return left @ right.T


def _scorer(width: int, same: bool, k: int):
    def score(key: tuple, groups: pa.Table, blocks: pa.Table) -> pa.Table:
        found: dict[str, list] = {c: [] for c in ("group", "row", "slot", "anchor", "score", "vec_id", "uid")}
        for block in blocks.to_pylist():
            n = block["n"]
            ids, uids = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["uids"], np.int64)
            rows = np.frombuffer(block["rows"], np.int64).reshape(n, width)
            centre = np.frombuffer(block["centre"], float)
            for group in groups.to_pylist():
                m = group["n"]
                anchors = np.frombuffer(group["rows"], np.int64).reshape(m, width)
                low, high = _ends(group["low"], m), _ends(group["high"], m)
                near, far = anchors @ centre, np.linalg.norm(anchors, axis=1) * block["radius"]
                mine = np.flatnonzero(_wanted(low, high, near - far, near + far))
                if not len(mine):
                    continue
                products = _scores(anchors[mine], rows)
                own, names = np.frombuffer(group["uids"], np.int64), np.frombuffer(group["ids"], np.int64)
                for i, scores in zip(mine.tolist(), products):
                    for slot in range(low.shape[1]):
                        fits = np.flatnonzero((scores >= low[i, slot]) & (scores <= high[i, slot]))
                        if same:
                            fits = fits[uids[fits] != own[i]]
                        if len(fits) > k:  # ties with the k-th stay for the order by id
                            worst = np.partition(scores[fits], len(fits) - k)[len(fits) - k]
                            fits = fits[scores[fits] >= worst]
                        if len(fits):
                            order = np.lexsort((uids[fits], ids[fits], -scores[fits]))[:k]
                            top = fits[order]
                            found["group"] += [group["key"]] * len(top)
                            found["row"] += [i] * len(top)
                            found["slot"] += [slot] * len(top)
                            found["anchor"] += [int(names[i])] * len(top)
                            for c, x in (("score", scores), ("vec_id", ids), ("uid", uids)):
                                found[c] += x[top].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()})

    return score


_FOUND = "group long, row long, slot long, anchor long, score long, vec_id long, uid long"


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each search, with their rank from 0."""
    order = Window.partitionBy("group", "row", "slot").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def _visit(groups: DataFrame, blocks: DataFrame, width: int, same: bool, k: int, chunks: int) -> DataFrame:
    """The k best of each search in the leaves that groups visit."""
    directory = blocks.select("leaf", F.col("label").alias("other"), F.col("key").alias("block"))
    pairs = groups.select(F.col("key").alias("group"), "label", F.explode("visits").alias("leaf")).join(directory, "leaf")
    pairs = pairs.filter(F.col("label") == F.col("other") if same else F.col("label") != F.col("other"))
    pairs = pairs.select("group", "block", F.pmod(F.xxhash64("group"), F.lit(chunks)).alias("chunk"))
    sent = pairs.join(groups.select("key", "ids", "uids", "rows", "n", "low", "high"), F.col("group") == F.col("key"))
    met_by = pairs.select(F.col("block").alias("key"), F.col("chunk").alias("by")).distinct()
    there = met_by.join(blocks.select("key", "ids", "uids", "rows", "centre", "radius", "n"), "key")
    met = sent.groupBy("block", "chunk").cogroup(there.groupBy("key", "by"))
    return met.applyInArrow(_scorer(width, same, k), _FOUND)


def _raiser(k: int):
    """Lifts the lower end of each search to the worst of its best, if it has k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows = []
            for row in batch.select(["n", "low", "best"]).to_pylist():
                low = _ends(row["low"], row["n"]).copy()
                for b in row["best"] or ():
                    low[b["row"], b["slot"]] = max(low[b["row"], b["slot"]], b["score"])
                lows.append(low.tobytes())
            keep = batch.drop_columns(["low", "best"])
            yield keep.append_column("low", pa.array(lows, pa.binary()))

    return run


_GROUP = "key long, label long, ids binary, uids binary, rows binary, n long, high binary, low binary, seen array<int>"


def search(groups: DataFrame, blocks: DataFrame, tree: Tree, radius: np.ndarray, width: int, same: bool, k: int) -> DataFrame:
    """The k best candidates of each search of each anchor: (group, row, slot, score, vec_id, uid, rank). ``groups`` has
    (key, label, ids, uids, rows, n, high, low): for each anchor and search the ends of the interval of scores.
    ``same``: of the group's own label, or of others."""
    chunks = max(1, math.ceil(groups.count() / CHUNK))
    visit = lambda g, first: g.mapInArrow(_visitor(tree, radius, width, first), _GROUP + ", visits array<int>")
    blank = groups.withColumn("seen", F.array().cast("array<int>")).select("key", "label", "ids", "uids", "rows", "n", "high", "low", "seen")
    start = materialise(visit(blank, True), "negatives-groups")
    best = materialise(_top(_visit(start, blocks, width, same, k, chunks), k), "negatives-found")
    worst = best.filter(F.col("rank") == k - 1).groupBy(F.col("group").alias("key"))
    worst = worst.agg(F.collect_list(F.struct("row", "slot", "score")).alias("best"))  # at most a few for each anchor of a group
    names = ["key", "label", "ids", "uids", "rows", "n", "high", "low", "best", F.col("visits").alias("seen")]
    raised = start.join(worst, "key", "left").select(*names)
    raised = raised.mapInArrow(_raiser(k), "key long, label long, ids binary, uids binary, rows binary, n long, high binary, seen array<int>, low binary")
    rest = materialise(visit(raised.select(*blank.columns), False), "negatives-groups")
    more = _visit(rest, blocks, width, same, k, chunks)
    return materialise(_top(best.drop("rank").union(more), k), "negatives-found")


_OPEN = "key long, label long, ids binary, uids binary, rows binary, n long, high binary, low binary"


def _with_all():
    """Groups with one search an anchor, for any score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_pylist()
            for name, end in (("high", _HIGH), ("low", _LOW)):
                batch = batch.append_column(name, pa.array([np.full(n, end).tobytes() for n in sizes], pa.binary()))
            yield batch

    return run


def _with_positives(low_share: int, k: int):
    """Groups with an interval for each positive: from ``low_share`` hundredths of its score to its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = [], []
            for row in batch.select(["n", "best"]).to_pylist():
                low, high = np.full((row["n"], k), _HIGH), np.full((row["n"], k), _LOW)
                for b in row["best"]:
                    # Python's whole numbers: the share of a large score need not fit a long on its way.
                    low[b["row"], b["rank"]] = -((-low_share * b["score"]) // 100)
                    high[b["row"], b["rank"]] = b["score"]
                lows.append(low.tobytes())
                highs.append(high.tobytes())
            keep = batch.drop_columns(["best"])
            yield keep.append_column("high", pa.array(highs, pa.binary())).append_column("low", pa.array(lows, pa.binary()))

    return run


def mine_negatives(
    rows: DataFrame, is_anchor: F.Column | None = None, low_share: int = 80, n_positives: int = 5, n_negatives: int = 5
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all anchors. ``rows`` come from
    :func:`usable_rows`; anchors are those whose id is divisible by 100 unless ``is_anchor`` says otherwise."""
    is_anchor = F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor
    anchors = rows.filter(is_anchor)
    n, width = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    n_anchors, width = anchors.count(), max(1, width or 1)
    by_width = max(1.0, width / 64)
    tree = _fit(rows, n, LEAF_ROWS, width)
    routed = materialise(rows.mapInArrow(_router(tree, width), "vec_id long, label long, vec array<long>, uid long, leaf int"), "negatives-routed")
    radius = np.full(len(tree.centre), -1.0)
    balls = routed.mapInArrow(_measurer(tree, width), "node int, radius double").groupBy("node").agg(F.max("radius"))
    for node, r in balls.collect():  # at most two rows a leaf
        radius[node] = r * (1 + 1e-9) + 1e-6
    blocks = _blocks(routed, max(64, int(BLOCK_ROWS / by_width)), width, "negatives-blocks")
    home = _fit(anchors, n_anchors, 8 * GROUP_ROWS, width)
    placed = anchors.mapInArrow(_router(home, width), "vec_id long, label long, vec array<long>, uid long, leaf int")
    groups = _blocks(placed, max(16, int(GROUP_ROWS / by_width)), width, "negatives-groups")
    groups = groups.select("key", "label", "ids", "uids", "rows", "n")
    open_groups = groups.mapInArrow(_with_all(), _OPEN)
    positives = search(open_groups, blocks, tree, radius, width, True, n_positives)
    known = positives.groupBy(F.col("group").alias("key")).agg(F.collect_list(F.struct("row", "rank", "score")).alias("best"))
    wanted = groups.join(known, "key").mapInArrow(_with_positives(low_share, n_positives), _OPEN)
    negatives = search(materialise(wanted, "negatives-groups"), blocks, tree, radius, width, False, n_negatives)
    shown = lambda c: F.when(F.col(c) != _LAST_ID, F.col(c))
    pairs = positives.select("group", "row", F.col("rank").alias("slot"), shown("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    mined = negatives.select("group", "row", F.col("slot").cast("int"), F.col("anchor").alias("anchor_id"), "rank", shown("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = mined.join(pairs, ["group", "row", "slot"])
    return joined.select(
        "anchor_id",
        "positive_id",
        (F.col("rank") + 1).cast("int").alias("rank"),
        "negative_id",
        "positive_score",
        "negative_score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row; every seventh row's label is moved on."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine_negatives(usable_rows(rows.withColumn("label", moved)))


ORACLE_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM rows a JOIN rows c ON a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score
  FROM scores WHERE label = own AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE label <> positives.own AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
