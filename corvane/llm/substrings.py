"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words. Its minimiser is the smallest hash of the ``m``-word groups inside
it; consecutive windows mostly share theirs. A run of windows with one minimiser is a super-k-mer: it
travels as one string to the bucket its minimiser names. Equal windows have equal minimisers, so all
places of a window meet in one bucket, where windows are sorted by hash, compared by their words, and
the smallest document of each window is found exactly.

Text is read in chunks. What a chunk sends to a bucket is one compressed row: the strings, and where
they start. A string that comes up often in one chunk (a shared passage) is sent once without its
places. These stay behind in a row of the chunk's own, dealt by chunk and not by minimiser, and are
looked up when the bucket has answered. So a passage in a third of all documents costs its bucket one
entry a chunk.

A word group that stands in very many documents, each time among other words, would send all windows around it to one
bucket. Such groups are found beforehand: the bytes that each minimiser would send are added up over a share of
the documents and of the strings, picked by hashes, and what comes to ``HOT_BYTES`` or more is hot. A hot group is a
window's minimiser only if all its groups are hot; then the window's own hash is, and it travels alone. Both
follow from the window's words, so equal windows still meet. Which groups are hot decides on balance, never on results.

Edge cases: null and blank texts have no words. A null id counts as larger than all ids. Rows with the
same id do not remove each other's words; they are told apart by a hash of their text, and equal rows
get equal results. Words are compared unchanged, byte by byte. Windows do not cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import materialise

WINDOW = 13
GROUP = 3
#: Bytes of text that are cut into windows at a time.
CHUNK_BYTES = 3 << 20
#: Places of one string in one chunk from which they stay with the chunk.
OFTEN = 8
#: Bytes of text for each bucket, buckets that a task counts one after the other, and tasks at which these grow.
BUCKET_BYTES = 4 << 20
TASK_BUCKETS, MAX_TASKS = 2, 100_000
#: Of zstd, for all that is sent to buckets.
LEVEL = 6
#: One in so many documents, and strings of these, are added up by minimiser.
DOC_SHARE, STRING_SHARE = 16, 256
#: Bytes of strings of one minimiser, over the whole input, from which its group is hot.
HOT_BYTES = 16 << 20
_NULL_ID = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words by their length, first 16 and last 8 bytes. They choose buckets and sort; equality
    is always settled by the bytes."""
    padded = np.frombuffer(bytes(8) + buffer + bytes(16), np.uint8)
    at = np.ndarray((len(padded) - 7,), np.uint64, padded.data, strides=(1,))
    length = ends - starts
    keep = lambda n: np.where(
        n >= 8, ~np.uint64(0), (np.uint64(1) << (np.clip(n, 0, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
    )
    h = _mix((at[starts + 8] & keep(length)) + length.astype(np.uint64) * _ODD)
    long = np.flatnonzero(length > 8)
    if len(long):
        s, e, n = starts[long], ends[long], length[long]
        h[long] = _mix(h[long] + (at[s + 16] & keep(n - 8)) * _ODD)
        h[long] = _mix(h[long] ^ at[e])
    return h


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive word hashes."""
    size = len(h) - n + 1
    total = h[:size].copy()
    for i in range(1, n):
        total *= _ODD
        total += h[i : i + size]
    return _mix(total)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _words_of(buffer: bytes, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that are joined by newlines, and the text of each word."""
    data = np.frombuffer(buffer, np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.empty_like(ends)
    starts[:1] = 0
    starts[1:] = ends[:-1] + 1
    real = ends > starts
    return starts[real], ends[real], np.repeat(np.arange(len(counts)), counts)


def _pack(*parts: bytes) -> bytes:
    head = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"".join(parts))


def _unpack(payload: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8)
    ends = np.cumsum(sizes) + 8 * (n + 1)
    return [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def minimisers(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The minimiser of each window of consecutive words, given the words' hashes and the sorted hashes of hot groups."""
    groups = rolling(hashes, GROUP)
    if not len(hot):
        return _sliding_min(groups, WINDOW - GROUP + 1)
    at = np.minimum(np.searchsorted(hot, groups), len(hot) - 1)
    top = np.uint64(1 << 63)
    least = _sliding_min(groups >> np.uint64(1) | np.where(hot[at] == groups, top, np.uint64(0)), WINDOW - GROUP + 1)
    return np.where(least >= top, rolling(hashes, WINDOW) | top, least)


def _cut(
    ids: np.ndarray, rows: np.ndarray, texts: list[bytes], counts: np.ndarray, n_buckets: int, chunk: int, hot: np.ndarray
):
    """Rows (kind, bucket, chunk, payload) of one chunk of texts. With no buckets, rows (minimiser, bytes) of a share
    of the strings that would be sent."""
    buffer = b"\n".join(texts) + b"\n"
    starts, ends, doc = _words_of(buffer, counts)
    n = len(starts) - WINDOW + 1
    if n <= 0:
        return
    inside = doc[:n] == doc[WINDOW - 1 :]
    hashes = word_hashes(buffer, starts, ends)
    least = minimisers(hashes, hot)[:n]
    at = np.flatnonzero(inside)
    if not len(at):
        return
    first = np.ones(len(at), bool)
    first[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(first)
    start = at[head]
    length = np.diff(np.append(head, len(at)))
    lo, hi = starts[start], ends[start + length + WINDOW - 2]
    bucket = (_mix(least[start]) % np.uint64(max(n_buckets, 1))).astype(np.int64)
    first_word = np.searchsorted(doc, doc[start])
    place = start - first_word
    # Strings that come up often in this chunk: sorted by a hash of both ends, told apart by their bytes.
    window = rolling(hashes, WINDOW)
    key = _mix(window[start] + _mix(window[start + length - 1]) * _ODD + length.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    often = np.full(len(start), -1, np.int64)
    names = 0
    bounds = np.concatenate([[0], cuts, [len(order)]])
    for first_at in np.flatnonzero(np.diff(bounds) >= OFTEN).tolist():
        run = order[bounds[first_at] : bounds[first_at + 1]]
        same: dict[bytes, list[int]] = {}
        for i in run.tolist():
            same.setdefault(buffer[lo[i] : hi[i]], []).append(i)
        for group in same.values():
            if len(group) >= OFTEN:
                often[group] = names
                names += 1
    if names and n_buckets:
        kept = np.flatnonzero(often >= 0)
        parts = [often[kept], ids[doc[start[kept]]], rows[doc[start[kept]]], place[kept]]
        yield 1, chunk % n_buckets, chunk, _pack(*[p.astype("<i8").tobytes() for p in parts])
    send = often < 0
    if names:
        every = np.flatnonzero(often >= 0)
        send[every[np.unique(often[every], return_index=True)[1]]] = True
        least_id = np.full(names, _NULL_ID, np.int64)
        most_id = np.full(names, -(1 << 63), np.int64)
        np.minimum.at(least_id, often[every], ids[doc[start[every]]])
        np.maximum.at(most_id, often[every], ids[doc[start[every]]])
    sent = np.flatnonzero(send)
    if not n_buckets:
        mark = _mix(rows[doc[start[sent]]].astype(np.uint64) + place[sent].astype(np.uint64) * _ODD)
        sent = sent[mark % np.uint64(STRING_SHARE) == 0]
        yield from zip(least[start[sent]].view(np.int64).tolist(), (hi - lo)[sent].tolist(), strict=True)
        return
    sent = sent[np.argsort(bucket[sent], kind="stable")]
    smallest = ids[doc[start[sent]]].copy()
    largest = smallest.copy()
    named = often[sent] >= 0
    if names:
        smallest[named] = least_id[often[sent][named]]
        largest[named] = most_id[often[sent][named]]
    edges = np.flatnonzero(np.diff(bucket[sent])) + 1
    lo_list, hi_list = lo[sent].tolist(), hi[sent].tolist()
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(sent)], strict=True):
        text = b"\n".join([buffer[s:e] for s, e in zip(lo_list[a:b], hi_list[a:b], strict=True)]) + b"\n"
        part = sent[a:b]
        arrays = (
            smallest[a:b].astype("<i8"),
            largest[a:b].astype("<i8"),
            rows[doc[start[part]]].astype("<i8"),
            place[part].astype("<i4"),
            (length[part] + WINDOW - 1).astype("<i4"),
            often[part].astype("<i4"),
        )
        yield 0, int(bucket[part[0]]), chunk, _pack(*[x.tobytes() for x in arrays], text)


_SENT = "kind int, bucket long, chunk long, payload binary"


def _cutter(n_buckets: int, hot: np.ndarray):
    names = ("kind", "bucket", "chunk", "payload") if n_buckets else ("least", "bytes")
    types = _SENT_TYPES if n_buckets else (pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, texts, counts, held = [], [], [], [], 0
            out: list[tuple] = []

            def close(ids=ids, rows=rows, texts=texts, counts=counts, out=out) -> None:
                if texts:
                    # The rows that a chunk holds give its number, so a second attempt gives the same one.
                    number = hashlib.blake2b(np.array([ids, rows], "<i8").tobytes(), digest_size=8).digest()
                    chunk = int.from_bytes(number, "little") >> 1
                    out.extend(
                        _cut(np.array(ids, np.int64), np.array(rows, np.int64), texts, np.array(counts), n_buckets, chunk, hot)
                    )
                for held_list in (ids, rows, texts, counts):
                    held_list.clear()

            for i, row, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(words) < WINDOW:
                    continue
                joined = b" ".join(words)
                ids.append(_NULL_ID if not i.is_valid else i.as_py())
                rows.append(row.as_py())
                texts.append(joined)
                counts.append(len(words))
                held += len(joined)
                if held >= CHUNK_BYTES:
                    close()
                    held = 0
                    if out:
                        yield _batch(out, names, types)
                        out.clear()
            close()
            if out:
                yield _batch(out, names, types)

    return run


_SENT_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
_FOUND_NAMES = ("kind", "chunk", "name", "id", "row", "start", "length", "owner", "payload")
_FOUND_TYPES = (pa.int32(), *[pa.int64()] * 7, pa.binary())
_FOUND = "kind int, chunk long, name long, id long, row long, start long, length long, owner long, payload binary"


def _batch(rows: list[tuple], names: tuple, types: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


def _sorted_windows(payloads: list[tuple[int, bytes]]):
    """Runs of windows of one bucket's strings that also start in a smaller document: by column, where they are."""
    parts = [_unpack(p) for _, p in payloads]
    join = lambda i, kind: np.concatenate([np.frombuffer(p[i], kind) for p in parts]).astype(np.int64)
    smallest, largest, row = join(0, "<i8"), join(1, "<i8"), join(2, "<i8")
    place, n_words, name = join(3, "<i4"), join(4, "<i4"), join(5, "<i4")
    chunk = np.repeat([c for c, _ in payloads], [len(p[0]) // 8 for p in parts])
    buffer = b"".join(p[6] for p in parts)
    starts, ends, entry = _words_of(buffer, n_words)
    n = len(starts) - WINDOW + 1
    window = rolling(word_hashes(buffer, starts, ends), WINDOW)
    at = np.flatnonzero(entry[:n] == entry[WINDOW - 1 :])
    order = at[np.argsort(window[at], kind="stable")]
    same = window[order[1:]] == window[order[:-1]]
    run = np.concatenate([[0], np.cumsum(~same)])
    # A string that stands for several documents of its chunk repeats its windows by itself.
    again = (np.bincount(run)[run] > 1) | (smallest < largest)[entry[order]]
    several, run = order[again], run[again]
    if not len(several):
        return None
    lo, hi = starts[several], ends[several + WINDOW - 1]
    # Settle equality by the bytes: a window that differs from its run's first gets a run of its own kind.
    lead = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
    lead_of = np.repeat(lead, np.diff(np.append(lead, len(run))))
    view = memoryview(buffer)
    los, his, leads = lo.tolist(), hi.tolist(), lead_of.tolist()
    odd = [i for i, j in enumerate(leads) if i != j and view[los[i] : his[i]] != view[los[j] : his[j]]]
    if odd:
        kinds: dict[tuple[int, bytes], int] = {}
        top = int(run.max()) + 1
        for i in odd:
            run[i] = kinds.setdefault((int(run[i]), bytes(view[los[i] : his[i]])), top + len(kinds))
        resort = np.argsort(run, kind="stable")
        several, run = several[resort], run[resort]
    owner_of = entry[several]
    _, dense = np.unique(run, return_inverse=True)
    least = np.full(dense.max() + 1, _NULL_ID, np.int64)
    np.minimum.at(least, dense, smallest[owner_of])
    least = least[dense]
    hit = np.flatnonzero(least < largest[owner_of])
    e = owner_of[hit]
    offset = several[hit] - np.searchsorted(entry, e)
    by = np.lexsort((offset, e))
    e, offset, least = e[by], offset[by], least[hit][by]
    # Runs of windows with one owner, as (start, number of windows).
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (offset[1:] != offset[:-1] + 1) | ((name[e[1:]] >= 0) & (least[1:] != least[:-1]))
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(e)))
    e, offset, least = e[head], offset[head], least[head]
    return chunk[e], name[e], largest[e], row[e], place[e], offset, length, least


def _count_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: flagged windows (start, length) of a row of documents. Kind 1: what a chunk holds of
    strings that are often there. Kind 2: the answer for such a string."""
    held: list[tuple[int, bytes]] = []
    current = None

    def answer() -> Iterator[pa.RecordBatch]:
        found = _sorted_windows(held) if held else None
        if found is not None and len(found[0]):
            chunk, name, ids, row, place, offset, length, least = found
            often = name >= 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(often, 2, 0).astype(np.int32)),
                    pa.array(np.where(often, chunk, 0)),
                    pa.array(np.where(often, name, -1)),
                    pa.array(ids),
                    pa.array(row),
                    pa.array(np.where(often, offset, place + offset)),
                    pa.array(length.astype(np.int64)),
                    pa.array(least),
                    pa.nulls(len(ids), pa.binary()),
                ],
                names=list(_FOUND_NAMES),
            )

    for batch in batches:
        kinds, buckets, chunks = (batch.column(i).to_pylist() for i in range(3))
        for kind, bucket, chunk, payload in zip(kinds, buckets, chunks, batch.column(3), strict=True):
            if kind == 1:
                yield _batch([(1, chunk, 0, 0, 0, 0, 0, 0, payload.as_py())], _FOUND_NAMES, _FOUND_TYPES)
                continue
            if bucket != current:
                yield from answer()
                held, current = [], bucket
            held.append((chunk, payload.as_py()))
    yield from answer()


def _spread_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, id, row, start) of the strings that are often in a chunk."""
    for batch in batches:
        for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            name, ids, row, place = (np.frombuffer(p, "<i8") for p in _unpack(payload.as_py()))
            columns = [np.full(len(name), chunk), name, ids, row, place]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["chunk", "name", "id", "row", "place"])


def hot_groups(source: DataFrame, hot_bytes: int = HOT_BYTES, doc_share: int = DOC_SHARE) -> np.ndarray:
    """Sorted hashes of the hot groups of ``source`` (id, row, text). There are at most bytes sent / hot_bytes of them:
    some 100,000 of 8 bytes for each TB."""
    picked = source.filter(F.pmod(F.xxhash64("id", "row"), F.lit(doc_share)) == 0)
    sent = picked.mapInArrow(_cutter(0, np.zeros(0, np.uint64)), "least long, bytes long")
    limit = hot_bytes // (doc_share * STRING_SHARE)
    found = sent.groupBy("least").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") >= limit).collect()
    return np.sort(np.array([r["least"] for r in found], np.int64).view(np.uint64))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns (id, row, start, length): runs of windows, by the number of their first word, whose words
    also start in a document with a smaller id. ``row`` is a hash of the text; a null id is 2**63 - 1."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_buckets = max(32, size // BUCKET_BYTES)
    sent = source.mapInArrow(_cutter(n_buckets, hot_groups(source)), _SENT)
    # Buckets are dealt by number, so that tasks hold equally many, and more input makes more tasks, not larger ones.
    n_tasks = min(MAX_TASKS, -(-n_buckets // TASK_BUCKETS))
    dealt = sent.repartitionById(n_tasks, F.pmod("bucket", F.lit(n_tasks)).cast("int"))
    found = materialise(dealt.sortWithinPartitions("bucket").mapInArrow(_count_bucket, _FOUND), "substring-found")
    direct = found.filter("kind = 0").select("id", "row", "start", "length")
    places = found.filter("kind = 1").select("chunk", "payload").mapInArrow(
        _spread_places, "chunk long, name long, id long, row long, place long"
    )
    answers = found.filter("kind = 2").select("chunk", "name", "start", "length", "owner")
    often = places.join(answers, ["chunk", "name"]).filter("owner < id")
    return direct.union(often.select("id", "row", F.col("place") + F.col("start"), "length"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last columns text, starts, lengths: replaced by n_words, n_removed and the kept words."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        n = batch.num_columns - 3
        for text, starts, lengths in zip(*(batch.column(n + i) for i in range(3)), strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            n_words.append(len(words))
            if starts.is_valid and len(starts):
                change = np.zeros(len(words) + 1, np.int64)
                start = np.array(starts.as_py())
                np.add.at(change, start, 1)
                np.add.at(change, np.minimum(start + np.array(lengths.as_py()) + WINDOW - 1, len(words)), -1)
                stays = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                n_removed.append(len(words) - len(stays))
                kept.append(b" ".join([words[i] for i in stays]))
            else:
                n_removed.append(0)
                kept.append(b" ".join(words))
        added = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())]
        names = [*batch.schema.names[:n], "n_words", "n_removed", "kept"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], *added], names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Columns (id_col, n_words, n_removed, kept): the words left of each row of ``docs``, joined by one
    space, as UTF-8. With ``digest``, their SHA-256 in place of the words."""
    flags = repeated_windows(docs, id_col, text)
    by_row = flags.groupBy("id", "row").agg(F.collect_set(F.struct("start", "length")).alias("runs"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("text")).withColumns(
        {"id": F.coalesce(F.col("__id").cast("long"), F.lit(_NULL_ID)), "row": F.xxhash64("text")}
    )
    joined = rows.join(by_row, ["id", "row"], "left").select("__id", "text", "runs.start", "runs.length")
    kind = docs.schema[id_col].dataType.simpleString()
    result = joined.mapInArrow(_remove, f"__id {kind}, n_words long, n_removed long, kept binary")
    last = F.sha2(F.col("kept"), 256).alias("kept_sha256") if digest else F.col("kept")
    return result.select(F.col("__id").alias(id_col), "n_words", "n_removed", last)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document after removing repeated 13-word windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, digest=True)


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM words, unnest(range(1, len(w) - 11)) AS u(i)),
owned AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS owner FROM windows),
gone AS (
  SELECT doc_id, list(DISTINCT i + j) AS gone FROM owned, unnest(range(0, 13)) AS v(j) WHERE owner < doc_id GROUP BY doc_id),
places AS (
  SELECT words.doc_id, len(w) AS n_words, w, p, list_contains(coalesce(gone, []), p) AS g
  FROM words LEFT JOIN gone USING (doc_id), unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE g) AS n_removed, coalesce(string_agg(w[p], ' ' ORDER BY p) FILTER (WHERE NOT g), '') AS k
  FROM places GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
