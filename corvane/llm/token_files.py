"""Token-id output: flat unsigned integer files with 64-bit document offsets.

Documents are dealt out by ranges of their id; each task writes one part: the ids of its documents,
one after the other, and where each document ends within the part. The number of ids in every part,
one row a part, gives the parts' bases by a prefix sum; a second short pass turns the ends into
offsets within the whole dataset. A part has three files:

``part-00000.bin``   ids, unsigned 16-bit (32-bit if the vocabulary needs it), little-endian
``part-00000.off``   n + 1 unsigned 64-bit offsets, in ids from the start of the dataset
``part-00000.doc``   n signed 64-bit document ids

``dataset.json`` names the width, the end id and the number of parts. Readers map the files into memory. A task
writes under a name of its own and renames at the end, so a repeated attempt replaces equal files.

Edge cases: a null text is empty: one document with only the end id. Null ids sort first and read back
as null. Rows with equal ids are separate documents, ordered by a hash of their text. An empty table
gives a dataset without parts. Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.storage import materialise, scratch_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Words whose ids a worker remembers; then it forgets them all.
MAX_WORDS = 1_500_000
_NULL_ID = -(1 << 63)
#: The kinds of normaliser and pre-tokenizer steps, and the pattern, under which words can be encoded
#: one by one: white space parts pieces and is dropped, case is folded, and no step looks beyond white space.
_WORDWISE_STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
_WORDWISE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: A word with ASCII marks behind an ASCII letter or digit; a word that no step of these makes longer or shorter: lower-cased
#: ASCII without control characters, and Latin letters of two bytes but the dotted I.
_TAIL = re.compile(rb"(.*[A-Za-z0-9])[!-/:-@\[-`{-~]+", re.DOTALL)
_PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+")
#: Words that are encoded as one text.
_TOGETHER = 200

_encoders: dict[str, Encoder] = {}


def _wordwise(spec: dict) -> bool:
    """Whether a tokenizer's file says that a text's ids are those of its lower-cased words in order."""
    steps = [(spec.get(k) or {}) for k in ("normalizer", "pre_tokenizer")]
    before, split = steps[0].get("normalizers", []), steps[1].get("pretokenizers", [])
    if ([s["type"] for s in before], [s["type"] for s in split]) != _WORDWISE_STEPS or spec.get("post_processor"):
        return False
    return (
        (before[1]["pattern"], before[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and split[0]["pattern"] == {"Regex": _WORDWISE_PATTERN}
        and (split[0]["behavior"], split[0]["invert"]) == ("Removed", True)
        and not split[1]["add_prefix_space"]
    )


class Encoder:
    """Encodes texts word by word, each word once, where the tokenizer allows it; else whole texts.

    A tokenizer allows it if it drops white space, never joins across it, folds case, and ends a piece where
    letters end: then a text's ids are those of its words in order, and those of a word with marks
    after a letter or digit are the word's and then the marks'. Texts that may hold special
    tokens, whose case matters, are encoded whole. Different words of a batch are found in Arrow, so Python
    looks at each once a batch.
    """

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer)
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.words: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, suffix = self.tokenizer.get_vocab(), spec["model"].get("end_of_word_suffix") or ""
        #: The bytes that each id stands for.
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.lengths[list(vocabulary.values())] = [len(t.removesuffix(suffix)) for t in vocabulary]
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.wordwise = _wordwise(spec) and all(t.startswith("<|") for t in special)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def learn(self, new: list[bytes]) -> None:
        """The ids of words that are new, each looked up once without the marks behind it."""
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        tails = {w: m.end(1) for w in new if (m := _TAIL.fullmatch(w))}
        bare = {w[:at] for w, at in tails.items()}.union((w[at:] for w, at in tails.items()), (w for w in new if w not in tails))
        bare = [w for w in bare if w not in self.words]
        plain = [w for w in bare if _PLAIN.fullmatch(w)]
        for i in range(0, len(plain), _TOGETHER):
            self._learn_plain(plain[i : i + _TOGETHER])
        self._learn_apart([w for w in bare if w not in self.words])
        for word, at in tails.items():
            self.words[word] = self.words[word[:at]] + self.words[word[at:]]

    def _learn_plain(self, words: list[bytes]) -> None:
        """Words whose bytes the normaliser keeps in number, as one text: an id stands for as many bytes as its token
        has characters, which tells where a word ends. Nothing is learnt if that does not come out even."""
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, np.int64)
        ends = np.cumsum(self.lengths[ids])
        wanted = np.cumsum([len(w) for w in words])
        at = np.searchsorted(ends, wanted)
        if len(ends) and ends[-1] == wanted[-1] and (ends[at] == wanted).all():
            self._remember(words, ids, at + 1)

    def _learn_apart(self, words: list[bytes]) -> None:
        """Words one by one: every id carries the number of the word it comes from, so nothing is read from the ids."""
        if words:
            found = self.tokenizer.encode(
                [w.decode("utf-8", "replace") for w in words], is_pretokenized=True, add_special_tokens=False
            )
            ends = np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(words)))
            self._remember(words, np.array(found.ids, np.int64), ends)

    def _remember(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, bounds = ids.astype(self.kind).tobytes(), (ends * np.dtype(self.kind).itemsize).tolist()
        self.words.update(zip(words, [raw[s:e] for s, e in zip([0, *bounds], bounds)], strict=True))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as bytes of the encoder's width. Texts are not null."""
        if not self.wordwise:
            return [self.whole(t) for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
        if not isinstance(texts, pa.Array):
            texts = pa.array([t.encode("utf-8", "replace") for t in texts], pa.string())
        special = pc.match_substring(texts, "<|")
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(special, "", texts)))
        # One look-up for each different word; None marks words that are new.
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        ids = list(map(self.words.get, names))
        if None in ids:
            self.learn([w for w, i in zip(names, ids, strict=True) if i is None])
            ids = [self.words[w] if i is None else i for w, i in zip(names, ids, strict=True)]
        taken = pa.array(ids, pa.binary()).take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(taken).to_numpy(zero_copy_only=False), dtype=np.int64)])
        bounds = ends[words.offsets.to_numpy()].tolist()
        raw = memoryview(taken.buffers()[2] or b"")
        found = [bytes(raw[s:e]) for s, e in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            found[i] = self.whole(texts[i].as_py())
        return found


def slices(texts: pa.Array, size: int = 1 << 23) -> Iterator[pa.Array]:
    """A column in slices of about ``size`` bytes of text, one text at least; nulls are empty."""
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(first, last - first)
        first = last


def _encoder(tokenizer: str) -> Encoder:
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    return _encoders[tokenizer]


def _put(files: fs.FileSystem, path: str, data: bytes) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as out:
        out.write(data)
    files.move(temporary, path)


def _writer(uri: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        files, root = fs.FileSystem.from_uri(uri)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], encoder.kind).tobytes()
        name = f"{root}/part-{part:05d}"
        temporary = f"{name}.bin.{uuid.uuid4().hex}"
        ids: list[pa.Array] = []
        sizes: list[int] = []
        out = None
        for batch in batches:
            ids.append(batch.column(0))
            for texts in slices(batch.column(1)):
                encoded = encoder.encode(texts)
                sizes += [len(e) + len(end) for e in encoded]
                out = out or files.open_output_stream(temporary)
                out.write(b"".join([e + end for e in encoded]))
        if out:
            out.close()
            files.move(temporary, f"{name}.bin")
            ends = np.cumsum(np.array(sizes, np.int64)) // len(end)
            _put(files, f"{name}.ends", ends.astype("<u8").tobytes())
            docs = pa.chunked_array(ids).fill_null(_NULL_ID).to_numpy()
            _put(files, f"{name}.doc", docs.astype("<i8").tobytes())
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "n_docs": [len(sizes)], "n_ids": [int(ends[-1])], "width": [len(end)]}
            )

    return run


def _offset_writer(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{root}/part-{row['part']:05d}"
                with files.open_input_file(f"{name}.ends") as f:
                    ends = np.frombuffer(f.read(), "<u8")
                offsets = np.concatenate([[0], ends]).astype("<u8") + np.uint64(row["base"])
                _put(files, f"{name}.off", offsets.tobytes())
            yield batch

    return run


def _one_a_task(parts: DataFrame, n_parts: int) -> DataFrame:
    """The rows of ``parts`` over as many tasks: a row stands for a whole file, and without a number rows so small
    would be put together."""
    return parts.repartition(max(n_parts, 1), "part")


def write_token_files(
    docs: DataFrame, uri: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the dataset below ``uri``, a folder that all executors share; return its parts (part, n_docs, n_ids,
    width, base). The numbers of ids are summed over one row a part."""
    files, root = fs.FileSystem.from_uri(uri)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("own"))
    dealt = rows.repartitionByRange("id", "own").sortWithinPartitions("id", "own").select("id", "text")
    sizes = dealt.mapInArrow(_writer(uri, tokenizer, end_id), "part long, n_docs long, n_ids long, width long")
    sizes = materialise(sizes, "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = sizes.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    schema = "part long, n_docs long, n_ids long, width long, base long"
    n_parts, width = sizes.agg(F.count("*"), F.coalesce(F.max("width"), F.lit(0))).first()
    parts = materialise(_one_a_task(based, n_parts).mapInArrow(_offset_writer(uri), schema), "token-parts")
    about = {"width": width, "end_id": end_id, "tokenizer": os.path.basename(tokenizer), "parts": n_parts}
    _put(files, f"{root}/dataset.json", json.dumps(about).encode())
    return parts


def _map(files: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: mapped into memory where the folder is mounted, else read."""
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_part(uri: str, part: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, offsets within the dataset, and ids of one part."""
    files, root = fs.FileSystem.from_uri(uri)
    name = f"{root}/part-{part:05d}"
    return (
        _map(files, f"{name}.doc", "<i8"),
        _map(files, f"{name}.off", "<u8"),
        _map(files, f"{name}.bin", f"<u{width}"),
    )


def _digester(uri: str, step: int = 10_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, offsets, ids = read_part(uri, row["part"], row["width"])
                for i in range(0, len(docs), step):
                    these = docs[i : i + step]
                    starts = offsets[i : i + step + 1].astype(np.int64)
                    local = (starts - row["base"]).tolist()
                    crc = [zlib.crc32(ids[s:e].astype("<u4")) for s, e in zip(local, local[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(these), mask=np.asarray(these == _NULL_ID)),
                            pa.array(starts[:-1]),
                            pa.array(np.diff(starts)),
                            pa.array(crc, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def digest_token_files(parts: DataFrame, uri: str) -> DataFrame:
    """Columns (doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    return _one_a_task(parts, parts.count()).mapInArrow(
        _digester(uri), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents and read them back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    uri = scratch_path(spark, "token-files")
    return digest_token_files(write_token_files(docs, uri), uri)


#: SQL has no tokenizer; tests/llm holds the query against the tokenizers library itself.
ORACLE_SQL = None
