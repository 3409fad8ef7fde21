"""Each query against a brute-force version on a small table with every edge case."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corvane.llm import (
    chat,
    decontaminate,
    licenses,
    mixing,
    quality,
    registry,
    sharding,
    simhash,
    substrings,
    token_files,
    url_filters,
)
from corvane.storage import materialise, scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def same(left, right):
    assert Counter(map(repr, left)) == Counter(map(repr, right))


@pytest.mark.parametrize("name", list(registry.queries()))
def test_empty_tables(spark, empty_dir, name):
    rows = registry.queries()[name](spark, empty_dir).collect()
    assert [r for r in rows if getattr(r, "conv_id", 0) != -1] == []


# 1. Mixing


def mix_brute(rows):
    key = lambda s: "1" if s is None else "0" + s
    docs = [(i, key(s), len(WORD.findall(t or ""))) for i, t, _, s, *_ in rows]
    size = Counter()
    for _, k, n in docs:
        size[k] += n
    order = sorted(size)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[k] for k in capped)
        unit = sum(weight[k] for k in order if k not in capped)
        target = {k: 2.0 * size[k] if k in capped else weight[k] * left / unit for k in order}
        over = {k for k in order if k not in capped and target[k] > 2 * size[k]}
        if not over:
            return docs, size, target
        capped |= over


def test_mixing(spark, docs_dir, doc_rows):
    docs, size, target = mix_brute(doc_rows)
    got = rows_of(mixing.query(spark, docs_dir))
    same([(r["doc_id"], r["size"]) for r in got], [(i, n) for i, _, n in docs])
    by_size = {size[k]: target[k] for k in size}
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["target"] == pytest.approx(by_size[r["source_size"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
        largest[r["source_size"]] = max(largest[r["source_size"]], r["size"])
    for s, t in by_size.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    positions = [r["first_position"] for r in got if r["first_position"] is not None]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    same(got, rows_of(mixing.query(spark, docs_dir)))


def test_mixed_documents_follow_the_plan(spark, docs_dir, doc_rows):
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    _, size, target = mix_brute(doc_rows)
    count = lambda t: len(WORD.findall(t or ""))
    key = lambda s: "1" if s is None else "0" + s
    words, rows, largest = Counter(), Counter(), Counter()
    for r in mixed.collect():
        words[key(r.source)] += count(r.text)
        rows[r] += 1
    for r in docs.collect():
        largest[key(r.source)] = max(largest[key(r.source)], count(r.text))
    for k in size:
        assert abs(words[k] - target[k]) <= largest[k] / 2 + 1
    there = Counter(docs.collect())
    assert all(n <= 2 * there[r] for r, n in rows.items())


@pytest.mark.parametrize("parts", [3, 11])
def test_mixing_tells_equal_texts_of_different_sources_apart(spark, parts):
    """Rows that share id and text but not source, and whole rows that repeat: each source meets its target."""
    import random

    rng = random.Random(2)
    said = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(20, 90))) for _ in range(40)]
    rows = [(i % 40, said[i % 40], s, n) for n, (i, s) in enumerate((i, s) for s, size in (("a", 400), ("b", 120), ("c", 90)) for i in range(size))]
    rows += [(None, said[0], None, 0)] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    mixed = mixing.mix_documents(docs.repartition(parts)).collect()
    _, size, target = mix_brute([(r[0], r[1], "en", r[2]) for r in rows])
    words = Counter()
    for r in mixed:
        words["1" if r.source is None else "0" + r.source] += len(r.text.split())
    for k in size:
        assert abs(words[k] - target[k]) <= 45, k
    assert max(Counter((r.doc_id, r.source, r.n) for r in mixed if r.source).values()) <= 2
    again = mixing.mix_documents(docs.repartition(5)).collect()
    assert Counter(mixed) == Counter(again)


def test_slots_follow_the_order_of_training(spark, docs_dir):
    """Positions of the plan, sorted, against the slots of a sharded mix that was written and read again."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{docs_dir}/documents.parquet").dropDuplicates(["doc_id", "text"]).filter("doc_id IS NOT NULL")
    docs = materialise(docs, "test-docs")
    own = F.xxhash64("text")
    narrow = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing._mark(F.col("doc_id"), own).alias("mark"))
    plan = mixing.plan_mix(narrow).select("doc_id", F.explode("positions").alias("at")).collect()
    mixed = materialise(mixing.mix_documents(docs), "test-mixed")
    sharded = sharding.shard_documents(mixed, 4).collect()
    home = {r.doc_id: r.shard for r in sharded}
    for shard in range(4):
        want = [r.doc_id for r in sorted(plan, key=lambda r: (r["at"], r.doc_id)) if home[r.doc_id] == shard]
        got = sorted((r for r in sharded if r.shard == shard), key=lambda r: r.slot)
        assert [r.doc_id for r in got] == want and [r.slot for r in got] == list(range(len(want)))


def test_schedule_inverse(spark):
    knots = ((0.0, 2.0), (0.5, 0.0), (1.0, 1.0))
    from pyspark.sql import functions as F

    shares = spark.range(101).select((F.col("id") / 100).alias("q"))
    for q, u in shares.select("q", mixing.time_of(F.col("q"), knots)).collect():
        area = lambda x: (2 * x - 2 * x * x if x <= 0.5 else 0.5 + (x - 0.5) ** 2) / 0.75
        assert area(u) == pytest.approx(q, abs=1e-9)


# 2. URLs


def test_urls(spark, tmp_path):
    urls = [
        "http://WWW.Example.com/en/1",
        "http://a.example.com/en/?x",
        "https://example.com/fr/",
        "http://x.net/es/1",
        "http://x.net/de/1",
        "http://net/fr/",
        "http://spam-farm.example.org/a/?utm_source=x&b=2",
        "http://www.spam-farm.example.org/a?b=2#top",
        "http://notspam-farm.example.org/a",
        "http://host.com",
        "ftp://host.com/\n",
        "no scheme",
        "",
        None,
        "http://",
        "http://x.org?u=http://y.com/",
    ]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls * 2)], "page_id long, url string, html string").write.parquet(
        f"{tmp_path}/pages.parquet"
    )

    def brute(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(LOWER)
        fits = [
            (len(h + p), h + p, v)
            for h, p, v in url_filters.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        if fits:
            return (host, path, *max(fits)[1:])
        on_list = any(host == d or host.endswith("." + d) for d in url_filters.LISTED_DOMAINS)
        return host, path, None, "block" if on_list else "allow"

    got = url_filters.query(spark, str(tmp_path)).collect()
    same([tuple(r) for r in got], [(i, *brute(u)) for i, u in enumerate(urls * 2)])


def test_url_columns_that_clash_stay(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.net/es/x", "c", "l", "h", 1.5), (2, None, "c", "l", "h", 2.5)],
        "page_id long, url string, canonical string, listed string, host string, `x.y` double",
    )
    listed = spark.createDataFrame([("b.net/q",)], "canonical string")
    got = url_filters.judge_urls(pages, listed).orderBy("page_id")
    assert got.columns == ["page_id", "url", "canonical", "listed", "x.y", "host", "path", "rule", "verdict"]
    assert [tuple(r) for r in got.collect()] == [
        (1, "http://a.net/es/x", "c", "l", 1.5, "a.net", "/es/x", "net/es/", "block"),
        (2, None, "c", "l", 2.5, "", "", None, "allow"),
    ]


def test_url_list_is_exact_beyond_the_filter(spark):
    """With a filter far too small nearly all rows are possible hits; the join still decides."""
    rows = spark.createDataFrame([(f"h{i}/p",) for i in range(5000)], "canonical string")
    listed = rows.filter("canonical LIKE '%7/p'")
    found = url_filters.listed_rows(rows, listed, max_blocks=1).filter("listed").collect()
    assert {r.canonical for r in found} == {f"h{i}/p" for i in range(5000) if i % 10 == 7}


# 3. Quality


def quality_brute(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines, seen, again = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered), failed


def test_quality(spark, docs_dir, doc_rows):
    got = quality.query(spark, docs_dir).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same([tuple(r[n] for n in names) for r in got], [(r[0], *quality_brute(r[1])) for r in doc_rows])
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_distances(spark, tmp_path):
    """Junk among clean prose is rejected, clean prose is not; distances equal those worked out here."""
    import random

    rng = random.Random(1)
    common = quality.COMMON_WORDS["en"]
    clean = [" ".join(rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("aeiounrst") for _ in range(7)) for _ in range(200)) for _ in range(40)]
    junk = ["".join("ta" * rng.randint(1, 4) + "###$$" + str(rng.random()) + " " for _ in range(200)) for _ in range(4)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(clean + junk)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    got = {r.doc_id: r for r in quality.query(spark, str(tmp_path)).collect()}
    assert all(got[i].kept for i in range(40)) and not any(got[i].kept for i in range(40, 44))
    hist = np.array([quality.measure(t)[5] for _, t, *_ in rows if not quality_brute(t)[5]])
    q = (hist / hist.sum(axis=1, keepdims=True)).mean(axis=0)
    for i in (0, 41):
        p = np.array(quality.measure(rows[i][1])[5]) / sum(quality.measure(rows[i][1])[5])
        m = (p + q) / 2
        part = lambda a, m=m: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
        assert got[i].class_distance == pytest.approx(((part(p) + part(q)) / 2) ** 0.5, abs=1e-5)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_every_language_has_its_reference(spark, monkeypatch):
    """More languages than are broadcast: the same verdicts, each by the reference of its own language."""
    import random

    rng, rows = random.Random(6), []
    for k in range(12):
        own = quality.COMMON_WORDS[("en", "fr", "de", "es")[k % 4]]
        rows += [(k * 10 + j, " ".join(rng.choice(own) for _ in range(120)), f"lang{k}") for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", quality._features("text").alias("f"))
    judge = lambda: {
        r.doc_id: (r.kept, round(r.class_distance, 9), round(r.word_distance, 9))
        for r in quality.judge(docs, quality.language_references(docs, "lang", "f")).collect()
    }
    want = judge()
    assert quality.language_references(docs, "lang", "f").count() == 12
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", 3)
    assert judge() == want and len(want) == 96


# 4. Token files


def test_token_files(spark, docs_dir, doc_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_files.query(spark, docs_dir).collect()
    expect = []
    for i, text, *_ in doc_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        expect.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], expect)
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        assert last is None or (r.doc_id is not None and r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else last


@pytest.mark.parametrize(
    "text",
    [
        "<|endoftext|> and <|ENDOFTEXT|> inside",
        "it's, we'll. x!, y.. z,. 3, 4.5,",
        "á é, ﬁ. Å,  x y\x1cz",
        "É,é.Ω,  ab",
    ],
)
def test_encoder_equals_the_library(text):
    encoder = token_files.Encoder("word_bpe_49k.json")
    for _ in range(2):
        (ids,) = encoder.encode([text])
        assert ids == encoder.whole(text)


def test_encoder_takes_every_character():
    """Words whose ids are lone bytes, and every character of two or three bytes once."""
    encoder = token_files.Encoder("word_bpe_49k.json")
    assert encoder.wordwise
    chars = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    texts = ["가 一 р ऀ", "가격은 얼마 \ue000 x\ue000", "".join(chars[:5000])]
    texts += [" ".join(chars[i : i + 4000]) for i in range(0, len(chars), 4000)]
    texts += [" ".join(f"a{c}b,{c}." for c in chars[i : i + 4000]) for i in range(0, len(chars), 4000)]
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]


def test_cased_tokenizers_encode_whole_texts():
    encoder = token_files.Encoder("byte_bpe_50k.json")
    assert not encoder.wordwise
    texts = ["The  end.", "THE end", "", "a\n\nb "]
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]


def test_parts_are_read_back_side_by_side(spark, docs_dir):
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    uri = scratch_path(spark, "token-test")
    parts = token_files.write_token_files(docs, uri)
    assert token_files.digest_token_files(parts, uri).rdd.getNumPartitions() == max(parts.count(), 1)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(token_files, "MAX_WORDS", 5)
    encoder = token_files.Encoder("word_bpe_49k.json")
    texts = [f"one two{i}, three{i}. four one," for i in range(20)]
    for text in texts:
        assert encoder.encode([text, texts[0]]) == [encoder.whole(text), encoder.whole(texts[0])]


def test_encoder_gives_each_word_to_the_library_once():
    """However many marks stand behind a word, and however often it comes."""
    encoder, given = token_files.Encoder("word_bpe_49k.json"), []

    class Counting:
        def __init__(self, library):
            self.library = library

        def encode(self, words, **how):
            given.extend(words.split(" ") if isinstance(words, str) else words)
            return self.library.encode(words, **how)

    texts = ["Ever?! ever... (ever ever", "ever!! 12%, 12, caña, caña don't!! d'' \u0301a,", ""]
    want = [encoder.whole(t) for t in texts]
    encoder.tokenizer = Counting(encoder.tokenizer)
    assert encoder.encode(texts) == want and encoder.encode(texts[::-1]) == want[::-1]
    assert len(given) == len(set(given)) and given.count("ever") == 1


def test_encoder_takes_words_apart_where_bytes_do_not_come_out_even():
    """Words in one text and words one by one have the same ids; lengths that are wrong are noticed."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcxyzéñßŸ19'.<!") for _ in range(rng.randrange(1, 12))).lower().encode() for _ in range(3000)]
    together, wrong = token_files.Encoder("word_bpe_49k.json"), token_files.Encoder("word_bpe_49k.json")
    wrong.lengths = wrong.lengths + (np.arange(len(wrong.lengths)) % 7 == 0)
    wrong._learn_plain(words[:200])
    assert not wrong.words
    text = [b" ".join(words).decode()]
    assert together.encode(text) == wrong.encode(text) == [together.whole(text[0])]


def test_slices_take_every_text_once():
    texts = pa.array([None, "", "a" * 50, "é", None, "b" * 7, "c" * 7])
    for size in (1, 8, 60, 1000):
        got = list(token_files.slices(texts.slice(1), size))
        assert [t for part in got for t in part.to_pylist()] == ["", "a" * 50, "é", "", "b" * 7, "c" * 7]
        assert all(len(part) == 1 or sum(len(t.encode()) for t in part.to_pylist()) <= size for part in got)


# 5. Substrings


def substrings_brute(rows):
    inf = 1 << 62
    first = {}
    docs = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in docs:
        for p in range(len(w) - 12):
            g = tuple(w[p : p + 13])
            first[g] = min(first.get(g, inf), inf if i is None else i)
    for i, w in docs:
        gone = {p + j for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < (inf if i is None else i) for j in range(13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("often", [2, 8])
def test_substrings(spark, docs_dir, doc_rows, monkeypatch, often):
    monkeypatch.setattr(substrings, "OFTEN", often)
    got = [tuple(r) for r in substrings.query(spark, docs_dir).collect()]
    same(got, list(substrings_brute(doc_rows)))


def test_substrings_many_chunks(spark, doc_rows, monkeypatch, tmp_path):
    """Small chunks: strings that are often in one chunk and not in another meet in one bucket."""
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(substrings, "OFTEN", 3)
    rows = [r for r in doc_rows if r[0] != 405]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, a string, b double").coalesce(
        1
    ).write.parquet(f"{tmp_path}/documents.parquet")
    same([tuple(r) for r in substrings.query(spark, str(tmp_path)).collect()], list(substrings_brute(rows)))


@pytest.mark.parametrize("share", [1, 2])
def test_substrings_with_hot_groups(spark, docs_dir, doc_rows, monkeypatch, share):
    """All word groups hot, or every other one: the same rows."""
    texts = [" ".join((r[1] or "").encode().decode().split()).encode() for r in doc_rows]
    hot = []
    for t in texts:
        starts, ends, _ = substrings._words_of(t + b"\n", np.array([len(t.split())]))
        if len(starts) >= substrings.GROUP:
            hot.append(substrings.rolling(substrings.word_hashes(t + b"\n", starts, ends), substrings.GROUP))
    hot = np.unique(np.concatenate(hot))[::share]
    monkeypatch.setattr(substrings, "hot_groups", lambda source: hot)
    same([tuple(r) for r in substrings.query(spark, docs_dir).collect()], list(substrings_brute(doc_rows)))


def test_hot_groups_share_the_load(spark):
    """One group in every document, each time among other words: its bucket takes many times the others' before."""
    from pyspark.sql import functions as F

    rows = [(i, i, " ".join(f"a{i}x{j}" for j in range(12)) + " in the end " + " ".join(f"b{i}x{j}" for j in range(12))) for i in range(3000)]
    source = spark.createDataFrame(rows, "id long, row long, text string").repartition(8)
    hot = substrings.hot_groups(source, hot_bytes=16 * 256 * 16, doc_share=1)
    words = b"in the end\n"
    group = substrings.rolling(substrings.word_hashes(words, np.array([0, 3, 7]), np.array([2, 6, 10])), 3)

    def largest(hot):
        sent = source.mapInArrow(substrings._cutter(256, hot), substrings._SENT)
        return sent.groupBy("bucket").agg(F.sum(F.octet_length("payload")).alias("n")).agg(F.max("n")).first()[0]

    none = np.zeros(0, np.uint64)
    if substrings._mix(group)[0] < 1 << 63:  # else it is the minimiser of few windows anyway
        assert largest(none) > 1.5 * largest(group)
    assert set(hot.tolist()) <= set(group.tolist())


# 6. Decontamination


def test_decontamination(spark, docs_dir, doc_rows, tmp_path):
    import random

    rng = random.Random(3)
    items = [(i, " ".join("".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(25))) for i in range(300)]
    items += [(900, None), (901, ""), (902, "too short")]
    filler = lambda n: " ".join(r[1] for r in doc_rows[:3]).split()[:n]
    planted, rows = set(), [r[:5] for r in doc_rows]
    for i in range(0, 300, 7):
        w = items[i][1].split()
        rows.append((1000 + i, " ".join([*filler(i), *w, *filler(50)]), "en", "s", 0))
        planted.add((1000 + i, i))
        for j in range(0, 25, 6):  # a paraphrase: a word in six replaced, the last five kept
            if j < 20:
                w[j] = "changed"
        rows.append((2000 + i, " ".join([*filler(30), *w, *filler(9)]).upper(), "en", "s", 0))
        planted.add((2000 + i, i))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.query(spark, str(tmp_path)).collect()}
    assert got == planted
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumnRenamed("n_chars", "matches")
    kept = decontaminate.keep_clean(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert kept.columns == docs.columns and kept.count() == len(rows) - len({d for d, _ in planted})


def test_lcs():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _lcs_step(row, x, b)
        return row[-1]

    def _lcs_step(row, x, b):
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        return new

    import random

    rng = random.Random(0)
    for _ in range(200):
        a = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 12))]
        b = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 15))]
        assert decontaminate.lcs_length(a, b) == plain(a, b)


def test_latent_basis_is_that_of_the_passages(spark):
    """The range finder against a plain SVD of the same TF-IDF rows: directions of corpus passages, fewer than these."""
    import random

    rng = random.Random(5)
    topics = [[f"t{t}w{j}" for j in range(30)] for t in range(6)]
    texts = [" ".join(rng.choice(topics[i % 6]) for _ in range(40)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    n, df = decontaminate.feature_frequencies(docs, "text")
    held = Counter(int(f) for t in texts for f in set(decontaminate.features(decontaminate._hashes([t.encode()])[0])))
    assert n == 200 and {f: int(df[f]) for f in np.flatnonzero(df)} == held
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    rows = docs.selectExpr("id AS mark", "1.0D AS weight", "text").repartition(3)
    basis = decontaminate.latent_basis(rows, idf, 6)
    full = np.zeros((200, decontaminate.FEATURES))
    for i, t in enumerate(texts):
        _, f, w = decontaminate._rows_of([t.encode()], idf)
        full[i, f] = w
    used = np.flatnonzero(df)
    right = np.linalg.svd(full[:, used], full_matrices=False)[2][:6]
    assert np.allclose(basis.T @ basis, np.eye(6), atol=1e-4)
    assert np.allclose(np.linalg.svd(right @ basis[used])[1], 1, atol=0.02)


def test_sampled_passages_are_bounded_and_stable(spark, monkeypatch):
    """Copies count once, and another partitioning picks the same passages."""
    monkeypatch.setattr(decontaminate, "SAMPLE", 40)
    texts = [" ".join(f"w{i}x{j}" for j in range(i % 150)) for i in range(400)] + ["the same copy of one text"] * 4000
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    one = {tuple(r) for r in decontaminate.sample_passages(docs.repartition(2), 400, "text").collect()}
    two = {tuple(r) for r in decontaminate.sample_passages(docs.repartition(7), 400, "text").collect()}
    assert one == two and 15 < len(one) < 80
    assert all(0 < len(t.split()) <= 64 for _, t in one)


@pytest.mark.parametrize("kind", ["string", "int"])
def test_item_ids_of_any_type(spark, kind):
    """Null, repeated and string ids; one text that holds items of null and of other ids."""
    words = [[f"i{k}w{j}" for j in range(12)] for k in range(3)]
    items = [(None, " ".join(words[0])), ("5", " ".join(words[1])), ("5", " ".join(words[2])), (None, " ")]
    bench = spark.createDataFrame(items, "item_id string, text string").selectExpr(f"CAST(item_id AS {kind}) item_id", "text")
    docs = spark.createDataFrame([(1, " ".join(sum(words, []))), (2, "nothing"), (3, None)], "id long, text string")
    got = decontaminate.find_contamination(docs, bench)
    assert dict(got.dtypes)["matches"].startswith(f"array<struct<item:{kind},")
    found = {r["id"]: sorted([str(m["item"]) for m in r["matches"]]) for r in got.collect()}
    assert found == {1: ["5", "5", "None"], 2: [], 3: []}


# 7. Chat


def test_chat(spark, tmp_path):
    long = "very long \\ </s> <|end|> " * 3000
    turns = [
        (1, 0, "user", "a\\b <|start|>user<|sep|> [INST] </s>\\"),
        (1, 1, "assistant", "<"),
        (1, 2, "assistant", "|end|> \\\\ [\\INST]"),
        (2, 0, "user", None),
        (3, 5, "assistant", "é𝄞"),
        (3, 1, None, "null role"),
        (4, 0, "user", "tie b"),
        (4, 0, "user", "tie a"),
        (4, 0, "user", "tie a"),
        (None, 0, "assistant", "no id"),
        (5, None, "user", "null turn"),
        (5, 3, "us\ner<|sep|>", long),
        *[(6, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)],
    ]
    spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, leaf string").write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    said = "</s>[INST] ok [/INST]"
    convs = defaultdict(list)
    for c, turn, role, text in [*turns, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        convs[c].append(((turn is None, turn or 0), role or "", text or ""))
    got = {r.conv_id: r for r in chat.query(spark, str(tmp_path)).collect()}
    assert set(got) == set(convs)
    for c, rows in convs.items():
        rows.sort()
        body = "".join(f"{r}\n{t}\n" for _, r, t in rows)
        loss = "".join(t for _, r, t in rows if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(rows), hashlib.sha256(body.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_reply_trees(spark):
    """Branches are whole root-to-leaf paths; the best mean score wins; circles belong to no path."""
    import random

    rng = random.Random(2)
    parent = {("t", i): rng.randint(0, i - 1) if i else None for i in range(60)}
    parent |= {("o", 0): 99, ("o", 1): 0, ("c", 0): 1, ("c", 1): 0}
    score = {k: rng.random() for k in parent}
    rows = [(c, n, p, "user", f"{n}", score[c, n]) for (c, n), p in parent.items()]
    df = spark.createDataFrame(rows, "conv string, node long, parent long, role string, text string, score double")
    inner = {(c, p) for (c, _), p in parent.items()}

    def path(c, n):
        out = []
        while n is not None and (c, n) in parent:
            out.append(n)
            n = parent[c, n]
        return out[::-1]

    leaves = [k for k in parent if k not in inner and k[0] != "c"]
    want = defaultdict(set)
    for r in chat.reply_paths(df.select("conv", "node", "parent")).collect():
        want[r.conv, r.leaf].add((r.distance, r.node))
    assert {k: [n for _, n in sorted(v, reverse=True)] for k, v in want.items()} == {k: path(*k) for k in leaves}
    best = chat.format_trees(df, branches=2).collect()
    for c in ("t", "o"):
        mean = lambda k: np.mean([score[k[0], n] for n in path(*k)])
        top = sorted((k for k in leaves if k[0] == c), key=lambda k: (-mean(k), k[1]))[:2]
        assert {r.leaf for r in best if r.conv == c} == {k[1] for k in top}


# 8. SimHash


def test_circles_make_no_paths(spark, monkeypatch):
    """Leaves that hang on circles among healthy chains: no more path rows than the healthy ones have."""
    made = []
    plain = chat.materialise
    monkeypatch.setattr(chat, "materialise", lambda df, label: made.append((label, plain(df, label))) or made[-1][1])
    rows = [("long", i, i - 1 if i else None) for i in range(300)] + [(f"c{i % 50}", i, None) for i in range(400)]
    rows += [("ring", 0, 2), ("ring", 1, 0), ("ring", 2, 1), ("ring", 9, 9)] + [("ring", 10 + i, i % 3) for i in range(5)]
    rows += [("ring", 20, None), ("ring", 21, 20)]
    paths = chat.reply_paths(spark.createDataFrame(rows, "conv string, node long, parent long"))
    got = paths.collect()
    assert Counter(r.conv for r in got)["long"] == 300
    assert sorted((r.leaf, r.node, r.distance) for r in got if r.conv == "ring") == [(21, 20, 1), (21, 21, 0)]
    assert len(got) == 300 + 400 + 2
    assert max(df.count() for label, df in made if label == "chat-paths") == len(got)


def fingerprint_brute(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(ids, fps):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(spark, docs_dir, doc_rows):
    ids = [r[0] for r in doc_rows]
    fps = [fingerprint_brute(r[1]) for r in doc_rows]
    expect = list(zip(ids, [f"{f:016x}" for f in fps], components_brute(ids, fps), strict=True))
    same([tuple(r) for r in simhash.query(spark, docs_dir).collect()], expect)
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    groups = defaultdict(list)  # by row, not by id: rows of one id may be in different components
    for row, name in enumerate(components_brute(list(range(len(ids))), fps)):
        groups[name].append(row)
    heads = [min(g, key=lambda n: (ids[n] is None, ids[n] or 0)) for g in groups.values()]
    got = kept.collect()
    same([r.doc_id for r in got], [ids[n] for n in heads])
    of = {t: name for name, g in groups.items() for t in (doc_rows[n][1] for n in g)}
    assert sorted(of[r.text] for r in got) == sorted(groups)


@pytest.mark.parametrize("block", [3, 4096])
def test_ball_links_are_complete(spark, block):
    """Planted chains and stars of fingerprints at distances up to 4: exactly the components of all links of 3 or fewer."""
    import random

    rng = random.Random(11)
    fps = set()
    for _ in range(25):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(at)
            step = at
            for b in rng.sample(range(64), rng.randint(1, 4)):
                step ^= 1 << b
            at = step if rng.random() < 0.5 else at
            fps.add(step)
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << b) for b in range(40)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    from corvane.operators.components import connected_components

    found = {r.node: r.component for r in connected_components(simhash.near_fingerprint_edges(df, block)).collect()}
    assert [found.get(s, s) for s in signed] == components_brute(signed, fps)


# 9. Licenses


def test_licenses(spark, tmp_path):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = [
        "Released under CC-BY 4.0. cc by cc BY, CC by",
        "General PUBLIC license general public license; all rights reserved",
        "all rights all rights reserved reserved",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files",
        "Licensed under the Apache License, Version 2.0",
        "cc",
        "by cc",
        "ccby ccKby écc by",
        "",
        None,
        "cc by " * 5000,
        "cc by " * 3,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(11, texts[11]), (None, "CC BY")]
    spark.createDataFrame([(*r, "l", 2.0) for r in rows], "doc_id long, text string, labels string, score double").write.parquet(
        f"{tmp_path}/documents.parquet"
    )

    def brute(text):
        w = pattern.findall((text or "").translate(LOWER))
        places = sorted(
            (i, label) for label, phrase in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()
        )
        ends = (places[0][0], places[-1][0]) if places else (None, None)
        return len(w), len(places), *ends, ",".join(sorted({label for _, label in places}))

    got = licenses.query(spark, str(tmp_path)).collect()
    same([tuple(r)[:6] for r in got], [(i, *brute(t)) for i, t in rows])
    same([(r.doc_id, r.labels, round(r.score, 9)) for r in got], [(i, *votes_brute(t, licenses.PHRASES, licenses.NOTICES)) for i, t in rows])
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].labels == "mit" and by_id[3].base_labels == ""  # one word put in: two diagonals, one span
    assert by_id[4].labels == "apache" and by_id[4].score == 1.0
    assert by_id[1].labels == "gpl,reserved" and by_id[8].score == 0.0


def votes_brute(text, phrases, notices):
    """Labels and score by all pairs of places: diagonals, neighbours merged, shares of pairs."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    labels, score = set(), 0.0
    for number, (label, said) in enumerate([*phrases, *notices]):
        t = said.split()
        held = defaultdict(set)
        for q in range(len(t) - 1):
            for p in range(len(w) - 1):
                if w[p : p + 2] == t[q : q + 2]:
                    held[p - q].add(q)
        spans, last = [], None
        for d in sorted(held):
            if last is None or d - last > licenses.MAX_SHIFT:
                spans.append(set())
            spans[-1] |= held[d]
            last = d
        best = max((len(s) / (len(t) - 1) for s in spans), default=0.0)
        score = max(score, best)
        whole = any(len(s) == len(t) - 1 for s in held.values())
        if whole if number < len(phrases) else best >= licenses.LEAST_SHARE:
            labels.add(label)
    return ",".join(sorted(labels)), round(score, 9)


@pytest.mark.parametrize("first", [2000, 3])
def test_whole_license_texts(spark, monkeypatch, first):
    """Templates of hundreds of words, whole, with words dropped, cut short, and a base phrase of over 64 words."""
    import random

    rng = random.Random(4)
    monkeypatch.setattr(licenses, "MAX_FIRST", first)
    text = lambda n: [rng.choice(("the", "work", "of", "you", "may")) if rng.random() < 0.4 else f"w{rng.randint(0, 400)}" for _ in range(n)]
    long, phrase = text(700), text(130)
    notices = [("long", " ".join(long)), ("mit", "released under the mit license")]
    dropped = [x for i, x in enumerate(long) if i % 40]
    texts = [" ".join(t) for t in (long, text(50) + dropped + text(9), long[:500], long[:600], text(300), phrase + phrase, phrase[:-1])]
    docs = spark.createDataFrame([(i, t.upper()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, [("base", " ".join(phrase))], notices).collect()}
    for i, t in enumerate(texts):
        assert (got[i].labels, round(got[i].score, 9)) == votes_brute(t, [("base", " ".join(phrase))], notices), i
    assert got[0].labels == got[1].labels == got[3].labels == "long" and got[2].labels == "" and got[0].score == 1.0
    assert (got[5].base_labels, got[5].n_base, got[5].first_word, got[5].last_word) == ("base", 2, 0, 130)
    assert (got[6].base_labels, got[6].n_base) == ("", 0)


# 10. Sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, docs_dir, doc_rows):
    got = sharding.query(spark, docs_dir).collect()
    expect = []
    for i, t, *_ in doc_rows:
        raw = (t or "").encode()
        key = 42 if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
        shard = (jump(key, 40), jump(key, 41))
        expect.append((i, len(raw) + 16, zlib.crc32(raw), "key", *shard))
    same([(r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got], expect)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_grow(spark):
    from pyspark.sql import functions as F

    keys = spark.range(4000).select(F.xxhash64("id").alias("k"))
    for n in (1, 2, 9, 40, 100, 1000):
        rows = keys.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).select("k", "s.*").collect()
        assert all((r.shard, r.grown_shard) == (jump(r.k % 2**64, n), jump(r.k % 2**64, n + 1)) for r in rows)


def test_sharding_keeps_columns(spark, docs_dir):
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    sharded = sharding.shard_documents(docs, 5)
    assert sharded.count() == docs.count()
    assert set(docs.columns) <= set(sharded.columns) and len(set(sharded.columns)) == len(sharded.columns)


def test_sharding_tables_without_files(spark):
    """Tables that are not read from files, with clashing columns and a dotted name."""
    docs = spark.createDataFrame(
        [(i, "t" * (i % 5), "x", 1, 2.0) for i in range(200)], "doc_id long, text string, shard string, slot int, `a.b` double"
    )
    got = sharding.shard_documents(docs, 3)
    assert got.columns == ["doc_id", "text", "a.b", "shard", "slot", "grown_shard"]
    for shard in range(3):
        slots = sorted(r.slot for r in got.collect() if r.shard == shard)
        assert slots == list(range(len(slots)))
