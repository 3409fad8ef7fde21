from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score double"


def word(rng: random.Random) -> str:
    return "".join(rng.choice(("ta", "re", "on", "the", "ing", "é", "Or", "st", "x")) for _ in range(rng.randint(1, 4)))


def prose(rng: random.Random, n: int) -> str:
    return "".join(word(rng) + rng.choice((" ", " ", " ", ", ", ".\n", "  ")) for _ in range(n))


@pytest.fixture(scope="session")
def doc_rows():
    """Documents with nulls, empty, blank and very long texts, repeated rows and ids, copies, shared passages."""
    rng = random.Random(7)
    passage = prose(rng, 40)
    rows = []
    for i in range(120):
        body = prose(rng, rng.randint(1, 150))
        if i % 3 == 0:
            body = body + passage + prose(rng, 20)
        rows.append([i, body, rng.choice(("en", "fr", None)), "s0" if i % 3 else f"s{i % 7}"])
    rows += [[200 + i, rows[5][1], "en", "s0"] for i in range(30)]  # copies
    rows += [[300 + i, rows[9][1] + f" tail{i}", "en", "s1"] for i in range(10)]  # near copies
    rows += [
        [400, None, None, None],
        [401, "", "en", "s2"],
        [402, " \n\t ", "en", None],
        [403, "one", "en", "é"],
        [404, "one two", "en", "Z"],
        [405, prose(rng, 40_000), "en", "s0"],  # very long
        [406, "\x1c\x85 a b c d", "en", "s2"],
        [None, "no id here at all " * 9, "en", "s2"],
        [None, passage, "en", "s2"],
        [7, "same id other text " * 5, "en", "s3"],
        [9, rows[9][1], rows[9][2], rows[9][3]],  # the whole row again
        [407, "w " * 300, "en", "s3"],
    ]
    return [(i, t, lang, s, len(t or ""), "clash", 1.5) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def docs_dir(spark, doc_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(doc_rows, DOCS).repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    tables = {
        "documents": DOCS,
        "pages": "page_id long, url string, html string",
        "embeddings": "vec_id long, embedding array<float>, label int",
        "conversations": "conv_id long, turn long, role string, text string",
        "benchmark": "item_id long, text string",
    }
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return path
