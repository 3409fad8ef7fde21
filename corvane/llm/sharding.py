"""Sharding by jump consistent hashing.

A key's shard follows from the key and the number of shards alone; no ring table is kept. Going from
n to n + 1 shards moves a key only if it moves into the new shard, which about 1 in n + 1 do. All of
it is built from integer and bit expressions, so it stays in the JVM.

Edge cases: a null key is hashed like any other value (it has a shard of its own choosing, always the
same). A null text counts as empty. Repeated rows get the same shard and different slots. An empty
table gives an empty result. Columns of the input that clash with the added ones are replaced.

Slots follow the order of training where there is one: a table read from files is numbered by the order of its files
and of the rows in them, which is that of the sort that wrote it. Any other table is numbered by a hash.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.prefix_sums import hash_digits, running_total
from corvane.storage import materialise

#: Multiplier of the linear congruential generator of the published algorithm.
MULTIPLIER = 2862933555777941757
_LOW32 = 0xFFFFFFFF


def _product_low32(x: Column, factor: int) -> Column:
    """Low 32 bits of x * factor for 0 <= x, factor < 2**32, without 64-bit overflow."""
    high = (x * F.lit(factor >> 16)).bitwiseAND(F.lit(0xFFFF))
    return x * F.lit(factor & 0xFFFF) + F.shiftleft(high, 16)


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64, the key given as two unsigned 32-bit halves."""
    a_hi, a_lo = MULTIPLIER >> 32, MULTIPLIER & _LOW32
    cross = lo * F.lit(a_lo >> 16)
    low = lo * F.lit(a_lo & 0xFFFF) + F.shiftleft(cross.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(cross, 16)
    high = carry + _product_low32(hi, a_lo) + _product_low32(lo, a_hi)
    return high.bitwiseAND(F.lit(_LOW32)), low.bitwiseAND(F.lit(_LOW32))


def jump_hash(key: Column, n_shards: int) -> Column:
    """Struct (shard, grown_shard) of a 64-bit key: its shard among ``n_shards`` and among one more.

    The walk visits candidate shards in rising order, about ln(n_shards) of them. Nearly all keys end within the first
    steps; the rest of ``n_shards`` steps, which always suffice, are taken only by keys that have not.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(_LOW32)).alias("lo"),
        zero.alias("b"),
        zero.alias("j"),
    )

    def step(state: Column, _: Column) -> Column:
        hi, lo = _advance(state["hi"], state["lo"])
        jump = (state["j"] + 1).cast("double") * (
            F.lit(float(1 << 31)) / (F.shiftrightunsigned(hi, 1) + 1).cast("double")
        )
        moved = F.struct(
            hi.alias("hi"), lo.alias("lo"), state["j"].alias("b"), F.floor(jump).cast("long").alias("j")
        )
        return F.when(state["j"] < n_shards, moved).otherwise(state)

    few = min(n_shards, math.ceil(3 * math.log(n_shards)) + 8) if n_shards > 1 else 1
    walk = lambda n, state: F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, step)
    # An array of one state, so that it is worked out once whatever mentions it.
    end = F.array(walk(few, start))
    if few < n_shards:
        end = F.transform(end, lambda s: F.when(s["j"] < n_shards, walk(n_shards - few, s)).otherwise(s))
    return F.transform(
        end,
        lambda s: F.struct(
            s["b"].cast("int").alias("shard"),
            F.when(s["j"] == n_shards, F.lit(n_shards)).otherwise(s["b"]).cast("int").alias("grown_shard"),
        ),
    )[0]


def assign_shards(docs: DataFrame, n_shards: int, key: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``grown_shard`` by the stable column ``key``; no rows move."""
    jumped = docs.drop("shard", "grown_shard").withColumn("__jump", jump_hash(F.xxhash64(F.col(key)), n_shards))
    return jumped.select("*", "__jump.shard", "__jump.grown_shard").drop("__jump")


def number_slots(sharded: DataFrame, narrow: list[str], n_rows: int) -> DataFrame:
    """Add ``slot``: gapless numbers from 0 in each shard, in the order of a hash of the ``narrow``
    columns. A shard is numbered in buckets, so no task holds a whole shard."""
    mark = F.lpad(F.hex(F.xxhash64(*[F.col(c) for c in narrow])), 16, "0")
    rows = sharded.drop("slot").withColumn("__mark", mark)
    total = running_total(
        rows,
        ["shard"],
        "__mark",
        narrow,
        F.lit(1).cast("long"),
        "slot",
        hash_digits(n_rows),
        compact=rows.select("shard", "__mark"),
    )
    return total.drop("__mark")


def number_in_order(sharded: DataFrame, file: str, row: str) -> DataFrame:
    """Add ``slot``: gapless numbers from 0 in each shard, by the columns ``file`` and ``row``, which are not null. A
    shard is numbered file by file, so no task holds a whole shard."""
    rows = sharded.withColumn("__mark", F.col(file))
    return running_total(
        rows, ["shard"], "__mark", [row], F.lit(1).cast("long"), "slot", 0, rows.select("shard", "__mark"), F.col("__mark")
    ).drop("__mark")


def _stored(docs: DataFrame) -> DataFrame | None:
    """``docs`` with its file, named so that files sort as they were written, and its row there; None without files."""
    number = F.lpad(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1), 10, "0")
    try:
        return docs.select(
            *[F.col(f"`{c}`") for c in docs.columns],
            F.concat(number, "_metadata.file_path").alias("__file"),
            F.col("_metadata.row_index").alias("__row"),
        )
    except AnalysisException:
        return None


def shard_documents(docs: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``shard``, ``grown_shard`` and ``slot``."""
    added = ["shard", "slot", "grown_shard"]
    stored = _stored(docs)
    if stored is not None:
        numbered = number_in_order(assign_shards(stored, n_shards, key).drop("slot"), "__file", "__row")
    else:
        sharded = assign_shards(docs, n_shards, key).withColumn("__crc", F.crc32(F.coalesce(F.col(text), F.lit(""))))
        numbered = number_slots(sharded, [key, "__crc"], docs.count())
    return numbered.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and grown shard of every document among 40 shards, by the ``key`` law."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    sharded = materialise(assign_shards(docs, 40), "sharded")
    slots = number_slots(sharded, ["doc_id", "text_crc32"], sharded.count())
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard"
    )


#: DuckDB has no CRC-32; tests/llm holds the query against a brute-force version.
ORACLE_SQL = None
