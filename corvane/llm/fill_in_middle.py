"""Fill-in-middle: texts cut into prefix, middle and suffix at the ends of units, by escaped marker injection.

The delimiter is one character. It and the escape character are first escaped inside the text, so that none is left;
``regexp_replace`` then puts one delimiter after every unit, the delimiters are counted, and ``substring_index`` takes
the first units up to a rank. What lies before the smaller of two ranks is the prefix, before the larger one the
middle, and the rest the suffix; each is unescaped and put together. No text is split into an array, so a text of any
number of units stays one string, and everything is a projection: no shuffle, no Python.

Cuts and forms come from a hash of the document's id, so they never depend on the order or place of rows:

``psm``    ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
``spm``    ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
``plain``  the text as it is: an empty text, one that holds a marker (it could not be told apart when read back), or one
           that the rate leaves out

Edge cases: a null text is empty, has no unit and is plain. A null id hashes as an empty string of digits. Repeated rows
get equal cuts and stay separate rows. Texts of one unit, or whose two cuts are equal, have empty parts. An empty table
gives an empty result. Columns that come along are kept, but for those with the name of a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: A line with its end, or the last line without one.
LINES = r"[^\n]*\n|[^\n]+"
#: Of 100 texts so many are cut, and so many of these are suffix first.
RATE, SPM_RATE = 100, 50
SEED = "7:"
#: Delimiter and escape character. Units are matched in the escaped text, where each of the two is the escape character
#: and a letter; a pattern of units must not part them.
DELIMITER, ESCAPE = "\x1e", "\x1b"
_DELIMITER_AS, _ESCAPE_AS = ESCAPE + "d", ESCAPE + "e"


def escape(text: Column) -> Column:
    """The text without any delimiter."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(_ESCAPE_AS))
    return F.replace(doubled, F.lit(DELIMITER), F.lit(_DELIMITER_AS))


def unescape(text: Column) -> Column:
    plain = F.replace(text, F.lit(_DELIMITER_AS), F.lit(DELIMITER))
    return F.replace(plain, F.lit(_ESCAPE_AS), F.lit(ESCAPE))


def _hash_word(digest: Column, i: int) -> Column:
    """The i-th 8-digit group (from 1) of a hexadecimal digest as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def _units(marked: Column) -> Column:
    """Marked text as plain text again."""
    return unescape(F.replace(marked, F.lit(DELIMITER), F.lit("")))


def cut_texts(
    docs: DataFrame,
    units: str = LINES,
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Add (n, form, prefix, middle, suffix, output) to every row: the number of units, the form, the three parts (null
    if plain) and the text to train on. ``units`` is a pattern whose matches, one after the other, cover any text and
    are never empty."""
    made = ("n", "form", "prefix", "middle", "suffix", "output")
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"), digest.alias("digest"))
    marked = rows.withColumn("marked", F.regexp_replace(escape(F.col("text")), units, f"$0{DELIMITER}"))
    counted = marked.withColumn("n", F.length("marked") - F.length(F.replace("marked", F.lit(DELIMITER), F.lit(""))))
    ranks = [(_hash_word(F.col("digest"), i) % (F.col("n") + 1)).cast("int") for i in (1, 2)]
    barred = F.col("text") == ""
    for marker in MARKERS:
        barred |= F.contains("text", F.lit(marker))
    chosen = counted.select(
        "row",
        "text",
        "marked",
        F.col("n").cast("long").alias("n"),
        F.least(*ranks).alias("first"),
        F.greatest(*ranks).alias("second"),
        F.when(barred | (_hash_word(F.col("digest"), 3) % 100 >= rate), "plain")
        .when(_hash_word(F.col("digest"), 4) % 100 < spm_rate, "spm")
        .otherwise("psm")
        .alias("form"),
    )
    is_cut = F.col("form") != "plain"
    # Of the marked text as much as the first ranks hold. A rank of n takes all but the last delimiter.
    heads = chosen.withColumn("two", F.when(is_cut, F.call_function("substring_index", "marked", F.lit(DELIMITER), F.col("second"))))
    heads = heads.withColumn("one", F.when(is_cut, F.call_function("substring_index", "two", F.lit(DELIMITER), F.col("first"))))
    after = lambda whole, head: F.substring(whole, F.length(head) + 1, F.length(whole))
    parts = heads.select(
        "row",
        "text",
        "n",
        "form",
        _units(F.col("one")).alias("prefix"),
        _units(after(F.col("two"), F.col("one"))).alias("middle"),
        F.when(is_cut, _units(after(F.col("marked"), F.col("two")))).alias("suffix"),
    )
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
    )
    return parts.select(*own, *made[:-1], output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a known form was made of."""
    # Both forms: a marker of three characters, a part, another marker, a part, <M>, the middle. No part holds a marker.
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.substring(output, F.length(head) + len(MIDDLE) + 1, F.length(output))
    turn = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    first = F.call_function("substring_index", F.substring(head, F.lit(len(PREFIX) + 1), F.length(head)), turn, F.lit(1))
    second = F.substring(head, F.length(first) + 2 * len(PREFIX) + 1, F.length(head))
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(first, middle, second))
        .otherwise(F.concat(second, middle, first))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut, formatted and rebuilt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut_texts(docs).select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
ranks AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n,
         ('0x' || substr(digest, 1, 8))::BIGINT % (len(units) + 1) AS a, ('0x' || substr(digest, 9, 8))::BIGINT % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN ('0x' || substr(digest, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS p,
         array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(units[greatest(a, b) + 1:], '') AS s
  FROM ranks)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
