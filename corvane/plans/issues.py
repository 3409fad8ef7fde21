"""Queries on citations, recognition, novelty, cards and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import audit as A
from corvane.operators import golden as Q
from corvane.operators import issues as I
from corvane.plans.catalogue import register
from corvane.plans.scoring import _TOK
from corvane.plans.signals import _CANON
from corvane.sources.tables import spread, table
from corvane.storage import materialise


@register(
    "cited_results",
    f"""WITH r AS (SELECT {_CANON} AS url, page_id FROM pages WHERE starts_with(url, 'https://') AND (lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) LIKE '%.example.org')),
f AS (SELECT url, arg_min('t' || page_id, page_id) AS title FROM r GROUP BY url), c AS (SELECT {_CANON} AS url, 'c' || page_id % 3 AS text FROM pages WHERE page_id % 2 = 0)
SELECT f.url, title, array_to_string(list_sort(list(DISTINCT text)), ',') AS cited FROM f JOIN c ON f.url = c.url GROUP BY f.url, title""",
)
def cited_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    results = pages.select("url", F.concat(F.lit("t"), "page_id").alias("title"), F.col("page_id").alias("pos"))
    citations = pages.filter("page_id % 2 = 0").select("url", F.concat(F.lit("c"), F.col("page_id") % 3).alias("text"))
    found = I.cited_results(results, citations, ["example.org"])
    return found.select("url", "title", F.array_join("cited", ",").alias("cited"))


@register(
    "ocr_replay",
    """WITH p AS (SELECT doc_id, sha256(substr(text, 1, 50)) AS checksum FROM documents),
r AS (SELECT DISTINCT sha256(substr(text, 1, 50)) AS checksum FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, CASE WHEN r.checksum IS NULL THEN 'provider_error' END AS failure FROM p LEFT JOIN r ON p.checksum = r.checksum""",
)
def ocr_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    checksum = F.sha2(F.substring("text", 1, 50), 256).alias("checksum")
    recorded = docs.filter("doc_id % 3 = 0").select(checksum, F.lit("text").alias("text")).distinct()
    return I.replay_recognition(docs.select("doc_id", checksum), recorded).select("doc_id", "failure")


@register(
    "ocr_merge",
    """SELECT conv_id AS doc, turn AS page, CASE WHEN turn % 2 = 0 THEN 'not_eligible' WHEN turn % 3 = 0 THEN 'not_attempted' WHEN turn = 1 THEN 'adopted' ELSE 'adopted' END AS decision,
  length(CASE WHEN turn % 2 = 1 AND turn % 3 <> 0 THEN text || 'x' WHEN turn % 2 = 1 THEN '' ELSE text END)::INT AS n FROM conversations""",
)
def ocr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other turn is blank in the base; of these, each third has no recognised page."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    odd = F.col("page") % 2 == 1
    pages = turns.select("doc", "page", F.when(odd, "").otherwise(F.col("text")).alias("text"), odd.alias("requires_ocr"), F.lit("ready").alias("status"))
    recognised = turns.filter("page % 3 <> 0").select(
        "doc", "page", F.concat("text", F.lit("x")).alias("ocr"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("failure")
    )
    return I.recognise(pages, recognised).select("doc", "page", "decision", F.length("text").alias("n"))


@register(
    "planning_cards",
    """WITH a AS (SELECT o_orderkey, [o_custkey, o_custkey + 1, -1] AS e, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F'),
x AS (SELECT o_orderkey, unnest(e) AS id, unnest([0, 1, 2]) AS pos FROM a), k AS (SELECT x.*, c_custkey % 2 = 0 AS pub FROM x JOIN customer ON id = c_custkey),
l AS (SELECT o_orderkey, list(id ORDER BY pos) FILTER (WHERE pub) AS p, list(id ORDER BY pos) FILTER (WHERE NOT pub) AS q FROM k GROUP BY o_orderkey)
SELECT a.o_orderkey AS candidate_id, coalesce(array_to_string(p_, ','), '') AS publications, CASE WHEN len(p_) > 0 AND len(q_) > 0 THEN 'sufficient' WHEN len(p_) > 0 OR len(q_) > 0 THEN 'partial' ELSE 'missing' END AS sufficiency,
  CASE WHEN a.p = '1-URGENT' THEN 2 END AS outline_size FROM a LEFT JOIN (SELECT o_orderkey, p AS p_, q AS q_ FROM l) l ON a.o_orderkey = l.o_orderkey""",
)
def planning_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    approved = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("candidate_id"),
        F.col("o_orderpriority").alias("output_type"),
        F.array(F.col("o_custkey"), F.col("o_custkey") + 1, F.lit(-1)).alias("evidence"),
    )
    known = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "publication").otherwise("external").alias("kind")
    )
    cards = I.planning_cards(approved, known, {"1-URGENT": ["question", "answer"]})
    return cards.select(
        "candidate_id",
        F.coalesce(F.array_join(F.col("publication_ids").cast("array<string>"), ","), F.lit("")).alias("publications"),
        "sufficiency",
        F.when(F.col("outline").isNotNull(), F.size("outline")).alias("outline_size"),
    )


@register(
    "question_flags",
    f"""WITH q AS (SELECT item_id, split_part(text, '.', 1) AS question, split_part(text, '.', 2) AS answer, item_id % 3 <> 0 AS mapped, item_id % 5 = 0 AS abstention FROM benchmark),
t AS (SELECT *, {_TOK.format('question')} AS a, {_TOK.format('answer')} AS b FROM q), d AS (SELECT DISTINCT unnest({_TOK.format('text')}) AS token FROM documents),
h AS (SELECT item_id, count(*) AS held FROM (SELECT item_id, unnest(a) AS token FROM t WHERE abstention) x JOIN d ON x.token = d.token GROUP BY item_id)
SELECT t.item_id AS id, array_to_string(list_filter([CASE WHEN len(b) > 0 AND len(list_intersect(b, a))::DOUBLE / len(b) > 0.5 THEN 'answer_leak' END,
  CASE WHEN ends_with(rtrim(question), 'the') OR ends_with(rtrim(question), 'of') THEN 'templated' END, CASE WHEN NOT mapped AND NOT abstention THEN 'unmapped_document' END,
  CASE WHEN abstention AND len(a) > 0 AND coalesce(held, 0)::DOUBLE / len(a) > 0.9 THEN 'trap_topic_present' END], lambda x: x IS NOT NULL), ',') AS flags FROM t LEFT JOIN h ON t.item_id = h.item_id""",
)
def question_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: F.split_part("text", F.lit("."), F.lit(n))
    k = F.col("item_id")
    questions = table(spark, sf_dir, "benchmark").select(
        k.alias("id"), part(1).alias("question"), part(2).alias("answer"), (k % 3 != 0).alias("mapped"), (k % 5 == 0).alias("abstention")
    )
    tokens = spread(table(spark, sf_dir, "documents")).select(F.explode(X.content_tokens(F.col("text"))).alias("token"))
    flags = I.question_flags(questions, ["the", "of"], tokens)
    return flags.select("id", F.array_join("flags", ",").alias("flags"))


@register(
    "question_audit",
    f"""WITH t AS (SELECT item_id AS id, split_part(text, '.', 1) AS question, item_id % 5 = 0 AS abstention, {_TOK.format("split_part(text, '.', 1)")} AS a, {_TOK.format("split_part(text, '.', 2)")} AS b, {_TOK.format('text')} AS w FROM benchmark),
pages AS (SELECT doc_id, length(text) AS size, {_TOK.format('text')} AS s FROM documents WHERE contains(text, 'license')::INT + contains(text, 'reserved')::INT < 2),
h AS (SELECT id, doc_id, size, count(*) AS hits FROM (SELECT id, unnest(w) AS token FROM t) x JOIN (SELECT doc_id, size, unnest(s) AS token FROM pages) d ON x.token = d.token GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, size DESC, doc_id) AS place FROM h QUALIFY place <= 3),
accepted AS (SELECT top.id, list_distinct(flatten(list(s))) AS held FROM top JOIN pages ON top.doc_id = pages.doc_id JOIN t ON t.id = top.id WHERE 2 * hits >= len(w) GROUP BY top.id),
known AS (SELECT DISTINCT unnest({_TOK.format('text')}) AS token FROM documents),
trap AS (SELECT id, count(*) AS n FROM (SELECT id, unnest(a) AS token FROM t WHERE abstention) x JOIN known ON x.token = known.token GROUP BY id),
near AS (SELECT x.id, list(y.id ORDER BY y.id) AS ids FROM t x JOIN t y ON x.id < y.id AND len(x.a) > 0 AND len(y.a) > 0
  AND len(list_intersect(x.a, y.a))::DOUBLE / len(list_distinct(list_concat(x.a, y.a))) >= 0.5 GROUP BY x.id),
g AS (SELECT t.*, held, ids, CASE WHEN NOT abstention AND held IS NOT NULL AND len(b) > 0 THEN len(list_intersect(b, held))::DOUBLE / len(b) END AS share, coalesce(n, 0) AS n
  FROM t LEFT JOIN accepted ON t.id = accepted.id LEFT JOIN trap ON t.id = trap.id LEFT JOIN near ON t.id = near.id),
f AS (SELECT id, round(share, 6) AS grounding, list_filter([CASE WHEN share < 0.9 THEN 'low_grounding' END, CASE WHEN len(b) > 0 AND len(list_intersect(b, a))::DOUBLE / len(b) > 0.5 THEN 'answer_leak' END,
  CASE WHEN ends_with(rtrim(question), 'the') OR ends_with(rtrim(question), 'of') THEN 'templated' END, CASE WHEN held IS NULL AND NOT abstention THEN 'unmapped_document' END,
  CASE WHEN abstention AND len(a) > 0 AND n::DOUBLE / len(a) > 0.9 THEN 'trap_topic_present' END, CASE WHEN ids IS NOT NULL THEN 'near_duplicate' END], lambda x: x IS NOT NULL) AS fl, array_to_string(ids, ',') AS near_duplicates FROM g)
SELECT id, grounding, array_to_string(fl, ',') AS flags, near_duplicates, row_number() OVER (ORDER BY len(fl) DESC, id)::BIGINT AS risk_rank FROM f""",
)
def question_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of the benchmark: its pages come from the data, by the tokens they share with the whole item."""
    part = lambda n: F.split_part("text", F.lit("."), F.lit(n))
    k = F.col("item_id")
    items = table(spark, sf_dir, "benchmark")
    questions = items.select(k.alias("id"), part(1).alias("question"), part(2).alias("answer"), (k % 5 == 0).alias("abstention"))
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    front = A.is_front_matter(F.col("text"), ("license", "reserved"))
    sets = docs.select("doc_id", F.length("text").alias("size"), front.alias("front"), X.content_tokens(F.col("text")).alias("tokens"))
    sets = materialise(sets, "audit-tokens")
    pages = sets.filter("NOT front").select(F.col("doc_id").alias("page"), "size", "tokens")
    asked = items.select(k.alias("question"), X.content_tokens(F.col("text")).alias("tokens"))
    proposed = Q.page_proposals(asked, pages, 3).join(asked, "question").filter(2 * F.col("hits") >= F.size("tokens"))
    accepted = proposed.select(F.col("question").alias("id"), F.col("page").alias("doc_id")).join(docs, "doc_id").select("id", "text")
    tokens = sets.select(F.explode("tokens").alias("token"))
    audit = A.audit_questions(questions, accepted, tokens, ["the", "of"], grounded=0.9, near=0.5)
    return audit.select(
        "id",
        F.round("grounding", 6).alias("grounding"),
        F.array_join("flags", ",").alias("flags"),
        F.array_join(F.col("near_duplicates").cast("array<string>"), ",").alias("near_duplicates"),
        "risk_rank",
    )


@register("novelty_cap")
def novelty_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates; the part before and the part after as similar publications."""
    parts = table(spark, sf_dir, "part")
    candidates = parts.select(F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("title"), F.lit(80.0).alias("novelty"))
    near = lambda step, pos: parts.select(
        (F.col("p_partkey") + step).alias("candidate_id"), F.lit(pos).alias("pos"), F.col("p_partkey").alias("publication_id"), F.col("p_name").alias("title")
    )
    return I.cap_novelty(candidates, near(1, 0).unionByName(near(-1, 1)))


@register("retry_count", "SELECT sum(greatest(user_id % 4 - 1, 0))::BIGINT AS retries FROM events")
def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(I.retry_count(F.col("user_id") % 4).alias("retries"))
