"""The question audit: one row for each flag and each way not to have it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import audit as A


def test_audit(spark):
    questions = [
        (1, "what does the drone carry", "a camera and sensors", False),
        (2, "what does the drone carry today", "camera sensors radar", False),  # near 1
        (3, "say the camera sensors radar of", "camera sensors radar", False),  # leak, templated, no page
        (4, "is there a submarine fleet", "none", True),  # the corpus holds it all
        (5, "is there an unknown thing", "none", True),
        (6, None, None, False),
        (7, "pages that hold nothing", "wholly different words", False),
    ]
    q = spark.createDataFrame(questions, "id int, question string, answer string, abstention boolean")
    accepted = spark.createDataFrame([(1, "a CAMERA here"), (1, "and there sensors"), (2, "camera"), (5, "x"), (7, None)], "id int, text string")
    tokens = spark.createDataFrame([(t,) for t in "is there submarine fleet is".split()], "token string")
    decided = spark.createDataFrame([(2,), (2,)], "id int")
    got = {r.id: r for r in A.audit_questions(q, accepted, tokens, ["of"], decided).collect()}
    flags = {k: list(r.flags) for k, r in got.items()}
    assert flags == {
        1: ["near_duplicate"],
        2: ["low_grounding"],
        3: ["answer_leak", "templated", "unmapped_document"],
        4: ["trap_topic_present"],
        5: [],
        6: ["unmapped_document"],
        7: ["low_grounding"],
    }
    assert got[1].grounding == 1.0 and abs(got[2].grounding - 1 / 3) < 1e-12 and got[5].grounding is None and got[7].grounding == 0
    assert list(got[1].near_duplicates) == [2] and got[2].near_duplicates is None
    assert [r.id for r in sorted(got.values(), key=lambda r: r.risk_rank)] == [3, 1, 2, 4, 6, 7, 5]
    assert [k for k, r in got.items() if r.decided] == [2]


def test_front_matter(spark):
    texts = ["발행처 ISSN", "발행처 only", None, "ISSN 발행인 편집장"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(A.is_front_matter(F.col("t")).alias("f"))
    assert [r.f for r in df.collect()] == [True, False, False, True]


def test_accepted_drafts(spark):
    drafts = spark.createDataFrame([("a", "e1"), ("b", "e2")], "case_id string, expected_evidence string")
    verdicts = spark.createDataFrame([("a", " Accept", "fact"), ("b", "reject", "fact"), ("c", "accept", None), ("d", "accept", "abstention"), ("e", None, "fact")], "case_id string, verdict string, query_slice string")
    decided = spark.createDataFrame([("c",)], "case_id string")
    got = {r.case_id: (r.expected_evidence, r.decision_basis) for r in A.accepted_drafts(drafts, verdicts, "case_id", ["expected_evidence"], decided).collect()}
    assert got == {"a": ("e1", ""), "c": (None, "(decided)")}
