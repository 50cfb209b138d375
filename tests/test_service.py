"""Search, evidence and coverage on a release written by hand."""

import pytest

from groundwork.operators import service


@pytest.fixture(scope="module")
def release(spark):
    concepts = spark.createDataFrame(
        [
            ("permit", "t1", "Residence permit", "Stay in the country", ["Aufenthaltsbewilligung"], ["Who needs a permit?"], ["CH"]),
            ("waste", "t1", "Waste collection", "Days of collection", ["Kehricht", "Abfall"], [], ["CH-ZH"]),
            ("dog", "t2", "Dog tax", "Yearly tax for dogs", ["Hundesteuer"], [], ["CH-BE"]),
        ],
        "concept_id string, topic_id string, label string, description string, aliases array<string>, questions array<string>, jurisdictions array<string>",
    )
    facts = spark.createDataFrame(
        [("f1", "permit", "A permit lasts five years.", ["e1", "e2"], "curated", "human"), ("f2", "waste", "Bags go out on Monday.", ["e3"], "candidate", "derived"), ("f3", "dog", "The tax is due in May.", [], "section", "human")],
        "fact_id string, concept_id string, statement string, evidence_ids array<string>, provenance string, review string",
    )
    evidence = spark.createDataFrame([("e1", "u1", "summary"), ("e2", "u1", "act"), ("e3", "u2", "guidance")], "evidence_id string, url string, basis string")
    return concepts, facts, evidence


def test_search_words(spark, release):
    concepts, facts, evidence = release
    prior = service.authority(facts, evidence)
    assert {r.concept_id: round(r.prior, 4) for r in prior.collect()} == {"permit": 1.0, "waste": round(0.7 + 0.3 * 0.9 * 0.8 * 0.6, 4), "dog": round(0.7 + 0.3 * 0.9, 4)}
    queries = spark.createDataFrame([(1, "Aufenthaltsbewilligung verlängern", "CH-ZH"), (2, "When is Abfall collected?", "CH-ZH-261"), (3, "Hundesteuer", "CH-ZH"), (4, "quantum physics", None)], "query_id int, text string, place string")
    got = service.search(queries, concepts, facts, prior).collect()
    assert {(r.query_id, r.concept_id, r["rank"]) for r in got} == {(1, "permit", 1), (2, "waste", 1)}
    assert {r.verdict for r in got} == {"strong"}


def test_search_fused(spark, release):
    concepts, facts, evidence = release
    vectors = spark.createDataFrame([("permit", [1.0, 0.0]), ("waste", [0.0, 1.0]), ("dog", [0.6, 0.8])], "concept_id string, vector array<double>")
    asked = spark.createDataFrame([(1, [0.7, 0.7])], "query_id int, query_vector array<double>")
    queries = spark.createDataFrame([(1, "dog permit", None)], "query_id int, text string, place string")
    got = service.search(queries, concepts, facts, service.authority(facts, evidence), asked, vectors).orderBy("rank").collect()
    assert [r.concept_id for r in got] == ["dog", "permit", "waste"] and got[0].verdict == "strong"


def test_evidence_and_citations(spark, release):
    concepts, facts, evidence = release
    asked = spark.createDataFrame([(1, ["e3", "f1", "e1", "nothing"])], "request_id int, ids array<string>")
    assert [r.evidence_id for r in service.evidence_of(asked, facts, evidence).orderBy("place").collect()] == ["e3", "e1", "e2"]
    cited = {r.fact_id: r for r in service.citations(facts, evidence).collect()}
    assert cited["f1"].basis == "act" and cited["f1"].excerpts == 2 and "f3" not in cited


def test_coverage(spark, release):
    topics = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "topic_id string")
    got = {r.topic_id: (r.concepts, r.jurisdictions) for r in service.coverage_page(topics, release[0]).collect()}
    assert got == {"t1": (2, ["CH", "CH-ZH"]), "t2": (1, ["CH-BE"]), "t3": (0, [])}
