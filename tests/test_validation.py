from datetime import date

from pyspark.sql import functions as F

from groundwork.operators import curation, validation
from groundwork.operators.validation import BASIS

PLACE = r"^CH(-[A-Z]{2}(-[0-9]{1,4})?)?$"
KINDS = {
    "documents": "document_id string, institution_id string, accessed_on date, content_sha256 string, raw_sha256 string",
    "topics": "topic_id string",
    "concepts": "concept_id string, topic_id string, label string, description string, fact_ids array<string>, jurisdictions array<string>, required_context array<string>, context_schema map<string,array<string>>",
    "facts": f"fact_id string, concept_id string, statement string, jurisdiction string, valid_from date, valid_through date, condition map<string,string>, evidence_ids array<string>, kind string, review_status string, basis {BASIS}",
    "evidence": f"evidence_id string, document_id string, start int, end int, excerpt string, excerpt_sha256 string, language string, content_sha256 string, raw_sha256 string, institution_id string, basis {BASIS}",
    "institutions": "institution_id string, name string, level string, jurisdiction string",
}
DAY, SHA = date(2026, 1, 1), "688787d8ff144c502c7f5cffaafe2cc588d86079f9de88304c26b0cb99ce91c6"  # of "asd"
ACT, GUIDE = ("federal", "act", "AIG, Art. 2", None, "Federal act: AIG, Art. 2"), ("cantonal", "guidance", None, None, "Cantonal authority guidance")


def good():
    return {
        "documents": [["d1", "i1", DAY, "c1", "r1"], ["d2", "i2", DAY, "c2", "r2"]], "topics": [["t1"]],
        "concepts": [["k1", "t1", "l", "d", ["f1"], ["CH"], ["age"], {"age": ["1", "2"], "free": None}], ["k2", "t1", "l", "d", ["f2"], ["CH-ZH-261"], None, None]],
        "facts": [["f1", "k1", "s", "CH", DAY, None, {"age": "1", "free": "any"}, ["e1"], "curated-statement", "human-reviewed", ACT], ["f2", "k2", "s", "CH-ZH-261", None, None, None, ["e2", "e1"], "curated-statement", "human-reviewed", ACT]],
        "evidence": [["e1", "d1", 0, 3, "asd", SHA, "de", "c1", "r1", "i1", ACT], ["e2", "d2", 5, 8, "asd", SHA, "fr", "c2", "r2", "i2", GUIDE]],
        "institutions": [["i1", "Bund", "federal", "CH"], ["i2", "Kanton", "cantonal", "CH-ZH"]],
    }


MANIFEST = validation.Manifest(["CH", "CH-ZH-261"], ["de", "fr"], DAY, {"curated-statement": 2}, {"human-reviewed": 2}, {"federal": 1, "cantonal": 1}, {"act": 2})


def issues(spark, parts, manifest=MANIFEST):
    frames = validation.Release(**{k: spark.createDataFrame([tuple(r) for r in rows], KINDS[k]) for k, rows in parts.items()})
    return {(r.rule, r.key) for r in validation.release_issues(frames, manifest, PLACE).collect()}


def test_a_sound_release_and_one_fault_at_a_time(spark):
    assert issues(spark, good()) == set()
    faults = [
        (("documents", 0, 1, None), {("document.no_institution", "d1"), ("institution.uncited", "i1"), ("evidence.institution", "e1"), ("manifest.institution_levels", "manifest")}),
        (("documents", 0, 2, date(2026, 2, 1)), {("document.accessed", "d1")}),
        (("documents", 1, 3, "x"), {("evidence.content_hash", "e2")}),
        (("documents", 1, 4, "x"), {("evidence.raw_hash", "e2")}),
        (("concepts", 0, 1, "t9"), {("concept.topic", "k1")}),
        (("concepts", 0, 2, " "), {("concept.text", "k1")}),
        (("concepts", 0, 4, ["f1", "f9"]), {("concept.fact", "k1")}),
        (("concepts", 0, 4, ["f1", "f2"]), {("fact.concept", "f2")}),
        (("concepts", 0, 5, ["CH", "CH-ZH"]), {("concept.jurisdictions", "k1")}),
        (("concepts", 0, 6, ["age", "sex"]), {("concept.context", "k1")}),
        (("facts", 0, 2, ""), {("fact.statement", "f1")}),
        (("facts", 0, 5, date(2025, 1, 1)), {("fact.validity", "f1")}),
        (("facts", 0, 6, {"sex": "1"}), {("fact.condition_field", "f1")}),
        (("facts", 0, 6, {"age": "3"}), {("fact.condition_value", "f1")}),
        (("facts", 0, 7, ["e1", "e9"]), {("fact.evidence", "f1")}),
        (("facts", 1, 7, ["e1"]), {("evidence.uncited", "e2")}),
        (("facts", 1, 10, GUIDE), {("fact.basis", "f2"), ("manifest.basis_kinds", "manifest")}),
        (("facts", 0, 8, "model-candidate"), {("manifest.provenance_kinds", "manifest")}),
        (("facts", 0, 1, "k9"), {("fact.unknown_concept", "f1"), ("fact.condition_field", "f1"), ("fact.concept", "f1"), ("concept.jurisdictions", "k1")}),
        (("evidence", 0, 3, 4), {("evidence.offsets", "e1")}),
        (("evidence", 0, 5, "0"), {("evidence.excerpt_hash", "e1")}),
        (("evidence", 0, 6, "de-CH"), {("evidence.language", "e1")}),
        (("evidence", 0, 6, "it"), {("evidence.undeclared_language", "e1")}),
        (("evidence", 1, 1, "d9"), {("evidence.document", "e2"), ("document.uncited", "d2")}),
        (("evidence", 1, 10, None), {("evidence.basis", "e2")}),
        (("evidence", 1, 10, ("cantonal", "guidance", None, None, "Guidance")), {("evidence.label", "e2")}),
        (("evidence", 1, 10, ("cantonal", "directive", " ", None, "x")), {("evidence.norm", "e2")}),
        (("evidence", 0, 0, "e 1"), {("evidence.id", "e 1"), ("evidence.uncited", "e 1"), ("fact.evidence", "f1"), ("fact.evidence", "f2"), ("fact.basis", "f1"), ("fact.basis", "f2")}),
        (("institutions", 1, 3, "CH-BE"), {("fact.institution", "f2")}),
        (("institutions", 1, 3, "zh"), {("institution.jurisdiction", "i2"), ("fact.institution", "f2")}),
        (("institutions", 1, 2, "municipal"), {("institution.level", "i2"), ("manifest.institution_levels", "manifest")}),
        (("institutions", 1, 1, None), {("institution.name", "i2")}),
        (("topics", 0, 0, "t2"), {("concept.topic", "k1"), ("concept.topic", "k2")}),
    ]
    ids = {"documents": [0, 1], "topics": [0], "concepts": [0, 1, 4], "facts": [0, 1, 7], "evidence": [0, 1, 9], "institutions": [0]}
    every = {k: [] for k in good()}
    for n, ((part, row, column, value), _) in enumerate(faults):  # a release of releases, each with a fault of its own
        parts = good()
        parts[part][row][column] = value
        named = lambda v: v if v is None else [f"n{n}.{x}" for x in v] if isinstance(v, list) else f"n{n}.{v}"  # noqa: B023, E731
        for k, rows in parts.items():
            every[k] += [[named(v) if c in ids[k] else v for c, v in enumerate(r)] for r in rows]
    found = [set() for _ in faults]
    for rule, key in issues(spark, every):
        if key != "manifest":
            n, own = key.split(".", 1)
            found[int(n[1:])].add((rule, own))
    for (fault, want), have in zip(faults, found):
        assert have == {x for x in want if x[1] != "manifest"}, fault
    parts = good()
    parts["facts"].append(parts["facts"][0])
    stated = MANIFEST._replace(provenance_kinds={"curated-statement": 1}, institution_levels={"federal": 2}, basis_kinds={}, jurisdictions=["CH"])
    assert issues(spark, parts, stated) == {("fact.duplicate", "f1"), ("fact.undeclared_jurisdiction", "f2"), *((f"manifest.{x}", "manifest") for x in ("provenance_kinds", "review_statuses", "institution_levels", "basis_kinds"))}
    assert issues(spark, {k: [] for k in good()}, MANIFEST._replace(provenance_kinds={}, review_statuses={}, institution_levels={}, basis_kinds={})) == set()


def test_bases(spark):
    spec = "struct<level:string,kind:string,norm:string,refers_to:string>"
    rows = [
        (1, ("federal", "act", "AIG", None), ("cantonal", "summary", None, None), "cantonal", "Art. 4", "I"), (2, None, (None, "act", "AIG", None), "federal", "Art. 4", None), (3, None, (None, "treaty", "FZA", None), "federal", "Art. 4", "I"),
        (4, None, None, "municipal", "Art. 4", None), (5, None, None, None, None, None), (6, None, (None, "summary", None, "the AIG"), "federal", None, None), (7, None, (None, "act", None, None), None, None, None), (8, None, ("cantonal", "ordinance", " ", None), None, None, None),
        (9, None, (None, "directive", "Weisung 1", None), "federal", "Art. 4", None), (10, None, (None, "directory", None, None), "cantonal", None, None),
    ]
    df = spark.createDataFrame(rows, f"id int, own {spec}, page {spec}, level string, article string, annex string")
    got = {r.id: r.b for r in df.select("id", validation.basis_of(F.col("own"), F.col("page"), F.col("level"), F.col("article"), F.col("annex")).alias("b")).collect()}
    assert {i: (b.label, b.rule, b.error) for i, b in got.items()} == {
        1: ("Federal act: AIG", "citation", None), 2: ("Federal act: AIG, Art. 4", "page rule", None), 3: ("International agreement: FZA, Annex I, Art. 4", "page rule", None), 4: ("Municipal authority guidance", "default", None),
        5: (None, "none", None), 6: ("Portal summary of federal rules, referring to the AIG", "page rule", None), 7: (None, "page rule", "no level"), 8: (None, "page rule", "no norm"), 9: ("Federal directive: Weisung 1", "page rule", None),
        10: ("Cantonal authority directory", "page rule", None),
    }


def test_failures_by_what_they_say(spark):
    said = {
        "redirected to MAILTO:x@y": "mailto-redirect", "HTTP Error 403: Forbidden": "access-denied", "robots-disallowed": "access-denied", "[Errno 11001] getaddrinfo failed": "dns-failure", "SSL: CERTIFICATE_VERIFY_FAILED": "tls-certificate",
        "http 404": "not-found", "HTTP Error 410: Gone": "not-found", "redirect-out-of-scope: https://x": "redirect-out-of-scope", "response-too-large": "oversized", "HTTP Error 429": "rate-limited", "http error 503": "server-error",
        "The read operation timed out": "transient-network", "robots-unavailable": "robots-unavailable", "pending": "not-attempted", "still pending": "unclassified", "HTTP Error 403 then timed out": "access-denied", "http 404 after http error 500": "not-found",
    }
    got = spark.createDataFrame([(k,) for k in said] + [(None,)], "t string").select("t", curation.failure_class(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == said | {None: "not-attempted"}
