from datetime import date

from groundwork.operators import acceptance as A


def filled(spark, kind, rows):
    names = [p.strip().split(" ")[0] for p in spark.createDataFrame([], kind).columns]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kind)


def test_steps_by_kind(spark):
    ok = {"status": "SUPPORTED", "gaps": ["period"], "bases": ["Federal act: AIG, Art. 2"]}
    cases = [
        ("search", {"expect_concept": "a", "expect_strength": "strong"}, {"hits": ["b", "a"], "strength": "strong"}, []),
        ("search", {"expect_concept": "z", "expect_strength": "strong", "expect_elsewhere": ["a", "e"]}, {"hits": ["b", "a"], "strength": "weak", "elsewhere": ["e"]}, ["concept", "strength", "elsewhere:a"]),
        ("search", {"expect_concept": "z", "retrieval": "hybrid"}, {"hits": [], "mode": "lexical"}, None), ("search", {"expect_concept": "z", "retrieval": "hybrid"}, {"hits": [], "mode": "hybrid"}, ["concept"]),
        ("search", {}, {"error": "INVALID_ARGUMENT"}, ["rejected"]), ("search", {}, None, ["rejected"]),
        ("resolve", {"expect_status": {"a": "SUPPORTED"}, "expect_gap": {"a": "period"}, "expect_basis": {"a": "Federal act: AIG"}, "expect_scope": "CH", "expect_not_recognised": []}, {"results": {"a": ok}, "scope": "CH"}, []),
        ("resolve", {"expect_status": {"a": "STALE", "b": "SUPPORTED"}, "expect_gap": {"a": "place"}, "expect_basis": {"a": "AIG"}, "expect_scope": "CH", "expect_not_recognised": ["city"]}, {"results": {"a": ok}, "scope": "CH-ZH", "not_recognised": ["canton"]}, ["scope", "not recognised", "status:a", "status:b", "gap:a", "basis:a"]),
        ("resolve", {"expect_error": "jurisdiction.city"}, {"error": "INVALID_ARGUMENT", "error_paths": ["jurisdiction.city"]}, []), ("resolve", {"expect_error": "jurisdiction.city"}, {"error": "INVALID_ARGUMENT", "error_paths": ["x"]}, ["rejected"]),
        ("resolve", {"expect_error": "jurisdiction.city"}, {"results": {}}, ["not rejected"]), ("resolve", {}, {"error": "TIMEOUT"}, ["rejected"]),
        ("lookup", {"expect_status": {"": "SUPPORTED"}, "expect_day": date(2026, 1, 5)}, {"served": True, "status": "SUPPORTED", "days": [date(2026, 1, 5), date(2026, 2, 1)]}, []),
        ("lookup", {"expect_status": {"": "SUPPORTED"}, "expect_gap": {"": "key"}, "expect_day": date(2026, 1, 5)}, {"served": True, "status": "STALE", "gaps": ["period"], "days": []}, ["status", "gap", "first day"]),
        ("lookup", {"expect_gap": {"": "key"}}, {"served": False}, None), ("lookup", {}, {"served": True, "error": "X"}, ["rejected"]),
    ]
    steps = filled(spark, A.STEPS, [{"case_id": "c", "step": n, "kind": k} | want for n, (k, want, _, _) in enumerate(cases)])
    answers = filled(spark, A.ANSWERS, [{"case_id": "c", "step": n} | a for n, (_, _, a, _) in enumerate(cases) if a is not None])
    got = {r.step: (r.judged, r.issues) for r in A.step_issues(steps, answers).collect()}
    assert got == {n: (want is not None, want or []) for n, (*_, want) in enumerate(cases)}


def test_claims_and_cases(spark):
    served = [("c1", "k", "f1", "You must REGISTER within\n14 days.", ["Fees  of cantons"]), ("c1", "k", "f2", "It costs nothing.", ["Fees  of cantons"]), ("c2", "k", "f3", "Other", None)]
    excerpts = [("f1", "Sie melden sich innert 14 Ta­gen an."), ("f1", "Anderes"), ("f2", "kostenlos")]
    claims = [
        (1, "c1", "k", None, ["register", "14 days"], ["innert 14 tagen"]), (2, "c1", "k", "f1", [], []), (3, "c1", "k", "f9", ["register"], []), (4, "c1", "k", None, ["register", "nothing"], []), (5, "c1", "k", None, ["register"], ["innert", "anderes"]),
        (6, "c1", "k", None, ["register"], ["kostenlos"]), (7, "c2", "k", None, ["register"], []), (8, "c2", "x", None, [], ["y"]), (9, "c2", "k", "f3", None, None), (10, "c1", "k", "f2", ["register"], []),
    ]
    s = spark.createDataFrame(served, "case_id string, concept string, fact_id string, statement string, not_served array<string>")
    c = spark.createDataFrame(claims, "claim_id int, case_id string, concept string, fact_id string, statement_contains array<string>, excerpt_contains array<string>")
    issues = A.claim_issues(c, s, spark.createDataFrame(excerpts, "fact_id string, excerpt string"))
    got = {r.claim_id: r.issue for r in issues.collect()}
    assert got == {1: None, 2: None, 3: "not served", 4: "not stated", 5: "not backed", 6: "not backed", 7: "not stated", 8: "not stated", 9: None, 10: "not stated"}
    cases = [("c1", True, ["f2", "f8"], [("k", "fees of CANTONS"), ("k", "taxes"), ("x", "y")]), ("c2", False, [], None), ("c3", True, None, [])]
    steps = spark.createDataFrame([("c1", ["a"]), ("c1", []), ("c2", [])], "case_id string, issues array<string>")
    verdicts = A.case_verdicts(spark.createDataFrame(cases, "case_id string, blocking boolean, must_not_serve array<string>, not_served array<struct<concept:string,phrase:string>>"), steps, c.join(issues, "claim_id"), s)
    assert {r.case_id: (r.blocking, r.passed, r.n_issues) for r in verdicts.collect()} == {"c1": (True, False, 1 + 5 + 1 + 2), "c2": (False, False, 2), "c3": (True, True, 0)}
