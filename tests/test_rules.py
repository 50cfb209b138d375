"""Cases of rules that code and SQL of a query could have wrong together."""

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.functions import canonical
from groundwork.operators import articles, coverage, places, release, resolution, runs


def test_gaps_of_targets(spark):
    targets = [(u, u == "review") for u in "none never shell covered several challenge robots retry worst odd review recovered".split()]
    attempts = [
        ("none", 1, "saved", [], None), ("shell", 1, "saved", ["javascript_application_shell"], None), ("covered", 1, "saved", ["javascript_application_shell", "unexpected_media_type"], None),
        ("several", 1, "saved", ["unexpected_media_type", "error_page_title", "javascript_application_shell"], None), ("challenge", 1, "saved", ["possible_access_challenge", "something new"], None),
        ("robots", 1, "failed", None, "access-denied"), ("retry", 1, "failed", None, "tls-certificate"), ("worst", 1, "failed", None, "server-error"), ("worst", 2, "failed", None, "not-found"), ("worst", 3, "failed", None, "transient-network"),
        ("odd", 1, "failed", None, "never heard of"), ("review", 1, "failed", None, "rate-limited"), ("recovered", 1, "failed", None, "dns-failure"), ("recovered", 2, "saved", None, None),
    ]
    got = runs.target_gaps(
        spark.createDataFrame(targets, "url string, needs_review boolean"), spark.createDataFrame(attempts, "url string, attempt int, status string, flags array<string>, failure string"),
        spark.createDataFrame([("covered",), ("none",)], "url string"),
    )
    assert {r.url: (r.gap, r.retriable) for r in got.collect()} == {
        "none": ("none", False), "never": ("not-attempted", True), "shell": ("javascript-shell", False), "covered": ("javascript-shell-resolved", False), "several": ("soft-error-page", True),
        "challenge": ("access-challenge", True), "robots": ("access-denied", False), "retry": ("tls-certificate", True), "worst": ("not-found", False), "odd": ("unclassified", True),
        "review": ("rate-limited", False), "recovered": ("none", False),
    }


def test_a_decision_on_a_state_that_came_back_holds(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item int, state string")
    decisions = spark.createDataFrame([(1, "a", "accepted", 1), (1, "x", "rejected", 2), (2, "y", "accepted", 1)], "item int, s string, decision string, at int").select("item", F.sha2("s", 256).alias("fingerprint"), "decision", "at")
    assert {r.item: r.review for r in runs.decided(rows, decisions, "state").collect()} == {1: "accepted", 2: "stale", 3: "open"}


def test_a_long_chain_is_reached_to_its_end(spark):
    edges = spark.range(90).select("id", (F.col("id") + 1).alias("to"))
    assert runs.reached(edges, spark.createDataFrame([(0,)], "node long"), "id", "to").count() == 91


def test_citations(spark):
    records = [
        ("same", "u", "h1", list("abcd"), 1, True, True, True), ("renumbered", "u", "h2", ["new", *"abcd"], 1, True, True, True), ("twice", "u", "h3", list("abab"), 1, True, True, True), ("blank", "v", "h4", list("zz"), 1, True, False, True),
        ("newest", "v", "h5", list("xab"), 9, True, True, True), ("old", "v", "h6", list("ab"), 3, True, True, True), ("superseded", "v", "h7", list("ab"), 99, False, True, True), ("second", "v", "h8", list("ab"), 50, True, True, False), ("dup", "w", "h9", list("abxab"), 1, True, True, True),
    ]
    cited = [
        ("intact", "same", "u", 1, ["a", "b"], "h1"), ("bare", "same", "u", 4, None, None), ("beyond", "same", "u", 5, None, None), ("shifted", "renumbered", "u", 1, ["a", "b"], "h0"), ("unclear", "twice", "u", 2, ["a", "b"], "h0"), ("changed inside", "same", "u", 1, ["q"], "h0"),
        ("replaced", "gone", "v", 1, ["a", "b"], "h0"), ("same text", "gone", "v", 2, ["other"], "h5"), ("lost", "gone", "v", 1, ["q"], "h0"), ("two places", "gone", "w", 1, ["a", "b"], "h0"), ("no anchor", "gone", "v", 1, None, None), ("no record", "gone", "nowhere", 1, ["a"], "h0"),
        ("not eligible", "blank", "v", 1, ["a", "b"], "h0"), ("superseded", "superseded", "v", 1, ["a", "b"], "h7"), ("longer than the record", "same", "u", 1, list("abcde"), "h0"),
    ]
    got = release.citations_resolved(
        spark.createDataFrame(cited, "citation_id string, document_id string, url string, first_block int, anchor array<string>, content_hash string"),
        spark.createDataFrame(records, "document_id string, url string, content_hash string, hashes array<string>, retrieved int, current boolean, eligible boolean, preferred boolean"),
    )
    assert {r.citation_id: (r.outcome, r.found, r.first_block) for r in got.collect()} == {
        "intact": ("same-snapshot", "same", 1), "bare": ("same-snapshot", "same", 4), "beyond": ("dropped", None, None), "shifted": ("moved", "renumbered", 2), "unclear": ("dropped", None, None), "changed inside": ("dropped", None, None),
        "replaced": ("moved", "newest", 2), "same text": ("same-text", "newest", 2), "lost": ("changed", "newest", None), "two places": ("ambiguous", "dup", None), "no anchor": ("dropped", None, None), "no record": ("dropped", None, None),
        "not eligible": ("moved", "newest", 2), "superseded": ("moved", "newest", 2), "longer than the record": ("dropped", None, None),
    }


def test_codes_of_other_countries_and_names_in_stages(spark):
    register = [("CH", "Alpland", 0), ("DE", "Rhineland", 0), ("CH-ZH", "Zett", 0), ("CH-ZH-261", "Town", 0), ("CH-ZH-5", "DE-ZH-261", 0), ("CH-ZH-7", "Brook", 0), ("CH-ZH-8", "Brook (ZH)", 0), ("CH-ZH-8", "Brook", 1)]
    asked = [(1, "CH", None, "DE-ZH-261"), (2, "CH", None, "CH-ZH-261"), (3, "fr", None, "Town"), (4, "France", None, "Town"), (5, "CH", None, "brook")]
    got = {r.request_id: r for r in places.resolved(spark.createDataFrame(asked, "request_id int, country string, canton string, city string"), spark.createDataFrame(register, "code string, name string, order int"), "CH").collect()}
    assert got[1].municipality == "CH-ZH-5"  # another country's code is looked up as a name
    assert got[2].municipality == "CH-ZH-261" and got[5].municipality == "CH-ZH-7"  # exact names before loose ones
    assert (got[3].served, got[3].country_code, got[4].served, got[4].country_code) == (False, "FR", False, None)
    bad = spark.createDataFrame([("CH", "a"), ("ch", "b"), ("CH-ZH", "c"), ("CH-ZH-01", "d"), ("CH-ZH-x", "e")], "code string, name string")
    assert sorted(r.key for r in places.register_issues(bad).filter("rule = 'place.malformed'").collect()) == ["CH-ZH-01", "CH-ZH-x", "ch"]


def test_levels_that_apply_against_all_pairs(spark):
    rng = random.Random(1)
    code = lambda: "-".join(["CH", *rng.choices("AB", k=1), *rng.choices("123", k=1)][: rng.randint(1, 3)])
    facts = [(rng.choice("tu"), code()) for _ in range(12)]
    asked = [(i, rng.choice("tuv"), code()) for i in range(40)]
    got = {r.request_id: (r.level, r.n_applying, r.n_narrower, r.elsewhere) for r in places.applying_level(spark.createDataFrame(facts, "topic string, jurisdiction string"), spark.createDataFrame(asked, "request_id int, topic string, place string")).collect()}
    want = {}
    for i, topic, place in asked:
        held = {j for t, j in facts if t == topic}
        if held:
            over = [j for j in held if (place + "-").startswith(j + "-")]
            under = [j for j in held if j.startswith(place + "-")]
            level = max((j.count("-") for j in over), default=None)
            want[i] = (level, len(over), len(under), None if under else sum(j.count("-") > (-1 if level is None else level) and j not in over for j in held))
    assert got == want


def test_keyless_rows_and_keys_that_are_alike(spark):
    rows = [("a", 1, None, date(2026, 1, 1)), ("a", 2, "x", date(2026, 1, 1)), ("b", 1, None, date(2026, 1, 1)), ("b", 2, None, date(2026, 1, 1)), ("c", 1, "Zone A", date(2026, 1, 2)), ("c", 2, "zone-a", date(2026, 1, 1)), ("d", 1, "b", date(2026, 1, 1)), ("d", 2, "a", date(2026, 1, 9))]
    manifests = [(k, n, date(2026, 1, 1), date(2026, 1, 5), keys, "t", licence) for k, n, keys, licence in (("a", 2, ["x"], "l"), ("b", 2, [], "l"), ("c", 2, ["Zone A", "zone-a"], " "), ("d", 3, ["a", "b"], None), ("e", 0, [], "l"))]
    got = release.dataset_issues(spark.createDataFrame(rows, "dataset string, position int, key string, day date"), spark.createDataFrame(manifests, "dataset string, row_count int, period_from date, period_to date, keys array<string>, title string, licence string"))
    found = {}
    for r in got.collect():
        found.setdefault(r.key, set()).add(r.rule.removeprefix("dataset."))
    assert found == {"a": {"keyless"}, "b": {"keyless", "repeated"}, "c": {"keys_alike", "licence"}, "d": {"unsorted", "period", "row_count", "licence"}, "e": {"empty"}}


def test_a_calendar_has_one_period(spark):
    periods = spark.createDataFrame([(date(2026, 1, 1), date(2026, 12, 31)), (date(2027, 1, 1), date(2027, 12, 31))], "period_from date, period_to date")
    events, asked = spark.createDataFrame([("k", date(2026, 2, 1))], "key string, day date"), spark.createDataFrame([(1, "k", date(2026, 1, 1), date(2026, 3, 1))], "request_id int, key string, from_day date, to_day date")
    with pytest.raises(ValueError, match="one period"):
        resolution.calendar(asked, events, periods)
    assert resolution.calendar(asked, events, periods.limit(1)).first().n_events == 1


def test_articles_with_glued_footnotes_and_annexes(spark):
    heads = [["Law", "Art. 1 Subject"], ["Law", "Art. 22"], ["Law", "Art. 2a"], ["Law", "Art. 1211 Terms"], ["Law", "Art. 1211 Terms"], ["Law", "Anhang I", "Art. 15"], ["Law", "Anhang I", "Art. 67"], ["Law", "Preface"], ["Law", "Art. 4384"]]
    rows = [("law", n, h) for n, h in enumerate(heads)] + [("other", 0, []), ("other", 1, ["Art. 9"]), ("other", 2, ["Anhang IV"]), ("other", 3, ["Art. 3"])]
    rows += [("long", n, [f"Art. {n}{n % 10}"]) for n in range(1, 3000)]
    blocks = spark.createDataFrame(rows, "page_id string, block_no int, heading_path array<string>").repartition(7)
    got = {(r.page_id, r.block_no): (r.annex, r.article) for r in articles.with_articles(blocks).collect()}
    want = [(None, "Art. 1"), (None, "Art. 2"), (None, "Art. 2a"), (None, "Art. 12"), (None, "Art. 12"), ("I", "Art. 1"), ("I", "Art. 6"), (None, None), (None, "Art. 4")]
    assert [got["law", n] for n in range(9)] == want
    assert [got["other", n] for n in range(4)] == [(None, None), (None, "Art. 9"), ("IV", None), (None, "Art. 3")]
    previous = 0
    for n in range(1, 3000):
        previous = articles.number_after(f"{n}{n % 10}", previous, "")
        assert got["long", n] == (None, f"Art. {previous}")


def test_canonical_json_is_that_of_json_dumps(spark):
    rng = random.Random(3)
    kind = T.StructType([
        T.StructField("z", T.StringType()), T.StructField('a "quoted" \\ name', T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("b", T.BooleanType()),
        T.StructField("list", T.ArrayType(T.StructType([T.StructField("y", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType()))]))), T.StructField("map", T.MapType(T.StringType(), T.LongType())),
    ])
    text = lambda: rng.choice([None, "", "é😀 ", 'q"\\/', "tab\tline\nret\r\b\f", "\x00\x01\x1f\x7f", "plain"])
    double = lambda: rng.choice([None, 0.0, -0.0, 1.0, 1e7, 123456789.125, 1e15, 9999999999999998.0, 1e16, 1.5e300, 1e23, 1.3042279608514274e17, 1e-4, 0.00012345, 1e-5, -2.5e-7, 1 / 3, rng.uniform(-1e6, 1e6), rng.uniform(0, 1) * 10.0 ** rng.randint(-20, 20)])
    rows = []
    for _ in range(300):
        items = [(text(), [double() for _ in range(rng.randint(0, 3))]) for _ in range(rng.randint(0, 3))]
        rows.append((text(), rng.choice([None, -(2**63), 7]), double(), rng.choice([None, True, False]), rng.choice([None, items]), rng.choice([None, {"b": 1, "a": None, "é": 3}])))
    df = spark.createDataFrame(rows, kind)
    got = [r[0] for r in df.select(canonical.row_json(df)).collect()]

    def plain(row):
        out = dict(zip(kind.names, row))
        out["list"] = None if row[4] is None else [{"y": y, "x": x} for y, x in row[4]]
        return json.dumps(out, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    assert sorted(got) == sorted(map(plain, rows))
    small = spark.createDataFrame([(1, None, []), (2, "x", [1])], "id int, note string, more array<int>")
    assert [r[0] for r in small.select(canonical.row_json(small, frozenset({"note", "more"}))).collect()] == ['{"id":1}', '{"id":2,"more":[1],"note":"x"}']


def test_digests_of_collections(spark):
    df = spark.range(500).select("id", F.concat(F.lit("é"), "id").alias("t"))
    digest = lambda x: canonical.collection_digest(x).first()
    assert digest(df) == digest(df.orderBy(F.rand(1)).repartition(13)) != digest(df.filter("id <> 3"))
    assert digest(df.unionAll(df.filter("id = 3"))).sha256 != digest(df.unionAll(df.filter("id = 4"))).sha256
    assert digest(df.limit(0)).rows == 0


def test_every_unit_is_in_one_class(spark):
    rng = random.Random(2)
    docs = [(f"d{i}", f"https://h{i % 3}.example/{'a' if i % 2 else 'b'}/{i}", f"h{i % 3}", ["s1"] if i % 4 else []) for i in range(30)] + [("none", "x", "h0", None)]
    units = []
    for i in range(30):
        at = 1
        for u in range(rng.randint(1, 6)):
            size = rng.choice([1, 3, 200])
            units.append((f"d{i}", u, at, at + size - 1, [f"s{u}", f"t{u}"], rng.choice(["", "contact", f"own {i} {u}"])))
            at += size
    cited = [(d, rng.randint(a, b)) for d, _, a, b, _, _ in units if rng.random() < 0.3]
    ruled = [(0, "k0", "d3", None, None), (1, "k1", "d3", None, None), (2, "k2", "d4", None, ["t1", "s2"]), (3, "k3", "d4", None, ["t1"]), (4, "k4", None, "https://h1.example/a/", None), (5, "k5", None, "https://h1.exam", None), (6, "k6", "gone", None, None), (7, "k7", None, "ftp://", None), (8, "k8", "d5", None, [])]
    dispositions = spark.createDataFrame(ruled, "number int, kind string, document_id string, url_prefix string, section_ids array<string>")
    documents = spark.createDataFrame(docs, "document_id string, source_url string, host string, source_ids array<string>")
    classes = coverage.classified(spark.createDataFrame(units, "document_id string, unit int, first_block int, last_block int, section_ids array<string>, text string"), documents, spark.createDataFrame(cited, "document_id string, block int"), dispositions, 3).cache()
    host, url = {d: h for d, _, h, _ in docs}, {d: u for d, u, _, _ in docs}
    pages = {}
    for d, *_, text in units:
        pages.setdefault((host[d], text), set()).add(d)
    want = {}
    for d, u, a, b, sections, text in units:
        whole = [k for _, k, x, _, s in ruled if x == d and not s]
        part = {s: k for _, k, x, _, ss in ruled if x == d for s in ss or []}
        named = [part[s] for s in sections if s in part]
        rules = [k for _, k, x, p, _ in ruled if x is None and url[d].startswith(p)]
        kind = (whole + named + rules + [None])[0]
        if any(x == d and a <= n <= b for x, n in cited):
            want[d, u] = ("cited", None)
        elif kind:
            want[d, u] = ("dispositioned", kind)
        else:
            want[d, u] = ("boilerplate" if text and len(pages[host[d], text]) >= 3 else "unclassified", None)
    assert {(r.document_id, r.unit): (r.status, r.kind) for r in classes.collect()} == want
    assert {s for s, _ in want.values()} == {"cited", "dispositioned", "boilerplate", "unclassified"}
    by = {r.document_id: r for r in coverage.by_document(classes, documents).collect()}
    assert by["none"].status == "empty" and sum(r.units for r in by.values()) == len(units)
    sources = {r.source_id: r for r in coverage.by_source(classes, documents, spark.createDataFrame([("s1",), ("unused",)], "source_id string")).collect()}
    assert set(sources) == {"s1", "unused", "(discovered)"} and sources["unused"].status == "no_documents"


def test_findings_on_dispositions(spark):
    rows = [
        (0, "deferred", "d1", None, date(2026, 1, 1), None, None), (1, "deferred", "d1", None, date(2027, 1, 1), None, None), (2, "out_of_scope", "d1", None, None, "Taxes", None), (3, "out_of_scope", "d1", None, None, "fishing", None),
        (4, "covered", "gone", None, None, None, None), (5, "rule", None, "https://a/", None, None, ["d1"]), (6, "rule", None, "https://nowhere/", None, None, None),
    ]
    dispositions = spark.createDataFrame(rows, "number int, kind string, document_id string, url_prefix string, reaffirm_by date, out_of_scope_entry string, known_documents array<string>")
    documents = spark.createDataFrame([("d1", "https://a/1"), ("d2", "https://a/2")], "document_id string, source_url string")
    got = coverage.findings(dispositions, documents, documents, date(2026, 6, 1), ["Taxes of companies"])
    assert sorted((r.finding, r.number, r.target) for r in got.collect()) == [("expired", 0, "d1"), ("new_under_rule", 5, "d2"), ("stale", 4, "gone"), ("unknown_out_of_scope_entry", 3, "d1"), ("unused_rule", 6, "https://nowhere/")]
