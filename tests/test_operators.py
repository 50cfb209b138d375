"""Operators on small instances written by hand."""

import datetime as dt

from pyspark.sql import functions as F

from groundwork.functions import dates, identity, scores, text
from groundwork.operators import quality, records, resolution, rules
from groundwork.sources import html, tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_folding_and_tokens(spark):
    assert value(spark, text.fold(F.lit("Öffnungszeiten Straße É"))) == "offnungszeiten strasse e"
    assert value(spark, text.tokens(F.lit("What are the Oeffnungszeiten of l'Office?"))) == ["office", "offnun"]
    assert value(spark, text.normalise(F.lit("A­b  C\n"))) == "ab c"
    assert value(spark, text.slug(F.lit("  Residence permit: B/L "))) == "residence-permit-b-l"
    assert value(spark, text.line_key(F.lit(" Page  12 "))) == "page ##"


def test_identity(spark):
    url = F.lit("https://WWW.Example.org:443/de/a/b_fr.html?x=1#y")
    assert value(spark, identity.host_of(url)) == "www.example.org"
    assert value(spark, identity.source_filename(url)) == "b_fr.html"
    assert value(spark, identity.url_language(url)) == "de"
    assert value(spark, identity.url_language(F.lit("https://h/x/b_fr.html"))) == "fr"
    assert value(spark, identity.block_number(identity.block_id(F.lit("doc-1"), F.lit(7)))) == 7
    assert value(spark, identity.in_paths(F.lit("/ab"), F.lit("/a"))) is False and value(spark, identity.in_paths(F.lit("/a/b"), F.lit("/a/"))) is True


def test_dates(spark):
    for written in ("2026-03-01", "01.03.2026", "01/03/2026"):
        assert value(spark, dates.parse_date(F.lit(written))) == dt.date(2026, 3, 1)
    assert value(spark, dates.parse_date(F.lit("March 1"))) is None


def test_verdict_order(spark):
    v = lambda share, weight, best: value(spark, scores.verdict(F.lit(share), F.lit(weight), F.lit(best)))
    assert v(0.9, 3.0, 0.4) == "weak" and v(0.5, 0.1, 0.5) == "strong" and v(0.1, 1.0, 0.6) == "strong" and v(0.1, 0.9, 0.69) == "weak" and v(0.0, 0.0, 0.7) == "strong"


def test_places(spark):
    held = rules.holders(spark.createDataFrame([("CH-ZH-261",)], "code string"), "code").collect()
    assert {r.outer for r in held} == {"CH", "CH-ZH", "CH-ZH-261"}
    assert value(spark, scores.contains_place(F.lit("CH-Z"), F.lit("CH-ZH"))) is False


def test_resolution_gates(spark):
    day = dt.date(2026, 1, 1)
    concepts = spark.createDataFrame([("c", ["permit"], dt.date(2026, 3, 1)), ("d", [], dt.date(2025, 1, 1))], "concept_id string, required_context array<string>, stale_from date")
    facts = spark.createDataFrame(
        [("c", "f1", "CH-ZH", {"permit": "B"}, dt.date(2021, 1, 1), None, True), ("c", "f2", "CH-ZH", {"permit": "L"}, dt.date(2027, 1, 1), None, True), ("c", "f3", "CH-ZH", {"permit": "C"}, None, None, False), ("d", "f4", "CH", None, None, None, True)],
        "concept_id string, fact_id string, jurisdiction string, condition map<string,string>, valid_from date, valid_through date, reviewed boolean",
    )
    asks = [(1, "x", "CH", {}), (2, "c", "CH-BE", {}), (3, "c", "CH-ZH-261", {"permit": ""}), (4, "c", "CH-ZH", {"permit": "Z"}), (5, "c", "CH-ZH", {"permit": "L"}), (6, "c", "CH-ZH", {"permit": "C"}), (7, "c", "CH-ZH", {"permit": "B"}), (8, "d", "CH-ZH", {})]
    requests = spark.createDataFrame([(i, c, p, day, m) for i, c, p, m in asks], "request_id int, concept_id string, place string, as_of date, context map<string,string>")
    got = {r.request_id: (r.status, r.gap, r.fact_ids) for r in resolution.resolved(requests, concepts, facts).collect()}
    assert [got[i][:2] for i in range(1, 9)] == [
        ("OUT_OF_COVERAGE", "concept"), ("OUT_OF_COVERAGE", "jurisdiction"), ("NEEDS_CONTEXT", "context"), ("OUT_OF_COVERAGE", "condition"),
        ("OUT_OF_COVERAGE", "validity"), ("OUT_OF_COVERAGE", "review"), ("SUPPORTED", None), ("STALE", None),
    ]
    assert got[7][2] == ["f1"]


def test_runs_and_offsets(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate(["a", "a", None, None, "b", "a"])], "d int, n int, v string")
    assert [r.run for r in records.runs(rows, "d", ["n"], "v").orderBy("n").collect()] == [1, 1, 2, 2, 3, 4]
    spans = records.with_offsets(rows.filter("v is not null"), "d", "n", "v").orderBy("n").collect()
    assert [(r.start, r.end) for r in spans] == [(0, 1), (3, 4), (6, 7), (9, 10)]


def test_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z"), (4, "w")], "k int, v string")
    assert {(r.k, r.change) for r in quality.diff(a, b, "k", "v").collect()} == {(1, "removed"), (2, "changed"), (4, "added")}


def test_html_blocks(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li>Menu</li></ul></nav><main><h1>One</h1><p>a <b>b</b><br>c<p>d<h2>Two</h2><table><tr><td>x</td><td>y</td></tr></table></main><script>no()</script></body></html>"
    got = html.blocks(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("block_no").collect()
    assert [(r.kind, r.text, r.heading_path) for r in got] == [("list_item", "Menu", []), ("heading", "One", ["One"]), ("paragraph", "a b c", ["One"]), ("paragraph", "d", ["One"]), ("heading", "Two", ["One", "Two"]), ("table", "x\ty", ["One", "Two"])]
    assert got[0].region == "nav" and got[0].furniture == ["navigation"]


def test_calendar_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿"PLZ";Abholdatum\n8000;03.02.2026\n8000;03.02.2026\n8001;2026-01-05\n8002;soon\n', encoding="utf-8")
    good, bad = tables.read_calendar(spark, str(tmp_path / "c.csv"), "PLZ", "Abholdatum")
    assert [(r.key, str(r.day)) for r in good.collect()] == [("8000", "2026-02-03"), ("8001", "2026-01-05")]
    assert bad.count() == 1


def test_place_register(spark):
    places = spark.createDataFrame([("CH-ZH-1", "Zürich")], "code string, name string")
    aliases = spark.createDataFrame([("CH-ZH-1", "ZURICH"), ("CH-ZH-1", "Züri"), ("CH-X", "nowhere")], "code string, alias string")
    known, unknown = tables.place_register(places, aliases)
    assert {(r.name, r.key) for r in known.collect()} == {("Zürich", "zurich"), ("Züri", "zuri")}
    assert [r.code for r in unknown.collect()] == ["CH-X"]
