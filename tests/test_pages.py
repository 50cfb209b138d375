import json

import pytest

from groundwork.operators import sections
from groundwork.sources import charsets, html

SITE = "https://example.gov/base/x.html"


def walked(spark, *sources):
    return html.walked(spark.createDataFrame([(k, s, SITE) for k, s in enumerate(sources, 1)], "page_id long, html string, url string"), url="url")


def blocks(spark, *sources):
    rows = html.with_heading_paths(html.located(html.with_carried_rows(walked(spark, *sources).filter("block_no > 0"))))
    return rows.orderBy("page_id", "block_no").collect()


def facts(spark, *sources):
    return html.page_facts(html.located(walked(spark, *sources))).orderBy("page_id").collect()


def test_headings_lists_footnotes_keep_their_context(spark):
    page = """<html lang="de"><body><main><h1>Aufenthalt</h1><article id="art_1"><h2>Art. 1</h2><p>Die Bewilli­gung ist erforderlich.<sup>1</sup></p>
        <ol start="3"><li>a<ul><li value="7">nested <a href="y.html">y</a></li></ul></li></ol></article><div id="fn-1"><p><sup>1</sup> Geändert 2026.</p></div></main></body></html>"""
    got = blocks(spark, page)
    by = {r.text: r for r in got}
    p = by["Die Bewilligung ist erforderlich.1"]
    assert p.heading_path == ["Aufenthalt", "Art. 1"] and p.article_id == "art_1" and p.in_main and p.anchor == "art_1" and not p.footnote
    nested = by["nested y"]
    assert [(x.ordered, x.position, x.start, x.value) for x in nested.lists] == [(True, 1, "3", None), (False, 1, None, "7")]
    assert [(x.href, x.resolved) for x in nested.links] == [("y.html", "https://example.gov/base/y.html")]
    assert got[-1].text == "1 Geändert 2026." and got[-1].footnote
    (f,) = facts(spark, page)
    assert (f.language, f.main_headings, f.whole, f.page_kind) == ("de", ["Aufenthalt"], True, "ordinary_page")


def test_a_heading_ends_those_of_its_level_and_below(spark):
    levels = [2, 4, 3, 3, 1, 6, 2, 5]
    page = "<body>" + "".join(f"<h{k}>h{n}</h{k}><p>p{n}</p>" for n, k in enumerate(levels)) + "<h3> </h3><p>last</p></body>"
    stack, want = [], {}
    for n, k in enumerate(levels):
        stack = [x for x in stack if x[0] < k] + [(k, f"h{n}")]
        want[f"p{n}"] = want[f"h{n}"] = [t for _, t in stack]
    want["last"] = want["p7"]
    assert {r.text: r.heading_path for r in blocks(spark, page)} == want


def test_tables_keep_cells_and_spans(spark):
    page = '<table><caption>Fees</caption><tr><th rowspan="2">Permit</th><td colspan=2>20<br>per year<table><tr><td>inner</td></tr></table></td></tr><tr><td>x</table><p>after'
    w = walked(spark, page)
    cells = html.table_cells(w).orderBy("row", "column").collect()
    assert [(c.row, c.column, c.text, c.header, c.rowspan, c.colspan) for c in cells] == [(0, 0, "Permit", True, "2", "1"), (0, 1, "20 per year inner", False, "1", "2"), (1, 0, "x", False, "1", "1")]
    got = blocks(spark, page)
    assert [(r.kind, r.text) for r in got] == [("table", "Fees\nPermit\t20 per year inner\nx"), ("paragraph", "after")] and got[0].caption == "Fees"


def test_tables_that_carry_their_rows_as_json(spark):
    data = json.dumps({"data": [{"name": "Sanitätsnotruf", "tel": "<a href='tel:144'>144</a>", "more": "x"}, {"tel": 117, "name": "Polizei &amp; Co"}, {"name": None}]}).replace("'", "&#39;")
    keyed = f"<table data-entities='{data}'><thead><tr><th data-data=name>Bezeichnung</th><th data-data=tel>Nummer</th></tr></thead><tbody></tbody></table>"
    no_keys = keyed.replace("data-data=tel", "")
    broken = keyed.replace('{"data"', '{"data')
    listed = """<h1>Ferien</h1><x-grid columns='[{"text": "Von"}, "Bis"]' rows='[[{"value": "1.1."}, "<b>2</b>.1."], "no row", [null, {"value": ""}], [3, {"other": 1}]]'><h2 level=2>Jahr</h2></x-grid><x-grid columns='[' rows='7'></x-grid>"""
    got = blocks(spark, keyed, no_keys, broken, listed)
    texts = {k: [(r.kind, r.text) for r in got if r.page_id == k] for k in range(1, 5)}
    assert texts[1] == [("table", "Bezeichnung\tNummer\nSanitätsnotruf\t144\nPolizei & Co\t117")]
    assert texts[2] == texts[3] == [("table", "Bezeichnung\tNummer")]
    assert texts[4] == [("heading", "Ferien"), ("heading", "Jahr"), ("table", "Von\tBis\n1.1.\t2.1.\n3\t")]
    assert next(r for r in got if r.page_id == 4 and r.kind == "table").heading_path == ["Ferien", "Jahr"]
    sources = {(c.page_id, c.source) for c in html.table_cells(walked(spark, keyed, no_keys, broken, listed)).collect()}
    assert sources == {(1, "html"), (1, "data-entities"), (2, "html"), (3, "html"), (4, "rows")}


def test_furniture_is_labelled_not_removed(spark):
    page = """<body><header><h1>Navigation</h1><div class="mod-breadcrumb"><a href="/">Home</a></div></header><nav><ul><li><a href="/help">Help</a></li></ul></nav>
        <div id="Cookie-Bar">We use cookies.</div><main><h1>Apply</h1><header><p>Intro</p></header><ul class="x mdl-related-content"><li><a href="a">Related A</a></li><li>Bring your passport</li></ul>
        <div style="display : none">Alternate text.</div></main><footer>Contact us.<script>doNotInclude()</script></footer></nav></div>trailing</body>"""
    got = {r.text: r for r in blocks(spark, page)}
    assert got["Navigation"].furniture == ["banner"] and got["Home"].furniture == ["banner", "breadcrumb"]
    assert (got["Help"].region, got["Help"].furniture, got["Help"].links[0].resolved) == ("nav", ["link-only", "navigation"], "https://example.gov/help")
    assert got["We use cookies."].furniture == ["cookie-notice"] and got["Intro"].furniture == [] and got["Intro"].region == "header"
    assert got["Related A"].furniture == ["link-only", "related-links"] and got["Bring your passport"].furniture == ["related-links"]
    assert got["Alternate text."].hidden and got["Contact us."].furniture == ["footer"]
    assert got["trailing"].region == "body"  # end tags without a start close nothing
    (f,) = facts(spark, page)
    assert f.main_headings == ["Apply"] and f.whole and not any("doNotInclude" in t for t in got)


@pytest.mark.parametrize(
    ("page", "kind"),
    [
        ("<title>Wartungsarbeiten heute</title><body>x</body>", "maintenance_page"),
        ("<body><nav>DE</nav><main><h1>Error Page (404)</h1></main></body>", "error_page"),
        ("<title>404 - Not Found</title><body>x", "error_page"),
        ("<title>Not Found in the archive</title><body>x", "ordinary_page"),
        ("<title>T</title><body><app-root></app-root></body>", "application_shell"),
        ("<title>Fedlex</title><body>x</body>", "application_shell"),
        ("<title>T</title><body><h1>Topic</h1></body>", "ordinary_page"),
    ],
)
def test_kinds_of_pages(spark, page, kind):
    assert facts(spark, page)[0].page_kind == kind


def test_base_declaration_blank_pages_and_depth(spark):
    deep = "<body>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>end"
    got = blocks(spark, '<?xml version="1.0"?><html><head><base href="/other/"></head><body><a href="page.html">x</a></body></html>', "  ", None, deep)
    assert got[0].links[0].resolved == "https://example.gov/other/page.html"
    assert [(r.page_id, r.text) for r in got] == [(1, "x"), (4, "deep"), (4, "end")]


def test_decoding_prefers_marks_then_utf8_then_what_is_declared(spark):
    rows = [
        (1, "<p>Zürich</p>".encode(), "text/html; charset=iso-8859-1"), (2, "<p>Zürich</p>".encode("latin-1"), 'text/html; charset="iso-8859-1"'),
        (3, '<meta charset="windows-1252"><p>Zürich €</p>'.encode("cp1252"), "text/html"), (4, "<p>Zürich</p>".encode("latin-1"), None), (5, b"\xef\xbb\xbf<p>x</p>", None),
        (6, "<p>Zürich</p>".encode("utf-16"), None), (7, "<meta charset=nonsense><p>Zürich".encode("latin-1"), "a; charset=ascii"), (8, b"\x81\xfc", None), (9, None, None), (10, b"", None),
        (11, "<meta charset=shift_jis>日本".encode("shift_jis"), None),
    ]
    got = {r.id: r for r in charsets.decoded(spark.createDataFrame(rows, "id long, raw binary, type string"), "raw", "type").collect()}
    assert {i: r.encoding for i, r in got.items()} == {1: "utf-8", 2: "iso8859-1", 3: "cp1252", 4: "windows-1252", 5: "utf-8-sig", 6: "utf-16", 7: "windows-1252", 8: "latin-1", 9: None, 10: "utf-8", 11: "shift_jis"}
    assert all("Zürich" in got[i].text for i in (1, 2, 3, 4, 6, 7)) and got[5].text == "<p>x</p>" and got[11].text.endswith("日本") and got[8].text == "\x81ü"
    assert (got[2].declared_http, got[3].declared_meta, got[2].warnings, got[1].warnings) == ("iso-8859-1", "windows-1252", [], [])
    assert got[7].warnings == ["declared_charset_failed:http:ascii", "declared_charset_failed:meta:nonsense", "character_encoding_fallback"] and got[4].warnings == ["character_encoding_fallback"] == got[8].warnings
    assert got[9].text is None and got[10].text == ""


ROWS = "page_id long, block_no int, kind string, text string, heading_path array<string>, region string, furniture array<string>, hidden boolean, footnote boolean, links array<struct<text:string>>"


def row(page, n, text, path, kind="paragraph", region="main", furniture=(), hidden=False, footnote=False, links=()):
    return (page, n, kind, text, path, region, list(furniture), hidden, footnote, [(x,) for x in links])


def test_sections_leave_out_furniture_and_lists_of_links(spark):
    rows = [
        row(1, 1, "Home", ["Navigation"], region="nav", furniture=["navigation"]), row(1, 2, "Anmeldung", ["Anmeldung"], "heading"), row(1, 3, "Sie melden  sich an.", ["Anmeldung"]),
        row(1, 4, "Fristen", ["Anmeldung", "Fristen"], "heading"), row(1, 5, "Vorher.", ["Anmeldung", "Fristen"]), row(1, 6, "Links", ["Links"], "heading"),
        row(1, 7, "SEM", ["Links"], "list_item", links=["SEM"]), row(1, 8, "Kanton", ["Kontakt"], region="footer"),
        row(2, 1, "Amt", ["Kontakt"]), row(2, 2, "Mo bis Fr", ["Kontakt"]),  # a contact page's own heading does not exclude it
        row(3, 1, "a", ["Navigation", "Thema"]), row(3, 2, "b", ["Navigation", "News"]), row(3, 3, "c", ["Navigation", "Suche", "x"]), row(3, 4, "d", ["Thema"], footnote=True), row(3, 5, "e", ["Thema"], hidden=True),
        row(3, 6, "f", ["Thema", "b"], "control"), row(3, 7, "g", [], "list_item", furniture=["link-only"], links=["g"]), row(3, 8, " ", ["leer"]),
    ]
    got = {(r.page_id, r.section): r for r in sections.sections(spark.createDataFrame(rows, ROWS)).collect()}
    assert [(got[1, k].first_block, got[1, k].last_block, got[1, k].reason) for k in range(1, 6)] == [(1, 1, "page_furniture_heading"), (2, 3, None), (4, 5, None), (6, 7, "link_only"), (8, 8, "page_furniture_heading")]
    assert got[1, 2].text == "sie melden sich an." and got[1, 2].characters == len("Sie melden  sich an.")
    assert got[2, 1].reason is None
    assert [got[3, k].reason for k in range(1, 8)] == [None, "embedded_news", "page_furniture_heading", "footnote", "control", "link_only", "no_spans"]
    n = {r.page_id: (r.sections, r.content_sections) for r in sections.counts(sections.sections(spark.createDataFrame(rows, ROWS))).collect()}
    assert n == {1: (5, 2), 2: (1, 1), 3: (7, 1)}


def test_repeated_sections_count_pages_of_a_host(spark):
    rows, hosts = [], []
    for page, host, card in ((1, "a", "Tel 044, Mo bis Fr"), (2, "a", "tel 044,\nmo bis fr"), (3, "a", "Tel 044, Mo bis Fr"), (4, "b", "Tel 044, Mo bis Fr"), (5, "b", "Other")):
        rows += [row(page, 1, f"Only here {page}", ["Thema"]), row(page, 2, card, ["Telefon"]), row(page, 3, card, ["Nochmals"])]
        hosts.append((page, host))
    got = sections.repeated(sections.sections(spark.createDataFrame(rows, ROWS)), spark.createDataFrame(hosts, "page_id long, host string")).collect()
    assert {(r.page_id, r.section, r.heading_path[0], r.pages) for r in got} == {(p, s, h, 3) for p in (1, 2, 3) for s, h in ((2, "Telefon"), (3, "Nochmals"))}
