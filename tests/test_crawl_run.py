import hashlib
import json

import pytest
from pyspark.sql import functions as F

from groundwork.operators import incremental
from groundwork.sources import crawl_run

PAGE, VARIANT, LEAFLET, LOST, SHELL = (f"https://a.example/{x}" for x in ("page", "variant", "leaflet.pdf", "lost", "law"))
ACT = "https://data.example/law/2026.html"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def saved(folder, url, *bodies, prefix="", name=None, **more):
    name = name or sha(url.encode())[:16]
    snapshots = []
    for k, body in enumerate(bodies, 1):
        where = folder / prefix / "pages" / name / f"attempt-{k:03d}"
        where.mkdir(parents=True)
        (where / "response.html").write_bytes(body)
        snapshots.append({"relative_path": f"pages/{name}/attempt-{k:03d}/response.html", "sha256": sha(body), "bytes_downloaded": len(body), "content_type": "text/html"})
    where = folder / prefix / "pages" / name
    where.mkdir(parents=True, exist_ok=True)
    manifest = {"url": url, "status": "saved" if bodies else "failed", "references": [{"label": "x"}], "snapshots": snapshots[-1:]} | more
    (where / "latest.json").write_text(json.dumps(manifest, indent=2))
    return where


@pytest.fixture
def run(tmp_path):
    root = tmp_path / "a run+1" / "pages"  # blanks, a plus sign, and a folder of the name that marks pages
    root.mkdir(parents=True)
    entry = lambda i: [{"definition": {"source_id": i, "language": "de"}, "title": i}]
    targets = [
        {"url": PAGE, "registry_entries": entry("permit")},
        {"url": VARIANT, "registry_entries": [], "attribution": {"kind": "in-scope", "source_ids": ["permit", "b"], "advertised_languages": ["de"], "reasons": ["topic-link"]}},
        {"url": LEAFLET, "attribution": {"kind": "out-of-scope", "source_ids": []}},
        {"url": LOST, "registry_entries": entry("lost")},
        {"url": SHELL, "registry_entries": entry("act")},
    ]
    (root / "plan.json").write_text(json.dumps({"catalogue_sha256": "c", "targets": targets}, indent=1))
    saved(root, PAGE, b"<p>old</p>", b"<p>new</p>")
    saved(root, VARIANT, b"<p>variant</p>", language="de")
    saved(root, LEAFLET, b"%PDF")
    saved(root, LOST, error="HTTP Error 404: Not Found")
    saved(root, SHELL, b"<app-root></app-root>")
    saved(root, ACT, b"<h1>Act</h1>", prefix="laws-documents", source_page_url=SHELL)
    return root


def test_snapshots_unavailable_and_attribution(spark, run):
    r = crawl_run.strict(crawl_run.read_run(spark, str(run)))
    rows = {x.url: x for x in r.snapshots.collect()}
    assert set(rows) == {PAGE, VARIANT, LEAFLET, SHELL, ACT}
    kinds = {u: (x.attribution.kind, x.attribution.source_ids) for u, x in rows.items()}
    assert kinds == {PAGE: ("catalogue", ["permit"]), VARIANT: ("in-scope", ["b", "permit"]), LEAFLET: ("out-of-scope", []), SHELL: ("catalogue", ["act"]), ACT: ("plugin-document", ["act"])}
    act = rows[ACT]
    assert (act.source_url, act.attribution.plugin_id, act.attribution.resolved_from) == (SHELL, "laws", SHELL)
    assert act.path.startswith("laws-documents/pages/") and rows[PAGE].attempt == "attempt-002" and rows[VARIANT].language == "de"
    assert act.document_id == "doc-" + sha(f"{SHELL}\n{sha(b'<h1>Act</h1>')}".encode())[:20]
    assert json.loads(rows[PAGE].references) == [{"label": "x"}]
    lost = r.unavailable.collect()
    assert [(x.url, x.error, x.attribution.source_ids) for x in lost] == [(LOST, "HTTP Error 404: Not Found", ["lost"])]
    of = lambda **k: {x.url for x in crawl_run.selected(r.snapshots, **k).collect()}
    assert of() == {PAGE, VARIANT, SHELL, ACT} and len(of(scope="all")) == 5 and of(kinds=["in-scope"]) == {VARIANT}
    assert of(sources=["act"]) == {SHELL, ACT} and of(document_ids=[act.document_id]) == {ACT}
    with pytest.raises(crawl_run.RunError):
        crawl_run.selected(r.snapshots, scope="everything")


def test_responses_are_checked_against_their_manifests(spark, run):
    for url, body in ((PAGE, b"<p>NEW</p>"), (VARIANT, b"longer than it was")):
        (run / "pages" / sha(url.encode())[:16] / ("attempt-002" if url == PAGE else "attempt-001") / "response.html").write_bytes(body)
    (run / "pages" / sha(LEAFLET.encode())[:16] / "attempt-001" / "response.html").unlink()
    r, there = crawl_run.read_run(spark, str(run)), crawl_run.read_responses(spark, str(run))
    verdicts = {x.url: x.verdict for x in crawl_run.verified(r.snapshots, there).collect()}
    assert verdicts == {PAGE: "hash differs", VARIANT: "size differs", LEAFLET: "missing", SHELL: "intact", ACT: "intact"}
    got = {x.url: bytes(x.content) for x in crawl_run.intact_bytes(r.snapshots, there).collect()}
    assert got == {SHELL: b"<app-root></app-root>", ACT: b"<h1>Act</h1>"}
    plan = crawl_run.verified(r.snapshots, there)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("binaryFile") == 1


def test_what_is_refused(spark, run):
    saved(run, "https://elsewhere.example/", b"x")
    saved(run, "https://data.example/stray", b"y", prefix="laws-documents", source_page_url="https://nowhere.example/")
    (saved(run, PAGE, b"z", name="broken") / "latest.json").write_text("{broken")
    for k, path in enumerate(("../outside.html", "/etc/passwd", "pages/../../x")):
        saved(run, LOST, name=f"unsafe{k}", snapshots=[{"relative_path": path, "sha256": "0", "bytes_downloaded": 1}])
    r = crawl_run.read_run(spark, str(run))
    assert sorted(x.reason for x in r.refused.collect()) == ["corrupt manifest", "page outside the plan", "plugin document without a planned page"] + ["unsafe path"] * 3
    assert r.snapshots.count() == 5
    with pytest.raises(crawl_run.RunError, match="outside the plan|corrupt|unsafe|without a planned"):
        crawl_run.strict(r)


def test_a_plugins_document_wins_over_the_page_with_its_bytes(spark, run):
    saved(run, SHELL, b"<h1>Act</h1>", name="again")
    firsts = crawl_run.first_of_each(crawl_run.read_run(spark, str(run)).snapshots).collect()
    act = [x for x in firsts if x.raw_sha256 == sha(b"<h1>Act</h1>")]
    assert [x.plugin_id for x in act] == ["laws"]


def test_without_a_plan(spark, tmp_path):
    with pytest.raises(Exception, match="plan.json"):
        crawl_run.read_targets(spark, str(tmp_path)).collect()


def records(spark, rows):
    return spark.createDataFrame(rows, "document_id string, raw_sha256 string, status string, extractor_version string, imported boolean, body string")


def test_decisions(spark):
    items = spark.createDataFrame([(i, h) for i, h in (("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5"), ("f", "6"), ("a", "1"))], "document_id string, raw_sha256 string")
    old = records(spark, [("a", "1", "extracted", "v2", False, "A"), ("b", "0", "extracted", "v2", False, "B"), ("c", "3", "extraction_failed", "v2", False, "C"), ("d", "4", "extracted", "v1", False, "D"), ("e", "5", "extracted", "v1", True, "E"), ("g", "7", "extracted", "v2", None, "G")])
    got = {r.document_id: (r.decision, r.reason) for r in incremental.decisions(items, old, "v2").collect()}
    assert got == {"a": ("reused", None), "b": ("recomputed", "bytes changed"), "c": ("recomputed", "failed before"), "d": ("recomputed", "extractor changed"), "e": ("reused", None), "f": ("new", None), "g": ("superseded", None)}
    assert {r.decision for r in incremental.decisions(items, old, "v2", force=True).filter("reason is not null").collect()} == {"recomputed"}


def test_a_second_run_recomputes_what_changed_and_a_loss_before_the_swap_leaves_the_table(spark, tmp_path, monkeypatch):
    folder, calls = str(tmp_path / "records"), spark.sparkContext.accumulator(0)

    def extract(rows):
        def one(it):
            for b in it:
                calls.add(b.num_rows)
                yield b

        shaped = rows.select("document_id", "raw_sha256", F.lit("extracted").alias("status"), F.lit("v1").alias("extractor_version"), F.lit(False).alias("imported"), F.upper("raw_sha256").alias("body"))
        return shaped.mapInArrow(one, shaped.schema)

    run = lambda changed, n: spark.range(n).select(F.concat(F.lit("d"), "id").alias("document_id"), F.when(F.col("id") < changed, F.concat(F.lit("y"), "id")).otherwise(F.concat(F.lit("x"), "id")).alias("raw_sha256"))
    assert incremental.current(spark, folder) is None
    none = records(spark, [])
    first = incremental.publish(incremental.extracted(run(0, 400), none, "v1", extract), folder)
    assert first.count() == 400 and calls.value == 400
    calls.value = 0
    old = incremental.current(spark, folder)
    incremental.publish(incremental.extracted(run(4, 390), old, "v1", extract), folder)
    assert calls.value == 4  # one in a hundred
    now = incremental.current(spark, folder)
    assert now.count() == 400 and now.filter("superseded").count() == 10 and {r.body for r in now.filter("document_id in ('d3', 'd4')").collect()} == {"Y3", "X4"}
    pruned = incremental.extracted(run(4, 390), now, "v1", extract, prune=True)
    assert pruned.count() == 390 and pruned.filter("superseded").count() == 0

    def lost(*_):
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(incremental, "_swap", lost)
    with pytest.raises(RuntimeError):
        incremental.publish(pruned.limit(1), folder)
    assert incremental.current(spark, folder).count() == 400
    assert len(incremental.unpublished(spark, folder)) == 2
