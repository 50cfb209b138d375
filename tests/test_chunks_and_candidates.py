import hashlib
import random

import pytest

from groundwork.operators import candidates, chunks


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh é", k=rng.randint(1, 12))) for _ in range(n))


def test_fragments_lose_nothing_keep_their_size_and_overlap():
    rng = random.Random(4)
    for _ in range(60):
        text = rng.choice([words(rng, rng.randint(1, 900)), "x" * rng.randint(1, 4000), words(rng, 200) + "y" * 3000 + words(rng, 50), " \n ", ""])
        most, overlap = rng.choice([500, 900, 2000]), rng.choice([0, 100, 250])
        each = chunks.fragments(text, most, overlap)
        covered = {i for spans in each for a, b in spans for i in range(a, b)}
        assert covered >= {i for i, c in enumerate(text) if not c.isspace()}
        assert all(chunks.cost(spans) <= most for spans in each) and all(b - a <= chunks.SPAN and text[a:b] == text[a:b].strip() for spans in each for a, b in spans)
        for one, two in zip(each, each[1:]):
            begin, end = two[0][0], one[-1][1]
            assert one[0][0] < begin and end - begin <= overlap + 1  # the next one begins within the overlap, or after it
            if text[begin - 1] != " " and overlap:
                assert begin >= end  # an unbroken word is cut without an overlap


def plain_plan(blocks, most, overlap):
    """Chunk numbers of (document, block_no, fragment) by one pass over each document."""
    out, state = {}, {}
    for document, section, n, _, text, link in sorted(blocks, key=lambda b: (b[0], b[2])):
        chunk, used, links, shut = state.get(document, (0, 0, None, True))
        each = chunks.fragments(text, most, overlap)
        for k, spans in enumerate(each):
            own = section if link else None
            if shut or used + chunks.cost(spans) > most or own != links:
                chunk, used, links = chunk + 1, 0, own
            used, shut = used + chunks.cost(spans), len(each) > 1
            out[document, n, k] = chunk
        state[document] = (chunk, used, links, shut)
    return out


def test_plan_over_documents_in_any_layout(spark):
    rng, rows = random.Random(9), []
    for d in range(12):
        at = 0
        for n in range(1, rng.randint(2, 40)):
            text = words(rng, rng.choice([1, 20, 60, 400]))
            section = n // 4
            rows.append((d, section, n, at, text, section % 5 == 3))
            at += len(text) + 2
    frame = spark.createDataFrame(rows, "document int, section int, block_no int, start int, text string, link_only boolean").repartition(5)
    got = chunks.chunk_plan(frame, 900, 120).collect()
    want = plain_plan(rows, 900, 120)
    texts = {(d, n): (at, t) for d, _, n, at, t, _ in rows}
    seen = {}
    for r in got:
        at, text = texts[r.document, r.block_no]
        assert text[r.start - at : r.end - at] == r.quote and r.evidence_id == f"b{r.block_no:05d}:{r.start - at}:{r.end - at}"
        seen.setdefault((r.document, r.block_no), set()).add(r.chunk)
    for d, n in {(d, n) for d, n, _ in want}:
        assert seen[d, n] == {c for (x, y, _), c in want.items() if (x, y) == (d, n)}
    links = {(r.document, r.chunk) for r in got if r.status == "skipped_link_only"}
    assert links and not links & {(r.document, r.chunk) for r in got if r.status == "ready"}
    with pytest.raises(ValueError):
        chunks.chunk_plan(frame, 900, 500)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_every_reason_and_ids(spark):
    text = ["Title", "Pay the fee.", "Within a month.", "More"]
    content = "\n".join(text)
    records = [("d", content, sha(content)), ("torn", content, "0"), ("odd", content, sha(content))]
    blocks, at = [], 0
    for n, t in enumerate(text, 1):
        blocks += [("d", n, f"d:b{n}", at, at + len(t), t, sha(t)), ("odd", n, f"odd:b{n}", at, at + len(t), t if n != 2 else "other words!", sha(t))]
        at += len(t) + 1

    def span(n, a, b, of="d", **changed):
        start = sum(len(t) + 1 for t in text[: n - 1])
        return tuple(({"evidence_id": f"b{n:05d}:{a}:{b}", "block_id": f"{of}:b{n}", "block_number": n, "start": start + a, "end": start + b, "quote": text[n - 1][a:b] if n <= len(text) else "", "text_sha256": sha(text[n - 1]) if n <= len(text) else ""} | changed).values())

    good = {"label": "Pay: the Fee", "description": "x", "confidence": 0.9, "state": "CANDIDATE", "decision": "supported", "issue": "none", "why": "fits", "language": "de-CH", "document": "d", "evidence": [span(2, 0, 7)]}
    cases = {
        "a1": ({}, None), "a2": ({"evidence": [span(3, 0, 6), span(2, 4, 12), span(1, 0, 5)]}, None), "a3": ({"label": "PAY the fee!", "evidence": [span(4, 0, 4), span(2, 0, 3), span(2, 4, 7)]}, None), "a4": ({"label": "?!"}, None),
        "b1": ({"state": "DRAFT"}, "no supported review"), "b2": ({"decision": None}, "no supported review"), "b3": ({"issue": "vague"}, "no supported review"), "b4": ({"why": " "}, "no supported review"),
        "c1": ({"confidence": 1.5}, "confidence"), "c2": ({"confidence": float("nan")}, "confidence"), "c3": ({"confidence": None}, "confidence"), "c4": ({"confidence": 0.3}, "low confidence"),
        "d1": ({"label": None}, "label or description"), "d2": ({"description": "\t"}, "label or description"), "e1": ({"language": "german"}, "language"), "e2": ({"language": None}, "language"),
        "f1": ({"document": "nowhere"}, "no record"), "f2": ({"document": "torn"}, "content hash"), "g1": ({"evidence": []}, "no evidence"), "g2": ({"evidence": None}, "no evidence"),
        "h1": ({"evidence": [span(9, 0, 3)]}, "block number"), "h2": ({"evidence": [span(2, 0, 3), span(1, 0, 9)]}, "outside block"), "h3": ({"evidence": [span(2, 0, 3, evidence_id="b00002:0:4")]}, "evidence id"),
        "h4": ({"evidence": [span(2, 0, 3, quote="Buy")]}, "evidence changed"), "h5": ({"evidence": [span(2, 0, 3, text_sha256="1")]}, "evidence changed"), "h6": ({"evidence": [span(2, 0, 3, block_id="x")]}, "evidence changed"),
        "h7": ({"document": "odd", "evidence": [span(2, 0, 3, "odd")]}, "evidence changed"), "h8": ({"evidence": [span(1, 0, 9), span(2, 0, 3, quote="Buy")]}, "outside block"), "h9": ({"evidence": [span(2, 3, 3)]}, "outside block"),
    }
    rows = [(i, c["document"], c["label"], c["description"], c["confidence"], c["state"], c["decision"], c["issue"], c["why"], c["language"], c["evidence"]) for i, c in ((i, good | change) for i, (change, _) in cases.items())]
    frame = spark.createDataFrame(rows, f"candidate_id string, document_id string, preferred_label string, description string, confidence double, validation_state string, decision string, issue string, review_reason string, language string, evidence {candidates.EVIDENCE}")
    got = {r.candidate_id: r for r in candidates.packaged(frame, spark.createDataFrame(records, "document_id string, content_text string, content_sha256 string"), spark.createDataFrame(blocks, "document_id string, block_number long, block_id string, start int, end int, text string, text_sha256 string"), 0.5).collect()}
    assert {i: r.reason for i, r in got.items()} == {i: reason for i, (_, reason) in cases.items()}
    assert {i: got[i].concept_id for i in ("a1", "a2", "a3", "a4", "b1")} == {"a1": "pay-the-fee", "a2": "pay-the-fee-2", "a3": "pay-the-fee-3", "a4": "concept", "b1": None}
    assert {i: [tuple(x) for x in got[i].ranges] for i in ("a1", "a2", "a3")} == {"a1": [(2, 2)], "a2": [(1, 3)], "a3": [(2, 2), (4, 4)]}
