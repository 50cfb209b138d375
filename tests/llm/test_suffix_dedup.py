import random
from collections import defaultdict

import duckdb
import numpy as np
from helpers import DOCS, awkward, empty

from groundwork.llm import queries, suffix_dedup


def plain(rows, length=50):
    """By row: its bytes and the spans of them that a row of smaller id has, by a table of all strings."""
    least = {}
    ids = [suffix_dedup._NULL_ID if i is None else i for i, _ in rows]
    texts = [(t or "").encode() for _, t in rows]
    for i, t in zip(ids, texts):
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, t in zip(ids, texts):
        spans = []
        for k in range(len(t) - length + 1):
            if least[t[k : k + length]] < i:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        out.append((t, [tuple(s) for s in spans]))
    return out


def check(docs, **sizes):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, got = defaultdict(int), defaultdict(int)
    for (i, _), (t, spans) in zip(rows, plain(rows)):
        at, kept = 0, b""
        for a, b in spans:
            kept, at = kept + t[at:a], b
        want[(i, len(t), kept + t[at:], tuple(spans))] += 1
    for r in suffix_dedup.without_earlier_strings(docs, **sizes).collect():
        got[(r.doc_id, r.n_bytes, bytes(r.kept), tuple((s.start, s.end) for s in r.removed))] += 1
    assert got == want
    return want


def test_edits_copies_and_shared_passages_over_many_blocks(spark):
    rng = random.Random(7)
    letters = lambda n, of="ab cé": "".join(rng.choice(of) for _ in range(n))
    passage, base = letters(180), letters(700)
    rows = []
    for i in range(60):
        kind, t = i % 6, letters(rng.randint(0, 300))
        if kind == 1:  # a near copy
            at = rng.randrange(700)
            t = base[:at] + letters(2, "xyz") + base[at + rng.randint(0, 3) :]
        if kind == 2:  # the common passage, or a part of it, amid other text
            a, b = rng.randint(0, 60), rng.randint(100, 180)
            t = letters(90) + passage[a:b] + letters(rng.randint(0, 90))
        if kind == 3:
            t = base
        if kind == 4:
            t = letters(60, "a") + letters(1) + "a" * rng.randint(40, 120)
        rows.append((rng.choice([i, 1000 - i, i // 2]), t, None, None, None))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for sizes in ({}, {"block_bytes": 1500, "range_bytes": 4000, "slice_bytes": 300}):
        want = check(docs, **sizes)
        assert sum(len(k[3]) > 1 for k in want) > 5


def test_slices_have_all_windows_once():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 99, n, dtype=np.uint8).tobytes() for n in (0, 49, 50, 2000, 0, 51, 700)]
    block = suffix_dedup._Block(suffix_dedup._Block.payload(list(range(7)), texts))
    want = [(d, t[k : k + 50]) for d, t in enumerate(texts) for k in range(len(t) - 49)]
    names = {}
    for size in (10_000, 111, 64):
        at, doc, own = [], [], []
        for start, s in suffix_dedup._slices(block, 50, size):
            at.extend((start + s.at).tolist()), doc.extend(s.doc.tolist())
            own.extend(zip(s.windows(s.at).tolist(), s.checks(s.at).tolist()))
            inside = np.concatenate([np.arange(a, b + 1) for a, b in zip(s.first, s.last)]) if len(s.first) else s.at
            assert inside.tolist() == s.at.tolist()
        begin = np.r_[0, block.ends[:-1]]
        got = [(d, texts[d][p - begin[d] : p - begin[d] + 50]) for p, d in zip(at, doc)]
        assert got == want
        for (_, w), n in zip(got, own):
            assert names.setdefault(w, n) == n
    assert len(set(names.values())) == len(names)


def test_awkward_rows_and_other_columns(spark):
    check(awkward(spark).selectExpr("*", "1 as block", "2 as kept", "3 as removed"))
    assert suffix_dedup.without_earlier_strings(empty(spark)).count() == 0


def test_query_gives_the_rows_of_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = queries.op12_suffix_dedup(spark, sf_dir)
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.oracle_sql()['op12_suffix_dedup']})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want) and any(r[2] for r in rows)


def test_open_windows_are_named_without_ranking_the_block_again(monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcde ") for _ in range(400))
    texts = [(passage[a : a + n] + "".join(rng.choice("xyz") for _ in range(60))).encode() for a, n in ((0, 400), (30, 200), (100, 300), (0, 70))] + [b"", b"short"]
    block = suffix_dedup._Block(suffix_dedup._Block.payload(list(range(len(texts))), texts))
    keys, *_ = suffix_dedup._ranks_of(block, 50, 300)
    made, plain_slice = [], suffix_dedup._Slice
    monkeypatch.setattr(suffix_dedup, "_Slice", lambda *args: made.append(args) or plain_slice(*args))
    *_, at, of, names, checks, docs = suffix_dedup._opened(block, np.full(len(keys), suffix_dedup._SEVERAL, np.uint8), 50, 300)
    assert len(made) == len(range(0, len(block.data) - 49, 300))  # each slice once
    data, least = block.data.tobytes(), {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            least.setdefault(t[k : k + 50], i)
    assert len(names) == len(least) and len(set(zip(names.tolist(), checks.tolist()))) == len(least)
    assert all(docs[j] == least[data[k : k + 50]] for k, j in zip(at.tolist(), of.tolist()))
