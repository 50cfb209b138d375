import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from helpers import awkward, empty, lower, near_classes, shingle_set

from groundwork.llm import exact_dedup, near_dedup, sentence_spans


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 3000])
def test_perfect_hash_is_minimal(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    displacement, slot = exact_dedup.build_mph(digests)
    assert sorted(slot.tolist()) == list(range(n))
    assert (exact_dedup.find_slots(digests, displacement, n) == slot).all()


def exact_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    return groups


@pytest.mark.parametrize("table", ["awkward", "shared"])
def test_exact_against_brute_force(spark, sf_dir, table):
    docs = awkward(spark) if table == "awkward" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    groups = exact_groups(rows)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_keeps_columns(spark):
    docs = awkward(spark).withColumnRenamed("lang", "_digest").withColumnRenamed("source", "historical").withColumnRenamed("n_chars", "row")
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(exact_groups((r.doc_id, r.text) for r in docs.collect()))
    assert exact_dedup.deduplicated(empty(spark)).count() == 0
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_exact_with_a_hot_group(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'Same' else concat('t', id % 2500) end as text")
    got = exact_dedup.exact_duplicates(docs)
    assert got.filter("kept").count() == docs.select("text").distinct().count()
    assert got.filter("group_size = 2000 and keep_id = 5997").count() == 2000


def check_near(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted((-1 if i is None else i, len(shingle_set(t)), -1 if c is None else c) for (i, t), c in zip(rows, near_classes(rows)))
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    return rows


def test_near_against_brute_force(spark, sf_dir):
    check_near(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_near_awkward(spark):
    docs = awkward(spark)
    check_near(spark, docs)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_near_graded_copies(spark):
    """Copies of one text with more and more words changed: some link only through others."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in rng.choice(150, i % 12, replace=False):
            w[k] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    check_near(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_near_chains_across_components(spark):
    """Many drifting chains of copies, so that stars leave links for the pair join."""
    rng, rows = np.random.default_rng(8), []
    for c in range(12):
        w = [f"c{c}w{i}" for i in range(60)]
        for k in range(25):
            rows.append((len(rows), " ".join(w)))
            w = list(w)
            for i in rng.choice(60, 1 + k % 2, replace=False):
                w[i] = f"c{c}n{k}x{i}"
    check_near(spark, spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("own, linked", [(32, False), (14, True)])
def test_a_shared_template_makes_few_pairs(spark, monkeypatch, own, linked):
    """Hundreds of texts with one template: just below the limit they make no pair at all, above it a star links them."""
    made = []
    plain = near_dedup._cross_pairs
    monkeypatch.setattr(near_dedup, "_cross_pairs", lambda sets: made.append(near_dedup.written(plain(sets), "test")) or made[0])
    template = " ".join(f"t{i}" for i in range(150))
    rows = [(i, template + " " + " ".join(f"d{i}x{k}" for k in range(own))) for i in range(600)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.select("component_id").distinct().count() == (1 if linked else 600)
    assert made[0].count() <= 600


def test_one_per_group(spark):
    docs = awkward(spark).withColumnRenamed("lang", "uid").withColumnRenamed("source", "row_key")
    out = near_dedup.one_per_group(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    empties = sum(not shingle_set(t) for _, t in rows)
    classes = {}
    for (i, t), c in zip(rows, near_classes(rows)):
        if shingle_set(t):
            classes.setdefault((c, lower(t) if c is None else ""), (i, t))
    assert len(kept) == empties + len(classes)
    assert near_dedup.one_per_group(empty(spark)).count() == 0


MARK = re.compile(r"(?<=[.!?])\s+|(?<=[。｡．！？।॥؟۔])(?![。｡．！？।॥؟۔\s])|(?<=[。｡．！？।॥؟۔])\s+|\n\s*")


def brute_sentences(text):
    """(start, end, words) built from the marks alone; blank stretches join the sentence before them."""
    out, at = [], 0
    for end in [*(m.end() for m in MARK.finditer(text)), len(text)]:
        w = tuple(lower(text[at:end]).encode("utf-8", "surrogatepass").split())
        if w or (out and end > at):
            if w:
                out.append([at if out else 0, end, w])
            else:
                out[-1][1] = end
            at = end
    return out


def brute_spans(rows, run=3, long=50):
    """By row: what stays when every sentence of a span that an earlier place holds is removed."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, xxhash.xxh3_64_intdigest((rows[k][1] or "").encode("utf-8", "surrogatepass"))))
    seen, out = set(), [None] * len(rows)
    for k in order:
        text = rows[k][1] or ""
        s, lost = brute_sentences(text), set()
        for i in range(len(s)):
            for size in range(1, run + 1):
                words = [w for *_, w in s[i : i + size]]
                if i + size <= len(s) and (size == run or sum(map(len, words)) >= long):
                    key = tuple(words)
                    if key in seen:
                        lost.update(range(i, i + size))
                    seen.add(key)
        out[k] = ("".join(text[i:j] for n, (i, j, _) in enumerate(s) if n not in lost) if s else text, len(lost))
    return out


@pytest.mark.parametrize("table", ["awkward", "shared"])
@pytest.mark.parametrize("parts", [1, 7])
def test_spans_against_brute_force(spark, sf_dir, table, parts):
    docs = awkward(spark) if table == "awkward" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted((-1 if i is None else i, t, n) for (i, _), (t, n) in zip(rows, brute_spans(rows)))
    got = sentence_spans.without_repeated_spans(docs.repartition(parts)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_removed) for r in got) == want


def test_short_spans_and_shared_ids(spark):
    """Three short sentences repeat; two rows of one id in different blocks, and clashing columns."""
    rows = [(1, "One here. Two. Three now. Own words."), (2, "Other. One here. Two. Three now."), (3, "One here. Two. Else."), (5, "A b. C d. E f. G."), (5, "Start. A b. C d. E f.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i, t, n) for (i, _), (t, n) in zip(rows, brute_spans(rows)))
    assert (2, "Other. ", 3) in want and (3, "One here. Two. Else.", 0) in want
    for parts in (1, 5):
        odd = docs.repartition(parts, "text").selectExpr("*", "1 as block", "2 as nth", "3 as shard", "4 as entries")
        got = sentence_spans.without_repeated_spans(odd).collect()
        assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == want


def test_planted_passage(spark):
    passage = " ".join(f"Word{i} follows word{i + 1} and then ends here." for i in range(9))
    rows = [(i, f"Opening line number {i} of its own kind. {passage} Closing words of document {i} alone.") for i in range(5)]
    got = {r.doc_id: r for r in sentence_spans.without_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1]
    for i in range(1, 5):
        assert got[i].text == f"Opening line number {i} of its own kind. Closing words of document {i} alone."
    assert sentence_spans.without_repeated_spans(empty(spark)).count() == 0


def test_long_single_sentences(spark):
    """A repeated sentence of 50 words goes alone; one of 49 stays; wide characters are words."""
    long, short = (" ".join(f"w{k}" for k in range(n)) + ". " for n in (50, 49))
    wide = "".join(chr(0x4E00 + k) for k in range(60)) + "。"
    rows = [(1, long), (2, long), (3, "First here. " + long + "Then this."), (4, short), (5, short), (6, wide), (7, "前。" + wide + "後。")]  # no run of three but these
    got = {r.doc_id: r.text for r in sentence_spans.without_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: long, 2: "", 3: "First here. Then this.", 4: short, 5: short, 6: wide, 7: "前。後。"}


def test_passages_inside_sentences(spark):
    """Passages of 50 words that begin and end inside sentences lose words in all places but the first; one of 24 stays."""
    own = lambda d, a, n: " ".join(f"d{d}x{k}" for k in range(a, a + n))
    shared = " ".join(f"p{k}." if k % 20 == 12 else f"p{k}" for k in range(50))
    short = " ".join(f"q{k}" for k in range(24))
    rows = [(d, f"{own(d, 0, 7 * d)} {shared} {own(d, 100, 9)}\n{own(d, 200, 30)} {short} {own(d, 300, 30)}") for d in (1, 2, 3)] + [(4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 3):
        got = {r.doc_id: r for r in sentence_spans.without_repeated_spans(docs.repartition(parts), passage=50).collect()}
        assert [got[i].text for i in (1, 4, 5)] == [rows[0][1], "", ""]
        for d in (2, 3):
            text, r = rows[d - 1][1], got[d]
            lost = " ".join(text[p.start : p.end] for p in r.removed).split()
            assert r.n_removed > 0 and len(lost) >= 25 and set(lost) <= set(shared.split())
            assert r.text.split() == [w for w in text.split() if w not in set(lost)]
    assert [r.n_removed for r in sentence_spans.without_repeated_spans(docs).collect()] == [0] * 5
