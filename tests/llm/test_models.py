import gc
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, empty, words
from pyspark.sql import functions as F

from groundwork.llm import language_model, pii, quality


def test_base_score_and_gain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: words(r.text) + [None] for r in docs.collect()}
    learnt = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in rows}
    c = Counter(w for i, t in rows.items() if learnt[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = language_model.scored(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = rows[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c[w] > 0 for w in t), n, not learnt[r.doc_id])
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def shard_row(counts, word, context, pairs):
    from groundwork.llm.blocks import pack

    return {"shard": 0, "counts": pack(np.array(counts, "<i8")), "pairs": pack(np.array(word, "<u4"), np.array(context, "<u4"), np.array(pairs, "<i8"))}


def test_probabilities_sum_to_one():
    """Over a vocabulary of four words and the unknown one, in the root and in every context."""
    word, context, pairs = np.array([0, 1, 2, 0, 1]), np.array([0, 0, 0, 1, 1]), np.array([20, 5, 1, 3, 3])
    s = language_model.Sweeps(shard_row([50, 20, 5, 1], word, context, pairs), 2, 4)
    s.begin(s.totals())
    for k in range(4):
        s.sweep(1 + k, s.totals())
        assert (np.bincount(np.repeat(np.arange(5), s.tables), s.sizes) == pairs).all() and (s.sizes > 0).all()
        assert (np.bincount(np.repeat(np.arange(4), s.root_tables), s.root_sizes) == s.customers()).all() and (s.root_sizes > 0).all()
    totals = s.totals()
    root = s.root(totals)
    unknown = (10.0 + 0.8 * totals[-2]) / 5 / (10.0 + totals[-1])
    assert math.isclose(root.sum() + unknown, 1)
    customers = np.array([26.0, 6.0])
    p = s.pair(totals, customers)
    for k in range(2):
        weight = (5.0 + 0.7 * totals[k]) / (5.0 + customers[k])
        unseen = [w for w in range(4) if w not in word[context == k]]
        assert math.isclose(p[context == k].sum() + weight * (root[unseen].sum() + unknown), 1)
    assert ((s.tables >= 1) & (s.tables <= s.pair_counts)).all()


def stirling(c, d):
    """Generalised Stirling numbers S(c, 1) to S(c, c): seatings of c customers by tables."""
    row = [0.0, 1.0]
    for n in range(1, c):
        row = [0.0] + [row[t - 1] + (n - d * t) * (row[t] if t < len(row) else 0) for t in range(1, n + 2)]
    return np.array(row[1:])


def test_gibbs_steps_reach_the_exact_conditional():
    """Tables of one dish given the rest of its restaurant: the steps' distribution is the one by enumeration."""
    rng, c, d, others, parent, copies = np.random.default_rng(0), 9, 0.7, 6, 0.2, 20_000
    want = stirling(c, d) * np.cumprod([parent * (5.0 + d * (others + k)) for k in range(c)])
    want /= want.sum()
    tables, sizes, of = np.ones(copies, np.int64), np.full(copies, c), np.full(copies, others + 1.0)

    def changed(dishes, by):
        of[dishes] += by

    steps = np.full(copies, 12)
    for _ in range(6):
        tables, sizes = language_model.move(tables, sizes, steps, steps, lambda x, gone: parent * (5.0 + d * (of[x] - gone)), changed, d, rng)
    have = np.bincount(tables, minlength=c + 1)[1:] / copies
    assert np.abs(have - want).max() < 0.015
    # and the share of customers that sit alone, from the sizes
    lone = np.bincount(np.repeat(np.arange(copies), tables), sizes == 1, copies).mean() / c
    smaller = stirling(c - 1, d)
    alone = sum(want[t - 1] * (smaller[t - 2] if t > 1 else 0) / stirling(c, d)[t - 1] for t in range(1, c + 1))
    assert abs(lone - alone) < 0.01


def plain_sampler(pairs, words, sweeps, burn):
    """Every customer of every restaurant taken out and seated again, one after another, in plain Python."""
    rng = random.Random(4)
    rest = {u: {} for u, _ in pairs} | {None: {}}
    base, (d0, d1), (s0, s1) = 1 / (words + 1), language_model.DISCOUNT, language_model.STRENGTH

    def total(u):
        return sum(map(len, rest[u].values()))

    def prob(u, w):
        t, d, s = rest[u].get(w, []), *((d0, s0) if u is None else (d1, s1))
        above = base if u is None else prob(None, w)
        n = sum(map(sum, rest[u].values()))
        return (max(sum(t) - d * len(t), 0) + (s + d * total(u)) * above) / (s + n)

    def seat(u, w):
        t, d, s = rest[u].setdefault(w, []), *((d0, s0) if u is None else (d1, s1))
        new = (s + d * total(u)) * (base if u is None else prob(None, w))
        x = rng.random() * (new + sum(t) - d * len(t))
        for k in range(len(t)):
            x -= t[k] - d
            if x < 0:
                t[k] += 1
                return
        t.append(1)
        if u is not None:
            seat(None, w)

    def unseat(u, w):
        t = rest[u][w]
        k = rng.choices(range(len(t)), t)[0]
        t[k] -= 1
        if not t[k]:
            t.pop(k)
            if u is not None:
                unseat(None, w)

    for (u, w), n in pairs.items():
        for _ in range(n):
            seat(u, w)
    mean = Counter()
    for k in range(burn + sweeps):
        for (u, w), n in pairs.items():
            for _ in range(n):
                unseat(u, w)
                seat(u, w)
        for w in {w for _, w in pairs}:
            for _ in range(sum(rest[None][w])):
                unseat(None, w)
                seat(None, w)
        if k >= burn:
            mean.update({p: prob(*p) / sweeps for p in pairs})
    return mean


def test_predictions_against_a_plain_sampler():
    rng = random.Random(1)
    pairs = Counter((rng.randrange(5), min(rng.randrange(7), rng.randrange(7))) for _ in range(220))
    want = plain_sampler(pairs, 7, 400, 20)
    keys = sorted(pairs, key=lambda p: (p[1], p[0]))
    counts = [sum(n for (_, w), n in pairs.items() if w == k) for k in range(7)]
    s = language_model.Sweeps(shard_row(counts, [w for _, w in keys], [u for u, _ in keys], [pairs[p] for p in keys]), 5, 7)
    s.begin(s.totals())
    size = np.array([sum(n for (u, _), n in pairs.items() if u == k) for k in range(5)], float)
    got = np.zeros(len(keys))
    for k in range(1520):
        s.sweep(1 + k, s.totals())
        if k >= 20:
            got += s.pair(s.totals(), size) / 1500
    off = np.abs(got / np.array([want[p] for p in keys]) - 1)  # two runs of the plain sampler differ by up to 4 %
    assert off.max() < 0.07 and off.mean() < 0.02


def test_scores_do_not_depend_on_layout(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 20_000)  # several shards on a small table
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    each = [sorted((r.doc_id, r.score, r.base_score) for r in language_model.scored(docs.repartition(k).selectExpr("*", "1 as held", "2 as block")).collect()) for k in (1, 7, 32)]
    assert each[0] == each[1] == each[2]
    held = {r.held_out: r for r in language_model.perplexity(language_model.scored(docs)).collect()}
    assert held[True].perplexity < held[True].base_perplexity


def test_rare_words_are_contexts(spark):
    """Every word is below 1/4000 of the tokens; what follows it must count all the same."""
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(held[0], "a17 b17"), (held[1], "a17 b18")]
    learnt = [i for i in range(1000, 40000) if zlib.crc32(str(i).encode()) % 7 != 2][:18000]
    rows += [(i, f"a{k % 6000} b{k % 6000}") for k, i in enumerate(learnt)]
    got = {r.doc_id: r for r in language_model.scored(spark.createDataFrame(rows, "doc_id long, text string")).filter(F.col("doc_id").isin(held)).collect()}
    seen, other = got[held[0]], got[held[1]]
    assert seen.held_out and other.held_out and seen.base_score == other.base_score
    assert seen.score > other.score + 1


def test_lm_awkward(spark):
    docs = awkward(spark)
    got = language_model.scored(docs).collect()
    assert len(got) == docs.count() and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (4, 5, 6)} == {1}
    assert language_model.scored(empty(spark)).count() == 0


def test_quality_held_out(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # a few hundred labels
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    y = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.score, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    assert np.mean([(s >= 0.3) == (q == 1) for s, q in held]) > 0.93
    good, poor = (np.array([s for s, q in held if q == k]) for k in (1, 0))
    assert np.mean(good[:, None] > poor[None, :]) > 0.95


def test_quality_does_not_read_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    a, b = (sorted((r.doc_id, r.score) for r in quality.quality_scores(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_quality_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, 0), (9, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(docs, labels).count() == docs.count()
    none = quality.quality_scores(docs, labels.filter("false")).collect()
    assert all(abs(r.score - 0.5) < 1e-12 for r in none)
    assert quality.quality_scores(empty(spark), labels).count() == 0
    odd = docs.withColumnRenamed("lang", "_score").withColumnRenamed("source", "score")
    assert quality.accepted(odd, labels).columns == odd.columns


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    y = np.arange(300) % 2
    rows = [np.unique(np.concatenate([rng.integers(0, 500, 30), rng.integers(600 + 50 * k, 650 + 50 * k, 4)])).astype(np.int32) for k in y]
    m = quality.fit(rows, y)
    s = m.score(np.array([m.margin(f) for f in rows]))
    assert ((s >= 0.5) == y).mean() > 0.98


def test_fit_against_a_plain_dual_solver():
    """The same problem with dense rows and cyclic steps until nothing moves: equal margins."""
    rng = np.random.default_rng(3)
    y = (np.arange(80) % 3 == 0).astype(np.int64)
    rows = [np.unique(np.concatenate([rng.integers(0, 60, 12), [70 + 3 * k + int(rng.integers(0, 3))]])).astype(np.int32) for k in y]
    m = quality.fit(rows, y, cost=1.0, epochs=400)
    counts = np.ones((2, 80))
    for f, k in zip(rows, y):
        counts[k, f] += 1
    rest = (1 << quality.TABLE_BITS) - 80  # features that no row has count one each
    ratio = np.log((counts[1] / (counts[1].sum() + rest)) / (counts[0] / (counts[0].sum() + rest)))
    x = np.zeros((80, 81))
    for i, f in enumerate(rows):
        x[i, f] = ratio[f] / np.sqrt((ratio[f] ** 2).sum())
        x[i, 80] = 1
    sign, most = np.where(y == 1, 1, -1), np.where(y == 1, 80 / (2 * y.sum()), 80 / (2 * (1 - y).sum()))
    alpha, w = np.zeros(80), np.zeros(81)
    for _ in range(3000):
        for i in range(80):
            new = min(max(alpha[i] - (sign[i] * (w @ x[i]) - 1) / (x[i] @ x[i]), 0), most[i])
            w += (new - alpha[i]) * sign[i] * x[i]
            alpha[i] = new
    assert np.abs(np.array([m.margin(f) for f in rows]) - x @ w).max() < 2e-3


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS, 1):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if (kind == 1 or kind == 2 and all(int(x) <= 255 for x in m.group().split(".")) or kind == 3 and 16 <= len(d) <= 19 and pii.luhn(d) or kind == 4 and 8 <= len(d) <= 15):
                out.append((kind, *m.span()))
    return out


def test_base_spans_against_patterns():
    random.seed(2)
    for alphabet in ("ab1.9 -+@(2", "0123456789 -.", "+0123456789().- ", "x@y.z%_-1"):
        for _ in range(3000):
            text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 60)))
            assert sorted(pii.base_spans(text)) == sorted(plain_spans(text)), text
    card = "card 4111 1111 1111 1111, ip 10.0.0.1, +1 (555) 123-4567, me@x.org"
    assert sorted(pii.base_spans(card)) == sorted(plain_spans(card)) and len(pii.base_spans(card)) == 4


@pytest.mark.parametrize("table", ["awkward", "shared"])
def test_personal_data_against_patterns(spark, sf_dir, table):
    """Counts and digest of the base spans of every text; the method's spans come on top and overlap none of them."""
    docs = awkward(spark) if table == "awkward" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, want = ("email", "ip", "card", "phone"), Counter()
    for r in docs.select("doc_id", "text").collect():
        base = sorted(plain_spans(r.text or ""))
        joined = ",".join(f"{names[k - 1]}:{s}:{e}" for k, s, e in base)
        want[(r.doc_id, *(sum(b[0] == k for b in base) for k in range(1, 5)), hashlib.sha256(joined.encode()).hexdigest())] += 1
    got = pii.personal_data(docs.selectExpr("*", "1 as base", "2 as nodes")).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        each = [x.split(":") for x in r.spans.split(",") if x]
        n = r.n_email + r.n_ip + r.n_card + r.n_phone
        assert len(each) == n + r.n_added and each == sorted(each, key=lambda x: (names.index(x[0]), int(x[1])))


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000):
        pii.base_spans(text)


def test_message_passing_on_a_chain_is_exact():
    """Without loops the marginals are those of the full sum."""
    rng = np.random.default_rng(3)
    g = pii.Graph([])
    g.doc, g.label, g.shape = np.zeros(3, np.int64), np.zeros(3, np.int64), np.arange(3)
    g.chain, g.skip = np.array([[0, 1]]), np.array([[1, 2]])
    unary, chain, skip = np.zeros((4096, 5)), rng.normal(size=(5, 5)), 2.0 * np.eye(5)
    unary[:3] = rng.normal(size=(3, 5))
    joint = np.exp(unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :] + chain[:, :, None] + skip[None])
    joint /= joint.sum()
    want = np.stack([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))])
    assert np.allclose(pii.marginals(g, unary, chain, skip), want, atol=1e-4)


def test_repeats_take_the_label(spark):
    number = "4111111111111111"
    rows = [(i, f"pay with {number} today, or number 12 {number} then call") for i in range(5)] + [(10 + i, f"only {i} items") for i in range(30)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_card == 1 and got[i].n_added == 1 for i in range(5))
    assert all(got[i].n_added == 0 and got[i].spans == "" for i in range(10, 40))


@pytest.mark.parametrize("n", [2, 5, 50])
def test_every_repeat_hears_the_base_span(n):
    """By the limits of the potentials: shapes that vote none, the largest skip weight, no chain."""
    unary = np.zeros((4096, pii.LABELS))
    unary[:, 1:] = -pii.UNARY_LIMIT
    chain, skip = np.zeros((pii.LABELS, pii.LABELS)), pii.SKIP_LIMIT * np.eye(pii.LABELS)
    for kind, first, again in ((4, "+1 (555) 123-4567", "555-123-4567"), (2, "10.0.0.1", "10-0-0-1")):
        text = f"call {first} or " + " or ".join([again] * n)
        found = pii.nodes(text, pii.base_spans(text))
        g = pii.Graph([pii.pack(np.array([x[:4] for x in found], "<i4").reshape(-1), np.array([x[4:] for x in found], np.uint64).reshape(-1))])
        p = pii.marginals(g, unary, chain, skip)
        assert len(p) == n + 1 and (p[:, kind] > 0.5).all()


def test_pii_awkward(spark):
    got = pii.personal_data(awkward(spark)).collect()
    assert len(got) == awkward(spark).count()
    assert {(r.n_email, r.n_card) for r in got if r.doc_id == 13} == {(1, 1)}
    assert pii.personal_data(empty(spark)).count() == 0


def test_a_sweep_takes_every_customer():
    """From one table of all: as many steps as customers, among other dishes and alone."""
    assert language_model.draws(np.array([0, 1, 2, 3, 1000])).tolist() == [0, 0, 2, 3, 1000]
    pairs = [2000, 1500, *[3] * 200]
    s = language_model.Sweeps(shard_row([2000, 1500, *[3] * 200], range(202), range(202), pairs), 202, 202)
    s.base, totals = 0.5, s.totals()
    totals[:2] = 2000  # tables that other shards hold
    s.sweep(1, totals)
    assert s.tables[0] > 25 and s.tables[1] > 25  # 22 steps open 22 at most
    steps = np.array([2000, 1500])
    t, sizes = language_model.move(np.array([1, 1]), steps.copy(), steps, steps, lambda x, gone: 50.0, lambda x, by: None, 0.7, np.random.default_rng(0))
    assert (t > 25).all() and (np.bincount(np.repeat([0, 1], t), sizes) == steps).all()


def test_steps_alone_reach_the_exact_conditional():
    rng, c, d, others, parent, copies = np.random.default_rng(0), 9, 0.7, 6, 0.2, 6000
    want = stirling(c, d) * np.cumprod([parent * (5.0 + d * (others + k)) for k in range(c)])
    want /= want.sum()
    got = np.zeros(c + 1)
    for _ in range(copies):
        got[len(language_model.move_one([c], 60, 60, lambda by: parent * (5.0 + d * (others + 1 + by)), d, rng))] += 1 / copies
    assert np.abs(got[1:] - want).max() < 0.025
    assert sum(language_model.move_one([4, 1], 3, 9, lambda by: 0.5, d, rng)) == 11 and language_model.move_one([2], 2, 0, lambda by: 0.5, d, rng) == []


def test_words_are_seated_at_once_by_the_exact_conditional(monkeypatch):
    """Tables and sizes of whole dishes against enumeration; the frequent words of the root take no single steps."""
    rng, c, d, mass, more, copies = np.random.default_rng(0), 9, 0.8, 1.4, 0.16, 20_000
    want = stirling(c, d) * np.cumprod([mass + more * k for k in range(c)])
    want /= want.sum()
    tables = language_model.seat_tables(np.full(copies, c), np.full(copies, mass), more, d, rng)
    assert np.abs(np.bincount(tables, minlength=c + 1)[1:] / copies - want).max() < 0.015
    sizes, of = language_model.seat_sizes(np.full(copies, c), tables, d, rng), np.repeat(np.arange(copies), tables)
    assert (np.bincount(of, sizes) == c).all() and (sizes > 0).all()
    smaller = stirling(c - 1, d)
    alone = sum(want[t - 1] * (smaller[t - 2] if t > 1 else 0) / stirling(c, d)[t - 1] for t in range(1, c + 1))
    assert abs(np.bincount(of, sizes == 1, copies).mean() / c - alone) < 0.01
    steps, one = [], language_model.move_one
    monkeypatch.setattr(language_model, "move_one", lambda sizes, leave, *rest: steps.append(leave) or one(sizes, leave, *rest))
    customers = [60_000, 5000, *range(1, 300)]
    s = language_model.Sweeps(shard_row(customers, [], [], []), 0, 400_000)
    totals = np.array([400_000.0, 50_000_000.0])
    s.begin(totals)
    s.sweep(1, totals)
    assert not steps and (np.bincount(np.repeat(np.arange(301), s.root_tables), s.root_sizes) == customers).all()


def test_words_beyond_the_tabulated_seatings_make_steps(monkeypatch):
    monkeypatch.setattr(language_model, "SEATED", 50)
    customers = [400, 0, 60, 7, 1, 30]
    s = language_model.Sweeps(shard_row(customers, [], [], []), 0, 6)
    s.begin(s.totals())
    for k in range(5):
        s.sweep(1 + k, s.totals())
        assert (np.bincount(np.repeat(np.arange(6), s.root_tables), s.root_sizes, 6) == customers).all() and (s.root_sizes > 0).all()


def test_large_pairs_are_seated_at_once_by_the_exact_conditional(monkeypatch):
    monkeypatch.setattr(language_model, "move_one", None)  # takes no single steps
    rng, c, d, others, parent = np.random.default_rng(0), 60, 0.7, 2, 0.05
    want = stirling(c, d) * np.cumprod([parent * (5.0 + d * (others + k)) for k in range(c)])
    want /= want.sum()
    tables, sizes, steps, got = np.ones(90, np.int64), np.full(90, c), np.full(90, c), np.zeros(c + 1)
    for _ in range(60):
        before = tables
        tables, sizes = language_model.move(tables, sizes, steps, steps, None, lambda x, by: None, d, rng, lambda k: lambda by: parent * (5.0 + d * (others + before[k] + by)))
        assert (np.bincount(np.repeat(np.arange(90), tables), sizes) == c).all() and (sizes > 0).all()
        got += np.bincount(tables, minlength=c + 1) / 5400
    assert np.abs(got[1:] - want).max() < 0.025


def test_a_task_of_the_language_model_keeps_one_python_worker(spark, sf_dir, monkeypatch):
    """No Python function feeds another without a shuffle between them: each would hold a worker of its own."""
    frames, write = [], language_model.written
    monkeypatch.setattr(language_model, "written", lambda df, name: frames.append(df) or write(df, name))
    frames.append(language_model.scored(spark.read.parquet(f"{sf_dir}/documents.parquet")))

    def most(node):
        """Python functions on a path without a shuffle: most on any below, and on the one that ends here."""
        children, name = node.children(), node.nodeName()
        below, here = (max(x, default=0) for x in zip(*(most(children.apply(i)) for i in range(children.size())))) if children.size() else (0, 0)
        here = 0 if "Exchange" in name else here + ("InArrow" in name)
        return max(below, here), here

    plans = [df._jdf.queryExecution().executedPlan() for df in frames]
    chains = [most(p.initialPlan() if p.nodeName() == "AdaptiveSparkPlan" else p)[0] for p in plans]
    assert len(chains) == 11 and set(chains) == {1}


def test_a_worker_lets_go_of_the_words_of_a_block(monkeypatch):
    """Without waiting for Python's collector of cycles, which seldom runs where most objects are bytes and arrays."""
    docs = pa.table({"doc_id": [1, 2], "text": ["a b a", None], "held": [False, True]})
    monkeypatch.setattr(language_model, "blocks_of", lambda batches, text, limit: [(0, docs)])

    class Frame:
        mapInArrow = staticmethod(lambda number, schema: number)

    gc.collect()
    gc.disable()
    gc.set_debug(gc.DEBUG_SAVEALL)
    try:
        (row,) = [r for b in language_model.numbered(Frame)(iter([])) for r in b.to_pylist()]
        gc.collect()
        left = [x for x in gc.garbage if isinstance(x, dict) and b"a" in x]
    finally:
        gc.set_debug(0)
        gc.garbage.clear()
        gc.enable()
    assert row["trained"] == 4 and not left
