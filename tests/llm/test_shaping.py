import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import awkward, empty

from groundwork.llm import chat_views, mixing, neighbours, packing, queries

PATH = queries.tokenizer_path()


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [np.append(np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4"), np.uint32(2)).astype("<u4") for x in texts]


@pytest.mark.parametrize("table", ["awkward", "shared"])
def test_packing(spark, sf_dir, table):
    docs = awkward(spark) if table == "awkward" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = packing.packed(docs.selectExpr('*', '1 as piece', '2 as block', '3 as rank', '4 as length'), PATH).collect()
    want = defaultdict(int)
    for r, ids in zip(rows, whole_ids([r.text for r in rows])):
        n = -(-len(ids) // 1024)
        at = 0
        for k in range(n):
            size = len(ids) - 1024 * (n - 1) if k == 0 else 1024
            want[(r.doc_id, k, at, size, zlib.crc32(ids[at : at + size].tobytes()))] += 1
            at += size
    have = defaultdict(int)
    for r in got:
        have[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
    assert have == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(r.length for r in got) // 1024)
    assert len(places) <= least + max(2, least // 50)
    assert packing.packed(empty(spark), PATH).count() == 0


def test_words_are_the_tokenizers():
    """Texts with and without characters beyond ASCII, split here, against the tokenizer alone."""
    texts = ["it's they'll 's 't x're don't", "a  b\n c\td ", "\n\n a", "12 3a 4.5 ' ''s", "café's naïve – “quoted” 7é", " ", "", "a's1 b-c_d", "İ 好 x's", "\x0b a\x1c b\x1f\x85c"]
    encoder = packing.WordEncoder(PATH)
    assert packing._ASCII_WORDS.findall("it's 7 o'clock") == packing._WORDS.findall("it's 7 o'clock")
    for _ in range(2):
        assert all((a == b).all() and len(a) + 1 == len(c) for a, b, c in zip(encoder.encode(texts), [x[:-1] for x in whole_ids(texts)], whole_ids(texts)))


def test_plan_is_best_fit():
    slots = packing.plan({700: 3, 300: 2, 200: 5, 24: 4}, 1024)
    room = defaultdict(int)
    for length, a, b, per, first, offset in slots:
        for k in range(b - a):
            room[first + k // per] += length
    assert max(room.values()) <= 1024 and sum(room.values()) == 3 * 700 + 2 * 300 + 5 * 200 + 4 * 24
    assert len(room) == 4


def plain_rates(cells, power=0.7, rounds=100):
    """Keep rates of cells {(source, lang, topic): tokens} by plain raking, and the targets."""
    total = sum(cells.values())
    sums = [defaultdict(float) for _ in range(3)]
    within = defaultdict(float)
    for key, n in cells.items():
        for k in range(3):
            sums[k][key[k]] += n
        within[key[1:]] += n
    goals = [{c: n**power / sum(v**power for v in sums[k].values()) for c, n in sums[k].items()} for k in range(2)]
    z = defaultdict(float)
    for (lang, _), n in within.items():
        z[lang] += n**power
    goals.append(defaultdict(float))
    for (lang, topic), n in within.items():
        goals[2][topic] += goals[1][lang] * n**power / z[lang]
    keep, wanted = 0.5 * total, []
    for k in range(3):
        scale = keep
        for _ in range(50):
            whole = {c for c, g in goals[k].items() if g * scale >= sums[k][c]}
            left = sum(g for c, g in goals[k].items() if c not in whole)
            scale = max(scale, (keep - sum(sums[k][c] for c in whole)) / left) if left else scale
        wanted.append({c: min(g * scale, sums[k][c]) for c, g in goals[k].items()})
    factor = dict.fromkeys(cells, 0.5)
    for _ in range(rounds):
        for k in range(3):
            have = defaultdict(float)
            for key, n in cells.items():
                have[key[k]] += n * min(1.0, factor[key])
            for key in cells:
                factor[key] = min(factor[key] * wanted[k][key[k]] / have[key[k]], 1e9)
    return {key: min(1.0, f) for key, f in factor.items()}, goals


def plain_draw(doc_id, text, seed=17):
    h = 42
    for raw in ([doc_id.to_bytes(8, "little", signed=True)] if doc_id is not None else []) + [len(text).to_bytes(4, "little"), text.encode(), seed.to_bytes(4, "little")]:
        h = xxhash.xxh64_intdigest(raw, h)
    return (h - (1 << 64) * (h >> 63)) % (1 << 53) / (1 << 53)


@pytest.mark.parametrize("table", ["awkward", "shared"])
def test_mixture_against_plain_raking_and_draws(spark, sf_dir, table):
    docs = awkward(spark) if table == "awkward" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.mixture(docs).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    cells = defaultdict(int)
    for r in got:
        cells[(r.source, r.lang, r.topic)] += r.tokens
    rates, _ = plain_rates(cells)
    assert all(abs(r.keep_rate - rates[(r.source, r.lang, r.topic)]) < 2e-4 for r in got)
    count = lambda t: max(1, len(t.encode("utf-8").split()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.tokens) for r in got) == sorted((-1 if i is None else i, count(t)) for i, t in rows)
    draws = defaultdict(list)
    for i, t in rows:
        draws[(i, count(t))].append(plain_draw(i, t))
    for r in got:
        mine = draws[(r.doc_id, r.tokens)]
        assert len(set(mine)) > 1 or r.kept == (mine[0] < r.keep_rate)
    kept = sorted(-1 if r.doc_id is None else r.doc_id for r in got if r.kept)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in mixing.mixed(docs).collect()) == kept
    again = sorted(-1 if r.doc_id is None else r.doc_id for r in mixing.mixture(docs.repartition(7)).collect() if r.kept)
    assert again == kept


def test_raking_a_table_is_raking(spark):
    """Many small sources, a hot one, a null and an empty name: no class is pooled; both ways agree and meet the targets."""
    rng = np.random.default_rng(0)
    sources = [None, ""] + [f"s{k}" for k in range(40)]
    rows = [(sources[int(k)], ["en", "de"][int(k) % 2], f"t{int(t)}", int(n)) for k, t, n in zip(rng.integers(0, 42, 600), rng.integers(0, 3, 600), rng.integers(1, 300, 600))]
    rows += [("hot", "en", "t0", 200)] * 300
    counted = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    names = ["_source", "_lang", "_topic", "keep_rate"]
    a, b = (sorted(map(tuple, mixing.calibrate(counted, driver_cells=most, rounds=4).select(*names).collect())) for most in (10_000, 0))
    assert [x[:3] for x in a] == [x[:3] for x in b] and max(abs(x[3] - y[3]) for x, y in zip(a, b)) < 1e-6
    assert {x[0] for x in a} >= {"null", "=", "=hot", "=s7"}
    given = {"source": {None: 0.5, "s1": 0.25, "hot": 0.25, "absent": 9.0}}
    rates = {x[0]: x[3] for x in sorted(map(tuple, mixing.calibrate(counted, given).select(*names).collect()))}
    assert rates["=s3"] == 0 and rates["=hot"] > 0 and rates["null"] > 0


def test_topics_follow_words(spark):
    pools = [[f"{p}{chr(97 + i)}{chr(97 + j)}x" for i in range(9) for j in range(26)] for p in ("river", "metal", "piano")]
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(pools[i % 3], 40))) for i in range(300)] + [(900, ""), (901, None), (902, "1 2 3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = mixing.fit_topics(docs, "text", topics=3)
    got = {r.doc_id: r.topic for r in mixing.with_topics(docs, "text", model, ["doc_id"]).collect()}
    assert len({got[i] for i in range(300)}) == 3 and all(got[i] == got[i % 3] for i in range(300))
    assert got[900] == got[901] == got[902] == "none"


def test_topics_count_every_text(spark):
    """Rarity from the exact counts of 6,000 texts and their copies, whatever the layout; centres are the means of what is nearest."""
    rng = np.random.default_rng(2)
    words = [chr(97 + i) * 2 + chr(97 + j) * 2 + chr(97 + k) for i in range(12) for j in range(12) for k in range(12)]
    rows = [(i, " ".join(rng.choice(words[144 * (i % 12) : 144 * (i % 12) + 288], 12)) + f" {i}") for i in range(6000)]
    docs = spark.createDataFrame(rows + rows[:50] * 20, "doc_id long, text string")
    idf, centres = mixing.fit_topics(docs.repartition(3), "text")
    dims, held = mixing.TopicWords(), np.zeros(mixing.TOPIC_DIMS)
    for _, t in rows:
        held += mixing.word_counts(t, dims)[1] > 0
    want = np.where((held > 1) & (held <= 600), np.log(6001 / (1 + held)), 0)
    assert np.allclose(idf, want) and len(centres) == 12
    again = mixing.fit_topics(docs.repartition(11), "text")
    assert (again[0] == idf).all() and (again[1] == centres).all()


def test_mixture_awkward(spark):
    docs = awkward(spark).withColumnRenamed("n_chars", "topic").selectExpr("*", "1 as draw", "2 as weight", "3 as keep_rate", "4 as size", "5 as row")
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixture(docs).count() == docs.count()
    assert mixing.mixture(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_hadamard_keeps_length():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(neighbours.rotate(x, 1), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(neighbours.hadamard(neighbours.hadamard(x)), x)


def exact_neighbours(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            s = x @ q
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_neighbours_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    table = rows.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], np.float64)
    want = exact_neighbours(ids, x)
    got = defaultdict(list)
    for r in neighbours.nearest(rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[i]} & {v for v, _ in want[i]}) for i in want)
    assert hits >= 0.9 * sum(len(w) for w in want.values())
    at = dict(zip(ids.tolist(), x))
    assert all(abs(s - at[i] @ at[v]) < 1e-12 for i, found in got.items() for v, s in found)


def test_neighbours_awkward(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=8) * (1 + i % 3)]) for i in range(200)]
    rows += [(300 + i, [1.0] * 8) for i in range(60)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [None] + [1.0] * 7), (480, [float("inf")] * 8), (None, [1.0] * 8), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = {i: np.array(np.array(v, np.float32), np.float64) for i, v in rows if i is not None and i not in (400, 420, 440, 460, 480)}
    ids, x = np.array(sorted(good)), np.array([good[i] for i in sorted(good)])
    want = exact_neighbours(ids, x)
    got = defaultdict(list)
    for r in neighbours.nearest(df.selectExpr('*', '1 as rep', '2 as code', '3 as part', '4 as n')).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(want)
    assert got[300] == [v for v, _ in want[300]]
    hits = sum(len(set(got[i]) & {v for v, _ in want[i]}) for i in want)
    assert hits >= 0.95 * sum(len(w) for w in want.values())
    assert neighbours.nearest(df.filter("false")).count() == 0


def recall(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ids, x = np.array([i for i, _ in rows]), np.array([np.array(v, np.float32) for _, v in rows], np.float64)
    want, got = exact_neighbours(ids, x), defaultdict(set)
    for r in neighbours.nearest(df, **more).collect():
        got[r.query_id].add(r.vec_id)
    assert set(got) == set(want) and all(len(got[i]) == len(want[i]) for i in want)
    return sum(len(got[i] & {v for v, _ in want[i]}) for i in want) / sum(len(w) for w in want.values())


def test_long_vectors_move_no_others(spark):
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(1500, 32))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    unit[7] *= 100
    unit[9] *= 3
    assert recall(spark, [(i, [float(c) for c in v]) for i, v in enumerate(unit)]) >= 0.9


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(4)
    for n in (2, 21, 25):
        assert recall(spark, [(i, [float(c) for c in rng.normal(size=16)]) for i in range(n)]) == 1


def test_clustered_vectors_need_few_probes(spark):
    """With near neighbours, a quarter of the probes find them."""
    rng = np.random.default_rng(5)
    rows = [(40 * c + k, [float(v) for v in centre + 0.25 * rng.normal(size=64) / 8]) for c, centre in enumerate(rng.normal(size=(50, 64)) / 8) for k in range(40)]
    assert recall(spark, rows, probes=26) >= 0.9


CHAT = ["conv_id", "assistant", "part", "start", "n_turns", "n_trained", "text", "mask"]


def sql_views(table):
    con = duckdb.connect()
    con.register("conversations", table)
    return con.sql(f"select {', '.join(CHAT)} from ({queries.oracle_sql()['op2_chat_views']})").fetchall()


def spans(mask):
    return ",".join(f"{m.start}:{m.end}" for m in mask)


def test_chat_views_match_sql(spark, sf_dir):
    got = queries.op2_chat_views(spark, sf_dir).select(*CHAT).collect()
    assert sorted(map(tuple, got)) == sorted(sql_views(spark.read.parquet(f"{sf_dir}/conversations.parquet").toArrow()))


def test_long_dialogues_are_whole(spark):
    """600 turns, many speakers, null and repeated turn numbers: one row a view; in small parts, the same view."""
    rows = [(7, 0, "system", "Be kind")] + [(7, None if i % 50 == 0 else i // 3, f"p{i % 5}", f"turn {i} <|x") for i in range(600)]
    rows += [(8, None, "ann", f"text {i}") for i in range(40)] + [(9, 3, "bo", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(sql_views(turns.toArrow()))
    whole = sorted((*r[:-1], spans(r["mask"])) for r in chat_views.views(turns).select(*CHAT).collect())
    assert whole == want and {(r[0], r[4]) for r in want} == {(7, 601), (8, 40), (9, 1)}
    parts = defaultdict(list)
    for r in chat_views.views(turns.repartition(7), part_turns=16).collect():
        assert r.n_turns <= 16
        parts[(r.conv_id, r.assistant)].append(r)
    joined = []
    for (conv, who), each in parts.items():
        each.sort(key=lambda r: r.part)
        text = "".join(r.text for r in each)
        assert all(text[r.start : r.start + len(r.text)] == r.text for r in each)
        mask = ",".join(f"{r.start + m.start}:{r.start + m.end}" for r in each for m in r["mask"])
        joined.append((conv, who, 0, 0, sum(r.n_turns for r in each), sum(r.n_trained for r in each), text, mask))
    assert sorted(joined) == want


def test_chat_views_awkward(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bo b", None), (1, 2, "cy", "tie"), (1, 600, "ann", "late"), (1, None, None, "who"), (2, 0, "system", "alone"), (None, 0, "dee", "x"), (None, 0, "dee", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.assistant): r for r in chat_views.views(turns).collect()}
    assert set(got) == {(1, a) for a in ("ann", "bo b", "cy", "unknown")} | {(None, "dee")}
    ann = got[(1, "ann")]
    assert ann.n_turns == 6 and ann.n_trained == 2
    assert [ann.text[m.start : m.end] for m in ann["mask"]] == ["hi < |im_end|><|im_end|>", "late<|im_end|>"]
    assert "user name=bo_b\n<|im_end|>" in ann.text and ann.text.count("<|im_start|>system") == 1
    assert got[(None, "dee")].n_turns == 1
    assert chat_views.views(turns.filter("false")).count() == 0
    odd = turns.selectExpr("*", "1 as part", "2 as rank", "3 as assistant", "4 as of", "5 as at")
    assert {(r.conv_id, r.assistant, r.text) for r in chat_views.views(odd).collect()} == {(c, a, r.text) for (c, a), r in got.items()}


def test_packing_without_broadcast(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = sorted(map(tuple, packing.packed(docs, PATH).collect()))
    monkeypatch.setattr(packing, "BROADCAST_COUNTS", 0)
    assert sorted(map(tuple, packing.packed(docs, PATH).collect())) == a


def test_counts_of_batches_are_those_of_each_text(spark):
    """One task with other texts on either side; ASCII white space alone parts words, letters alone count."""
    texts = [None, "", " \t\x0b\n", "Alpha alpha  BETA beta2 gam ma\x0cdelta", "naïve Übermut wort wort　eins", "x" * 9000, "a1 b2", "Trailing words here \r\n"] * 70
    dims, (tokens, at, of) = mixing.TopicWords(), mixing.batch_counts(pa.array(texts, pa.string()).slice(3))
    for t, n, d, c in zip(texts[3:], tokens.to_pylist(), at.to_pylist(), of.to_pylist()):
        words, counts = mixing.word_counts(t, dims)
        assert n == max(1, words) and (np.frombuffer(d, "<u2") == np.flatnonzero(counts)).all() and (np.frombuffer(c, "<u4") == counts[counts > 0]).all()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model = mixing.fit_topics(rows, "text", topics=2)
    topics = mixing.with_topics(rows, "text", model, ["doc_id", "text"])
    assert topics._jdf.queryExecution().toString().count("MapInArrow") <= 4  # once in each of the four plans: one Python worker a task
    assert {(r.doc_id, r.text): r.tokens for r in topics.collect()} == {(i, t): max(1, mixing.word_counts(t, dims)[0]) for i, t in enumerate(texts)}
