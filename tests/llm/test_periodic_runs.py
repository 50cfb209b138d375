import random

import duckdb
import numpy as np
from helpers import WORD, awkward, empty

from groundwork.llm import periodic_runs, queries


def plain_runs(words, min_length=12):
    """By every period, every stretch of words that equal those one period on."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end + q - i >= max(min_length, 2 * q):
                found.setdefault((i, end + q - i), q)
            i = end
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_against_every_period():
    rng = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 8])
            words = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
            if rng.random() < 0.5 and n:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            docs.append(words)
        least = rng.choice([4, 7, 12, 12])
        got = zip(*(x.tolist() for x in periodic_runs._runs_of([w for d in docs for w in d], np.array([len(d) for d in docs]), least)))
        want, before = [], 0
        for words in docs:
            want += [(s + before, n, q) for s, n, q in plain_runs(words, least)]
            before += len(words)
        assert sorted(got) == want


def test_long_repetitive_texts():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 2000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for words in (["x"] * 3000, [str(i % 700) for i in range(3000)], list(fibonacci[-1])):
        got = periodic_runs._runs_of([w.encode() for w in words], np.array([len(words)]), 12)
        assert list(zip(*(x.tolist() for x in got))) == plain_runs(words)


def test_awkward_rows_and_other_columns(spark):
    docs = awkward(spark)
    docs = docs.unionByName(spark.createDataFrame([(20, "go on " * 9 + "then stop\t" + "la " * 20, None, None, None), (21, "a b c d e f " * 2, None, None, None)], docs.schema))
    got = {}
    for r in periodic_runs.periodic_runs(docs.selectExpr("*", "1 as runs", "2 as n_words", "3 as start")).collect():
        got.setdefault(r.doc_id, []).append(r)
    rows = docs.collect()
    assert sum(map(len, got.values())) == len(rows)
    for r in rows:
        words = [w.encode() for w in WORD.findall(r.text or "")]
        runs = plain_runs(words) if len(words) < 5000 else [(0, 40_000, 9_100)]  # by the making of the long texts
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        assert any((len(words), [tuple(x) for x in g.runs], g.text) == (g.n_words, runs, kept) for g in got[r.doc_id])
    assert [tuple(x) for x in got[20][0].runs] == [(0, 18, 2), (20, 20, 1)] and got[20][0].text == "go on then stop la"
    assert periodic_runs.periodic_runs(empty(spark)).count() == 0


def test_query_gives_the_rows_of_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = queries.op13_periodic_runs(spark, sf_dir)
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.oracle_sql()['op13_periodic_runs']})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    key = lambda r: r[0]
    assert sorted(rows, key=key) == sorted(want, key=key) and any(r[1] for r in rows)
