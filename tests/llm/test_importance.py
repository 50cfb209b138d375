import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
from helpers import awkward, empty, lower

from groundwork.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, buckets=10_000, most=2, share=25, min_words=20, seed=7):
    """(doc_id, n_words, n_features, weight, score) of each row, and how many are drawn."""

    def counted(text):
        w = WORD.findall(lower(text))
        runs = [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]
        return len(w), Counter(zlib.crc32(f.encode()) % buckets for f in runs)

    each, aims = [counted(t) for _, t in docs], [counted(t)[1] for t in target]
    s, t = sum((c for _, c in each), Counter()), sum(aims, Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gains = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for (i, _), (n, c) in zip(docs, each):
        size = sum(c.values())
        weight = sum(gains[b] * k for b, k in c.items()) // size if size else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out, share * sum(r[1] >= min_words for r in out) // 100


def check(docs, target, **options):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, n = plain(rows, [r.text for r in target.select("text").collect()], **{k: v for k, v in options.items() if k not in ("ranges", "part_blocks")})
    got = importance.resampled(docs, target, **options).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    order = sorted((r for r in want if r[1] >= options.get("min_words", 20)), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    assert [r["rank"] for r in drawn] == list(range(1, n + 1))
    assert [(r.doc_id, r.score) for r in drawn] == [(r[0], r[4]) for r in order[:n]]


def test_awkward_rows_parts_and_options(spark, sf_dir):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = awkward(spark).selectExpr("*", "1 as block", "2 as nth", "3 as range", "4 as score").repartition(5)
    check(docs, target)
    check(docs, target, buckets=37, ranges=5, most=3, share=60, min_words=1, part_blocks=2)
    check(docs, target.limit(0), ranges=3, buckets=3)
    assert importance.resampled(empty(spark), target).count() == 0


def test_query_gives_the_rows_of_its_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.op11_importance(spark, sf_dir)
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.oracle_sql()['op11_importance']})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    key = lambda r: r[0]
    assert sorted(rows, key=key) == sorted(want, key=key) and any(r[4] for r in rows)
