"""Queries on small tables with odd rows give the rows of their SQL."""

from datetime import datetime

import duckdb

from groundwork import catalogue


def both(spark, sf_dir, name, stored=False, **tables):
    """The sorted rows of a query and of its SQL; ``stored``: the query gives rows that only have to be read."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{sf_dir}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet/*.parquet'")
    got = catalogue.queries()[name](spark, str(sf_dir))
    assert not stored or "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    columns = ", ".join(f'"{c}"' for c in got.columns)
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    return order(got.collect()), order(con.sql(f"select {columns} from ({catalogue.oracle_sql()[name]}) t").fetchall())


def test_a_dataset_without_any_key_is_keyless_only(spark, tmp_path):
    orders = [(97, 1, "5-LOW"), (194, 2, "5-LOW"), (291, 2, "2-HIGH"), (3, 3, "5-LOW"), (388, 3, "5-LOW")]
    orders = [(*r, datetime(1996, 1, 1)) for r in orders], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp_ntz"
    customers = [(k, "FURNITURE") for k in (1, 2, 3, 4)], "c_custkey long, c_mktsegment string"
    got, want = both(spark, tmp_path, "dataset_issues", orders=orders, customer=customers)
    assert got == want
    assert {r[1] for r in got if r[0] == "dataset.keys"} == {"3"} and {r[1] for r in got if r[0] == "dataset.keyless"} == {"1", "2", "3"}


#: Headings cut within a reference, as they are in the given pages, and references to other signs without their end.
PAGES = [
    (1, "https://a.example/x", '<html lang="en"><head><title>Tom &amp;&amp</title></head><body><nav><ul><li><a href="/a">A&am</a></li></ul></nav><article><h1>Tom &amp;&amp</h1><p><b>Tom &amp;&amp;</b> said &quot;so&quot;<br>&copy; &ampx; &#65 &</p></article></body></html>'),
    (2, "https://a.example/y", '<html lang="de"><head><title>&quot;Ja&quot</title></head><body><article><h1>&quot;Ja&quot</h1><p>1 &lt 2 &lt; 3 &notit; &copy</p></article><footer>&copy; &middot; &#x27;22&nbsp</footer></body></html>'),
], "page_id long, url string, html string"


def test_references_without_a_semicolon_stay_in_blocks(spark, tmp_path):
    got, want = both(spark, tmp_path, "page_blocks", pages=PAGES)
    assert got == want
    assert {r[4] for r in got} == {"", "Tom &&amp", '"Ja&quot'}


def test_references_without_a_semicolon_stay_in_facts(spark, tmp_path):
    got, want = both(spark, tmp_path, "page_facts", pages=PAGES)
    assert got == want
    assert [r[1] for r in got] == ["Tom &&amp", '"Ja&quot'] and all(r[-1] for r in got)


def test_references_without_a_semicolon_stay_in_sections(spark, tmp_path):
    got, want = both(spark, tmp_path, "page_sections", pages=PAGES)
    assert got == want
    assert {r[2] for r in got} == {"", "Tom &&amp", '"Ja&quot'}


def test_a_release_is_checked_part_by_part(spark, tmp_path):
    lines = [(k, 1 + n % 4, 85 + n % 12, n % 130, "NAR"[n // 12 % 3]) for n in range(400) for k in (n % 120,) if k % 50]
    tables = {
        "orders": ([(k, k % 9, datetime(1996, 1, 1 + k % 28)) for k in range(120)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "lineitem": (lines + lines[:70], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string"),
        "customer": ([(k, k % 8) for k in range(61)], "c_custkey long, c_nationkey int"), "part": ([(k,) for k in range(80, 96)], "p_partkey long"), "nation": ([(k,) for k in range(8)], "n_nationkey int"),
    }
    got, want = both(spark, tmp_path, "release_issues", stored=True, **tables)
    assert got == want
    assert {"evidence.document", "evidence.label", "evidence.norm", "fact.federal_basis", "document.uncited", "concept.jurisdictions"} <= {r[0] for r in got}
