"""Cases that the shared tables do not show."""

from groundwork.operators import operations, places, release, retrieval, runs, service


def test_places(spark):
    register = spark.createDataFrame([("CH", "Alpland"), ("CH-ZH", "Zett"), ("CH-BE", "Bee"), ("CH-ZH-261", "Town"), ("CH-BE-12", "Town"), ("CH-BE-13", "Brook")], "code string, name string")
    asked = [(1, None, None, "town"), (2, None, "zett", "town"), (3, "ch", "ZH", "brook"), (4, None, None, "261"), (5, None, "zh", "0261"), (6, None, None, "ZH-261"), (7, "Mars", "ZH", "town"), (8, "Alpland", "Nowhere", "brook"), (9, " ", " ", " ")]
    got = {r.request_id: r for r in places.resolved(spark.createDataFrame(asked, "request_id int, country string, canton string, city string"), register, "CH").collect()}
    assert got[1].error == "city fits several" and got[3].error == "city lies elsewhere"
    assert got[2].municipality == got[5].municipality == got[6].municipality == "CH-ZH-261"
    assert got[4].municipality is None and got[4].not_recognised == ["city"]
    assert not got[7].served and got[7].canton_code is None
    assert got[8].not_recognised == ["canton"] and got[8].canton_code == "CH-BE"
    assert got[9].country_code == "CH" and got[9].error is None and got[9].canton_code is None


def test_altered_links_are_found(spark):
    from pyspark.sql import functions as F

    events = spark.range(200).selectExpr("id % 5 as c", "id", "cast(id as string) as body")
    sealed = operations.chained(events, "c", "id", F.col("body")).select("c", "id", "previous", "link")
    assert operations.chain_breaks(sealed.join(events, ["c", "id"]), "c", "id", F.col("body")).count() == 0
    cut = sealed.join(events, ["c", "id"]).filter("id <> 55")
    assert [(r.c, r.id) for r in operations.chain_breaks(cut, "c", "id", F.col("body")).collect()] == [(0, 60)]
    early = operations.chained(events.withColumn("body", F.when(F.col("id") == 0, "x").otherwise(F.col("body"))), "c", "id", F.col("body"))
    assert early.join(sealed, ["c", "id", "link"]).filter("c = 0").count() == 0 and early.join(sealed, ["c", "id", "link"]).count() == 160


def test_applying_is_applies(spark):
    from pyspark.sql import functions as F

    queries = spark.createDataFrame([(1, "CH"), (2, "CH-ZH-261"), (3, None), (4, "DE")], "query_id int, place string")
    concepts = spark.createDataFrame([("a", ["CH"]), ("b", ["CH-ZH"]), ("c", []), ("d", None), ("e", ["DE-X", "CH-BE"])], "concept_id string, jurisdictions array<string>")
    want = queries.crossJoin(concepts).filter(service.applies(F.col("jurisdictions"), F.col("place"))).select("query_id", "concept_id")
    assert sorted(map(tuple, service.applying(queries, concepts).collect())) == sorted(map(tuple, want.collect()))


def test_cosine_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 30)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, [0.0] * 4)], "vec_id long, vector array<double>")
    asked = rows.filter("vec_id % 10 = 0").selectExpr("vec_id as query_id", "vector as query_vector")
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.cosine_top(asked, rows, None, "query_id", "vec_id", 5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 200, 10):
        s = u @ u[i]
        for k, j in enumerate(np.argsort(-s, kind="stable")[:5]):
            assert s[j] < 0.5 or got[(i, k + 1)] == j


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "g int, n int")
    assert release.ranges(empty, "g", "n").count() == 0
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a int, b int")
    assert sorted(r.node for r in runs.reached(edges, spark.createDataFrame([(1,)], "node int"), "a", "b").collect()) == [1, 2, 3]
