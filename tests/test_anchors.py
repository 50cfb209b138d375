from groundwork.operators import anchors


def test_relocation(spark):
    new = [("d", 1, "h0", "A"), ("d", 2, "hx", "A"), ("d", 3, "h1", "B"), ("d", 4, "h2", "B"), ("d", 5, "h1", "C"), ("d", 6, "h2", "C"), ("d", 7, "h9", "C"), ("d", 8, "h9", "C")]
    blocks = spark.createDataFrame(new, "document string, block_no int, text_sha256 string, heading_path string")
    old = [(1, "d", ["h0"], "A", 1), (2, "d", ["h1", "h2"], "B", 2), (3, "d", ["h1", "h2"], "Z", 2), (4, "d", ["h1", "h3"], "B", 3), (5, "d", ["hx"], "Z", 9), (6, "d", ["h9"], "C", 4)]
    asked = spark.createDataFrame(old, "anchor_id int, document string, hashes array<string>, heading_path string, block_no int")
    got = {r.anchor_id: (r.outcome, r.block_no) for r in anchors.relocated(asked, blocks).collect()}
    assert got == {1: ("same-text", 1), 2: ("moved", 3), 3: ("ambiguous", None), 4: ("changed", None), 5: ("moved", 2), 6: ("ambiguous", None)}


def test_pinned(spark):
    blocks = spark.createDataFrame([("d", k, f"h{k}", "A", 10 * k, 10 * k + 8) for k in range(4)], "document string, block_no int, text_sha256 string, heading_path string, start int, end int")
    ranges = spark.createDataFrame([(7, "d", 1, 2)], "anchor_id int, document string, first_block int, last_block int")
    r = anchors.pinned(blocks, ranges).first()
    assert (r.hashes, r.start, r.end) == (["h1", "h2"], 10, 28)


def test_excerpts_and_closest_blocks(spark):
    records = spark.createDataFrame([("d", "aaa one two three. four")], "document string, content string")
    blocks = spark.createDataFrame([("d", 1, 0, 10, "aaa one tw"), ("d", 2, 10, 23, "o three. four")], "document string, block_no int, start int, end int, text string")
    asked = spark.createDataFrame([(1, "d", "one two"), (2, "d", "aa"), (3, "d", "one 2 three"), (4, "d", ""), (5, "e", "x")], "anchor_id int, document string, excerpt string")
    got = {r.anchor_id: tuple(r)[1:] for r in anchors.relocated_by_excerpt(asked, records, blocks).select("anchor_id", "outcome", "start", "end", "first_block", "last_block").collect()}
    assert got[1] == ("moved", 4, 11, 1, 2) and got[2] == ("ambiguous", None, None, None, None)
    assert got[3][0] == got[4][0] == got[5][0] == "changed"
    near = anchors.closest_blocks(asked.filter("anchor_id = 3"), blocks).orderBy("rank").collect()
    assert [r["rank"] for r in near] == [1, 2] and near[0].ratio >= near[1].ratio > 0
