from strandwork.operators import routes


def test_links_of_hits_alone(spark):
    code = spark.createDataFrame([(1, "f"), (1, "g"), (2, "f")], "query_id long, id string")
    spec = spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "query_id long, id long")
    w = spark.createDataFrame([(i, x) for i in ("f", "g", "unseen") for x in ("read", "index", i)] + [("f", "read")], "id string, w string")
    v = spark.createDataFrame([(7, "read"), (7, "index"), (8, "read"), (8, "f"), (9, "read"), (9, "index")], "id long, w string")
    assert {tuple(x) for x in routes.hit_links(code, spec, w, v).collect()} == {("f", 7), ("g", 7), ("f", 8)}
