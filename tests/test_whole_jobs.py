"""Queries do their whole job: small tables on which a cut would show."""

import numpy as np
import pytest

from quern.operators import graphs, hierarchy, knowledge
from quern.plans import registry


def _write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_mentions_with_common_parts_only_are_decided(spark, tmp_path):
    d = _write(
        spark, tmp_path,
        kb_candidates=([(f"Q{i}", f"John Name{i}", None, i, "human") for i in range(12)], "qid string, label string, aliases array<string>, rank int, type_hint string"),
        resolutions=([(1, "John Nmae3", None), (2, "John Name3", "human"), (3, "Jane", None), (4, None, None)], "res_id long, mention string, type_hint string"),
        entity_refs=([("entity", " q5")], "target_type string, target_id string"),
    )
    scored = registry.queries()["resolver_scores"](spark, d).collect()
    assert sorted((r["res_id"], r["qid"]) for r in scored) == sorted((m, f"Q{i}") for m in (1, 2) for i in range(12))
    got = {r["res_id"]: (r["status"], r["score"]) for r in registry.queries()["resolver_decision"](spark, d).collect()}
    assert set(got) == {1, 2} and got[1] == ("resolved", max(r["total"] for r in scored if r["res_id"] == 1))


@pytest.mark.parametrize("name", ["vec_topk", "vec_topk_filtered", "matryoshka_topk", "prf_topk", "retrieval_metrics", "hybrid_rrf", "convex_fusion"])
def test_searches_ask_for_every_fiftieth_row(spark, tmp_path, name):
    g = np.random.default_rng(7)
    d = _write(
        spark, tmp_path,
        embeddings=([(i, i % 4, [float(x) for x in g.normal(size=64)]) for i in range(160)], "vec_id long, label int, embedding array<float>"),
        documents=([(i, f"word{i % 9} text{i}", "en", "s", "c") for i in range(260)], "doc_id long, text string, lang string, source string, collection string"),
    )
    got = registry.queries()[name](spark, d).toPandas()
    assert set(got["qid"]) == ({0, 50, 100, 150, 200, 250} if name in ("hybrid_rrf", "convex_fusion") else {0, 50, 100, 150})
    if name == "hybrid_rrf":
        assert {q: i for q, i, r in zip(got["qid"], got["id"], got["rank"]) if r == 1} == {q: q for q in range(0, 251, 50)}


@pytest.mark.parametrize("name", ["novelty_global", "novelty_local", "novelty_decay", "novelty_premultiplied", "novelty_specific"])
def test_novelty_compares_with_all_other_rows(spark, tmp_path, name):
    g = np.random.default_rng(7)
    x = g.normal(size=(120, 64)).astype("float32").astype(float)
    x[50] = x[0]  # a copy whose id is divisible by 50 as well
    d = _write(spark, tmp_path, embeddings=([(i, i % 4 if i % 50 else 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label, age = np.array([i % 4 if i % 50 else 0 for i in range(120)]), np.arange(120) % 90
    got = {r["qid"]: r["novelty"] for r in registry.queries()[name](spark, d).collect()}
    assert set(got) == {0, 50, 100}
    for q in got:
        rows = np.flatnonzero(np.arange(120) != q)
        s, w = u[rows] @ u[q], np.exp(-0.02 * age[rows])
        if name == "novelty_premultiplied":
            s = s * w
        near = np.argsort(-s)[:3]  # three neighbours count in an index of 51 to 200
        value = 1 - np.average(s[near], weights=w[near] if name == "novelty_decay" else None)
        if name in ("novelty_local", "novelty_specific"):
            value = 0.4 * value + 0.6 * (1 - np.sort(s[label[rows] == label[q]])[-3:].mean())
        if name == "novelty_specific":
            m = u.mean(0)
            value = 0.7 * value + 0.3 * (1 - u[q] @ m / np.linalg.norm(m))
        assert got[q] == pytest.approx(min(1, max(0, value)), abs=2e-6)


def test_each_root_of_a_node_has_its_path(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("r", "d"), ("d", "e"), ("x", "y"), ("y", "x"), ("b", "d2"), ("a", "d2"), ("r", "d2")]
    edges = spark.createDataFrame([("g", p, c) for p, c in links], "g string, p string, c string")
    nodes = edges.select("g", "p").union(edges.select("g", "c")).distinct().toDF("g", "n")
    got = {r["n"]: r for r in hierarchy.hierarchy(nodes, edges).collect()}
    assert [tuple(w) for w in got["e"]["paths"]] == [("a", 4, "a > b > c > d > e"), ("r", 2, "r > d > e")]
    assert [tuple(w) for w in got["d2"]["paths"]] == [("a", 1, "a > d2"), ("r", 1, "r > d2")]
    assert (got["e"]["depth"], got["e"]["path"], got["d2"]["path"]) == (2, "r > d > e", "a > d2") and got["x"]["paths"] == []
    assert all(",".join(w["root"] for w in r["paths"]) == r["roots"] for r in got.values())


def test_all_cycles_are_broken(spark):
    # 102 two-node cycles in one graph, of which the earlier 100 rounds broke one each; a larger cycle with a chord beside them
    links = [(f"a{i:03}", f"b{i:03}") for i in range(102)] + [(f"b{i:03}", f"a{i:03}") for i in range(102)] + [("x", "y"), ("y", "z"), ("z", "x"), ("z", "y"), ("z", "q")]
    left = {(r["p"], r["c"]) for r in knowledge.break_cycles(spark.createDataFrame([("g", p, c) for p, c in links], "g string, p string, c string")).collect()}
    assert left == {(f"b{i:03}", f"a{i:03}") for i in range(102)} | {("x", "y"), ("z", "x"), ("z", "y"), ("z", "q")}


def test_paths_of_more_than_64_links(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(66)], "a long, b long")
    assert graphs.shortest_path(e, 0, 66) == list(range(67)) and graphs.shortest_path(e, 0, 99) == []
