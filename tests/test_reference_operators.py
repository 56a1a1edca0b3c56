"""Goldens and numpy twins of operators that SQL can't express, and parity of all SQL twins on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quern.functions import text
from quern.functions.temporal import parse_date
from quern.functions.vectors import cosine, unit, weighted
from quern.operators import entities, graphs, knowledge, metrics, operations, resolution, retrieval, similarity
from quern.plans import registry
from quern.sources import files
from quern.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and x != x) or str(x) in ("NaT", "<NA>"):
        return "~"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)) or type(x).__name__ == "Decimal":
        return repr(round(float(x), 6) + 0.0)
    return "[" + ",".join(map(_cell, x)) + "]" if isinstance(x, (list, np.ndarray)) else str(x)


def _rows(df):
    return sorted(tuple(_cell(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_sql_twin(spark, duck, name):
    assert _rows(registry.queries()[name](spark, SF).toPandas()) == _rows(duck.execute(registry.sql()[name]).df())


def test_genericise_equals_pythons_expressions(spark):
    """Every text of the smallest tables and odd ones, by the same expressions in Python."""
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    odd = ["", " ", None, "see https://a.b/c?d=1 or x@y.org", "2024-01-31 1/2/2020 March 1999, 2001–2003; 1998 - 1999", "12,5 % of $3.2 Million or €5", "é2020 v2020 2020é ١٢٣", "\x1c a\u00a0\u2003b \x85", "a  b   c"]
    df = docs.unionByName(spark.createDataFrame([(x,) for x in odd], "text string"))

    def plain(t):
        for p in text.GENERIC:
            t = re.sub(p, "", t)
        return re.sub(text.BLANKS, " ", t).strip()

    for r in df.select("text", text.genericise(F.col("text")).alias("g")).collect():
        assert r["g"] == (None if r["text"] is None else plain(r["text"]))


def test_payloads_claims_and_vectors_are_kept_up(spark):
    from quern.operators import upkeep

    with pytest.raises(ValueError):
        upkeep.append_vectors(None, spark.createDataFrame([("a", [1.0])], "id string, embedding array<float>"), 2)
    cache = spark.createDataFrame([], "key string, source string, payload string, fetched_at long, ttl_seconds long")
    with pytest.raises(ValueError):
        upkeep.put_many(cache, cache.select("key", "payload"), "", 1)
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), (None, "3")], "key string, payload string")
    cache = upkeep.put_many(upkeep.put_many(cache, rows, "s", 100, 10), rows, "t", 100, 10)
    assert {(r["key"], r["payload"]) for r in upkeep.get_many(cache, rows, "s", 110).collect()} == {("a", "2")}
    assert upkeep.get_many(cache, rows, "s", 111).count() == 0 and upkeep.get_many(cache, rows, "s", 111, True).count() == 1
    assert upkeep.clear_source(cache, "s").count() == 1 and upkeep.invalidate_before(cache, "t", 101)[1].first()["removed"] == 1
    one = spark.createDataFrame([('{"id": "Q1", "labels": {"de": {"value": "Ding"}}, "claims": {"P31": [{"rank": "normal", "mainsnak": {"datatype": "wikibase-item", "datavalue": {"value": {"id": "Q5"}}}}]}}',), ("no json",), (None,)], "j string")
    got = [r["p"] for r in one.select(upkeep.parse_payload(F.col("j")).alias("p")).collect()]
    assert got[0]["qid"] == "Q1" and got[0]["label"] == "Ding" and [(c["property"], c["value"]) for c in got[0]["claims"]] == [("P31", "Q5")] and got[1:] == [None, None]


def test_every_query_is_registered_once():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "hybrid_rrf" in entry.queries()


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(unit(F.col("a")).alias("u"), unit(F.col("b")).alias("z"), cosine(F.col("a"), F.col("b")).alias("c"), weighted([(F.col("a"), 3.0), (F.col("a"), 1.0)]).alias("w")).first()
    assert r["u"] == pytest.approx([0.6, 0.8]) and r["z"] == [0.0, 0.0] and r["c"] == 0.0 and r["w"] == pytest.approx([0.6, 0.8])
    with pytest.raises(ValueError):
        weighted([(F.col("a"), 0.0)])


def test_porter():
    known = "caresses caress ponies poni cats cat agreed agre plastered plaster motoring motor hopping hop filing file happy happi relational relat conditional condit vietnamization vietnam triplicate triplic hopefulness hope adjustment adjust adoption adopt probate probat controlling control"
    words = known.split()
    assert [text.porter(w) for w in words[::2]] == words[1::2]


@pytest.mark.parametrize("written,years", [("940s", (940, 949)), ("10th century", (901, 1000)), ("4th century BC", (-400, -301)), ("c. 1450", (1450, 1450)), ("1890–1910", (1890, 1910)), ("44 BC", (-44, -44)), ("nonsense", None), ("", None)])
def test_dates(spark, written, years):
    r = spark.createDataFrame([(written,)], "t string").select(parse_date(F.col("t")).alias("r")).first()["r"]
    assert (None if r is None else (r["start"], r["end"])) == years


def test_rrf_arithmetic(spark):
    rows = [(0, "a", 1, "x"), (0, "a", 2, "y"), (0, "b", 1, "y"), (0, "b", 4, "z"), (0, "b", 2, None)]
    got = {r["id"]: r["score"] for r in retrieval.rrf(spark.createDataFrame(rows, "qid int, list_label string, rank int, id string")).collect()}
    assert got == {"x": round(1 / 61 + 0.05, 6), "y": round(1 / 62 + 1 / 61 + 0.05, 6), "z": round(1 / 64, 6)}


def test_query_terms_and_grep(spark):
    df = spark.createDataFrame([(1, "NOT a 42 ünit"), (2, "50% off"), (3, None)], "id int, content string")
    assert df.where("id = 1").select(text.query_terms(F.col("content"))).first()[0] == ["NOT", "ünit"]
    assert retrieval.grep(df, "  ").count() == 0 and retrieval.grep(df, "N_T").count() == 1 and retrieval.grep(df, "N_T", exact=True).count() == 0


def test_expansion_lines(spark):
    t = "1. lex: exact words\nVEC: a meaning\nchatter\nhyde:  a passage "
    got = spark.createDataFrame([(t,)], "t string").select(retrieval.expansion_lines(F.col("t")).alias("e")).first()["e"]
    assert [(x["type"], x["query"]) for x in got] == [("lex", "exact words"), ("vec", "a meaning"), ("hyde", "a passage")]


def test_clusters_keep_their_thresholds(spark):
    g = np.random.default_rng(42)
    base = g.normal(size=(2, 16))
    x = np.concatenate([base[:1] + 0.01 * g.normal(size=(3, 16)), base[1:] + 0.01 * g.normal(size=(3, 16)), g.normal(size=(1, 16))])
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, embedding array<double>")
    pairs = similarity.cosine_pairs(df, 0.85)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(i, j) for i in range(7) for j in range(i + 1, 7) if u[i] @ u[j] >= 0.85}
    for op in (similarity.greedy_clusters, similarity.complete_clusters):
        got = {}
        for r in op(pairs, 0.85).collect():
            got.setdefault(r["seed"], set()).add(r["member"])
        assert sorted(map(sorted, got.values())) == [[0, 1, 2], [3, 4, 5]]
    inc = similarity.incremental_clusters(df, 0.85).toPandas()
    assert inc.groupby("cluster").size().tolist() == [3, 3, 1]


def test_whitening_is_isotropic(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(400, 6)) @ g.normal(size=(6, 6))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, embedding array<double>")
    n, mean, cov = similarity.covariance(df)
    assert n == 400 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    mean, w = similarity.whitening(df, "zca", eps=1e-9)
    assert np.allclose(np.cov(((x - mean) @ w).T, bias=True), np.eye(6), atol=1e-5)
    assert similarity.whitening(df, "pca", k=3)[1].shape == (6, 3)


def test_knowledge_rules():
    m = knowledge.Map(["a", "b", "c"], [("a", "b"), ("b", "c")], {"a": 0.3, "b": 0.3, "c": 0.3}, set())
    h = m.copy()
    h.observe("b", "none", True)
    assert h.belief["b"] == 0.05 and h.belief["c"] <= 0.1 * 0.8 + 1e-12
    h = m.copy()
    h.observe("c", "solid", True)
    assert h.belief["b"] == pytest.approx(1 - 0.2 * 0.8) and h.belief["a"] == pytest.approx(1 - 0.2 * 0.64)
    m.observe("c", "deep", False)
    assert m.belief["a"] > 0.3 and m.belief["b"] > 0.3 and all(0.01 <= v <= 0.99 for v in m.belief.values())


def test_merges_chain_and_cycle(spark):
    good = spark.createDataFrame([(1, 2), (2, 3)], "source long, target long")
    assert {(r["source"], r["target"]) for r in entities.resolve_merges(good).collect()} == {("1", "3"), ("2", "3")}
    long = spark.createDataFrame([(i, i + 1) for i in range(200)], "source long, target long")
    assert {r["target"] for r in entities.resolve_merges(long).collect()} == {"200"}
    for bad in ([(1, 2), (2, 1)], [(1, 2), (1, 3)], [(1, 2), (2, 3), (3, 1), (4, 5)]):
        with pytest.raises(ValueError):
            entities.resolve_merges(spark.createDataFrame(bad, "source long, target long"))


def test_budget_stops_at_the_limit(spark):
    items = spark.createDataFrame([(i, f"i{i}", c) for i, c in enumerate([1.0, None, 2.0, 2.0, 0.5])], "seq long, item_id string, cost double")
    assert [r["seq"] for r in operations.budget_prefix(items, 3.0).orderBy("seq").collect()] == [0, 1, 2]
    done, total = operations.run_batches(items, lambda b: b.withColumn("status", F.lit("done")), 2, budget=3.0)
    assert total == 3.0 and done.count() == 3


def test_kappa_edges(spark):
    same = spark.createDataFrame([("x", "x")] * 4, "label_a string, label_b string")
    r = metrics.kappa(same).first()
    assert (r["n"], r["agreement"], r["kappa"]) == (4, 1.0, 0.0) and metrics.kappa(same.limit(0)).count() == 0


def test_decision_margin(spark):
    rows = [(1, "a", 0.7), (1, "b", 0.5), (2, "a", 0.7), (2, "b", 0.6), (3, "a", 0.5)]
    got = {r["m"]: r["status"] for r in resolution.decide(spark.createDataFrame(rows, "m int, qid string, total double"), "m").collect()}
    assert got == {1: "resolved", 2: "ambiguous", 3: "ambiguous"}


def test_betweenness_of_a_path(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    got = {r["v"]: r["score"] for r in graphs.betweenness(e, spark.createDataFrame([(i,) for i in range(1, 5)], "id long")).collect()}
    assert {k: v for k, v in got.items() if v} == {2: 4.0, 3: 4.0} and graphs.shortest_path(e, 1, 4) == [1, 2, 3, 4]


def test_yaml_and_audit_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("person", "p1", '{"name": "Åse"}')], "entity_type string, entity_id string, data string")
    assert files.write_yaml(e, str(tmp_path / "y")) == 1
    (tmp_path / "y" / "person" / "bad.yaml").write_text("a: [")
    assert files.read_yaml(spark, str(tmp_path / "y")).first()["entity_id"] == "p1"
    log = spark.createDataFrame([("2024-01-02T00:00:00", "i", "check", "{}", 1.0, "t")], files.AUDIT)
    files.append_audit(log, str(tmp_path / "a"))
    (tmp_path / "a" / "date=2024-01-02" / "x.json").write_text("\nbroken{\n")
    assert files.read_audit(spark, str(tmp_path / "a")).count() == 1 and files.read_audit(spark, str(tmp_path / "none")).count() == 0
    assert files.read_audit(spark, str(tmp_path / "a"), "2024-02").count() == 0


def test_provider_failures_are_rows(spark):
    def fetch(keys):
        if "bad" in keys:
            raise RuntimeError("down")
        return {k: k.upper() for k in keys}

    df = spark.createDataFrame([("a",), ("bad",)], "key string").coalesce(1)
    got = {r["key"]: (r["payload"], r["error"]) for r in files.fetch_missing(df, fetch, batch=1).collect()}
    assert got == {"a": ("A", None), "bad": (None, "down")}


def test_stream_latest_and_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("k", 1.0, "old"), ("k", 3.0, "new"), ("k", 2.0, "late")], "key string, ts double, value string").write.parquet(source)
    stream = spark.readStream.schema("key string, ts double, value string").parquet(source)
    q = streams.latest_per_key(stream).writeStream.format("memory").queryName("latest").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert [r["value"] for r in spark.sql("SELECT value FROM latest").collect()] == ["new"]
    for i in range(2):
        q = streams.process_once(stream, str(tmp_path / "ledger"), lambda b: b, "key").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c2{i}")).start()
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 1


def test_decay_without_weight(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 10.0)], "s double, age double")
    assert df.agg(similarity.decayed_mean(F.col("s"), F.col("age"), 0.0)).first()[0] == 0.5
    assert df.agg(similarity.decayed_mean(F.col("s"), F.col("age"), 1.0)).first()[0] == pytest.approx(1 / (1 + math.exp(-10)))
