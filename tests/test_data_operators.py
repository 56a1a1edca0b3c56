"""Incremental processing, hierarchies and orphan references against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions.keys import path_key
from quern.operators import hierarchy, incremental, orphans


def closure(edges):
    up = {}
    for p, c in edges:
        up.setdefault(c, set()).add(p)
    out = set()
    for start in {x for e in edges for x in e}:
        seen, todo = set(), list(up.get(start, ()))
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                todo += up.get(a, ())
        out |= {(a, start) for a in seen}
    return out


@pytest.mark.parametrize("seed,cyclic", [(1, False), (2, True), (3, True)])
def test_ancestors_equal_brute_force(spark, seed, cyclic):
    r = random.Random(seed)
    edges = {(f"n{r.randrange(i)}", f"n{i}") for i in range(1, 40) for _ in range(r.choice([1, 1, 1, 2]))}
    edges |= {(f"c{i}", f"c{i + 1}") for i in range(12)}  # a chain to compress
    if cyclic:
        edges |= {("c12", "c0"), ("n5", "n5"), ("n30", "n2"), ("c12", "n7")}
    df = spark.createDataFrame([("g", p, c) for p, c in edges], "g string, p string, c string")
    got = {(x["a"], x["d"]) for x in hierarchy.ancestors(df).collect()}
    assert got == closure(edges)


def test_latest_nodes_dirty_rows(spark):
    rows = [("G ", "A", ["b", " B ", None, "x"], 1, "t"), ("g", "a ", ["b"], 2, "t"), ("g", "b", None, 1, None), (None, "z", [], 1, "t"), ("g", None, ["a"], 1, "t"), ("g", "b", None, 1, None)]
    df = spark.createDataFrame(rows, "graph_id string, id string, prerequisites array<string>, updated_at int, p string")
    nodes = hierarchy.latest_nodes(df)
    assert {(x["g"], x["n"], tuple(x["up"])) for x in nodes.collect()} == {("g", "a", ("b",)), ("g", "b", ()), ("", "z", ())}
    assert [(x["p"], x["c"]) for x in hierarchy.links(nodes).collect()] == [("b", "a")]
    h = {x["n"]: x for x in hierarchy.hierarchy(nodes, hierarchy.links(nodes)).collect()}
    assert h["a"]["path"] == "b > a" and h["a"]["roots"] == "b" and h["b"]["n_descendants"] == 1 and h["z"]["depth"] == 0


@pytest.mark.parametrize("shape", ["chain", "ladder", "ring"])
def test_depth_does_not_set_the_number_of_rounds(spark, shape):
    """1,000 levels of a chain, 200 of a ladder (two nodes a level, each below both of the level above), a ring of 150."""
    n = {"chain": 1000, "ladder": 200, "ring": 150}[shape]
    if shape == "ladder":
        edges = [(f"{a}{i}", f"{b}{i + 1}") for i in range(n) for a in "xy" for b in "xy"]
    else:
        edges = [(f"n{i}", f"n{(i + 1) % n if shape == 'ring' else i + 1}") for i in range(n)]
    df = spark.createDataFrame([("g", p, c) for p, c in edges], "g string, p string, c string")
    log, core = hierarchy.contract(df)
    assert len(log) <= 25 and (shape == "chain") <= (core is None)
    assert hierarchy.ancestors(df, (log, core)).count() == {"chain": n * (n + 1) // 2, "ladder": 4 * n * (n + 1) // 2, "ring": n * n}[shape]
    nodes = df.select("g", "p").union(df.select("g", "c")).distinct().toDF("g", "n")
    ways = hierarchy.ways_from_roots(nodes, df, (log, core)).selectExpr("count(*)", "max(size(way))").first()
    assert tuple(ways) == {"chain": (n + 1, n), "ladder": (2 * (2 * n + 1), n), "ring": (0, None)}[shape]


def test_ancestors_of_nothing(spark):
    assert hierarchy.ancestors(spark.createDataFrame([], "g string, p string, c string")).count() == 0


def test_merkle_changes_and_publication(spark, tmp_path):
    records = spark.createDataFrame([(f"k{i}", f"v{i}") for i in range(500)] + [("k1", "v1"), (None, "x")], "k string, state string")
    led = incremental.Ledger(spark, str(tmp_path / "ledger"))
    assert led.current() is None
    todo, tree = incremental.changes(records, None, None, ["k"], "state", 2)
    assert todo.count() == 500
    publish = lambda todo, rows, tree: led.publish(todo, rows.where("k IS NOT NULL").dropDuplicates(["k"]), tree, ["k"], "state", 2)
    publish(todo, records, tree)
    first = led.current()
    later = records.where("k <> 'k7'").withColumn("state", F.when(F.col("k") == "k3", F.lit(None)).otherwise(F.col("state"))).unionByName(spark.createDataFrame([("new", "v")], "k string, state string"))
    for _ in range(2):  # a run that fails before it publishes changes nothing
        todo, tree = incremental.changes(later, led.load("records"), led.load("tree"), ["k"], "state", 2)
        assert {(x["k"], x["change"]) for x in todo.collect()} == {("k3", "changed"), ("new", "added"), ("k7", "removed")}
    publish(todo, later, tree)
    assert led.current() != first
    assert incremental.changes(later, led.load("records"), led.load("tree"), ["k"], "state", 2)[0].count() == 0


def test_ledger_keeps_clashing_columns_and_empty_tables(spark, tmp_path):
    led = incremental.Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([(1, "a", 7, 8, 9, {"x": 1})], "k long, state string, leaf int, range int, node int, m map<string,int>")
    assert led.take(rows.limit(0), ["k"], "state").count() == 0
    assert led.take(rows, ["k"], "state").collect()[0].asDict() == {"k": 1, "state": "a", "leaf": 7, "range": 8, "node": 9, "m": {"x": 1}, "change": "added"}
    assert led.take(rows, ["k"], "state").count() == 0


def test_ledger_survives_a_crash_and_reads_only_the_tree_without_changes(spark, tmp_path, monkeypatch):
    led = incremental.Ledger(spark, str(tmp_path / "ledger"))
    # repeated keys with other columns: one row by the greatest state, the same one each time
    rows = spark.createDataFrame([(f"k{i}", f"v{i}", i) for i in range(900)] + [("k1", "v0", 5), ("k1", None, 6)], "k string, state string, more int")
    assert led.take(rows, ["k"], "state").count() == 900
    first = led.current()
    changed = rows.withColumn("state", F.when(F.col("k") == "k8", F.lit("new")).otherwise(F.col("state"))).where("k <> 'k9'")
    with monkeypatch.context() as m:
        m.setattr(incremental.Ledger, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost between output and commit")))
        with pytest.raises(RuntimeError):
            led.take(changed, ["k"], "state")
    assert led.current() == first
    assert {(r["k"], r["change"]) for r in led.take(changed, ["k"], "state").collect()} == {("k8", "changed"), ("k9", "removed")}
    again, _ = incremental.changes(changed, led.load("records"), led.load("tree"), ["k"], "state", led.levels())
    assert again.count() == 0 and "records" not in " ".join(again.inputFiles())
    assert led.take(changed, ["k"], "state").count() == 0 and led.take(changed.limit(0), ["k"], "state").where("change = 'removed'").count() == 899


def test_pending_of_units_and_signs(spark):
    runs = spark.createDataFrame([(1, "ok"), (2, "failed")], "run_id long, status string")
    docs = [(1, 100.0, 200.0, 1), (2, 300.0, 200.0, 1), (3, 100.0, None, None), (4, 100.0, 0.0, None), (5, 100.0, 200.0, 2), (6, 1.7e12, 1.7e9, 1), (7, 1.7e12 + 1, 1.7e9, 1), (8, 100.0, -1.0, 1), (9, float("nan"), 200.0, 1), (1, 100.0, 200.0, 1)]
    d = spark.createDataFrame([(*x, None) for x in docs], "doc_id long, mtime double, indexed_at double, run_id long, deleted_at timestamp")
    items = spark.createDataFrame([("a", "done", 1, 1, None), ("A ", "error", 2, 2, 2), ("b", "Pending", 1, 3, None), ("c", "done", 1, 4, 2), ("d", " DONE", 1, 5, 1), (None, "done", 1, 6, 1)], "item_id string, status string, ts int, seq long, run_id long")
    got = incremental.pending(incremental.document_states(d, runs).unionByName(incremental.item_states(items, runs)))
    assert {(x["table_name"], x["record_key"]) for x in got.collect()} == {("documents", k) for k in "234578"} | {("items", "b"), ("items", "c")}


def test_paths_that_lead_to_one_file(spark):
    same = ["a/b c.md", " A/B c.md", "./a/b%20c.md", "a//b c.md", "a\\b c.md", "a/x/../b c.md", "/a/b c.md"]
    df = spark.createDataFrame([(p,) for p in same], "p string").select(path_key(F.col("p")).alias("k"))
    assert {x["k"] for x in df.collect()} == {"a/b c.md"}
    odd = spark.createDataFrame([("100%/x",), ("a+b",), ("",), (None,)], "p string").select(path_key(F.col("p")).alias("k"))
    assert [x["k"] for x in odd.collect()] == ["100%/x", "a+b", None, None]


def test_orphans_hot_missing_and_empty(spark):
    parents = spark.createDataFrame([("item", f"i{k}") for k in range(50)], "kind string, target string")
    refs = [("t", k, "item", f"i{k % 60}", None) for k in range(300)] + [("t", 1000 + k, "item", "gone", None) for k in range(200)] + [("t", 1000, "item", "gone", None)]
    r = spark.createDataFrame(refs, "table_name string, row_id long, kind string, target string, at timestamp_ntz")
    got = {x["row_id"] for x in orphans.orphans(parents, r).collect()}
    assert got == {k for k in range(300) if k % 60 >= 50} | {1000 + k for k in range(200)}
    assert orphans.orphans(parents.limit(0), r).count() == 500
    assert orphans.orphans(parents, r.limit(0)).count() == 0
