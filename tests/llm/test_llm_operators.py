"""Operators for training data against brute force, exact round trips and edge cases."""

import random

import numpy as np
import pandas as pd
import pytest

from quern.llm import components, leakage, names, neighbours, ranking, stuffing, tokens


def test_components_equal_union_find(spark):
    r = random.Random(4)
    edges = [(f"v{r.randrange(300):03d}", f"v{r.randrange(300):03d}") for _ in range(260)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"h{i}") for i in range(100)]
    edges += [(None, "x"), ("s", "s"), edges[0], edges[0][::-1]]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = components.components(spark.createDataFrame(edges, "a string, b string"))
    assert {(x["v"], x["group"]) for x in got.collect()} == {(v, find(v)) for v in list(up)}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_refused_pairs_make_no_edge(spark):
    rows = [("A ", "b", True), ("b", "a", None), ("b", "c", False), ("c", "d", None), ("d", None, True), ("e", " E", True), ("", "f", True)]
    got = components.accepted_edges(spark.createDataFrame(rows, "id_a string, id_b string, accepted boolean"))
    assert {(x["a"], x["b"]) for x in got.collect()} == {("a", "b"), ("c", "d")}


def _pairs(x, keys, k=5, least=0.9):
    u = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 5)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    near = [{j for j in sorted(range(len(keys)), key=lambda j: (-s[i, j], keys[j]))[:k] if s[i, j] >= least} for i in range(len(keys))]
    return {(min(keys[i], keys[j]), max(keys[i], keys[j])) for i in range(len(keys)) for j in near[i] if i in near[j]}


def test_similar_pairs_recall(spark):
    g = np.random.default_rng(3)
    base = g.normal(size=(900, 16))
    x = np.concatenate([base, base[:200] + 0.03 * g.normal(size=(200, 16)), base[:40] * 7, np.repeat(base[-1:], 30, 0)])
    keys = [f"{i:05d}" for i in range(len(x))]
    rows = [("s", k, [float(y) for y in v]) for k, v in zip(keys, x)] + [("s", "null", None), ("s", "zero", [0.0] * 16), ("s", "short", [1.0]), ("other", "00000x", [float(y) for y in x[0]]), (None, "q", None)]
    df = spark.createDataFrame(rows, "space string, key string, embedding array<float>").where("space IS NOT NULL")
    got = {(r["key_a"], r["key_b"]) for r in neighbours.similar_pairs(df, 16, shard_rows=300, max_rows=250).collect()}
    true = _pairs(x, keys)
    assert len(got & true) >= 0.95 * len(true) and not any("0x" in a for a, _ in got) and len(got - true) <= 0.03 * len(true)


def test_nearest_recall(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(1500, 16))
    df = spark.createDataFrame([("s", f"{i:05d}", [float(y) for y in v]) for i, v in enumerate(x)], "space string, key string, embedding array<float>")
    got = neighbours.nearest(df, df.where("CAST(key AS INT) % 50 = 0"), 16, shard_rows=500).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(0, 1500, 50):
        true = {f"{j:05d}" for j in np.argsort(-(u @ u[i]))[1:6]}
        hits += len(true & set(got[got.key == f"{i:05d}"].neighbour))
    assert hits >= 0.9 * 150


def test_every_equal_query_is_answered(spark):
    g = np.random.default_rng(8)
    x = np.concatenate([np.repeat(g.normal(size=(1, 16)), 13, 0), g.normal(size=(60, 16))])
    df = spark.createDataFrame([("s", f"{i:03d}", [float(y) for y in v]) for i, v in enumerate(x)] + [("s", "000", [float(y) for y in x[0]])], "space string, key string, embedding array<float>")
    got = neighbours.nearest(df, df, 16).groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in got} == {f"{i:03d}": 5 for i in range(73)}


def test_cells_of_shards_that_few_centroids_leave_large(spark):
    """With two centroids only, shards are cut into cells; what a query visits doesn't grow and neighbours are still found."""
    g = np.random.default_rng(6)
    base = g.normal(size=(2400, 16))
    x = np.concatenate([base, base[:300] + 0.02 * g.normal(size=(300, 16))])
    df = spark.createDataFrame([("s", f"{i:05d}", [float(y) for y in v]) for i, v in enumerate(x)], "space string, key string, embedding array<float>")
    got = {(r["key_a"], r["key_b"]) for r in neighbours.similar_pairs(df, 16, shard_rows=150, max_rows=400, centroids_most=2).collect()}
    true = _pairs(x, [f"{i:05d}" for i in range(len(x))])
    assert len(got & true) >= 0.95 * len(true) and len(got - true) <= 0.03 * len(true)


def test_leximin_absent_lists_and_gaps(spark):
    rows = [(1, "a", "vec", "x", 0.9, 1), (1, "a", "vec ", "y", 0.8, 2), (1, "a", "VEC", "z", 0.7, 3), (1, "b", "fts", "y", -5.0, 0), (1, "b", "fts", "x", -4.0, None), (1, "b", "fts", "w", -3.0, 2), (1, "b", "fts", None, 9.0, 1), (1, "b", "fts", "y", float("nan"), 0)]
    df = spark.createDataFrame([(*r, None) for r in rows], "query_id long, list_label string, source string, id string, score double, rank int, logged_at timestamp_ntz")
    got = [(r["id"], r["lists_in"]) for r in ranking.rank_items(df).orderBy("place").collect()]
    assert got[:2] in ([("y", 2), ("x", 2)], [("x", 2), ("y", 2)]) and {i for i, _ in got[2:]} == {"z", "w"}
    assert ranking.rank_items(df.limit(0)).count() == 0


def test_names(spark):
    kb = [("Q1", "Elizabeth Cornelius Vergilaovič", ["Liz Vergilaovič"], "human"), ("Q2", "Margaret Verzotumont", None, "human"), ("Q3", "Tornizomont Public Library", [], "organisation"), ("Q4", "Society for Oral History in Cordapeino", ["SOHC"], "organisation"), ("Q5", None, None, "human")]
    kb += [(f"Z{i}", f"Society for Rare Maps in Place{chr(97 + i)}{chr(97 + i)}xy", None, "organisation") for i in range(20)] + [(f"L{i}", f"Town{chr(97 + i)}{chr(98 + i)}q Public Library", None, "organisation") for i in range(10)]
    asked = {1: "vergilaovic, E. C.", 2: "Dr Beth Vergi1aovič", 3: "MARGARTE VERZOTUMONT", 4: "Robert Verzotumont", 5: "Public Lib. of Tornizomont", 6: "S.O.H.C.", 7: "", 8: None, 9: "margaretverzotumont", 10: "Tornizomont University", 11: "M. V. Verzotumont", 12: "Elizabeth Q. Vergilaovič", 13: "x" * 5000}
    m = spark.createDataFrame(list(asked.items()), "res_id long, mention string")
    k = spark.createDataFrame(kb, "qid string, label string, aliases array<string>, type_hint string")
    got = {r["res_id"]: r["qid"] for r in names.link(m, k).collect()}
    assert got == {1: "Q1", 2: "Q1", 3: "Q2", 5: "Q3", 6: "Q4", 9: "Q2", 11: "Q2"}
    assert names.link(m.limit(0), k).count() == 0 and names.link(m, k.limit(0)).count() == 0


def test_trie_distances():
    t = names.Trie(["kitten", "mitten", "sitting"])
    assert dict(t.near("kittne", 1)) == {"kitten": 1} and dict(t.near("mitten", 1)) == {"mitten": 0, "kitten": 1}


def test_forced_boundaries_round_trip(spark):
    enc = tokens.encoder(f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}")
    r = random.Random(9)
    alphabet = list("ab'sé ñ \t\n\r  .,!?1234中文àÀ\x1c\x85<|>endoftext👩‍")
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000)] + ["a" * 30000, "中文" * 5000, " " * 9000, "<|endoftext|>", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumnRenamed("text", "t")
    got = {x["doc_id"]: x["ids"] for x in tokens.encode(df, "doc_id", "t").collect()}
    for i, t in enumerate(texts):
        assert got[i] == (enc.encoding.encode_ordinary(t) if t else [])
        assert enc.encoding.decode(got[i]) == (t or "")


WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600 // 1)][:600]


def test_leaks_whole_partial_changed(spark):
    r = random.Random(2)
    say = lambda n: [r.choice(WORDS) for _ in range(n)]
    p = say(60)
    changed = [w if i % 9 else "other" for i, w in enumerate(p)]
    texts = {1: say(80) + p + say(80), 2: say(50) + p[:34] + say(50), 3: say(200), 4: [w.upper() for w in changed], 5: say(60) + p[10:18] + say(60), 6: p[:17] + say(300) + p[17:34], 7: None, 8: [], 9: list(reversed(p))}
    docs = spark.createDataFrame([(k, None if t is None else "<br/>".join([" ".join(t)])) for k, t in texts.items()] + [(1, " ".join(texts[1]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(p)), (2, " ".join(p)), (3, None), (4, ""), (5, "two words")], "item_id long, passage string")
    got = {(x["doc_id"], x["item_id"]) for x in leakage.leaks(docs, "doc_id", "text", items, "item_id", "passage").collect()}
    assert got == {(d, i) for d in (1, 2, 4, 6) for i in (1, 2)}
    assert leakage.leaks(docs.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0
    assert leakage.leaks(docs, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


def test_leaks_in_blocks_and_long_documents(spark):
    """A dictionary in many blocks finds the same; a passage many times in one long document is found in linear time."""
    r = random.Random(12)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    ps = [say(50) for _ in range(40)]
    docs = [(i, f"{say(30)} {ps[i]} {say(30)}" if i % 2 else say(100)) for i in range(40)] + [(100, (ps[3] + " ") * 3000), (101, " ".join(["a"] * 20000)), (102, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(ps)), "item_id long, passage string")
    got = [{(x["doc_id"], x["item_id"]) for x in leakage.leaks(df, "doc_id", "text", items, "item_id", "passage", block_chars=n).collect()} for n in (2000, 10**9)]
    assert got[0] == got[1] == {(i, i) for i in range(1, 40, 2)} | {(100, 3)}


def test_only_the_prefix_is_joined():
    """Every pair with enough shared shingles passes the prefix join; it forms fewer pairs than the join on all shingles."""
    r = random.Random(3)
    ps = [[r.choice(WORDS[:60]) for _ in range(30)] for _ in range(30)]
    texts = [" ".join(ps[r.randrange(30)][: r.choice([4, 8, 30])] + [r.choice(WORDS[:60]) for _ in range(40)]) for _ in range(200)]
    block = leakage.Passages([" ".join(p) for p in ps])
    text, place, shingle, size = block.hits(pd.Series(texts))
    block.order(np.bincount(np.unique(text * len(block.codes) + shingle) % len(block.codes), minlength=len(block.codes)))
    joined = [{(int(text[i]), int(p)) for i, p in zip(*leakage._joined(o, shingle))} for o in (block.of_prefix, block.of_shingle)]
    shared = [set(shingle[text == t]) for t in range(200)]
    enough = {(t, p) for t in range(200) for p in range(30) if len(shared[t] & set(block.own[p])) >= block.need[p]}
    assert enough <= joined[0] < joined[1] and len(joined[0]) < len(joined[1])


def test_words_ignore_layout():
    assert leakage.words("The v5.28\n> `re_build` d\\u00e9j&agrave; <br/>ﬁne") == leakage.words("the V528 rebuild deja fine")


def test_stuffed_pages(spark):
    r = random.Random(7)
    voc = [f"{a}{b}{c}" for a in ("re", "mo", "ta", "li") for b in ("ka", "ne", "so", "du") for c in ("ton", "mer", "sil", "gat", "ven")]
    prose = lambda: " ".join(f"The {r.choice(voc)} of {r.choice(voc)} {r.choice(voc)}s with the {r.choice(voc)} and it has a {r.choice(voc)}." for _ in range(9))
    docs = [(i, prose(), "en") for i in range(200)]
    docs += [(900, " ".join(r.choice(["gold", "ring", "buy"]) for _ in range(150)), "en"), (901, "\n".join(f"http://{v}.test/{i}" for i, v in enumerate(voc[:40])), None), (902, " ".join(f"#{a}{b}" for a, b in zip(voc, voc[::-1])), "en")]
    docs += [(903, "\n".join(f"- {v}: the {r.choice(voc)} of a {r.choice(voc)} that is in {r.choice(voc)}" for v in voc[:40]), "en"), (904, None, "en"), (905, "", "en"), (906, "word", None), (907, "https://a.b/c https://d.e/f", "en"), (908, " \t", "xx")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {x["doc_id"] for x in stuffing.stuffed(df, "doc_id", "text", "lang").collect()}
    assert got == {900, 901, 902, 907}
    assert stuffing.stuffed(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_the_distance_decides_about_pages(spark):
    """Pages in a spam-directed direction that don't lie far out are no spam: without the distance more would be flagged."""
    r = random.Random(5)
    voc = [a + b + c + d for a in ("re", "mo", "ta", "li") for b in ("ka", "ne", "so", "du") for c in ("to", "me", "si", "ga", "ve") for d in ("n", "rt", "x", "ck", "lm")]
    prose = lambda n: [w for _ in range(n) for w in ("the", r.choice(voc), "of", "a", r.choice(voc), "is", r.choice(voc))]
    docs = [(i, " ".join(prose(r.randrange(8, 20)) + [r.choice(voc) for _ in range(r.choice([0, 4, 12]))])) for i in range(300)]
    docs += [(1000 + i, " ".join(prose(12) + [r.choice(voc[: 2 + i]) for _ in range(6 + i)])) for i in range(20)] + [(2000 + i, " ".join(r.choice(voc[:3]) for _ in range(200))) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' AS lang")
    near, far = ({x["doc_id"] for x in stuffing.stuffed(df, "doc_id", "text", "lang", far=f, directed=0.0).collect()} for f in (0.0, stuffing.FAR))
    assert far < near and {x for x in far if x >= 2000} == set(range(2000, 2005))


@pytest.mark.parametrize("n", [1, 3, 60])
def test_graph_of_few_points(n):
    from quern.llm.graph_index import ShardGraph

    x = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = ShardGraph(x, 4, 8)
    g.build(3)
    ids, sims = g.search(x, 1)
    assert (ids[:, 0] == np.arange(n)).mean() > 0.95 and pd.notna(sims).all()
