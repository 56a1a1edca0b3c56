"""Providers, expanded search, claims, two-pass resolution and graph cleaning."""

from pyspark.sql import functions as F

from quern.functions import providers
from quern.operators import knowledge, resolution, retrieval


def test_embedding_uses_the_cache(spark):
    t = spark.createDataFrame([(1, "a text"), (2, "a text"), (3, None), (4, "other")], "id int, text string")
    first = providers.embed(t)
    assert first.count() == 3 and first.select("text_hash").distinct().count() == 2
    cache = first.dropDuplicates(["text_hash"]).select("text_hash", F.lit("hashed-64").alias("model_name"), "embedding")

    def broken(_):
        raise RuntimeError("must not be called")

    assert providers.embed(t, broken, cache=cache).count() == 3


def test_nli_and_generation(spark):
    p = spark.createDataFrame([(1, "it is so", "it is so"), (2, "it is so", "it is not so"), (3, None, "x y")], "id int, premise string, hypothesis string")
    assert {r["id"]: r["nli"] for r in providers.classify_nli(p).collect()} == {1: "entailment", 2: "contradiction", 3: "neutral"}
    q = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, prompt string").coalesce(1)

    def model(ps):
        if "bad" in ps:
            raise ValueError("no")
        return [x.upper() for x in ps]

    assert {r["id"]: (r["answer"], r["error"]) for r in providers.generate(q, model, 1).collect()} == {1: ("OK", None), 2: (None, "no")}


def test_expanded_search(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue whale"), (3, "green frog")], "id long, content string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "id long, embedding array<double>")
    o = spark.createDataFrame([(0, "red fox", [1.0, 0.0])], "qid int, query string, q array<double>")
    e = spark.createDataFrame([(0, 1, "lex", "whale", None), (0, 2, "vec", "a sea animal", [0.0, 1.0])], "qid int, seq int, type string, query string, q array<double>")
    got = retrieval.expanded_hybrid(v, docs, o, e, 3).orderBy("rank").collect()
    assert got[0]["id"] in (1, 2) and {t["list_label"] for r in got for t in r["traces"]} == {"vec:original", "fts:original", "fts:whale", "vec:vec:a sea animal"}


def test_claims_variants_two_pass(spark):
    c = spark.createDataFrame([("Q1", "P569", "normal", "+1850-01-01", 1), ("Q1", "P569", "deprecated", "+1700", 0), ("Q1", "P570", None, "1900", 2), ("Q2", "P50", None, "Q1", 1)], "qid string, property string, rank string, value string, ord int")
    r = resolution.life_dates(c).where("qid = 'Q1'").first()
    assert (r["start"], r["end"]) == (1850, 1900) and resolution.claim_values(c, "P569").first()["first"] == "+1850-01-01"
    m = spark.createDataFrame([("Charles V",), ("Ada",)], "m string").select(resolution.regnal_variants(F.col("m")).alias("v")).collect()
    assert m[0]["v"] == ["Charles V", "Carl V", "Karl V", "Carlos V", "Carlo V"] and m[1]["v"] == ["Ada"]
    cand = spark.createDataFrame([(1, "Q1", 0.7), (2, "Q2", 0.45), (2, "Q3", 0.45)], "mention_id int, qid string, base double")
    got = {x["mention_id"]: (x["status"], x["qid"]) for x in resolution.two_pass(cand, c, ["P50"]).collect()}
    assert got == {1: ("resolved", "Q1"), 2: ("resolved", "Q2")}


def test_clean_and_acyclic(spark):
    n = spark.createDataFrame([("g", "a", "A", None, None, ["a", "b", "x"]), ("g", "b", "B", 1, 1, None), ("g", "", "C", 1, 1, []), ("g", "d", None, 1, 1, [])], "g string, id string, title string, level int, obscurity int, prerequisites array<string>")
    got = {r["id"]: (r["level"], r["prerequisites"]) for r in knowledge.clean_nodes(n).collect()}
    assert got == {"a": (2, ["b"]), "b": (1, [])}
    e = spark.createDataFrame([("g", "a", "b"), ("g", "b", "a"), ("g", "a", "c")], "g string, p string, c string")
    assert {(r["p"], r["c"]) for r in knowledge.break_cycles(e).collect()} == {("b", "a"), ("a", "c")}


def test_fetch_retries_by_status_and_follows_redirects(spark, tmp_path):
    from quern.sources.files import ProviderError, fetch_missing

    folder = str(tmp_path)

    def fetch(keys):
        import os
        import uuid

        open(os.path.join(folder, f"{'-'.join(keys)}.{uuid.uuid4().hex}"), "w").close()
        if keys == ["missing"]:
            raise ProviderError("no such key", 404)
        if keys == ["busy"]:
            raise ProviderError("slow down", 429, retry_after=0.0)
        return {k: ("redirect", "new") if k == "old" else ("redirect", "old") if k == "loop" else k.upper() for k in keys}

    keys = spark.createDataFrame([(k,) for k in ["a", "a", "old", "loop", "missing", "busy", None]], "key string")
    got = {r["key"]: (r["payload"], r["error"]) for r in fetch_missing(keys, fetch, batch=1, tries=3).collect()}
    assert got["a"] == ("A", None) and got["old"] == ("NEW", None) and got["loop"][0] is None
    assert got["missing"] == (None, "no such key") and got["busy"] == (None, "slow down") and len(got) == 5
    calls = [p.name.split(".")[0] for p in tmp_path.iterdir()]
    assert calls.count("missing") == 1 and calls.count("busy") == 3 and calls.count("a") == 1


def test_yaml_files_keep_a_backup_and_are_deleted(spark, tmp_path):
    from quern.sources.files import delete_yaml, read_yaml, write_yaml

    home = str(tmp_path / "store")
    one = lambda v: spark.createDataFrame([("work", "w1", '{"id": "w1", "n": %d}' % v), ("work", "w2", '{"id": "w2"}')], "entity_type string, entity_id string, data string")
    assert write_yaml(one(1), home) == 2 and write_yaml(one(2), home, backup=True) == 2
    assert {r["entity_id"] for r in read_yaml(spark, home).collect()} == {"w1", "w2"}
    assert "n: 1" in (tmp_path / "store/work/w1.yaml.bak").read_text() and "n: 2" in (tmp_path / "store/work/w1.yaml").read_text()
    assert delete_yaml(one(1), home) == 2 and delete_yaml(one(1), home) == 0 and read_yaml(spark, home).count() == 0
