"""Operators for training data do their whole job: cases on which a cut would show."""

from itertools import permutations

import numpy as np
import pandas as pd
import pytest

from quern.llm import names


def test_long_mentions_are_linked(spark):
    long = "Royal Northern Institute Applied Curation Archives Libraries Museums Galleries Records Manuscripts Maps Charters Seals"
    cat = spark.createDataFrame([("Q1", long, None, "organisation"), ("Q2", "Harbour Museum", ["Old " + long], "organisation"), ("Q3", "Ada Quill", None, "human")], "qid string, label string, aliases array<string>, type_hint string")
    asked = [(1, long), (2, long.replace("Manuscripts", "Manuscritps")), (3, "Old " + long), (4, long.replace("Seals", "Zebras Paint")), (5, "ada quill")]
    got = {r["res_id"]: r["qid"] for r in names.link(spark.createDataFrame(asked, "res_id long, mention string"), cat).collect()}
    assert got == {1: "Q1", 2: "Q1", 3: "Q2", 5: "Q3"}


def test_hungarian_equals_brute_force():
    g = np.random.default_rng(3)
    for _ in range(200):
        n, m = (int(x) for x in sorted(g.integers(1, 6, size=2)))
        grid = [[None if g.random() < 0.4 else float(x) for x in row] for row in g.random((n, m)).round(2)]
        every = [sum(c) for p in permutations(range(m), n) if None not in (c := [grid[i][k] for i, k in enumerate(p)])]
        got = names._hungarian(grid)
        assert (got is None) == (not every) and (not every or got[0] == pytest.approx(min(every)))


def test_short_forms_and_initials_beyond_any_list(spark):
    """Short forms that begin like the name, learned ones, everyday ones, and initials of middle names that the catalogue lacks."""
    people = ["Stephen Quillmoor", "Jonathan Varstead", "Christopher Ombrey", "Zebulon Hartwhistle", "Zebulon Crake", "Mary Undersole"]
    cat = [(f"Q{i}", n, ["Zeb Crake", "Wuz Crake"] if "Crake" in n else ["Wuz Hartwhistle"] if "Hart" in n else None, "human") for i, n in enumerate(people)]
    asked = ["Steve Quillmoor", "Jon Varstead", "Chris Ombrey", "Stephen J. R. Quillmoor", "Wuz Hartwhistle", "Molly Undersole", "Ste Quillmore", "Jo Varstead", "A. B. C. D. Quillmoor", " ".join("abcdefgh" * 300) + " Quillmoor"]
    got = {r["res_id"]: r["qid"] for r in names.link(spark.createDataFrame(list(enumerate(asked)), "res_id long, mention string"), spark.createDataFrame(cat, "qid string, label string, aliases array<string>, type_hint string")).collect()}
    assert got == {0: "Q0", 1: "Q1", 2: "Q2", 3: "Q0", 4: "Q3", 5: "Q5", 6: "Q0"}


def _linked(spark, cat, asked):
    """Links by the place of the mention asked."""
    k = spark.createDataFrame([(q, n, a, "human" if q[0] == "H" else "organisation") for q, n, a in cat], "qid string, label string, aliases array<string>, type_hint string")
    m = spark.createDataFrame(list(enumerate(asked)), "res_id long, mention string")
    return {r["res_id"]: r["qid"] for r in names.link(m, k).collect()}


def test_lost_blanks_are_found_in_any_number_of_tokens(spark):
    """More than four pieces, two glued tokens, a glued token near a known word, stop words in between; no half of a surname."""
    cat = [("H1", "Anna Maria Luisa Fernanda Ortegaveld", None), ("O2", "Tornizomont Institute of Applied Paper Curation", None), ("H3", "Margaret Henrietta Casimir Verzotumont", None)]
    cat += [("H4", "Zacharias Zanfegrove", None), ("O5", "University of Cordapeino", None), ("H6", "Alexander Emzoroø", None), ("H7", "Margaret Liu", None)]
    asked = ["annamarialuisafernandaortegaveld", "tornizomontinstituteofappliedpapercuration", "margarethenrietta casimirverzotumont", "zzanfegrove", "UniversityOfTheCordapeino", "margaretliu"]
    wrong = ["zanfegrove", "zanfegrive", "Alexander Emzozolund", "ofof", "x" * 3000, "Verzotumont", "Zacharias Zanfegrovecasimir", "margaretliuin"]
    assert _linked(spark, cat, asked + wrong) == {0: "H1", 1: "O2", 2: "H3", 3: "H4", 4: "O5", 5: "H7"}


def test_no_index_leaves_candidates_out(spark):
    """A misspelling that is another's name, misspelled aliases, names of generic words only, one letter at the end, acronyms of any length."""
    cat = [("H1", "Ada Quillmoore", None), ("H2", "Berta Quillmoorz", None), ("H3", "Samuel Clemensson", ["Mark Twainford", "S. Twainford"]), ("H4", "Malcolm X", None)]
    cat += [("O1", "Public Record Office Museum", None)] + [(f"O{i}", f"Public Record Office Museum {chr(97 + i)}{chr(97 + i)}stad", None) for i in range(10, 20)]
    cat += [("O2", "EUROMET", None), ("O3", "Harbour Society", None), ("O4", "Bureau of Rare Early Coastal Charts Maps Tables Seals", ["UX"])]
    asked = ["Berta Quillmoore", "Mark Twianford", "Public Record Ofice Mus.", "Malcom X", "Euromet", "BRECCMTS", "ux", "Harbor Society"]
    assert _linked(spark, cat, [*asked, "Stella Twainford", "Public Record", "S. Q. Twainford"]) == {0: "H2", 1: "H3", 2: "O1", 3: "H4", 4: "O2", 5: "O4", 6: "O4", 7: "O3"}


def test_short_forms_of_one_alias_in_a_large_catalogue(spark):
    """A short form counts however many entities there are, in whichever shard they lie."""
    letters = "bcdfghjklm"
    filler = [(f"O{i}", "".join(letters[int(c)] + "a" for c in f"{i:04d}") + " Guild", None) for i in range(7000)]
    cat = [("H1", "Zebulon Crake", ["Wuz Crake"])] + [(f"H{i}", f"Zebulon {n}", None) for i, n in enumerate(["Hartwhistle", "Ombrey", "Varstead", "Undersole"], 2)] + filler
    asked = ["Wuz Hartwhistle", "Wuz Ombrey", "Wuz Varstead", "Wuz Undersole", "Wuz Crake"]
    assert _linked(spark, cat, asked) == {0: "H2", 1: "H3", 2: "H4", 3: "H5", 4: "H1"}


def test_given_acronyms_win_in_any_shard(spark, monkeypatch):
    cat = [("O1", "Quillmoor Trust", ["HMG"]), ("O2", "Harbour Maps Guild", None)] + [(f"O{i}", f"Varstead{chr(97 + i)} Trust", None) for i in range(3, 9)]
    for shard in (1, names.SHARD):
        monkeypatch.setattr(names, "SHARD", shard)
        assert _linked(spark, cat, ["HMG", "Harbour Maps Guidl"]) == {0: "O1", 1: "O2"}


def test_every_mention_of_a_key_is_linked(spark):
    k = spark.createDataFrame([("H1", "Ada Quill", None, "human"), ("H2", "Berta Moor", None, "human")], "qid string, label string, aliases array<string>, type_hint string")
    m = spark.createDataFrame([(1, "Ada Quill"), (1, "Berta Moor"), (1, "ada quill")], "res_id long, mention string")
    assert sorted((r["res_id"], r["qid"]) for r in names.link(m, k).collect()) == [(1, "H1"), (1, "H2")]


def test_candidates_equal_all_entities():
    """The indexes reach every entity that a comparison with all of them accepts."""
    g = np.random.default_rng(11)
    part = lambda: "".join(g.choice(list("abet"), g.integers(2, 8)))
    first, second = [part() for _ in range(8)], [part() for _ in range(25)]
    rows = [(f"{i:03d}", " ".join([*g.choice(first, g.integers(1, 3)), g.choice(second)]), [f"{g.choice(first)} {g.choice(second)}"], "human" if i % 2 else "organisation") for i in range(80)]
    generic = frozenset(first[:4])
    linker = names.Linker(pd.DataFrame(rows, columns=["qid", "label", "aliases", "kind"]), generic, {first[5]: frozenset(first[:1])})
    seen = [0, 0]
    for _ in range(300):
        m = [x for x in "".join(c for c in rows[g.integers(80)][1] + g.choice(["", "b"]) if g.random() > 0.05 + 0.3 * (c == " ")).split()]
        for glued in (False, True):
            got, every = {}, {}
            (linker._glued if glued else linker._candidates)(m, got)
            pieces = [[linker._starts(t[i:]) for i in range(len(t))] for t in m]
            for i, (_, human, forms) in enumerate(linker.entity):
                costs = [linker._read(m, pieces, f, human, human and at > 0) if glued else linker._accept(m, f, human, human and at > 0) for at, f in enumerate(forms)]
                if any(c is not None for c in costs):
                    every[i] = min(c for c in costs if c is not None) + 0.3 * glued
            assert got == pytest.approx(every)
            seen[glued] += len(got)
    assert min(seen) > 50


def test_pieces_equal_single_walks():
    g = np.random.default_rng(12)
    for _ in range(100):
        trie = names.Trie({"".join(g.choice(list("abc"), g.integers(2, 10))) for _ in range(40)})
        text = "".join(g.choice(list("abc"), g.integers(1, 12)))
        assert sorted(trie.starts(text)) == sorted((i, w, d) for i in range(1, len(text) + 1) for w, d in trie.near(text[:i], names.bound(text[:i])))


def test_assignments_cover_what_they_must():
    """A dearer assignment that covers first and last name counts, also where the search goes over to polynomial time."""
    linker = names.Linker(pd.DataFrame([], columns=["qid", "label", "aliases", "kind"]), frozenset(), {"jack": frozenset({"john"})})
    assert linker._accept(["jack", "smith"], ["john", "jack", "smith"], True) == pytest.approx(0.25)
    tail = [f"name{chr(97 + i)}" for i in range(14)]
    assert linker._accept(["jack", *tail, "smith"], ["john", "jack", *tail, "smith"], True) == pytest.approx(0.25)
