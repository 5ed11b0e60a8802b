"""Scores against SQLite's FTS5 with the same columns and weights."""

import random
import sqlite3

import pytest

from stratagraph.errors import ConfigDrift
from stratagraph.functions.search import FullTextIndex, highlight, wanted_words
from stratagraph.functions.text import fold, stem_de, stem_en, stem_es, stem_folded, stem_fr, tokens

NOTES = ["Laternen aus dem Berg", "Der Laterne im Schrank, ein Laterne", "berge und täler", None, "", "Ein m² Laternenglas", "the lanterns were growing in the mountains"]
DESCS = ["growing lanterns", None, "a mountain of lantern", "lanterns lanterns", "drawer", None, "Lantern drawer; hardness scale of a lantern"]


@pytest.fixture(scope="module")
def index(spark):
    gems = spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(zip(NOTES, DESCS))], "oid bigint, notes string, description string")
    vendors = spark.createDataFrame([(100, "lantern clear"), (101, "Berg und Tal")], "oid bigint, motto string")
    return FullTextIndex.build({"Gem": {"notes": "de", "description": "en"}, "Vendor": {"motto": None}}, {"Gem": gems, "Vendor": vendors})


def fts5(query, match):
    cols = [("notes", "de"), ("description", "en"), ("motto", None)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table docs using fts5(typename, f_notes, s_notes, f_description, s_description, f_motto, s_motto, tokenize='unicode61')")
    docs = [(i, "Gem", {"notes": n, "description": d}) for i, (n, d) in enumerate(zip(NOTES, DESCS))] + [(100, "Vendor", {"motto": "lantern clear"}), (101, "Vendor", {"motto": "Berg und Tal"})]
    for oid, kind, v in docs:
        row = [kind]
        for f, lang in cols:
            words = None if v.get(f) is None else tokens(v[f])
            row += [None if words is None else " ".join(map(fold, words)), " ".join(stem_folded(w, lang) for w in words) if words is not None and lang else None]
        con.execute("insert into docs (rowid, typename, f_notes, s_notes, f_description, s_description, f_motto, s_motto) values (?,?,?,?,?,?,?,?)", (oid, *row))
    clauses = []
    for unit in wanted_words(query):
        forms = dict.fromkeys([f'f_{f} : "{" ".join(map(fold, unit))}"' for f, _ in cols] + [f's_{f} : "{" ".join(stem_folded(w, lang) for w in unit)}"' for f, lang in cols if lang])
        clauses.append("(" + " OR ".join(forms) + ")")
    sql = "select rowid, -bm25(docs, 0, 2.0, 1.0, 2.0, 1.0, 2.0, 1.0) from docs where docs match ?"
    return dict(con.execute(sql, ((" AND " if match == "all" else " OR ").join(clauses),)).fetchall())


@pytest.mark.parametrize("match", ["any", "all"])
@pytest.mark.parametrize("query", ["lantern", "Laterne Berg", '"hardness scale" lantern', "growing mountain", "tal", '"lanterns lanterns"', "nothing"])
def test_scores(index, query, match):
    got = {r["oid"]: r["score"] for r in index.scores(query, None, match).collect()}
    want = fts5(query, match)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_search(spark, index):
    best = [r["oid"] for r in index.search("lantern", "Gem", 3).collect()]
    assert len(best) == 3
    fence = spark.createDataFrame([(best[2],)], "oid bigint")
    assert [r["oid"] for r in index.search("lantern", "Gem", 3, readable=fence).collect()] == [best[2]]
    assert index.search("lantern", "Gem", 3, readable=fence, scan_cap=2).count() == 0
    assert index.search("!!", "Gem").count() == 0
    with pytest.raises(ValueError):
        index.search("x", match="some")
    with pytest.raises(ConfigDrift):
        FullTextIndex.build({"G": {"t": "hi"}}, {"G": spark.createDataFrame([(1, "x")], "oid bigint, t string")})
    new = index.refresh({"Gem": spark.createDataFrame([(0, "nichts", "zzz"), (50, "Laterne", None)], "oid bigint, notes string, description string")}, spark.createDataFrame([(1,)], "oid bigint"))
    assert {r["oid"] for r in new.search("Laterne", "Gem").collect()} == {50}


def test_saved_index(spark, index, tmp_path):
    path, kinds = f"file://{tmp_path}/index", {"Gem": {"notes": "de", "description": "en"}, "Vendor": {"motto": None}}
    index.save(path, 7)
    again = FullTextIndex.load(spark, path, kinds, 7)
    order = lambda x: [r["oid"] for r in x.search("lantern", None, 5).collect()]
    plan = again.scores("lantern drawer", "Gem")._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan  # a saved index is clustered by term: row groups of other terms aren't read
    assert order(again) == order(index) and FullTextIndex.load(spark, path, kinds, 8) is None
    with pytest.raises(ConfigDrift):
        FullTextIndex.load(spark, path, kinds | {"Vendor": {"motto": "en"}})


def test_query_words():
    assert wanted_words('red "Old Lamp" blue') == [["old", "lamp"], ["red"], ["blue"]]
    assert wanted_words('a "b c') == [["a"], ["b"], ["c"]] and wanted_words('"" "!" x"y"z') == [["y"], ["x"], ["z"]] and wanted_words("") == []


def test_highlight():
    units = wanted_words('Laterne "am Fenster"')
    assert highlight("Die Laternen stehen am Fenster, heute", units, "de") == "Die [Laternen] stehen [am] [Fenster], heute"
    assert highlight("nichts", units, "de") is None and highlight(None, units) is None and highlight("", units) is None and highlight("am kalten Fenster", units) is None
    long = " ".join(f"w{i}" for i in range(30)).replace("w15", "Laterne").replace("w28", "Laterne")
    assert highlight(long, units) == "…w10 w11 w12 w13 w14 [Laterne] w16 w17 w18 w19 w20 w21…"
    assert highlight("(Laterne) e\u0301t\u00e9", units) == "([Laterne]) été" and highlight("am Fenster am Fenster.", units) == "[am] [Fenster] [am] [Fenster]."
    for n in range(20):  # against a plain reading
        words = [random.Random(n * 50 + i).choice(["laterne", "am", "fenster", "x", "y"]) for i in range(n)]
        marked = {i for i, w in enumerate(words) if w == "laterne"} | {i + k for i in range(n - 1) if words[i : i + 2] == ["am", "fenster"] for k in (0, 1)}
        if not marked:
            assert highlight(" ".join(words), units) is None
            continue
        low, high = max(0, min(marked) - 5), min(n, min(marked) + 7)
        want = " ".join(f"[{w}]" if i in marked else w for i, w in enumerate(words) if low <= i < high)
        assert highlight(" ".join(words), units) == ("…" if low else "") + want + ("…" if high < n else "")


def test_stems():
    """Pairs from the published Snowball vocabularies."""
    en = {"consistency": "consist", "knightly": "knight", "consolations": "consol", "kneeling": "kneel", "generously": "generous", "skies": "sky", "hopping": "hop", "relational": "relat", "happy": "happi"}
    de = {"aufeinanderfolgenden": "aufeinanderfolg", "kategorischen": "kategor", "häuser": "haus", "kristalle": "kristall", "jahrhunderts": "jahrhundert", "katers": "kat"}
    es = {"chicas": "chic", "torneados": "torn", "cristales": "cristal", "rápidamente": "rapid", "nacionalidad": "nacional", "comiendo": "com"}
    fr = {"continuellement": "continuel", "continuité": "continu", "contractées": "contract", "maîtresses": "maîtress", "maladive": "malad", "maïs": "maï", "majestueusement": "majestu", "contournait": "contourn"}
    assert {w: stem_fr(w) for w in fr} == fr
    assert {w: stem_en(w) for w in en} == en
    assert {w: stem_de(w) for w in de} == de
    assert {w: stem_es(w) for w in es} == es
