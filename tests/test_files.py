"""Files as tables, with the odd lines they hold."""

from stratagraph.sources import files

OBO = """format-version: 1.2

[Term]
id: T:1
name: root
namespace: n

[Term]
id: T:2
name: child ! not a comment
is_a: T:1 ! root
is_a: T:3

[Term]
id: T:3
name: gone
is_obsolete: true

[Typedef]
id: part_of
"""


def test_obo(spark, tmp_path):
    (tmp_path / "t.obo").write_text(OBO)
    got = [tuple(r) for r in files.obo_terms(spark, f"file://{tmp_path}/t.obo").collect()]
    assert got == [("T:1", "root", "n", []), ("T:2", "child ! not a comment", "", ["T:1", "T:3"])]
    (tmp_path / "empty.obo").write_text("")
    assert files.obo_terms(spark, f"file://{tmp_path}/empty.obo").count() == 0


def test_csv_json_xml(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n"x,y",1\nz,\n')
    assert [tuple(r) for r in files.csv(spark, f"file://{tmp_path}/a.csv", "k string, v int").collect()] == [("x,y", 1), ("z", None)]
    (tmp_path / "a.json").write_text('{"k": "x", "v": 1, "more": 2}\n{"v": null}\n')
    assert [tuple(r) for r in files.json_lines(spark, f"file://{tmp_path}/a.json", "k string, v int").collect()] == [("x", 1), (None, None)]
    (tmp_path / "a.xml").write_text("<all><row><k>x</k><v>1</v></row><row><k>y</k></row></all>")
    assert [tuple(r) for r in files.xml(spark, f"file://{tmp_path}/a.xml", "row", "k string, v int").collect()] == [("x", 1), ("y", None)]
