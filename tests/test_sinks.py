"""Files are written all or none."""

import os

import pytest

from tidemark.operators import filing
from tidemark.sources import sinks


def tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(folder) for f in names}


def rows(spark, *own, schema="path string, content string, refused string"):
    return spark.createDataFrame([(*r, None)[:3] for r in own], schema).repartition(3)


def test_files_are_made_once(spark, tmp_path):
    folder = str(tmp_path)
    batch = rows(spark, *((f"a/{k}.md", f"text {k}\r\nä") for k in range(20)), ("b.md", None))
    sinks.write_files(batch, folder)
    made = tree(folder)
    assert len(made) == 21 and open(tmp_path / "a/7.md", newline="").read() == "text 7\r\nä" and made["b.md"] == ""
    with pytest.raises(Exception, match="there already: a/"):
        sinks.write_files(batch, folder)
    with pytest.raises(Exception, match="there already: b.md"):
        sinks.write_files(rows(spark, ("c.md", "x"), ("b.md", "y")), folder)
    assert tree(folder) == made and not any(n.startswith(".tidemark-") for n in os.listdir(folder))


@pytest.mark.parametrize(("bad", "said"), [(("c.md", "x", "E-FILE-DATE"), "refused: c.md: E-FILE-DATE"), (("../c.md", "x"), "not a path within"), (("/c.md", "x"), "not a path within"), ((".", "x"), "not a path within"), (("new/0.md", "again"), "two rows of one path: new/0.md")])
def test_a_bad_row_leaves_the_folder_as_it_was(spark, tmp_path, bad, said):
    (tmp_path / "old.md").write_text("old")
    with pytest.raises(Exception, match=said):
        sinks.write_files(rows(spark, *((f"new/{k}.md", "x") for k in range(12)), bad), str(tmp_path))
    assert tree(tmp_path) == {"old.md": "old"} and os.listdir(tmp_path) == ["old.md"]


def test_replacing_is_undone_on_failure(spark, tmp_path, monkeypatch):
    for k in range(3):
        (tmp_path / f"{k}.md").write_text(f"old {k}")
    os.chmod(tmp_path / "1.md", 0o640)
    sinks.replace_notes(spark.createDataFrame([(f"{k}.md", f"new {k}") for k in range(2)], "note string, content string"), str(tmp_path))
    assert tree(tmp_path) == {"0.md": "new 0", "1.md": "new 1", "2.md": "old 2"} and (tmp_path / "1.md").stat().st_mode & 0o777 == 0o640
    # The last target can't be made, as a file stands where its folder would be.
    writer = sinks.FilesWriter({"path": str(tmp_path), "replace": "true"}, ["path", "content"])
    from pyspark.sql import Row

    before = tree(tmp_path)
    messages = [writer.write(iter([Row(path="0.md", content="worse"), Row(path="fresh.md", content="f")])), writer.write(iter([Row(path="2.md/x.md", content="y")])), None]
    with pytest.raises(OSError):
        writer.commit(messages)
    assert tree(tmp_path) == before


def test_refused_notes_are_not_filed(spark, tmp_path):
    schema = "note string, recording_id string, note_date string, as_of date, body string"
    import datetime

    day = datetime.date(2024, 1, 20)
    notes_ = [("2024-01-02--a--x.md", "r1", "2024-01-02", day, "one"), ("2024-01-03--b--y.md", "r2", "2024-01-03", day, "two")]
    existing = spark.createDataFrame([("r9", "z.md")], "recording_id string, note string")
    good, bad = (spark.createDataFrame(n, schema) for n in (notes_, [*notes_, ("bad.md", "r3", "2024-01-03", day, " ")]))
    with pytest.raises(Exception, match="refused: bad.md: E-FILE-EMPTY,E-FILE-NAME"):
        sinks.file_notes(bad.selectExpr("note", "body as content"), filing.filing_refusals(bad, existing), str(tmp_path))
    assert tree(tmp_path) == {}
    sinks.file_notes(good.selectExpr("note", "body as content"), filing.filing_refusals(good, existing), str(tmp_path))
    assert tree(tmp_path) == {n[0]: n[4] for n in notes_}
