"""Captions and lines read in parts of any size, against reading whole files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.sources import datasources, files, timed_text


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    datasources.register(spark)


def captions(seed: int) -> str:
    rng = random.Random(seed)
    out, at = ["WEBVTT", ""], 0
    for k in range(60):
        at += rng.randrange(1, 9)
        times = rng.choice(["00:00:{:02d}.000 --> 00:01:{:02d}.500 align:start", "00:{:02d}.000 --> 00:{:02d}.500", "note 00:00:{:02d},000 --> 00:00:{:02d},900", "  00:00:{:02d}.100 --> 00:00:{:02d}.200"]).format(at % 60, (at + 2) % 60)
        out += [rng.choice(["", f"{k}"])] if rng.random() < 0.5 else []
        out += [times, *(rng.choice(["<c>Hallo</c> Wörter", "a line", "x"]) for _ in range(rng.randrange(3)))]
        out += [""] * rng.choice([0, 1, 1, 1, 2])
    return rng.choice(["\n", "\r\n"]).join(out)


def whole(text: str, form: str):
    """The reference reading, line by line over the whole text."""
    lines, k, found = text.splitlines(), 0, []
    pattern = datasources.FORMS[form]
    read = pattern.match if form == "capture" else pattern.search
    while k < len(lines):
        m = read(lines[k])
        k += 1
        if not m:
            continue
        body = []
        while k < len(lines) and lines[k].strip() and not (form == "grading" and read(lines[k])):
            body.append(lines[k])
            k += 1
        g = m.groups()
        seconds = lambda h, mi, s, ms: int(h or 0) * 3600 + int(mi) * 60 + int(s) + int(ms) / 1000
        found.append((seconds(*g[:4]), seconds(*g[4:]), body))
    return found


@pytest.mark.parametrize("form", ["capture", "grading"])
@pytest.mark.parametrize("split", [1, 37, 500, 1 << 20])
def test_cues_in_parts(spark, tmp_path, form, split):
    texts = {f"{k}.vtt": captions(k) for k in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    if split == 1:
        # One task a byte would be many tasks: the reader alone.
        for name, text in texts.items():
            reader = datasources.CueReader({"path": str(tmp_path / name), "form": form, "split_bytes": "1"})
            assert [r[2:] for p in reader.partitions() for r in reader.read(p)] == whole(text, form)
        return
    df = spark.read.format("tidemark-vtt").option("form", form).option("split_bytes", split).load(str(tmp_path))
    found = {}
    for r in df.orderBy("path", "at").collect():
        found.setdefault(r.path.rsplit("/", 1)[1], []).append((r.start_s, r.end_s, r.lines))
    assert found == {name: whole(text, form) for name, text in texts.items()}


def test_the_forms_differ(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("00:01.000 --> 00:02.000\nshort\n\n00:00:03,000 --> 00:00:04,000\ncomma\n\n00:00:05.000 --> 00:00:06.000\none\n00:00:07.000 --> 00:00:08.000\ntwo\n")
    read = lambda form: [(r.start_s, r.lines) for r in spark.read.format("tidemark-vtt").option("form", form).load(str(tmp_path / "a.vtt")).orderBy("at").collect()]
    assert read("capture") == [(3.0, ["comma"]), (5.0, ["one", "00:00:07.000 --> 00:00:08.000", "two"])]
    assert read("grading") == [(1.0, ["short"]), (5.0, ["one"]), (7.0, ["two"])]
    for form in ("capture", "grading"):
        cues = timed_text.vtt_cues(spark, str(tmp_path / "a.vtt"), form).orderBy("cue_no").collect()
        assert [(r.start_s, r.lines) for r in cues] == read(form)
    assert [r.text for r in files.raw_cues(spark, str(tmp_path / "a.vtt")).orderBy("ord").collect()] == ["short", "one", "two"]
    assert [r.text for r in timed_text.vtt_segments(spark, str(tmp_path / "a.vtt")).orderBy("ord").collect()] == ["comma", "one 00:00:07.000 --> 00:00:08.000 two"]


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    with open(tmp_path / "large.vtt", "w") as f:
        f.write("WEBVTT\n\n")
        for k in range(40_000):
            f.write(f"{k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d}.000 --> {k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d}.900\nline {k}\n\n")
    df = spark.read.format("tidemark-vtt").option("split_bytes", 200_000).load(str(tmp_path / "large.vtt"))
    assert df.rdd.getNumPartitions() > 8
    got = df.agg(F.count("*").alias("n"), F.count_distinct("start_s").alias("d"), F.min("start_s").alias("lo"), F.max("start_s").alias("hi")).first()
    assert tuple(got) == (40_000, 40_000, 0.0, 39_999.0)


@pytest.mark.parametrize("split", [1, 5, 64, 1 << 20])
def test_lines_in_parts(spark, tmp_path, split):
    text = "kind\tstart\r\n# x\n\nä lange Zeile ohne Ende" + "y" * 90 + "\n\nlast"
    (tmp_path / "m.tsv").write_bytes(text.encode())
    (tmp_path / "empty.tsv").write_bytes(b"")
    reader = datasources.LinesReader({"path": str(tmp_path), "split_bytes": str(split)})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[2] for r in rows] == re.split("\r?\n", text) and [r[1] for r in rows] == sorted(r[1] for r in rows)
    df = spark.read.format("tidemark-lines").option("split_bytes", max(split, 30)).load(str(tmp_path / "*.tsv"))
    assert [r.line for r in df.orderBy("at").collect()] == re.split("\r?\n", text)


def test_files_are_left_out_by_name(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.txt").write_text(f"file {k}\n")
    one = str(tmp_path / "2.txt")
    df = spark.read.format("tidemark-lines").load(str(tmp_path))
    assert [r.line for r in df.where(F.col("path") == one).collect()] == ["file 2"]
    reader = datasources.LinesReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, In

    assert len(list(reader.pushFilters([EqualTo(("path",), one), In(("path",), (one, "x"))]))) == 2
    assert [p.path for p in reader.partitions()] == [one]
    with pytest.raises(FileNotFoundError):
        datasources.listed(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        datasources.CueReader({"path": one, "form": "other"})


def test_a_tree_is_walked_once_and_read_where_it_may_be(spark, tmp_path, monkeypatch):
    import os

    root = tmp_path / "root"
    for name, text in {"a.md": "x", "sub/b.txt": "y", "sub/deep/c": "no suffix", "node_modules/d.md": "no", "out.bin": "z"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    with open(root / "large.bin", "wb") as f:
        f.truncate(10 << 30)
    (tmp_path / "beside").mkdir()
    (tmp_path / "beside/e.md").write_text("linked")
    os.symlink(root, root / "sub/loop")
    os.symlink(tmp_path, root / "sub/up")
    os.symlink(tmp_path / "beside", root / "link1")
    os.symlink(tmp_path / "beside", root / "link2")
    os.symlink(root / "node_modules", root / "lent")
    os.symlink(root / "nothing", root / "gone.md")
    os.symlink("self.md", root / "self.md")
    (root / "bytes.txt").write_bytes(b"\0\1\2")
    found = {os.path.relpath(r.path, root): r for r in files.tree(spark, f"file://{root}").collect()}
    assert {k: (r.read, r.text, r.error) for k, r in found.items()} == {
        "a.md": (True, "x", None), "sub/b.txt": (True, "y", None), "sub/deep/c": (True, "no suffix", None), "out.bin": (False, None, "suffix"), "large.bin": (False, None, "suffix"), "link1/e.md": (True, "linked", None),
        "gone.md": (False, None, "unreadable: No such file or directory"), "self.md": (False, None, "unreadable: Too many levels of symbolic links"), "bytes.txt": (False, None, "binary"),
    }
    sizes = {os.path.relpath(r.path, root): r["size"] for r in files.walk(spark, str(root)).collect()}
    assert sizes["large.bin"] == 10 << 30 and sizes["a.md"] == 1 and sizes["gone.md"] is None
    assert [r.error for r in files.walk(spark, str(root / "none")).collect()] == ["unlistable: No such file or directory"]
