"""Scalar functions, and readers and writers."""

import json

from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.functions import text as tx
from tidemark.sources import timed_text as src


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_stems(spark):
    assert [one(spark, w, tx.stem) for w in ("companies", "its", "dragging", "houses")] == ["company", "its", "dragg", "hous"]


def test_clocks(spark):
    assert [one(spark, w, clock.parse_time) for w in ("1:03:12", "59:25", "7.5", "", "x")] == [3792.0, 3565.0, 7.5, None, None]
    assert one(spark, "1:75:00", clock.parse_clock) is None
    assert [one(spark, w, lambda c: clock.rounded_stamp(c.cast("double"))) for w in ("59.5", "60.5", "3599.6")] == ["01:00", "01:00", "1:00:00"]


def test_salience(spark):
    salient = lambda t: one(spark, t, lambda c: tx.is_salient(tx.tokens(c)))
    assert [salient(t) for t in ("not", "1994", "the business")] == [True, True, False]


def test_unicode_functions(spark):
    assert one(spark, "a&amp;b", tx.unescape) == "a&b"
    assert one(spark, "a+b%20c", tx.percent_decoded) == "a+b c"
    assert one(spark, "Ｓ-ß", tx.squashed) == "sss"
    assert one(spark, "Été à Paris!", tx.slug) == "ete-a-paris"
    assert one(spark, "<b>a</b>&nbsp; b", tx.cue_text) == "a b"


def test_header_values(spark):
    cases = {"plain": "plain", "": "", '"SHIP"': "SHIP", "'\"x\"'": "x", '"\u200b"': "", '"" ""': "", '"': "", "\ufeff１２\u00ad": "12", " a b ": "a b", '"a': '"a', "it's": "it's", "é": "é", "a\u200bb": "a\u200bb"}
    assert {t: one(spark, t, tx.header_value) for t in cases} == cases


def test_id_shaped_and_names(spark):
    assert one(spark, "see dQw4w9WgXcQ and abcdefghijk", tx.id_shaped) == ["dQw4w9WgXcQ"]
    assert one(spark, "Then Maria said. Then I left Paris", tx.name_candidates) == ["maria", "paris"]


VTT = """WEBVTT

00:00:00.000 --> 00:00:02.000
hello <c>there</c>

00:00:02.000 --> 00:00:04.000
hello there
general &amp; friends

00:01:00,500 --> 00:01:01.000

"""


def test_vtt(spark, tmp_path):
    (tmp_path / "a.vtt").write_text(VTT)
    cues = src.vtt_cues(spark, str(tmp_path / "*.vtt")).orderBy("cue_no").collect()
    assert [(r.start_s, r.end_s, r.lines) for r in cues] == [(0.0, 2.0, ["hello <c>there</c>"]), (2.0, 4.0, ["hello there", "general &amp; friends"]), (60.5, 61.0, [])]
    rows = src.vtt_segments(spark, str(tmp_path / "*.vtt")).orderBy("start_s").collect()
    assert [(r.start_s, r.text) for r in rows] == [(0.0, "hello there"), (2.0, "general & friends")]


def test_tables_and_json(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# video_id\tabc\nstart\tend\ttext\n2\t3\tb\tc\n0\t1\ta\nx\t1\tbad\n")
    assert [(r.ord, r.text) for r in src.tsv_segments(spark, str(tmp_path / "t.tsv")).orderBy("ord").collect()] == [(0, "a"), (1, "b\tc")]
    assert [(r.key, r.value) for r in src.table_headers(spark, str(tmp_path / "t.tsv")).collect()] == [("video_id", "abc")]
    for name, value in (("l.json", [{"start": 1, "end": 2, "text": "x"}]), ("s.json", {"segments": [{"start": 1, "end": 2, "text": "x"}]}), ("w.json", {"transcription": [{"text": "x", "offsets": {"from": 1000, "to": 2000}}]})):
        (tmp_path / name).write_text(json.dumps(value))
        assert [(r.start_s, r.end_s, r.text) for r in src.json_segments(spark, str(tmp_path / name)).collect()] == [(1.0, 2.0, "x")]


def test_manifest_and_notes(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("kind\tstart\tend\tid\tsha256\nframe\t1\t1\ta\ts\nframe\t1\t1\tb\ts\ncue\t0\t2\tc\t\nodd\n")
    rows, defects = src.manifest(spark, str(tmp_path / "m.tsv"))
    assert {(r.kind, r.id) for r in rows.collect()} == {("frame", "a"), ("cue", "c")}
    assert {r.code for r in defects.collect()} == {"E-MANIFEST-DUPLICATE", "E-MANIFEST-ROW"}
    (tmp_path / "n.md").write_text("---\ntitle: x\n---\nbody\n---\nmore\n")
    note = src.notes(spark, str(tmp_path / "n.md")).first()
    assert (note.frontmatter, note.body) == ("title: x\n", "body\n---\nmore\n")


def test_index_round_trip(spark, tmp_path):
    segments = spark.createDataFrame([(1, 0, 0.0, 1.5, "a\tb"), (1, 1, 2.0, 3.0, "c")], "recording_id long, ord long, start_s double, end_s double, text string")
    src.write_index(segments, str(tmp_path / "out"))
    back = src.tsv_segments(spark, str(tmp_path / "out" / "*" / "*.txt")).orderBy("ord").collect()
    assert [(r.start_s, r.end_s, r.text) for r in back] == [(0.0, 1.5, "a b"), (2.0, 3.0, "c")]
