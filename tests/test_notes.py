"""Note grading, scans, decoder output and filing, on cases with answers known by hand."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.plans import views
from tidemark.operators import alignment, coverage, decoding, filing, notes, planning, rules, scan, sequence, votes
from tidemark.sources import files


def lines(spark, text, key="recording_id", value="r"):
    return spark.createDataFrame([(value, k, line) for k, line in enumerate(text.split("\n"))], f"{key} string, line_no int, text string")


def test_fences_close_with_their_own_sign_or_not_at_all(spark):
    body = "a\n```py\n- x\n~~~\n``` no\n````\nb\n~~~~\nc\n~~~\nd"
    found = {tuple(r) for r in notes.fences(lines(spark, body)).select("open_at", "close_at").collect()}
    assert found == {(1, 5), (7, None)}
    quoted = {r.line_no for r in notes.quoted(lines(spark, body)).where("quoted").collect()}
    assert quoted == {2, 3, 4}


def test_blocks_fold_continuations_and_name_sections(spark):
    body = "intro\n## One\n- a\n  more\n- b\n\ntext\n| t |\n```\n- q\n\n- r\n```\n# Two\nend"
    rows = notes.blocks(lines(spark, body)).orderBy("line_no").collect()
    assert [(r.line_no, r.block, r.section, r.verbatim) for r in rows] == [
        (0, 1, "", False), (1, 2, "One", False), (2, 3, "One", False), (3, 3, "One", False), (4, 4, "One", False), (6, 5, "One", False), (7, 6, "One", False),
        (9, 7, "One", True), (11, 7, "One", True), (13, 8, "One", False), (14, 9, "One", False),
    ]


@pytest.mark.parametrize(
    ("item", "classes"),
    [
        ("- `[00:04]` `SPOKEN` `ON-SCREEN` `[01:04]`", ["SPOKEN", "ON-SCREEN"]),
        ("- all `SPOKEN`: `[00:02]` and then `[01:19]`", ["SPOKEN", "SPOKEN"]),
        ("- `[00:43]` / `[01:59]` `ON-SCREEN` but `SPOKEN` words `[02:00]`", ["ON-SCREEN", "ON-SCREEN", "MULTI"]),
        ("- `SPOKEN` `[00:10]` `ON-SCREEN`", ["CONTESTED"]),
        ("- `[00:01]`", ["NONE"]),
        ("- `[01:12]` `ORPHAN` `SPOKEN` and `ON-SCREEN` `[02:00]`", ["SPOKEN", "ON-SCREEN"]),
        ("- `[00:30]`\n  `[00:40]` `SPOKEN` x `ON-SCREEN`", ["MULTI", "SPOKEN"]),
        ("- `[00:30]` -\n  `[00:40]` `SPOKEN` x `ON-SCREEN`", ["SPOKEN", "SPOKEN"]),
    ],
)
def test_classes_bind_by_touch(spark, item, classes):
    found = notes.anchors(notes.blocks(lines(spark, item))).orderBy("block", "k").collect()
    assert [r["class"] for r in found] == classes


def test_foreign_references_reach_two_lines(spark):
    body = "- see notes/2024-01-02--talk--other.md\n  `[00:01]`\n  `[00:02]`\n  `[00:03]`\n- notes/2024-01-02--talk--r.md `[00:04]`"
    found = notes.anchors(notes.blocks(lines(spark, body))).orderBy("at_s").collect()
    assert [r["foreign"] for r in found] == [True, True, False, False]


def test_rows_and_refusals(spark):
    body = "- `[00:10]` `SPOKEN` — said\n- `[00:99]` `SPOKEN` — x\n- `[01:00]` `SPOKEN` to `[00:30]` `SPOKEN` — x\n- `[00:10]` `SPOKEN` —\n- `[-00:10]` `SPOKEN` — x\nprose `[00:01]`\n- `[105:18]` `INFERRED` (late) – y"
    rows = notes.claim_rows(lines(spark, body)).orderBy("line_no").collect()
    assert [r.kind for r in rows] == ["row", "impossible", "misshapen", "misshapen", "unread", "prose", "row"]
    assert (rows[6].at_s, rows[6].claim, rows[0].until_s) == (6318.0, "y", 10.0)


def test_moments_however_they_are_written(spark):
    texts = {"[01:02] and 1:02:03": [62, 3723], "١:٠٥ at": [65], "at 1h02m03s, 30s, 2m": [3723], "t=30 and 12:34.5": [30], "12:345 1:2": [], "0：07": [7], "took 73 sec": [73]}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.moments(tx.plainly(F.col("t"))).alias("m")).collect()
    assert {r.t: r.m for r in rows} == texts


def test_contained_stamps(spark):
    schema = "source_id string, line_no int, text string"
    corpus = spark.createDataFrame([("n", 0, "[00:07] [00:13] [01:01]"), ("n", 1, "[01:00] [02:00]"), ("n", 2, "[00:07]")], schema)
    published = spark.createDataFrame([("p", 0, "0:13 then 0:07"), ("p", 1, "0:13 and 2:00"), ("p", 2, "1:00, 2:00"), ("p", 3, "0:07")], schema)
    assert [tuple(r) for r in scan.contained_lines(published, scan.stamp_sets(corpus)).collect()] == [("p", 0)]


def test_scope_says_what_a_scan_is_blind_to(spark):
    listed = spark.createDataFrame([("a.md", True), ("b/c.PNG", False), ("x", True)], "path string, read boolean")
    sets = spark.createDataFrame([(1, [1, 2])], "set_id long, seconds array<long>")
    (row,) = scan.scope(listed, ["longer needle", "x"], sets).collect()
    assert (row.files, row.unread, row.literals, row.stamp_sets, row.under_floor, row.blind) == (3, 1, 2, 1, 1, False)
    assert scan.scope(listed, [], sets).first().blind
    assert {r.suffix: r.files for r in scan.suffix_census(listed).collect()} == {".md": 1, ".png": 1, "": 1}


def test_seams_lose_what_the_chunk_before_kept(spark):
    plan = spark.createDataFrame([("r", 0, 0.0, 0.0, 60.0, None), ("r", 1, 50.0, 60.0, 120.0, None), ("r", 2, 110.0, 120.0, 180.0, "language")], "recording_id string, chunk long, offset_s double, keep_from double, keep_to double, failed string")
    said = [("r", 0, 0, 0, 1.0, 5.0, "start"), ("r", 0, 0, 1, 55.0, 60.5, "The seam."), ("r", 1, 0, 0, 8.2, 10.4, "the seam"), ("r", 1, 0, 1, 12.0, 20.0, "after"), ("r", 1, 0, 2, 25.0, 30.0, "start")]
    chunks = spark.createDataFrame(said, "recording_id string, chunk long, attempt int, ord long, start_s double, end_s double, text string")
    segments, lost = decoding.assembled(chunks, plan)
    assert [(r.ord, r.start_s, r.text) for r in segments.orderBy("ord").collect()] == [(0, 1.0, "start"), (1, 55.0, "The seam."), (2, 62.0, "after"), (3, 75.0, "start")]
    assert [tuple(r) for r in lost.collect()] == [("r", 120.0, 180.0, "language")]


def test_looped_attempts_give_way_to_better_ones(spark):
    rows = [("r", c, a, k, float(k), k + 1.0, "loop" if looped else f"w{k}") for c, a, looped in ((0, 0, True), (0, 1, False), (1, 0, False), (1, 1, True), (2, 0, True), (2, 1, True)) for k in range(5)]
    chunks = spark.createDataFrame(rows, "recording_id string, chunk long, attempt int, ord long, start_s double, end_s double, text string")
    assert {(r.chunk, r.attempt) for r in decoding.better_attempts(chunks).collect()} == {(0, 1), (1, 0), (2, 0)}
    assert {(r.chunk, r.attempt) for r in decoding.loop_spans(chunks).collect()} == {(0, 0), (1, 1), (2, 0), (2, 1)}


def test_rebuild_decisions(spark):
    coarse = [("gap", 0, 0.0, 100.0, "w " * 90), ("whole", 0, 0.0, 100.0, "w " * 90), ("few", 0, 0.0, 100.0, "w " * 400), ("fine", 0, 0.0, 4.0, "a b"), ("share", 0, 0.0, 100.0, "w")]
    served = spark.createDataFrame(coarse, "recording_id string, ord int, start_s double, end_s double, text string")
    stamps = [(r, k, str(float(k)), str(k + 0.9), "w") for r in ("gap", "whole", "few", "fine", "share") for k in range(101) if not (r == "gap" and 30 <= k < 60) and not (r == "share" and k % 20 in (5, 6, 7))]
    words = spark.createDataFrame([*stamps, ("whole", 200, "x", "y", "bad"), ("whole", 201, "1", "2", " ")], "recording_id string, ord int, start_s string, end_s string, text string")
    found = {r.recording_id: r.decision for r in decoding.rebuild_decisions(served, decoding.usable_words(words)).collect()}
    assert found == {"gap": "refused-run", "whole": "rebuild", "few": "refused-words", "fine": "keep", "share": "refused-share"}
    texts = spark.createDataFrame([("bare", "text"), ("fine", "x"), ("empty", " ")], "recording_id string, text string")
    segments, refused = decoding.from_response(served, words, texts)
    assert {r.recording_id: r.reason for r in refused.collect()} == {"gap": "refused-run", "few": "refused-words", "share": "refused-share", "bare": "untimed"}
    untimed = decoding.from_response(served, words, texts, allow_untimed=True)[0].where("recording_id = 'bare'").collect()
    assert [(r.start_s, r.end_s, r.text) for r in untimed] == [(0.0, 0.0, "text")] and segments.where("recording_id = 'whole'").count() > 10


def test_language_pins(spark):
    rows = [("a", 0, "auto", None, None), ("a", 1, "auto", None, "German"), ("a", 2, "auto", None, "fr"), ("b", 0, "en-GB", "de", "de"), ("c", 0, None, "Polish", "xx")]
    found = decoding.pinned_language(spark.createDataFrame(rows, "recording_id string, chunk int, configured string, declared string, detected string")).orderBy("recording_id", "chunk").collect()
    assert [(r.pin, r.mismatch) for r in found] == [(None, False), ("de", False), ("de", True), ("en", True), ("pl", False)]


def test_pixel_votes(spark):
    body = "- `[00:10]` `SPOKEN` — Kubernetes and The thing\n- `[00:10]` `ON-SCREEN` — Terraform\n- `[00:10]` `ON-SCREEN` — Kubernetez\n- `[00:10]` `SPOKEN` `ON-SCREEN` — Ansible\n```\n- `[00:10]` `ON-SCREEN` — Quoted\n```"
    index = spark.createDataFrame([("r", 20, 5, ["Kubernetes", "alpha"]), ("r", 90, 9, ["Terraform"]), ("r", 95, 1, [])], "recording_id string, second int, words int, tokens array<string>")
    found = {(r.token, r["class"]): (r.seen, r.verdict) for r in votes.pixel_vote(notes.blocks(lines(spark, body)), index).collect()}
    assert found == {("Kubernetes", "SPOKEN"): ("Kubernetes", "PROMOTE"), ("Terraform", "ON-SCREEN"): (None, "FLAG"), ("Kubernetez", "ON-SCREEN"): ("Kubernetes", None)}
    poor = index.withColumn("words", F.lit(1))
    assert votes.pixel_vote(notes.blocks(lines(spark, body)), poor).count() == 0


def test_citations_resolve_within_one_block(spark):
    body = 'x {{CITE:docs/a.md#"two *words*"}}\n{{CITE:docs/a.md#"over blocks"}} {{CITE:no.md#"q"}} {{CITE:n.md#"self"}} {{CITE:docs/a.md#""}} {{CITE docs}}'
    bodies = spark.createDataFrame([("n.md", body)], "note string, body string")
    listing = spark.createDataFrame([("docs/a.md", "s1", "# t\n\nhas two\nwords in\nit over\n\nblocks"), ("n.md", "s2", "self")], "path string, sha256 string, text string")
    found = filing.resolved_citations(bodies, listing).orderBy("k").collect()
    assert [(r.code, r.target_line) for r in found] == [(None, 2), ("E-CITE-NOMATCH", None), ("E-CITE-NOFILE", None), ("E-CITE-SELF", 0), ("E-CITE-EMPTY", None)]
    assert found[0].sha256 == "s1" and found[1].line_no == 1
    assert [tuple(r) for r in filing.malformed(bodies).collect()] == [("n.md", "cite", 6, 5)]


def test_sets_count_their_members(spark):
    body = 'a\n{{SET:parts}}\n- one\n  more\n- two\n{{/SET}}\nb {{SET:two parts}}\n- x\n{{/SET}} {{SET:none}} {{/SET}} {{CITE:p.md#"q"}}'
    bodies = spark.createDataFrame([("n", body)], "note string, body string")
    found = filing.sets(bodies).orderBy("k").collect()
    assert [(r.label, r.members, r.code) for r in found] == [("parts", ["- one more", "- two"], None), ("two parts", ["- x"], "E-SET-COUNT"), ("none", [], "E-SET-EMPTY")]
    shown = filing.rendered(bodies).first().body
    assert "parts (2 listed):\n\n- one more\n- two" in shown and "{{SET:two parts}}" in shown and shown.endswith("`p.md`")


def test_repeated_tokens_have_their_own_lines(spark):
    body = '{{CITE:a.md#"q"}}\n\n{{CITE:a.md#"q"}} {{CITE:a.md#"two\nlines"}}\n{{CITE:a.md#"q"}}\n{{cite:x {{CITE:b {{CITE:c#"d"}}'
    bodies = spark.createDataFrame([("n", body), ("m", "plain")], "note string, body string")
    assert [(r.k, r.line_no) for r in filing.citations(bodies).orderBy("k").collect()] == [(0, 0), (1, 2), (2, 2), (3, 4), (4, 5)]
    found = sorted((r.line_no, r.code) for r in filing.token_defects(bodies).collect())
    assert found == [(5, "E-CITE-MALFORMED"), (5, "E-CITE-MALFORMED")]


def test_sets_that_are_unsound_are_named(spark):
    cases = {
        "unclosed": ("a\n{{SET:x}}\n- one\n{{SET:y}}\n- two", [("x", "E-SET-UNCLOSED", 1)], [(1, "E-SET-UNCLOSED"), (3, "E-SET-MALFORMED")]),
        "nested": ("{{SET:x}}\n{{SET:y}}\n- one\n{{/SET}}\n{{/SET}}", [("x", "E-SET-NESTED", 0), ("y", None, 1)], [(0, "E-SET-NESTED")]),
        "late": ("{{SET:x}}\n- one\n{{/SET}}\n{{SET:y}}\n- two", [("x", None, 0), ("y", "E-SET-UNCLOSED", 3)], [(3, "E-SET-UNCLOSED")]),
        "malformed": ("{{ SET:x}}\n- one\n{{/SET}}", [], [(0, "E-SET-MALFORMED")]),
        "stray": ("{{/SET}} x", [], []),
    }
    bodies = spark.createDataFrame([(n, c[0]) for n, c in cases.items()], "note string, body string")
    found = {}
    for r in filing.sets(bodies).orderBy("note", "k").collect():
        found.setdefault(r.note, []).append((r.label, r.code, r.line_no))
    defects = {}
    for r in filing.token_defects(bodies).collect():
        defects.setdefault(r.note, []).append((r.line_no, r.code))
    for name, (_, sets, wrong) in cases.items():
        assert found.get(name, []) == sets and sorted(defects.get(name, [])) == wrong, name


def test_sets_of_one_label_are_rendered_each(spark):
    body = "{{SET:x}}\n- a\n{{/SET}}\n\nmid {{SET:x}}\n- b\n- c\n{{/SET}} end {{SET:bad 2}}\n- d\n{{/SET}}"
    (r,) = filing.rendered(spark.createDataFrame([("n", body)], "note string, body string")).collect()
    assert r.body == "x (1 listed):\n\n- a\n\nmid x (2 listed):\n\n- b\n- c\n end {{SET:bad 2}}\n- d\n{{/SET}}"


def test_a_note_without_status_is_named(spark):
    heads = [("a", None, None), ("b", "done", None), ("c", "capture", "x"), ("d", "applied", None), ("e", "applied", "gone"), ("f", "applied", "x"), ("g", "capture", None), ("h", " ", None)]
    found = filing.status_defects(spark.createDataFrame(heads, "note string, status string, applied_to string"), spark.createDataFrame([("x",)], "path string"))
    assert {r.note: r.code for r in found.collect()} == {"a": "E-STATUS-MISSING", "b": "E-STATUS-UNKNOWN", "c": "E-STATUS-APPLIED", "d": "E-STATUS-NOEDGE", "e": "E-STATUS-EDGE", "h": "E-STATUS-MISSING"}


def test_patterns_walk_the_tree(spark):
    listing = ["runs/vid/x.json", "runs/vid/chunks/c1.json", "runs/vid/chunks/c10.json", "runs/oth/run.json", "runs/oth/x.json", "corpus/a.md", "corpus/deep/er/b.md", "a.md", "/abs/runs/v/r.json", "runs/vid/[odd].txt"]
    files_ = spark.createDataFrame([(p,) for p in listing], "path string")
    asked = {
        "runs/*/x.json": ("runs/oth/x.json", False), "c?.json": (None, False), "chunks/c?.json (what it is)": ("runs/vid/chunks/c1.json", True), "runs/vid/../oth/run.json": ("runs/oth/run.json", False), "chunks/*.json": ("runs/vid/chunks/c1.json", True),
        "chunks/c[2-9]*.json": (None, False), "chunks/c[!2-9]?.json": ("runs/vid/chunks/c10.json", True), "**/b.md": ("corpus/deep/er/b.md", False), "corpus/**": ("corpus/a.md", False), "./x.json": ("runs/vid/x.json", True), "a.md": ("a.md", False),
        "/abs/runs/v/r.json": ("/abs/runs/v/r.json", False), "/**/*.json": (None, False), "[[]odd].txt": ("runs/vid/[odd].txt", True), "": (None, False),
    }
    declared = spark.createDataFrame([(f"n{k}", "vid", o) for k, o in enumerate(asked)] + [("none", "vid", None)], "note string, recording_id string, oracle string")
    found = {r.oracle: (r.path, r.related) for r in filing.oracle_targets(declared, files_).collect()}
    assert found.pop(None) == (None, False)
    # Without a corpus folder an absolute pattern may only name what lies under the runs folder.
    assert {k: v for k, v in found.items() if v != asked[k]} == {"/**/*.json": ("/abs/runs/v/r.json", False)}
    bounded = {r.oracle: r.path for r in filing.oracle_targets(declared, files_, runs="/abs/runs", root="corpus").collect()}
    assert bounded["/**/*.json"] is None and bounded["a.md"] == "corpus/a.md" and bounded["/abs/runs/v/r.json"] == "/abs/runs/v/r.json"


def test_enumerations_must_count(spark):
    text = "There are three parts:\n- a\n- b\n\nboth sides:\n- a\n- b\nplain\n- one of two things:\n- x"
    assert [(r.line_no, r.stated, r.listed) for r in filing.enumerations(lines(spark, text, "note")).collect()] == [(0, 3, 2)]


def test_demotion_is_a_fixed_point(spark):
    body = "pre `[09:09]`\n## Claims\n- tagged `[00:01]` `SPOKEN`\n- free `[00:02]` x\n- none\n## Detail\nsee `[00:01]` and `[00:07]`\n## Strongest objection\n- weak `[00:08]`\n\n- strong\n  *Falsifier:* test\n## Run notes\n`[00:30]`"
    first = lines(spark, body, "note")
    (counts,) = filing.demotion_counts(first).collect()
    assert (counts.claims, counts.untagged, counts.objections, counts.speculation, counts.orphans, counts.demotions) == (3, 2, 2, 1, 2, 5)
    render = lambda df: [r.text for r in filing.demoted(df).orderBy("part", "line_no").collect()]
    once = render(first)
    assert "- free `[00:02]` `INFERRED` x <!-- auto-demoted -->" in once and "see `[00:01]` and `[00:07]` `ORPHAN`" in once and "- none" in once
    assert once[once.index("## Speculation") + 1] == "- weak `[00:08]` `ORPHAN`" and "pre `[09:09]`" in once and "`[00:30]`" in once
    assert render(lines(spark, "\n".join(once), "note")) == once
    assert "3 claims, 0 demoted" in filing.integrity(first).first().line


def test_headers_and_densities(spark):
    heads = spark.createDataFrame([("a", "video_id: x\nduration: 1:02\nstatus: capture\nstatus: late"), ("b", "duration: x")], "note string, frontmatter string")
    fields = filing.header_fields(heads)
    assert {r.note: r.fields for r in fields.collect()} == {"a": {"video_id": "x", "duration": "1:02", "status": "capture"}, "b": {"duration": "x"}}
    assert [tuple(r) for r in filing.typed_header(fields, {"video_id": (r"^\S+$", True), "duration": (r"^\d+(:\d\d)*$", False)}).collect()] == [("b", "duration", "E-HEADER-FORM")]
    bodies = spark.createDataFrame([("a", "x\n\nDensity: 1,200 words over 12 video-minutes, 100 words per video-minute.\n\n7 words")], "note string, body string")
    assert [tuple(r) for r in filing.declared_numbers(bodies).collect()] == [("a", 1200.0, 12.0, 100.0)]


def test_sentences_and_paths(spark):
    row = spark.range(1).select(filing.sentence_around(F.lit("One. Two is here. Three."), F.lit(10)).alias("s"), filing.report_name(F.lit("facts"), F.lit(3)).alias("r"), files.stamped_name(F.lit("cue"), F.lit(3725.0)).alias("f")).first()
    assert tuple(row) == ("Two is here.", "facts-03.md", "cue_t1h02m05s.jpg")
    found = filing.bare_paths(lines(spark, 'docs/a.md and xdocs/b.md {{CITE:docs/c.md#"q"}}', "note")).collect()
    assert [r.path for r in found] == ["docs/a.md"]


def test_oracles_resolve_by_path_or_pattern(spark):
    listing = spark.createDataFrame([("runs/r1/a.vtt",), ("runs/r1/b.vtt",), ("runs/r2/a.vtt",)], "path string")
    declared = spark.createDataFrame([("n1", "r1", "runs/r1/*.vtt"), ("n2", "r1", "runs/r2/a.vtt"), ("n3", "r3", "runs/r3/*"), ("n4", "r4", "x")], "note string, recording_id string, oracle string")
    assert {r.note: (r.path, r.related) for r in filing.oracle_targets(declared, listing).collect()} == {"n1": ("runs/r1/a.vtt", True), "n2": ("runs/r2/a.vtt", False), "n3": (None, False), "n4": (None, False)}


def test_sidecars_and_gates(spark):
    schema = "note string, k long, path string, target_line int, sha256 string"
    now = spark.createDataFrame([("n", 0, "a", 1, "s"), ("n", 1, "b", 2, "s"), ("n", 2, "c", 3, "s")], schema)
    old = spark.createDataFrame([("n", 0, "a", 1, "s"), ("n", 1, "b", 9, "s"), ("n", 3, "d", 4, "s")], schema)
    assert {r.k: r.code for r in filing.sidecar_defects(now, old).collect()} == {1: "E-SIDECAR-STALE", 2: "E-SIDECAR-MISSING", 3: "E-SIDECAR-EXTRA"}

    def broken():
        raise ValueError("no input")

    results = filing.run_gates({"clean": lambda: now.limit(0), "defects": lambda: now, "broken": broken})
    assert [(r["gate"], r["status"], r["defects"]) for r in results] == [("clean", 0, 0), ("defects", 1, 3), ("broken", 2, 0), ("all", 2, 3)]


def test_gates_over_the_same_rows_read_them_once(spark):
    rows = spark.range(100).withColumn("v", F.col("id") % 10)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("gates"))
    spark.sparkContext.setJobGroup("gates", "gates")
    try:
        gates = {f"g{k}": (rows, F.col("v") < k) for k in range(5)} | {"own": lambda: rows.where("v = 9")}
        found = {r["gate"]: (r["status"], r["defects"]) for r in filing.run_gates(gates)}
        assert found == {**{f"g{k}": (int(k > 0), 10 * k) for k in range(5)}, "own": (1, 10), "all": (1, 110)}
        shared = jobs()
        broken = gates | {"broken": (rows, F.assert_true(F.col("v") < 5).isNull() & (F.col("v") > 90)), "null": (rows, F.lit(None).cast("boolean"))}
        found = {r["gate"]: (r["status"], r["defects"]) for r in filing.run_gates(broken)}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # One job for the five, and at most two for the gate that counts its own findings.
    assert shared <= 3
    assert found["broken"] == (2, 0) and found["g3"] == (1, 30) and found["null"] == (0, 0) and found["all"] == (2, 110)


def test_encodings(spark):
    raw = ["é".encode(), "é".encode("utf-16"), "é".encode("utf-32"), "ab".encode("utf-16-le"), "é".encode("latin-1"), b"\xef\xbb\xbfx", b"\x00\x01\x02", None]
    found = spark.createDataFrame([(k, bytearray(r) if r is not None else None) for k, r in enumerate(raw)], "k int, c binary").select("k", files.decoded("c").alias("t")).orderBy("k").collect()
    assert [r.t.text for r in found] == ["é", "é", "é", "ab", "é", "x", None, None] and found[6].t.error == "binary"


def test_trees_notes_and_frontmatter(spark, tmp_path):
    for name, text in {"a.md": "x", "2024-01-02--t--r.md": "n", "b.bin": "z", "node_modules/c.md": "no", "reviews/2024-01-02--t--r.md": "v"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.tree(spark, str(tmp_path))
    assert sorted((r.path.split("/")[-1], r.read, r.text) for r in found.collect()) == [("2024-01-02--t--r.md", True, "n"), ("2024-01-02--t--r.md", True, "v"), ("a.md", True, "x"), ("b.bin", False, None)]
    own, skipped = files.note_files(found)
    assert [str(r.note_date) for r in own.collect()] == ["2024-01-02"] and skipped.count() == 2
    assert files.refuse_empty(own).count() == 1
    with pytest.raises(Exception, match="no notes"):
        files.refuse_empty(own.limit(0).unionByName(own.limit(0))).count() or files.refuse_empty(own.where("false")).collect() or (_ for _ in ()).throw(ValueError("no notes"))
    cut = files.without_frontmatter(lines(spark, "---\nkey: v\n# c\n---\nbody"))
    assert [r.text for r in cut.orderBy("line_no").collect()] == ["body"]
    rule = files.without_frontmatter(lines(spark, "---\nprose\nmore\nlines: 1\n---\nbody"))
    assert rule.count() == 6


def test_policy_dates(spark, tmp_path):
    (tmp_path / "tidemark.toml").write_text('[runs]\nr1 = "2024-01-02 gone"\n')
    below = tmp_path / "a" / "b"
    below.mkdir(parents=True)
    tables = files.policy(str(below))
    assert [(r.ledger, r.key, str(r.as_of)) for r in files.ledger(spark, tables).collect()] == [("runs", "r1", "2024-01-02")]
    with pytest.raises(ValueError, match="future"):
        files.policy(str(below), today=datetime.date(2023, 1, 1))
    (tmp_path / "tidemark.toml").write_text('[runs]\nr1 = "soon"\n')
    with pytest.raises(ValueError, match="no date"):
        files.policy(str(below))
    assert files.policy("/nonexistent") == {}


def test_frames_tracks_infos_and_manifests(spark, tmp_path):
    paths = spark.createDataFrame([("r", "x/frame_1_t01m05s.jpg"), ("r", "y/cue_t1h00m00s.PNG"), ("r", "z/f_01m05s.jpeg"), ("r", "plain.jpg")], "recording_id string, path string")
    own, unstamped, twice = files.frame_files(paths)
    assert sorted(r.second for r in own.collect()) == [65, 3600] and unstamped.count() == 1 and twice.first().path == "z/f_01m05s.jpeg"
    tracks = spark.createDataFrame([("r", "d/v.en.vtt"), ("r", "d/v.en-orig.vtt"), ("q", "d/v.en-US.vtt"), ("q", "d/v.en.vtt")], "recording_id string, path string")
    assert {r.recording_id: r.path for r in files.preferred_track(tracks).collect()} == {"r": "d/v.en-orig.vtt", "q": "d/v.en.vtt"}
    infos = spark.createDataFrame([("r", "a", "{bad"), ("r", "b", '{"duration": -1, "id": "r"}'), ("q", "a", '{"duration": 9.5, "id": "q"}')], "recording_id string, path string, value string")
    assert {r.recording_id: (r.duration_s, r.id) for r in files.run_info(infos).collect()} == {"r": (None, "r"), "q": (9.5, "q")}
    frames = spark.createDataFrame([("r", 65, "f1", "h")], "recording_id string, second int, id string, sha256 string")
    cues = spark.createDataFrame([("r", 1.0, 70.5)], "recording_id string, start_s double, end_s double")
    built = files.manifest_rows(frames, cues, files.run_info(infos).where("recording_id = 'r'")).orderBy("part").collect()
    assert [r.line for r in built] == ["# video_id\tr", "# duration\t70.500", "kind\tstart\tend\tid\tsha256", "frame\t65.000\t65.000\tf1\th", "cue\t1.000\t70.500\t-\t-"]
    (tmp_path / "m.json").write_text('{"chapters": [{"start_time": 0, "end_time": 5, "title": "a"}, 7, {"start_time": 5, "end_time": 9, "title": "b"}]}')
    assert [(r.chapter, r.start_s, r.title) for r in files.chapters(spark, str(tmp_path / "m.json")).collect()] == [(0, 0.0, "a"), (2, 5.0, "b")]
    (tmp_path / "o.tsv").write_text("frame\tseconds\tsha256\twidth\theight\twords\ttext\nf1\t5\th\t1\t2\t3\tBeta alpha Beta x\nf2\tx\th\t1\t2\t3\tt\n")
    rows, defects = files.ocr_index(spark, str(tmp_path / "o.tsv"))
    assert rows.first().tokens == ["Beta", "alpha"] and defects.count() == 1


def test_transcripts_of_every_shape(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\n<c>hi</c> there\n\n00:02.000 --> 00:03.000\n\n00:04.000 --> 00:03.000\nback\n")
    (tmp_path / "b.tsv").write_text("# video_id\tr9\nstart\tend\ttext\n1.0\t2.0\tx\ty\nbad\n0.5\t1\tfirst\n")
    (tmp_path / "c.json").write_text('{"segments": [{"start": 1, "end": 2, "text": "j"}]}')
    found = files.transcripts(spark, [str(tmp_path / n) for n in ("a.vtt", "b.tsv", "c.json")]).collect()
    assert sorted((r.start_s, r.text) for r in found) == [(0.5, "first"), (1.0, "hi there"), (1.0, "j"), (1.0, "x\ty"), (4.0, "back")]
    assert files.cue_spans(spark, str(tmp_path / "a.vtt")).count() == 2
    assert {r.declared for r in files.caption_index(spark, str(tmp_path / "b.tsv")).collect()} == {"r9"}
    with pytest.raises(ValueError, match="not a transcript"):
        files.transcripts(spark, ["x.doc"])


def test_health_with_declared_durations(spark):
    rows = [("a", k, k * 4.0, k * 4.0 + 4, f"word{k}x") for k in range(10)]
    segments = spark.createDataFrame(rows, "recording_id string, ord int, start_s double, end_s double, text string")
    durations = spark.createDataFrame([("a", 100.0), ("b", 50.0)], "recording_id string, duration_s double")
    found = {(r.recording_id, r.code) for r in rules.health_defects(rules.health(segments, durations)).collect()}
    assert {("a", "E-TS-SHORT"), ("b", "E-TS-EMPTY"), ("b", "E-TS-SHORT")} <= found and ("a", "E-TS-EMPTY") not in found


def test_selections(spark):
    frames = spark.createDataFrame([("a", k) for k in range(8)] + [("b", 0)], "recording_id string, idx int")
    uniform = spark.createDataFrame([("a", 99), ("b", 98), ("c", 97)], "recording_id string, idx int")
    engines = {(r.recording_id, r.engine) for r in planning.with_fallback(frames, uniform).collect()}
    assert engines == {("a", "candidates"), ("b", "uniform"), ("c", "uniform")}
    flat, flicker = [5.0] * 4, [0.0, 50.0, 0.0, 50.0]
    thumbs = spark.createDataFrame([("a", 0, flat), ("a", 1, flicker), ("b", 0, flat)], "recording_id string, idx int, thumb array<double>")
    assert {(r.recording_id, r.idx) for r in sequence.without_blanks(thumbs).collect()} == {("a", 1), ("b", 0)}
    said = spark.createDataFrame([("Now look at this chart",), ("looking at things",), ("As you can see it",)], "text string")
    assert [r.p for r in said.select(tx.points("text").alias("p")).collect()] == [True, False, True]


def test_regions_put_salient_ones_first(spark):
    schema = "recording_id long, start_s double, ord int, text string"
    base = spark.createDataFrame([(1, 0.0, 0, "we do like the red car and one big old house here")], schema)
    other = spark.createDataFrame([(1, 0.0, 0, "we do not like the red car and a very tall tree stands here")], schema)
    found = alignment.regions(base, other).orderBy("rank").collect()
    assert [(r.is_salient, r.base, r.other) for r in found][0] == (True, "one big old house", "a very tall tree stands")
    assert (True, "", "not") in [(r.is_salient, r.base, r.other) for r in found]
    assert coverage.region_census(alignment.regions(base, other)).first().only_other == 6


def test_undated_defects(spark):
    defects = spark.createDataFrame([("a", None)], "key string, as_of date")
    ledger = spark.createDataFrame([("a", "2024-01-01 x")], "key string, reason string")
    assert rules.excused(defects, ledger).first().exempt and not rules.excused(defects, ledger, undated=False).first().exempt


def test_binding_control_loses_every_touch(spark):
    body = "- `[00:04]` `SPOKEN` and `ON-SCREEN` `[01:04]`\n- `[00:09]` `SPOKEN`"
    assert [tuple(r) for r in filing.binding_control(lines(spark, body)).collect()] == [("r", 2, 0)]


def test_differences_stamps_and_densities(spark):
    diff = spark.range(1).select(alignment.unified_diff(F.lit("a\nb\n"), F.lit("a\nc\n")).alias("d"), alignment.unified_diff(F.lit("a"), F.lit("a")).alias("e")).first()
    assert "-b\n+c\n" in diff.d and diff.e == ""
    digest = "0" * 64
    stamps = spark.createDataFrame([("a", None, digest), ("b", "v1 " + digest, digest), ("c", "v0 " + digest, digest), ("d", "v1 " + "1" * 64, digest), ("e", "x", digest)], "note string, graded string, digest string")
    assert {r.note: r.code for r in filing.grade_defects(stamps, "v1").collect()} == {"a": "E-GRADE-MISSING", "c": "E-GRADE-BUILD", "d": "E-GRADE-BODY", "e": "E-GRADE-FORM"}
    numbers = spark.createDataFrame([("a", 10.0, 2.0, 5.0), ("b", 11.0, 2.0, 5.0), ("c", None, None, None), ("d", 10.0, 2.0, 7.0)], "note string, words double, minutes double, wpm double")
    measured = spark.createDataFrame([(n, 10, 2.0) for n in "abcd"], "note string, words long, minutes double")
    assert {r.note: r.code for r in filing.declared_density(numbers, measured).collect()} == {"b": "E-DENSITY-WORDS", "c": "E-DENSITY-MISSING", "d": "E-DENSITY-RATE"}


def test_package_citations(spark):
    cites = spark.createDataFrame([("n", 0, "p@1.0:m.py"), ("n", 1, "p@2.0:m.py"), ("n", 2, "q@1:x"), ("n", 3, "p@1.0:no.py"), ("n", 4, "docs/a.md")], "note string, k long, path string")
    packages = spark.createDataFrame([("p", "1.0", "p/m.py"), ("p", "1.0", "p/z.py")], "name string, version string, path string")
    assert {r.k: (r.file, r.code) for r in filing.package_targets(cites, packages).collect()} == {0: ("p/m.py", None), 1: (None, "E-CITE-VERSION"), 2: (None, "E-CITE-NOPKG"), 3: (None, "E-CITE-NOFILE")}


def test_reviews_and_briefs(spark):
    known = spark.createDataFrame([("n", "s")], "note string, sha256 string")
    stamps = spark.createDataFrame([("n", "facts", "b1"), ("n", "style", None)], "note string, lane string, stamp string")
    cases = [("f1", "n", "facts", "facts", "s", "b1", None), ("f2", "n", "facts", "facts", "t", None, None), ("f3", "n", "facts", "style", "s", "b2", None), ("f4", "n", "style", "style", "s", "x", None), ("f5", "n", "other", "other", "s", None, None), ("f6", "m", "other", "other", "s", None, None), ("f7", "n", "facts", None, None, None, "no header")]
    reviews = spark.createDataFrame(cases, "file string, note string, lane string, said_lane string, note_sha256 string, brief_sha256 string, problem string")
    found = {}
    for r in filing.review_refusals(reviews, known, stamps).collect():
        found.setdefault(r.file, []).append(r.code)
    assert found == {"f2": ["E-FILE-UNBRIEFED", "E-FILE-STALE"], "f3": ["E-FILE-WRONGBRIEF", "E-FILE-MISLABELLED"], "f4": ["E-FILE-BADBRIEF"], "f6": ["E-FILE-STALE"], "f7": ["E-FILE-UNPARSED"]}
    asked = spark.createDataFrame([("n", "v", "facts", "x"), ("o", "v", "Facts", "x"), ("p", None, "facts", "x"), ("q", "v", "facts", " \n")], "note string, video_id string, lane string, text string")
    assert {r.note: r.code for r in filing.brief_refusals(asked).collect()} == {"o": "USAGE-BAD-LANE", "p": "USAGE-NO-ID", "q": "E-BRIEF-EMPTY"}
    runs = spark.createDataFrame([("a", "v1", "12", "Été à Paris!", None, "2024-01-02", "r"), ("b", "v2", "12", "!!!", None, "2024-01-02", "r"), ("c", "v3", "x", "t", None, "2024-01-02", "r"), ("d", "v9", "1", "t", None, "2024-01-02", "r"), ("e", "v4", "1", "t", "my-name", "2024-01-02", None), ("f", "a*b", "1", "t", None, "2024-01-02", "r"), ("g", "", "1", "t", None, "2024-01-02", "r")], "run string, video_id string, duration string, title string, stem string, note_date string, rendering string")
    opened = {r.run: r.note or r.code for r in filing.note_refusals(runs, spark.createDataFrame([("v9",)], "video_id string")).collect()}
    assert opened == {"a": "2024-01-02--ete-a-paris--v1.md", "b": "E-NOTE-UNNAMEABLE", "c": "USAGE-NO-DURATION", "d": "E-NOTE-EXISTS", "e": "E-NOTE-BLINDORACLE", "f": "USAGE-BAD-ID", "g": "USAGE-NO-ID"}
    frames = planning.batches(spark.createDataFrame([("r", k, f"f{k:02d}") for k in range(25)], "recording_id string, idx int, path string"))
    written = filing.briefs(spark.createDataFrame([("n", "r", "facts")], "note string, recording_id string, lane string"), frames).orderBy("batch").collect()
    assert [len(r.frames) for r in written] == [20, 5] and written[1].header == "# Review of n: facts, batch 2 of frames"
    paths = spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(filing.review_paths(F.lit("notes/a--b.md"), F.lit("facts"))))).first()
    assert tuple(paths) == ("notes/reviews/a--b--facts.md", "notes/reviews/a--b--facts.brief", "notes/a--b.cites.tsv")


def test_unclaimed_and_refused(spark):
    manifests = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "recording_id string, path string")
    held = spark.createDataFrame([("n", "b")], "note string, recording_id string")
    assert {(r.recording_id, r.code) for r in filing.unclaimed_manifests(manifests, held).collect()} == {("a", "E-MANIFEST-UNCLAIMED"), ("b", "E-MANIFEST-TWICE")}
    plan = spark.createDataFrame([("a", 0, "failed"), ("b", 0, None), ("b", 1, "failed"), ("c", 0, None), ("d", 0, None)], "recording_id string, chunk int, failed string")
    lost = spark.createDataFrame([("b", 1.0)], "recording_id string, from_s double")
    segments = spark.createDataFrame([("b",), ("d",)], "recording_id string")
    assert {r.recording_id: r.reason for r in filing.decode_refusals(lost, plan, segments).collect()} == {"a": "all-failed", "b": "lost-spans", "c": "empty"}
    assert {r.recording_id for r in filing.decode_refusals(lost, plan, segments, allow_lost=True).collect()} == {"a", "c"}


def test_a_long_item_without_marks_costs_its_length(spark):
    """F2-F6, F8, F16: what follows an item's last mark was read again from each of its signs."""
    lines = spark.createDataFrame([("r", 0, "- `[00:05]` `SPOKEN` " + "word " * 60_000)], "recording_id string, line_no long, text string")
    began = time.monotonic()
    (row,) = notes.anchors(notes.blocks(lines)).collect()
    assert (row["anchor"], row["class"], row["blanket"]) == ("00:05", "SPOKEN", False)
    assert time.monotonic() - began < 60


def test_marks_and_their_gaps(spark):
    texts = ["- `[00:05]``SPOKEN`, `[00:06]` x", "- a `INFERRED`", "- none", "- `[00:07]`"]
    lines = spark.createDataFrame([("r", k, t) for k, t in enumerate(texts)], "recording_id string, line_no long, text string")
    found = notes.item_marks(notes.blocks(lines)).orderBy("block", "k").collect()
    assert [(r.line_no, r.k, r.gap, r.mark) for r in found] == [(0, 0, "- ", "`[00:05]`"), (0, 1, "", "`SPOKEN`"), (0, 2, ", ", "`[00:06]`"), (1, 0, "- a ", "`INFERRED`"), (3, 0, "- ", "`[00:07]`")]


@pytest.mark.parametrize("few", [0, 200])
def test_quotes_are_found_whole_or_by_pieces(spark, monkeypatch, few):
    """files were cut into pieces, a row for each of their signs, even for one quote."""
    monkeypatch.setattr(filing, "FEW_QUOTES", few)
    cut = []
    monkeypatch.setattr(filing, "_pieces", lambda text, size, own=filing._pieces: cut.append(size) or own(text, size))
    files = spark.createDataFrame([("a", "x", "one two\nthree four\n\nfive six"), ("b", "y", "five\n\n\nsix")], "path string, sha256 string, text string")
    cites = ["three", "two three four", "five six", "four five", "x", "six"]
    body = " ".join(f'{{{{CITE:{p}#"{q}"}}}}' for p in "ab" for q in cites)
    found = filing.resolved_citations(spark.createDataFrame([("n", body)], "note string, body string"), files).orderBy("k").collect()
    assert [r.target_line for r in found] == [1, 0, 3, None, 3, 3, None, None, None, None, 3, 3]
    assert bool(cut) == (few == 0)


def test_measure_reads_the_rows_of_notes_once(spark):
    lines = spark.createDataFrame([(1, 0, "- `[00:10]` `SPOKEN` — the quick brown fox jumps"), (1, 1, "```"), (1, 2, "[00:20] quoted words that do not count"), (1, 3, "```")], "recording_id long, line_no long, text string")
    segments = spark.createDataFrame([(1, 0, 0.0, 30.0, "the quick brown fox jumps over 12 dogs")], "recording_id long, ord long, start_s double, end_s double, text string")
    found = notes.measure(lines, segments)
    # Fences are folded when rows are read, not again for each measure.
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    row = found.first()
    assert (row["rows"], row.rows_in_note, row.anchors, row.impossible) == (1, 1, 1, 0)


def test_turns_before_the_first_have_no_line_as_in_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(1, t, "user", "word " * (t + 5)) for t in range(-4, 30)] + [(2, None, "user", "x"), (2, 1, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = [tuple(r) for r in views.note_line(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(found) == sorted(con.execute(views.with_views("SELECT recording_id, line_no, text FROM note_line", "note_line")).fetchall())
