"""Deterministic timed-text views over the driver tables, as DataFrames and as SQL for the checks."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import notes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seg_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation, twelve seconds apart, fifteen characters a second."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * F.lit(12.0)
    return c.select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("ord"), start.alias("start_s"), (start + F.least(F.length("text") / F.lit(15.0), F.lit(30.0))).alias("end_s"), "text", "role")


def seg_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events, in seconds since the first event of all; each lasts its value in seconds."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    first = e.agg(F.min("us").alias("us")).scalar()
    start = (F.col("us") - first) / F.lit(1e6)
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) - 1
    return e.select(F.col("user_id").alias("recording_id"), order.cast("long").alias("ord"), start.alias("start_s"), (start + F.col("value")).alias("end_s"), F.col("event_type").alias("text"), "event_id", "value")


def seg_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document, four seconds each."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = d.select(F.col("doc_id").alias("recording_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return lines.select("recording_id", F.col("ord").cast("long").alias("ord"), (F.col("ord") * F.lit(4.0)).alias("start_s"), (F.col("ord") * F.lit(4.0) + 4.0).alias("end_s"), "text")


def frame_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as thumbnails of recordings named by their label."""
    e = table(spark, sf_dir, "embeddings")
    idx = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    return e.select(F.col("label").cast("long").alias("recording_id"), idx.alias("idx"), idx.cast("double").alias("ts"), F.col("embedding").alias("thumb"))


def frame_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of sampled frames: view events."""
    return seg_evt(spark, sf_dir).where("text = 'view'").select("recording_id", F.col("start_s").alias("frame_s"))


def anchor_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of notes: click, purchase and signup events, with the evidence class that the type stands for."""
    kind = F.when(F.col("text") == "click", F.when(F.col("event_id") % 3 == 0, "ON-SCREEN").otherwise("SPOKEN")).when(F.col("text") == "purchase", "INFERRED").otherwise("NONE")
    return seg_evt(spark, sf_dir).where("text in ('click', 'purchase', 'signup')").select("recording_id", F.col("event_id").alias("anchor_id"), F.col("start_s").alias("at_s"), kind.alias("class"))


def cue_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption spans: error events that last their value in minutes."""
    return seg_evt(spark, sf_dir).where("text = 'error'").select("recording_id", "ord", "start_s", (F.col("start_s") + F.col("value") * 60).alias("end_s"))


#: How turns become lines of a note: by (turn + length of its text) modulo their number. S, E and P are the stamps of the
#: turn's start, end and predecessor, N its number, R its recording, T its text on one line without backticks.
NOTE_TEMPLATES = [
    ["## Section {N}", "{T}"],
    ["- `[{S}]` `SPOKEN` — {T}"],
    ["- `[{S}]` / `[{E}]` `ON-SCREEN` then `SPOKEN` `[{P}]` {T}"],
    ["```text", "- `[{S}]` `SPOKEN` — {T}", "", "```"],
    ["- `[{S}]` `SPOKEN` to `[{E}]` `SPOKEN` — {T}"],
    ["- `[{S}]` `INFERRED` — {T}"],
    ["{T} as `[{S}]` shows", "and `[{P}]` too", ""],
    ["- `[{S}]` `SPOKEN` `ON-SCREEN` `[{E}]` and {T}"],
    ["- `[{S}:99]` `SPOKEN` — {T}", "- `[{E}]` `SPOKEN` to `[{P}]` `SPOKEN` — backwards", "- `[{S}]` `SPOKEN` —", "- `[{S}]` `[{E}]` SPOKEN {T}"],
    ["## Claims", "- {T} `[{S}]`", "  and `[{E}]` `SPOKEN`", "- `[{S}]``ORPHAN` `ON-SCREEN` {T}"],
    ["> notes/2024-01-02--talk--r{N}.md says `[{S}]`", "> `[{E}]` `ON-SCREEN`", "| `[{P}]` | `SPOKEN` | {T} |"],
    ["## Strongest objection", "- {T}", "  *Falsifier:* `[{S}]`", "- no test `[{E}]`", "~~~~"],
]


def note_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a note about each conversation."""
    s = seg_conv(spark, sf_dir).withColumn("body", F.coalesce("text", F.lit("")))
    stamp = lambda c: F.format_string("%02d:%02d", (F.floor(c) / 60).cast("long"), (F.floor(c) % 60).cast("long"))
    parts = {"S": stamp(F.col("start_s")), "E": stamp(F.coalesce("end_s", "start_s")), "P": stamp(F.greatest(F.col("start_s") - 12, F.lit(0.0))), "N": F.col("ord").cast("string"), "T": F.translate("body", "\n`", " ")}

    def line(template: str) -> Column:
        return F.concat(*(parts[p] if k % 2 else F.lit(p) for k, p in enumerate(re.split(r"\{(\w)\}", template)) if p or k % 2))

    which = ((F.col("ord") + F.length("body")) % len(NOTE_TEMPLATES)).cast("int")
    # One template is filled for each turn, not all of them.
    texts = reduce(lambda chosen, k: chosen.when(which == k, F.array(*map(line, NOTE_TEMPLATES[k]))), range(1, len(NOTE_TEMPLATES)), F.when(which == 0, F.array(*map(line, NOTE_TEMPLATES[0]))))
    rows = s.select("recording_id", "ord", F.posexplode(texts).alias("k", "text"))
    return rows.select("recording_id", (F.col("ord") * 10 + F.col("k")).alias("line_no"), "text")


def note_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.blocks(note_line(spark, sf_dir))


def note_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.anchors(note_block(spark, sf_dir))


def _note_sql() -> str:
    """note_line in SQL."""

    def line(template: str) -> str:
        return " || ".join((p if k % 2 else "'" + p.replace("'", "''") + "'") for k, p in enumerate(re.split(r"\{(\w)\}", template)) if p or k % 2) or "''"

    stamp = lambda c: f"printf('%02d:%02d', (floor({c}))::BIGINT // 60, (floor({c}))::BIGINT % 60)"
    cases = " ".join(f"WHEN {k} THEN [{', '.join(map(line, t))}]" for k, t in enumerate(NOTE_TEMPLATES))
    source = f"SELECT recording_id, ord, {stamp('start_s')} AS S, {stamp('coalesce(end_s, start_s)')} AS E, {stamp('greatest(start_s - 12, 0)')} AS P, ord::VARCHAR AS N, replace(replace(coalesce(text, ''), chr(10), ' '), '`', '') AS T, (ord + length(coalesce(text, ''))) % {len(NOTE_TEMPLATES)} AS which FROM seg_conv"
    return f"SELECT recording_id, ord * 10 + k AS line_no, text FROM (SELECT recording_id, ord, unnest(range(len(l))) AS k, unnest(l) AS text FROM (SELECT recording_id, ord, CASE which {cases} END AS l FROM ({source})))"


def _block_sql() -> str:
    """note_block in SQL."""
    over = "OVER (PARTITION BY recording_id ORDER BY line_no"
    q = lambda p: "'" + p.replace("'", "''") + "'"
    return f"""SELECT recording_id, line_no, text, dense_rank() OVER (PARTITION BY recording_id ORDER BY part) AS block, section, verbatim FROM (
  SELECT *, sum(CASE WHEN fence OR head OR (NOT verbatim AND NOT fence AND (blank OR regexp_matches(text, {q(notes.ITEM)}) OR regexp_matches(text, {q(notes.TABLE)}) OR regexp_matches(text, {q(notes.QUOTE)}))) OR coalesce(after_head, false) THEN 1 ELSE 0 END) {over} ROWS UNBOUNDED PRECEDING) AS part,
    coalesce(last_value(CASE WHEN head AND regexp_matches(text, '^##\\s+') THEN trim(regexp_extract(text, '^##\\s+(.*?)\\s*$', 1)) END IGNORE NULLS) {over} ROWS UNBOUNDED PRECEDING), '') AS section
  FROM (SELECT *, lag(head) {over}) AS after_head FROM (SELECT *, NOT verbatim AND NOT fence AND regexp_matches(text, {q(notes.HEADING)}) AS head FROM (
    SELECT *, sum(fence::INT) {over} ROWS UNBOUNDED PRECEDING) % 2 = 1 AS verbatim FROM (SELECT *, regexp_matches(text, {q(notes.FENCE)}) AS fence, trim(text, chr(9) || chr(12) || chr(13) || ' ') = '' AS blank FROM note_line)))))
WHERE NOT fence AND NOT blank"""


def _anchor_sql() -> str:
    """note_anchor in SQL: marks of an item in order, groups of anchors by glue, and what reaches each group."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    anchor, mark, marks = notes.ANCHOR, f"(?s)(.*?)({notes.ANCHOR}|{notes.CLASS_MARK})", "|".join(notes.MACHINE_MARKS)
    over = "OVER (PARTITION BY recording_id, block ORDER BY k"
    foreign = f"SELECT DISTINCT recording_id, line_no FROM (SELECT recording_id, line_no, max(len(list_filter(list_transform(regexp_extract_all(text, {q(notes.NOTE_REFERENCE)}, 1), lambda r: list_extract(string_split(regexp_replace(list_extract(string_split(r, '/'), -1), '\\.md$', ''), '--'), -1)), lambda r: r <> recording_id::VARCHAR))) OVER (PARTITION BY recording_id, block ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS others FROM note_block) WHERE others > 0"
    return f"""WITH item AS (SELECT recording_id, block, any_value(section) AS section, bool_or(verbatim) AS verbatim, list(line_no ORDER BY line_no) AS numbers, string_agg(text, chr(10) ORDER BY line_no) AS raw FROM note_block GROUP BY 1, 2),
clean AS (SELECT *, regexp_replace(raw, {q(f"({anchor})|{marks}")}, '\\1', 'g') AS c FROM item),
joined AS (SELECT *, CASE WHEN regexp_extract_all(c, {q(anchor)}) = regexp_extract_all(raw, {q(anchor)}) THEN c ELSE raw END AS j FROM clean),
t AS (SELECT recording_id, block, section, verbatim, numbers, unnest(range(len(m))) AS k, unnest(g) AS gap, unnest(m) AS mark FROM (SELECT *, regexp_extract_all(j, {q(mark)}, 1) AS g, regexp_extract_all(j, {q(mark)}, 2) AS m FROM joined)),
u AS (SELECT *, numbers[(sum(length(gap) - length(replace(gap, chr(10), ''))) {over} ROWS UNBOUNDED PRECEDING))::BIGINT + 1] AS line_no, starts_with(mark, '`[') AS is_anchor, regexp_matches(gap, {q(notes.GLUE)}) AND NOT (contains(gap, chr(10)) AND regexp_full_match(gap, '\\s*')) AS glued FROM t),
v AS (SELECT *, coalesce(lag(is_anchor) {over}), false) AS after_anchor, coalesce(lead(is_anchor) {over}), false) AND coalesce(lead(glued) {over}), false) AS next_ok, lead(gap) {over}) AS next_gap FROM u),
w AS (SELECT *, sum(CASE WHEN is_anchor AND NOT (after_anchor AND glued) THEN 1 ELSE 0 END) {over} ROWS UNBOUNDED PRECEDING) AS grp FROM v),
x AS (SELECT *, CASE WHEN NOT is_anchor THEN CASE WHEN after_anchor AND glued AND (NOT next_ok OR length(gap) <= length(next_gap)) THEN grp WHEN next_ok THEN lead(grp) {over}) END END AS reaches, replace(mark, '`', '') AS label FROM w),
hit AS (SELECT recording_id, block, reaches AS grp, list(DISTINCT label) AS touching FROM x WHERE reaches IS NOT NULL GROUP BY 1, 2, 3),
nam AS (SELECT recording_id, block, list(DISTINCT label) AS present FROM x WHERE NOT is_anchor GROUP BY 1, 2),
fgn AS ({foreign})
SELECT x.recording_id, x.block, k, x.line_no, regexp_extract(mark, {q(chr(92) + "[(" + notes.STAMP + ")" + chr(92) + "]")}, 1) AS anchor, list_reduce(list_transform(string_split(regexp_extract(mark, {q(chr(92) + "[(" + notes.STAMP + ")" + chr(92) + "]")}, 1), ':'), lambda p: p::DOUBLE), lambda a, b: a * 60 + b) AS at_s,
  CASE WHEN verbatim THEN 'VERBATIM' WHEN present IS NULL THEN 'NONE' WHEN len(present) = 1 THEN present[1] WHEN touching IS NULL THEN 'MULTI' WHEN len(touching) = 1 THEN touching[1] ELSE 'CONTESTED' END AS class, section, fgn.line_no IS NOT NULL AS "foreign",
  coalesce(len(present), 0) = 1 AND touching IS NULL AND NOT verbatim AND fgn.line_no IS NULL AS blanket
FROM x LEFT JOIN hit USING (recording_id, block, grp) LEFT JOIN nam USING (recording_id, block) LEFT JOIN fgn ON fgn.recording_id = x.recording_id AND fgn.line_no = x.line_no WHERE is_anchor"""


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg_evt(spark, sf_dir).groupBy("recording_id").agg(F.max("end_s").alias("duration_s"))


SQL: dict[str, str] = {
    "seg_conv": """SELECT conv_id AS recording_id, turn AS ord, turn * 12.0::DOUBLE AS start_s, turn * 12.0::DOUBLE + least(length(text) / 15.0::DOUBLE, 30.0::DOUBLE) AS end_s, text, role FROM conversations""",
    "seg_evt": """SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6::DOUBLE AS start_s, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6::DOUBLE + value AS end_s, event_type AS text, event_id, value FROM events""",
    "seg_line": """SELECT recording_id, ord, ord * 4.0::DOUBLE AS start_s, ord * 4.0::DOUBLE + 4.0::DOUBLE AS end_s, text FROM (SELECT doc_id AS recording_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL)""",
    "frame_emb": """SELECT label::BIGINT AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::DOUBLE AS ts, embedding AS thumb FROM embeddings""",
    "frame_evt": """SELECT recording_id, start_s AS frame_s FROM seg_evt WHERE text = 'view'""",
    "anchor_evt": """SELECT recording_id, event_id AS anchor_id, start_s AS at_s, CASE text WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'ON-SCREEN' ELSE 'SPOKEN' END WHEN 'purchase' THEN 'INFERRED' ELSE 'NONE' END AS class FROM seg_evt WHERE text IN ('click', 'purchase', 'signup')""",
    "cue_evt": """SELECT recording_id, ord, start_s, start_s + value * 60 AS end_s FROM seg_evt WHERE text = 'error'""",
    "durations": """SELECT recording_id, max(end_s) AS duration_s FROM seg_evt GROUP BY 1""",
    "note_line": _note_sql(),
    "note_block": _block_sql(),
    "note_anchor": _anchor_sql(),
}
_NEEDS = {"note_line": ["seg_conv"], "note_block": ["seg_conv", "note_line"], "note_anchor": ["seg_conv", "note_line", "note_block"], "frame_evt": ["seg_evt"], "anchor_evt": ["seg_evt"], "cue_evt": ["seg_evt"], "durations": ["seg_evt"]}
VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (seg_conv, seg_evt, seg_line, frame_emb, frame_evt, anchor_evt, cue_evt, durations, note_line, note_block, note_anchor)}


def with_views(body: str, *names: str) -> str:
    """SQL with the named views in front; body may begin with further common tables ("WITH ...")."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in [*_NEEDS.get(name, []), name] if n not in wanted]
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    body = body.strip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


#: Entities of the driver's tables and the signs that they stand for, as SQL; the ampersand comes last.
ENTITIES = {"&nbsp;": "chr(160)", "&lt;": "'<'", "&gt;": "'>'", "&quot;": "chr(34)", "&#39;": "chr(39)", "&amp;": "'&'"}

#: The same as text, for the operators.
ENTITY_SIGNS = (("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def literal_sql(files: str, names: list[str], spelt: list[str]) -> str:
    """WITH tables that end in literal(source_id, line_no, "column", name, way): names in whole texts of files(source_id, text).

    spelt: the names' letters and digits. For texts whose signs are their own compatibility forms, and whose entities are ENTITIES.
    """
    reach = max(map(len, spelt))
    run = r"[\p{L}\p{N}]+"
    at_once = " UNION ALL ".join(
        f"SELECT source_id, way, pos, line_no, line_at, {' || '.join(['run', *(f'lead(run, {i}) OVER w' for i in range(1, j))])} AS spelt, {' OR '.join(['FALSE', *(f'lead(ends, {i}) OVER w' for i in range(1, j))])} AS ends FROM placed WINDOW w AS (PARTITION BY source_id, way ORDER BY k)"
        for j in range(1, reach + 1)
    )
    opened = "text"
    for entity, sign in ENTITIES.items():
        opened = f"replace({opened}, '{entity}', {sign})"
    named = ", ".join(f"({k + 1}, '{n}', '{s}')" for k, (n, s) in enumerate(zip(names, spelt, strict=True)))
    return rf"""files AS ({files}),
read AS (SELECT source_id, 3 AS way, text FROM files UNION ALL SELECT source_id, 5, {opened} FROM files WHERE text <> {opened}),
runs AS (SELECT source_id, way, generate_subscripts(regexp_extract_all(text, '{run}'), 1) AS k, unnest(regexp_extract_all(text, '{run}')) AS run,
  unnest(list_slice(regexp_split_to_array(text, '{run}'), 1, len(regexp_extract_all(text, '{run}')))) AS gap FROM read),
sized AS (SELECT *, sum(length(gap) + length(run)) OVER (PARTITION BY source_id, way ORDER BY k) - length(run) AS pos,
  sum(length(gap) - length(replace(gap, chr(10), ''))) OVER (PARTITION BY source_id, way ORDER BY k) + 1 AS line_no FROM runs),
placed AS (SELECT source_id, way, k, lower(run) AS run, pos, line_no, coalesce(max(CASE WHEN contains(gap, chr(10)) THEN pos - strpos(reverse(gap), chr(10)) + 1 END) OVER (PARTITION BY source_id, way ORDER BY k), 0) AS line_at,
  regexp_matches(run, '^\p{{Lu}}') AND regexp_matches(gap, '[.!?;]\s*[^\S\n]') AS ends FROM sized),
names AS (SELECT * FROM (VALUES {named}) v(name, said, spelt)),
forms AS (SELECT name, way, form FROM (SELECT name, said, unnest([0, 1, 2]) AS way, unnest([to_base64(encode(said)), translate(to_base64(encode(said)), '+/', '-_'), rtrim(to_base64(encode(said)), '=')]) AS form FROM names) WHERE length(form) >= 12 AND form <> said),
coded AS (SELECT source_id, line_no, strpos(line, form) AS pos, name, way FROM (SELECT source_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM files) JOIN forms ON strpos(line, form) > 0),
met AS (SELECT source_id, line_no, pos - line_at + 1 AS pos, name, way FROM ({at_once}) JOIN names USING (spelt) WHERE NOT ends UNION ALL SELECT * FROM coded),
literal AS (SELECT source_id, line_no::BIGINT AS line_no, arg_min(pos, (way, pos))::BIGINT AS "column", name, ['base64', 'base64-url', 'base64-bare', 'squashed', 'percent', 'entities'][min(way) + 1] AS way FROM met GROUP BY source_id, line_no, name)"""
