"""Queries over notes: blocks, rows, anchors and their classes, dispositions, votes and censuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.words import STOPWORDS
from tidemark.operators import notes, votes
from tidemark.plans import views
from tidemark.plans.registry import Registry, r6
from tidemark.plans.views import with_views

_reg = Registry()
QUERIES, ORACLES = _reg.queries, _reg.oracles
query = _reg.query


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns' starts stand for frames."""
    return views.seg_conv(spark, sf_dir).where("role = 'assistant'").select("recording_id", F.col("start_s").alias("frame_s"))


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns stand for caption spans."""
    return views.seg_conv(spark, sf_dir).where("role = 'user' and end_s is not null").select("recording_id", "ord", "start_s", "end_s")


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.seg_conv(spark, sf_dir).groupBy("recording_id").agg(F.max("end_s").alias("duration_s"))


_SEEN = """frm AS (SELECT recording_id, start_s AS frame_s FROM seg_conv WHERE role = 'assistant'),
cue AS (SELECT recording_id, min(start_s) AS start_s, max(end_s) AS end_s FROM (SELECT *, sum(CASE WHEN start_s > reach + 1 OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_s, ord ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(end_s) OVER (PARTITION BY recording_id ORDER BY start_s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg_conv WHERE role = 'user' AND end_s IS NOT NULL)) GROUP BY recording_id, island),
dur AS (SELECT recording_id, max(end_s) AS duration_s FROM seg_conv GROUP BY 1),
space AS (SELECT dur.recording_id, coalesce(f.frames, 0) AS frames, c.cue_s IS NOT NULL AS has_cues, CASE WHEN duration_s > 0 THEN least(1, coalesce(c.cue_s, 0) / duration_s) ELSE 0 END AS cue_coverage, CASE WHEN duration_s > 0 THEN least(1, coalesce(f.frames, 0) / duration_s) ELSE 0 END AS frame_coverage
  FROM dur LEFT JOIN (SELECT recording_id, count(DISTINCT floor(frame_s)) AS frames FROM frm GROUP BY 1) f USING (recording_id) LEFT JOIN (SELECT recording_id, sum(end_s - start_s) AS cue_s FROM cue GROUP BY 1) c USING (recording_id))"""
_PLAIN = "regexp_replace({}, '(?s)`[^`]*`|<!--.*?-->|\\{{\\{{[^}}]*\\}}\\}}|[*_>#|]', ' ', 'g')"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _words(text: str) -> str:
    """item_words in SQL."""
    found = f"regexp_extract_all(lower({_PLAIN.format(text)}), '[a-z][a-z''-]{{3,}}')"
    return f"list_distinct(list_filter(list_concat({found}, list_filter(flatten(list_transform(list_filter({found}, lambda w: contains(w, '-')), lambda w: string_split(w, '-'))), lambda w: length(w) >= 4)), lambda w: NOT list_contains({_STOP}, w)))"


@query(with_views("SELECT recording_id, block, any_value(section) AS section, bool_or(verbatim) AS verbatim, min(line_no) AS first_line, count(*) AS lines FROM note_block GROUP BY 1, 2", "note_block"))
def note_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of notes with their section."""
    rows = views.note_block(spark, sf_dir).groupBy("recording_id", "block")
    return rows.agg(F.first("section").alias("section"), F.first("verbatim").alias("verbatim"), F.min("line_no").alias("first_line"), F.count("*").alias("lines"))


_STARTS = " OR ".join(f"regexp_matches(text, {_q(p)})" for p in (notes.HEADING, notes.FENCE, r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$", notes.TABLE, notes.QUOTE, notes.ITEM))


@query(with_views(f"SELECT recording_id, count(*) FILTER (WHERE {_STARTS}) AS starts, count(*) FILTER (WHERE regexp_matches(text, {_q(notes.FENCE)})) AS fences, count(*) FILTER (WHERE regexp_matches(text, {_q(notes.FENCE)})) % 2 = 0 AS balanced FROM note_line GROUP BY 1", "note_line"))
def fence_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin a block, and whether fences come in pairs."""
    lines = views.note_line(spark, sf_dir)
    starts = lines.groupBy("recording_id").agg(F.count_if(notes.is_block_start("text")).alias("starts"))
    return starts.join(notes.fence_balance(lines), "recording_id")


_FENCES = r"""mk AS (SELECT recording_id, line_no, left(m, 1) AS sign, length(m) AS width, trim(regexp_replace(text, '^[ \t]*(`{3,}|~{3,})', '')) = '' AS bare, row_number() OVER (PARTITION BY recording_id ORDER BY line_no) AS k FROM (SELECT *, regexp_extract(text, '^[ \t]*(`{3,}|~{3,})', 1) AS m FROM note_line) WHERE m <> ''),
st AS (SELECT recording_id, k, line_no AS o, sign, width, NULL::BIGINT AS open_at, NULL::BIGINT AS close_at FROM mk WHERE k = 1
  UNION ALL SELECT m.recording_id, m.k, CASE WHEN s.o IS NULL THEN m.line_no WHEN m.sign = s.sign AND m.width >= s.width AND m.bare THEN NULL ELSE s.o END, CASE WHEN s.o IS NULL THEN m.sign ELSE s.sign END, CASE WHEN s.o IS NULL THEN m.width ELSE s.width END,
    CASE WHEN s.o IS NOT NULL AND m.sign = s.sign AND m.width >= s.width AND m.bare THEN s.o END, CASE WHEN s.o IS NOT NULL AND m.sign = s.sign AND m.width >= s.width AND m.bare THEN m.line_no END FROM st s JOIN mk m ON m.recording_id = s.recording_id AND m.k = s.k + 1),
fence AS (SELECT recording_id, open_at, close_at FROM st WHERE open_at IS NOT NULL UNION ALL SELECT recording_id, o, NULL FROM st JOIN (SELECT recording_id, max(k) AS k FROM st GROUP BY 1) USING (recording_id, k) WHERE o IS NOT NULL),
free AS (SELECT * FROM note_line l WHERE NOT EXISTS (FROM fence f WHERE f.recording_id = l.recording_id AND l.line_no > open_at AND l.line_no < close_at))"""


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql[5:]


@query(_recursive(with_views(f"WITH {_FENCES} SELECT * FROM fence", "note_line")))
def fence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences of notes; what nothing closes has no end."""
    return notes.fences(views.note_line(spark, sf_dir))


def _clock_sql(stamp: str) -> str:
    parts = f"string_split({stamp}, ':')"
    return f"CASE WHEN {stamp} <> '' AND len(list_filter(({parts})[2:], lambda p: p::INT >= 60)) = 0 THEN list_reduce(list_transform({parts}, lambda p: p::DOUBLE), lambda a, b: a * 60 + b) END"


_ROW = lambda k: f"regexp_extract(text, {_q(notes.ROW)}, {k})"
_KINDS = f"""p AS (SELECT *, regexp_matches(text, {_q(notes.ROW)}) AS is_row, regexp_matches(text, {_q(notes.ROWISH)}) AS rowish, {_ROW(1)} AS a, {_ROW(2)} AS c, CASE WHEN {_ROW(3)} = '' THEN {_ROW(1)} ELSE {_ROW(3)} END AS z, trim({_ROW(4)}) AS claim FROM SOURCE),
p2 AS (SELECT *, {_clock_sql('a')} AS t0, {_clock_sql('z')} AS t1 FROM p),
kinds AS (SELECT recording_id, line_no, text, CASE WHEN NOT is_row THEN CASE WHEN rowish THEN 'unread' ELSE 'prose' END WHEN t0 IS NULL OR t1 IS NULL THEN 'impossible' WHEN t1 < t0 OR claim = '' THEN 'misshapen' ELSE 'row' END AS kind, t0, t1, c, claim FROM p2)"""


@query(with_views(f"WITH {_KINDS.replace('SOURCE', 'note_line')} SELECT recording_id, line_no, kind, CASE WHEN kind = 'row' THEN t0 END AS at_s, CASE WHEN kind = 'row' THEN t1 END AS until_s, CASE WHEN kind = 'row' THEN c END AS class, CASE WHEN kind = 'row' THEN md5(claim) END AS claim FROM kinds", "note_line"))
def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the notes as a row, a refusal or prose."""
    found = notes.claim_rows(views.note_line(spark, sf_dir))
    return found.select("recording_id", "line_no", "kind", "at_s", "until_s", "class", F.md5("claim").alias("claim"))


_STAMPED = f"""SELECT recording_id, line_no, {_clock_sql('stamp')} AS at_s, said AND NOT refused AS counts, said AND refused AS refused FROM (SELECT recording_id, line_no, kind IN ('impossible', 'misshapen') AS refused, len(regexp_extract_all(lower(regexp_replace(text, {_q(notes.LOOSE_ANCHOR)}, ' ', 'g')), '[a-z0-9'']+')) >= 4 AS said, unnest(regexp_extract_all(text, {_q(notes.LOOSE_ANCHOR)}, 1)) AS stamp FROM kinds)"""


@query(_recursive(with_views(f"WITH {_FENCES}, {_KINDS.replace('SOURCE', 'free')} SELECT * FROM ({_STAMPED}) WHERE at_s IS NOT NULL", "note_line")))
def line_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sayable stamps of lines outside fences, and whether they count."""
    return notes.line_anchors(views.note_line(spark, sf_dir))


@query(with_views(f"WITH l AS (SELECT *, list_transform(regexp_extract_all(text, {_q(notes.LOOSE_ANCHOR)}, 1), lambda s: {_clock_sql('s')}) AS secs FROM note_line) SELECT recording_id, line_no FROM l WHERE len(list_filter(secs, lambda s: s BETWEEN 10 AND 40)) > 0", "note_line"))
def span_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are stamped between seconds 10 and 40."""
    return notes.span_text(views.note_line(spark, sf_dir), 10, 40).select("recording_id", "line_no")


@query(with_views('SELECT recording_id, line_no, k, anchor, at_s, class, section, "foreign", blanket FROM note_anchor', "note_anchor"))
def anchor_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors with the class that each is bound to."""
    return views.note_anchor(spark, sf_dir).drop("block")


@query(with_views("SELECT recording_id, block, md5(array_to_string(list_sort(w), ' ')) AS words, len(w) AS n FROM (SELECT recording_id, block, WORDS AS w FROM (SELECT recording_id, block, string_agg(text, chr(10) ORDER BY line_no) AS raw FROM note_block GROUP BY 1, 2))".replace("WORDS", _words("raw")), "note_block"))
def item_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each item that could witness it."""
    items = notes.items(views.note_block(spark, sf_dir)).withColumn("w", tx.item_words("raw"))
    return items.select("recording_id", "block", F.md5(F.array_join(F.array_sort("w"), " ")).alias("words"), F.size("w").cast("long").alias("n"))


@query(with_views(f"WITH {_SEEN} SELECT recording_id, frames, has_cues, round(cue_coverage, 6) AS cue_coverage, round(frame_coverage, 6) AS frame_coverage, cue_coverage >= 0.95 AS cues_vacuous FROM space", "seg_conv"))
def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What anchors can be checked against, and whether that check could fail."""
    found = notes.namespaces(_frames(spark, sf_dir), _cues(spark, sf_dir), _durations(spark, sf_dir))
    return found.select("recording_id", "frames", "has_cues", r6("cue_coverage"), r6("frame_coverage"), "cues_vacuous")


_SCORES = """it AS (SELECT recording_id, block, WORDS AS words FROM (SELECT recording_id, block, string_agg(text, chr(10) ORDER BY line_no) AS raw FROM note_block GROUP BY 1, 2)),
said AS (SELECT recording_id, start_s, end_s, unnest(SAID) AS word FROM seg_conv),
aw AS (SELECT recording_id, block, k, at_s, len(words) AS n, unnest(words) AS word FROM note_anchor JOIN it USING (recording_id, block)),
hit AS (SELECT recording_id, block, k, count(DISTINCT aw.word) AS hits FROM aw JOIN said USING (recording_id, word) WHERE start_s <= at_s + 12 AND end_s >= at_s - 12 GROUP BY 1, 2, 3),
sc AS (SELECT a.*, len(words) AS n, coalesce(hits, 0) AS hits, coalesce(hits, 0) >= 4 AND coalesce(hits, 0) / len(words)::DOUBLE >= 0.25 AS passed FROM note_anchor a JOIN it USING (recording_id, block) LEFT JOIN hit USING (recording_id, block, k))""".replace("WORDS", _words("raw")).replace("SAID", _words("text"))
_DISPOSED = f"""{_SEEN}, {_SCORES},
lab AS (SELECT recording_id, at_s, count(DISTINCT class) AS classes FROM note_anchor WHERE NOT "foreign" AND class IN ('ON-SCREEN', 'SPOKEN', 'INFERRED') GROUP BY 1, 2),
d AS (SELECT sc.recording_id, sc.block, sc.k, CASE WHEN "foreign" THEN 'foreign' WHEN class = 'VERBATIM' THEN 'verbatim' WHEN class IN ('NONE', 'MULTI', 'CONTESTED') THEN CASE WHEN classes = 1 THEN 'cross-referenced' ELSE 'unattributable' END
  WHEN class = 'ON-SCREEN' THEN CASE WHEN coalesce(frames, 0) = 0 THEN 'unchecked' WHEN EXISTS (FROM frm f WHERE f.recording_id = sc.recording_id AND floor(frame_s) = sc.at_s) THEN 'resolved' ELSE 'unresolved' END
  WHEN coalesce(has_cues AND cue_coverage < 0.95, false) THEN CASE WHEN EXISTS (FROM cue c WHERE c.recording_id = sc.recording_id AND sc.at_s BETWEEN c.start_s AND c.end_s) THEN 'resolved' ELSE 'unresolved' END
  WHEN class = 'SPOKEN' THEN CASE WHEN n >= 6 AND passed THEN 'witnessed-spoken' ELSE 'unchecked-spoken' END ELSE 'unbound-inferred' END AS disposition
  FROM sc LEFT JOIN lab ON lab.recording_id = sc.recording_id AND lab.at_s = sc.at_s LEFT JOIN space ON space.recording_id = sc.recording_id)"""


def _disposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Blocks and anchors are read several times; a lost part of the cache is computed again.
    lined = views.note_block(spark, sf_dir).persist()
    return notes.dispositions(notes.anchors(lined).persist(), lined, _frames(spark, sf_dir), _cues(spark, sf_dir), _durations(spark, sf_dir), views.seg_conv(spark, sf_dir))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE disposition = '{d}') AS {d.replace('-', '_')}" for d in notes.DISPOSITIONS)


@query(with_views(f"WITH {_DISPOSED} SELECT recording_id, count(*) AS anchors, {_COUNTS}, true AS adds_up FROM d GROUP BY 1", "note_anchor"))
def note_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many anchors of each note end up in each of ten dispositions."""
    return notes.census(_disposed(spark, sf_dir))


@query(with_views(f"WITH {_DISPOSED} SELECT count(DISTINCT recording_id) AS notes, count(*) AS anchors, count(*) FILTER (WHERE disposition = 'resolved') AS resolved, count(*) FILTER (WHERE disposition = 'unattributable') AS unattributable, (SELECT count(*) FROM space WHERE cue_coverage >= 0.95) AS vacuous FROM d", "note_anchor"))
def corpus_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus in one row."""
    spaces = notes.namespaces(_frames(spark, sf_dir), _cues(spark, sf_dir), _durations(spark, sf_dir))
    return notes.corpus_census(notes.census(_disposed(spark, sf_dir)), spaces)


@query(with_views(f"""WITH {_SEEN}, {_SCORES}, kd AS (SELECT sc.recording_id, class, CASE WHEN duration_s > 0 AND at_s > duration_s THEN 'beyond' WHEN n < 6 THEN 'unscorable' WHEN class = 'SPOKEN' THEN CASE WHEN passed THEN 'witnessed' ELSE 'unwitnessed' END WHEN class IN ('NONE', 'MULTI', 'CONTESTED') THEN CASE WHEN passed THEN 'candidate' ELSE 'unattributed' END ELSE 'other' END AS kind FROM sc LEFT JOIN dur USING (recording_id) WHERE class <> 'VERBATIM')
SELECT recording_id, count(*) AS anchors, count(*) FILTER (WHERE class = 'SPOKEN') AS spoken, count(*) FILTER (WHERE kind = 'witnessed') AS witnessed, count(*) FILTER (WHERE kind = 'unwitnessed') AS unwitnessed, count(*) FILTER (WHERE kind = 'unscorable' AND class = 'SPOKEN') AS short, count(*) FILTER (WHERE kind = 'beyond' AND class = 'SPOKEN') AS beyond, count(*) FILTER (WHERE kind = 'unscorable') AS unscorable, count(*) FILTER (WHERE kind = 'candidate') AS candidates, count(*) FILTER (WHERE kind IN ('candidate', 'unattributed')) AS unattributed FROM kd GROUP BY 1""", "note_anchor"))
def spoken_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of what is said on the anchors of each note."""
    lined = views.note_block(spark, sf_dir).persist()
    return votes.spoken_census(votes.spoken_scores(notes.anchors(lined).persist(), lined, views.seg_conv(spark, sf_dir), _durations(spark, sf_dir)))


@query(with_views("""WITH pt AS (SELECT DISTINCT recording_id, at_s FROM note_anchor WHERE NOT "foreign") SELECT recording_id, count(*) AS seconds, count(*) FILTER (WHERE f) AS framed, count(*) FILTER (WHERE s) AS spoken, count(*) FILTER (WHERE f) * 2 < count(*) AS few_framed
FROM (SELECT *, EXISTS (FROM seg_conv g WHERE g.recording_id = pt.recording_id AND role = 'assistant' AND floor(start_s) = at_s) AS f, EXISTS (FROM seg_conv g WHERE g.recording_id = pt.recording_id AND floor(start_s) = at_s) AS s FROM pt) GROUP BY 1""", "note_anchor"))
def anchor_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored seconds that a frame or a segment's start stands for."""
    return notes.anchor_reach(views.note_anchor(spark, sf_dir), _frames(spark, sf_dir), views.seg_conv(spark, sf_dir))


@query(with_views(r"""WITH w AS (SELECT recording_id, sum(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> ''))) AS words FROM note_line GROUP BY 1), d AS (SELECT recording_id, words, max_end / 60 AS minutes, words / (max_end / 60) AS wpm FROM w JOIN (SELECT recording_id, max(end_s) AS max_end FROM seg_conv GROUP BY 1) USING (recording_id) WHERE max_end > 0)
SELECT recording_id, words, round(minutes, 6) AS minutes, round(wpm, 6) AS wpm, round((SELECT min(wpm) FROM d), 6) AS low, round((SELECT max(wpm) FROM d), 6) AS high FROM d""", "note_line"))
def note_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a note per minute, and the band of all notes."""
    minutes = _durations(spark, sf_dir).select("recording_id", (F.col("duration_s") / 60).alias("minutes"))
    return notes.density(views.note_line(spark, sf_dir), minutes).select("recording_id", "words", r6("minutes"), r6("wpm"), r6("low"), r6("high"))


def _rounded(found: DataFrame) -> DataFrame:
    return found.select(*[r6(c) if kind == "double" else c for c, kind in found.dtypes])


@query()
def note_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage record of each note over its whole recording."""
    return _rounded(notes.measure(views.note_line(spark, sf_dir), views.seg_conv(spark, sf_dir).where("end_s is not null")))


@query()
def note_span_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage records of each note over the halves of its recording."""
    segments = views.seg_conv(spark, sf_dir).where("end_s is not null")
    ends = segments.groupBy("recording_id").agg(F.min("start_s").alias("lo"), F.max("end_s").alias("hi"))
    middle = (F.col("lo") + F.col("hi")) / 2
    halves = F.array(F.struct(F.lit(0).alias("span_no"), F.col("lo").alias("lo_s"), middle.alias("hi_s")), F.struct(F.lit(1).alias("span_no"), middle.alias("lo_s"), F.col("hi").alias("hi_s")))
    return _rounded(notes.measure(views.note_line(spark, sf_dir), segments, ends.select("recording_id", F.explode(halves).alias("s")).select("recording_id", "s.*")))


def _ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns stand for OCR of a frame."""
    tokens = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z-]{2,}"), F.lit(0))))
    rows = views.seg_conv(spark, sf_dir).where("role = 'assistant' and text is not null").withColumn("tokens", tokens)
    return rows.select("recording_id", F.col("start_s").cast("int").alias("second"), F.size("tokens").alias("words"), "tokens")


@query(with_views("""SELECT recording_id, count(*) AS frames, count(*) FILTER (WHERE w >= 5) AS textful, count(*) FILTER (WHERE w >= 5) / count(*)::DOUBLE >= 0.25 AS usable FROM (SELECT recording_id, len(list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z-]{2,}'))) AS w FROM seg_conv WHERE role = 'assistant' AND text IS NOT NULL) GROUP BY 1""", "seg_conv"))
def pixel_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings whose frames show enough text to vote."""
    return votes.channel(_ocr(spark, sf_dir))


@query()
def pixel_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of items with one class, against what frames near their moments show."""
    return votes.pixel_vote(views.note_block(spark, sf_dir), _ocr(spark, sf_dir))


@query(with_views("SELECT recording_id, len(list_distinct(flatten(list(regexp_extract_all(text, ANCHOR, 0))))) AS anchors FROM note_line GROUP BY 1".replace("ANCHOR", _q(notes.ANCHOR)), "note_line"))
def anchor_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different anchors of each note."""
    lines = views.note_line(spark, sf_dir).select("recording_id", F.explode_outer(F.regexp_extract_all("text", F.lit(notes.ANCHOR), F.lit(0))).alias("a"))
    return lines.groupBy("recording_id").agg(F.count_distinct("a").alias("anchors"))


def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, line_no, text): each line of the notes behind the one before it, as published pages."""
    lines = views.note_line(spark, sf_dir)
    before = F.coalesce(F.lag("text").over(Window.partitionBy("recording_id").orderBy("line_no")), F.lit(""))
    return lines.select(F.col("recording_id").cast("string").alias("source_id"), "line_no", F.concat(before, F.lit(" "), "text").alias("text"))
