"""Notes about recordings: markdown blocks, fences, claim rows, anchors and the evidence class that each is bound to.

A note is a table of lines (recording_id, line_no, text). What a line depends on stands in the same note, so everything is
windows over a note's lines or over the marks of one block; only fence markers are folded, as their state needs it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.functions import text as tx
from tidemark.operators import interval, witness
from tidemark.operators.folds import folded
from tidemark.operators.running import KEY
from tidemark.operators.stages import stored

# How a note writes evidence classes, moments, rows and marks.
CLASSES = ["ON-SCREEN", "SPOKEN", "INFERRED"]
STAMP = r"\d{1,2}:\d{2}(?::\d{2})?"
LONG_STAMP = r"\d{1,3}(?::\d{2}){1,2}"
ANCHOR = rf"`\[{STAMP}\]`"
CLASS_MARK = "`(?:" + "|".join(CLASSES) + ")`"
MACHINE_MARKS = ["`ORPHAN`", "<!-- auto-demoted -->"]
GLUE = r"^[\s`+,;/&|*~-]*$"
FENCE, HEADING, ITEM, TABLE, QUOTE = r"^\s*(?:```|~~~)", r"^#{1,6}\s+", r"^\s*(?:[-*+]|\d+[.)])\s", r"^\s*\|", r"^\s*>"
STRICT_FENCE = r"^[ \t]*(`{3,}|~{3,})"
NOTE_REFERENCE = r"notes/(\S+\.md)"
ROW = rf"^\s*[-*]\s+`\[({LONG_STAMP})\]`\s+`([A-Z-]+)`(?:\s*to\s+`\[({LONG_STAMP})\]`\s+`[A-Z-]+`)?\s*(?:\([^)]*\)\s*)?[—–-]+\s*(.*)$"
ROWISH = rf"^\s*[-*]\s+`?\[[-+]?{LONG_STAMP}\]`?\s+`?[A-Z-]{{4,}}`?"
LOOSE_ANCHOR = rf"`?\[({LONG_STAMP})\]`?"
DISPOSITIONS = ["resolved", "unresolved", "unchecked", "witnessed-spoken", "unchecked-spoken", "unbound-inferred", "unattributable", "verbatim", "foreign", "cross-referenced"]
VACUOUS, LINE_WORDS, REACH_LINES = 0.95, 4, 2


def lines_of(notes: DataFrame) -> DataFrame:
    """(recording_id, line_no, text) of (recording_id, body)."""
    return notes.select(KEY, F.posexplode(F.split("body", "\n")).alias("line_no", "text"))


def is_block_start(text: Column | str) -> Column:
    """Whether a line begins a block of its own: heading, fence, rule, table row, quote or list item."""
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(HEADING) | text.rlike(FENCE) | text.rlike(r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$") | text.rlike(TABLE) | text.rlike(QUOTE) | text.rlike(ITEM)


def blocks(lines: DataFrame) -> DataFrame:
    """(recording_id, line_no, text, block, section, verbatim) of every line with content.

    A list item, table row, quote line, heading or paragraph is a block with the lines that continue it; fences toggle, and
    what they hold is one block of quoted text. A second-level heading names the section from itself on.
    """
    order = Window.partitionBy(KEY).orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("text").rlike(FENCE)
    rows = lines.withColumn("fence", fence).withColumn("verbatim", F.sum(F.col("fence").cast("long")).over(so_far) % 2 == 1)
    own, blank = ~F.col("verbatim") & ~F.col("fence"), F.trim(F.regexp_replace("text", r"[\t\r\f]", " ")) == ""
    rows = rows.withColumn("blank", blank).withColumn("head", own & F.col("text").rlike(HEADING))
    starts = F.col("text").rlike(ITEM) | F.col("text").rlike(TABLE) | F.col("text").rlike(QUOTE)
    breaks = F.col("fence") | F.col("head") | (own & (F.col("blank") | starts)) | F.coalesce(F.lag("head").over(order), F.lit(False))
    title = F.when(F.col("head") & F.col("text").rlike(r"^##\s+"), F.trim(F.regexp_extract("text", r"^##\s+(.*?)\s*$", 1)))
    rows = rows.withColumn("part", F.sum(breaks.cast("long")).over(so_far)).withColumn("section", F.coalesce(F.last(title, True).over(so_far), F.lit("")))
    kept = rows.where("not fence and not blank")
    return kept.select(KEY, "line_no", "text", F.dense_rank().over(Window.partitionBy(KEY).orderBy("part")).cast("long").alias("block"), "section", "verbatim")


def fence_balance(lines: DataFrame) -> DataFrame:
    """(recording_id, fences, balanced) by the toggle rule."""
    counts = lines.groupBy(KEY).agg(F.count_if(F.col("text").rlike(FENCE)).alias("fences"))
    return counts.withColumn("balanced", F.col("fences") % 2 == 0)


#: Lines that a stretch of a note has.
LINES = 20_000.0


def fences(lines: DataFrame) -> DataFrame:
    """(recording_id, open_at, close_at) of code fences; close_at is null for one that nothing closes.

    A closer has the opener's character, is at least as long and stands alone. Only marker lines are folded.
    """
    mark = F.regexp_extract("text", STRICT_FENCE, 1)
    bare = F.trim(F.regexp_replace(F.col("text"), STRICT_FENCE, "")) == ""
    marks = lines.where(mark != "").select(KEY, F.col("line_no").cast("long").alias("line_no"), F.substring(mark, 1, 1).alias("sign"), F.length(mark).alias("width"), bare.alias("bare"))

    def advance(opener: list | None, rows: Iterable[tuple]) -> tuple[list[tuple], list | None]:
        done = []
        for at, sign, width, alone in rows:
            if opener is None:
                opener = [at, sign, width]
            elif sign == opener[1] and width >= opener[2] and alone:
                done.append((opener[0], at))
                opener = None
        return done, opener

    finish = lambda opener: [] if opener is None else [(opener[0], None)]
    return folded(marks, ["line_no", "sign", "width", "bare"], ["line_no"], "open_at long, close_at long", advance, finish, stretch=LINES)


def quoted(lines: DataFrame) -> DataFrame:
    """Lines with quoted: inside a fence that is closed. Markers and what follows an unclosed one aren't quoted."""
    closed = fences(lines).where("close_at is not null")
    inside = closed.select(KEY, F.explode(F.sequence(F.col("open_at") + 1, F.col("close_at"))).alias("line_no")).join(closed.select(KEY, F.col("close_at").alias("line_no")), [KEY, "line_no"], "left_anti")
    return lines.join(inside.withColumn("_in", F.lit(True)), [KEY, "line_no"], "left").withColumn("quoted", F.coalesce("_in", F.lit(False))).drop("_in")


def claim_rows(lines: DataFrame) -> DataFrame:
    """Lines with kind (row, impossible, misshapen, unread or prose) and, for rows, at_s, class, claim and until_s."""
    part = lambda k: F.regexp_extract("text", ROW, k)
    at, until = clock.parse_clock(part(1)), F.when(part(3) == "", clock.parse_clock(part(1))).otherwise(clock.parse_clock(part(3)))
    rows = lines.withColumn("is_row", F.col("text").rlike(ROW)).withColumn("at_s", at).withColumn("until_s", until).withColumn("claim", F.trim(part(4)))
    kind = F.when(~F.col("is_row"), F.when(F.col("text").rlike(ROWISH), "unread").otherwise("prose"))
    kind = kind.when(F.col("at_s").isNull() | F.col("until_s").isNull(), "impossible").when((F.col("until_s") < F.col("at_s")) | (F.col("claim") == ""), "misshapen").otherwise("row")
    rows = rows.withColumn("kind", kind)
    only = lambda c: F.when(F.col("kind") == "row", c)
    return rows.select(*lines.columns, "kind", only(F.col("at_s")).alias("at_s"), only(part(2)).alias("class"), only(F.col("claim")).alias("claim"), only(F.col("until_s")).alias("until_s"))


def line_anchors(lines: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """(recording_id, line_no, at_s, counts, refused) of every sayable stamp on a line that isn't quoted.

    A stamp counts if its line carries LINE_WORDS words besides stamps and isn't a row that was read and refused.
    """
    return _anchors_of(claim_rows(quoted(lines)).where("not quoted"))


def _anchors_of(rows: DataFrame) -> DataFrame:
    """line_anchors() of claim_rows() that aren't quoted."""
    said = F.size(tx.tokens(F.regexp_replace("text", LOOSE_ANCHOR, " ")))
    found = rows.select(KEY, "line_no", (said >= LINE_WORDS).alias("written"), F.col("kind").isin("impossible", "misshapen").alias("refused"), F.explode(F.regexp_extract_all("text", F.lit(LOOSE_ANCHOR), F.lit(1))).alias("stamp"))
    found = found.withColumn("at_s", clock.parse_clock(F.col("stamp"))).where("at_s is not null")
    return found.select(KEY, "line_no", "at_s", (F.col("written") & ~F.col("refused")).alias("counts"), (F.col("written") & F.col("refused")).alias("refused"))


def without_marks(text: Column) -> Column:
    """The text without the renderer's own marks, unless an anchor would come or go with them."""
    marks = "|".join(m.replace("-", r"\-") for m in MACHINE_MARKS)
    clean = F.regexp_replace(text, f"({ANCHOR})|{marks}", "$1")
    stamps = lambda t: F.regexp_extract_all(t, F.lit(ANCHOR), F.lit(0))
    return F.when(stamps(clean) == stamps(text), clean).otherwise(text)


def is_glue(gap: Column) -> Column:
    """Nothing but joining signs; a line break alone joins nothing."""
    return gap.rlike(GLUE) & ~(gap.contains("\n") & (F.trim(F.regexp_replace(gap, r"\s", " ")) == ""))


def items(lined: DataFrame) -> DataFrame:
    """(recording_id, block, section, verbatim, numbers, raw) of blocks(): a block's lines as one text."""
    held = lined.groupBy(KEY, "block").agg(F.first("section").alias("section"), F.first("verbatim").alias("verbatim"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return held.select(KEY, "block", "section", "verbatim", F.col("l.line_no").alias("numbers"), F.array_join("l.text", "\n").alias("raw"))


def item_marks(lined: DataFrame) -> DataFrame:
    """(recording_id, block, k, mark, gap, line_no, is_anchor, ...) of every anchor and class mark of blocks(), in order.

    gap is what stands between the mark and the one before it.
    """
    # One pattern with the gap in it would try the rest of a text from each of its signs, once no mark follows.
    pattern = rf"{ANCHOR}|{CLASS_MARK}"
    texts = items(lined).withColumn("joined", without_marks(F.col("raw"))).withColumn("marks", F.regexp_extract_all("joined", F.lit(pattern), F.lit(0)))
    pairs = F.arrays_zip(F.slice(F.split("joined", pattern), 1, F.size("marks")).alias("gap"), F.col("marks").alias("mark"))
    found = texts.select(KEY, "block", "section", "verbatim", "numbers", F.posexplode(pairs).alias("k", "p")).select(KEY, "block", "section", "verbatim", "numbers", "k", "p.gap", "p.mark")
    breaks = F.length("gap") - F.length(F.translate("gap", "\n", ""))
    row = F.sum(breaks).over(Window.partitionBy(KEY, "block").orderBy("k")).cast("int")
    return found.withColumn("line_no", F.element_at("numbers", row + 1)).withColumn("is_anchor", F.col("mark").startswith("`[")).drop("numbers")


def foreign_lines(lined: DataFrame) -> DataFrame:
    """(recording_id, line_no) of lines that another recording's note is named on, or on one of the two before in the block."""
    stem = lambda r: F.element_at(F.split(F.regexp_replace(F.element_at(F.split(r, "/"), -1), r"\.md$", ""), "--"), -1)
    others = F.filter(F.transform(F.regexp_extract_all("text", F.lit(NOTE_REFERENCE), F.lit(1)), stem), lambda r: r != F.col(KEY).cast("string"))
    near = Window.partitionBy(KEY, "block").orderBy("line_no").rowsBetween(-REACH_LINES, 0)
    return lined.withColumn("foreign", F.max((F.size(others) > 0).cast("int")).over(near) == 1).where("foreign").select(KEY, "line_no").distinct()


def anchors(lined: DataFrame) -> DataFrame:
    """(recording_id, block, k, line_no, anchor, at_s, class, section, foreign, blanket) of every anchor of blocks().

    An item with one class gives it to all its anchors. With several, anchors that only glue separates are a group; each
    class mark goes to the nearer group that it touches through glue (an anchor before it wins a tie), a group that one class
    reached has it, one that several reached is CONTESTED, others are MULTI. blanket: the item's one class doesn't touch it.
    """
    order = Window.partitionBy(KEY, "block").orderBy("k")
    marks = item_marks(lined).withColumn("glued", is_glue(F.col("gap")))
    joins = F.col("is_anchor") & F.coalesce(F.lag("is_anchor").over(order), F.lit(False)) & F.col("glued")
    marks = marks.withColumn("group", F.sum((F.col("is_anchor") & ~joins).cast("long")).over(order))
    after = F.lead(F.struct("is_anchor", "glued", "gap", "group")).over(order)
    marks = marks.withColumn("before_ok", F.coalesce(F.lag("is_anchor").over(order), F.lit(False)) & F.col("glued")).withColumn("next", after)
    after_ok = F.coalesce(F.col("next.is_anchor") & F.col("next.glued"), F.lit(False))
    nearer = F.col("before_ok") & (~after_ok | (F.length("gap") <= F.length("next.gap")))
    marks = marks.withColumn("reaches", F.when(~F.col("is_anchor"), F.when(nearer, F.col("group")).when(after_ok, F.col("next.group"))))
    marks = marks.withColumn("class", F.when(~F.col("is_anchor"), F.translate("mark", "`", "")))
    reached = marks.where("reaches is not null").groupBy(KEY, "block", F.col("reaches").alias("group")).agg(F.sort_array(F.collect_set("class")).alias("touching"))
    named = marks.where("not is_anchor").groupBy(KEY, "block").agg(F.sort_array(F.collect_set("class")).alias("present"))
    found = marks.where("is_anchor").drop("class").join(reached, [KEY, "block", "group"], "left").join(named, [KEY, "block"], "left")
    found = found.join(foreign_lines(lined).withColumn("foreign", F.lit(True)), [KEY, "line_no"], "left").withColumn("foreign", F.coalesce("foreign", F.lit(False)))
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    present, touching = F.when(F.col("present").isNull(), 0).otherwise(count("present")), F.when(F.col("touching").isNull(), 0).otherwise(count("touching"))
    bound = F.when(present == 0, "NONE").when(present == 1, F.get("present", F.lit(0))).when(touching == 0, "MULTI").when(touching == 1, F.get("touching", F.lit(0))).otherwise("CONTESTED")
    stamp = F.regexp_extract("mark", rf"\[({STAMP})\]", 1)
    blanket = (present == 1) & (touching == 0) & ~F.col("verbatim") & ~F.col("foreign")
    return found.select(KEY, "block", F.col("k").cast("long").alias("k"), "line_no", stamp.alias("anchor"), clock.parse_time(stamp).alias("at_s"), F.when(F.col("verbatim"), "VERBATIM").otherwise(bound).alias("class"), "section", "foreign", blanket.alias("blanket"))


def namespaces(frames: DataFrame, cues: DataFrame, durations: DataFrame) -> DataFrame:
    """(recording_id, frames, cue_coverage, frame_coverage, cues_vacuous): what anchors of a recording can be checked against.

    Cue spans that cover nearly all of a recording can't fail a containment test, so they are vacuous.
    """
    spans = interval.coalesce_spans(cues.select(KEY, F.monotonically_increasing_id().alias("ord"), "start_s", "end_s").where("end_s >= start_s"), 1.0)
    covered = spans.groupBy(KEY).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("cue_s"))
    seconds = frames.groupBy(KEY).agg(F.count_distinct(F.floor("frame_s")).alias("frames"))
    share = lambda c: F.when(F.col("duration_s") > 0, F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0)) / F.col("duration_s"))).otherwise(0.0)
    rows = durations.join(covered, KEY, "left").join(seconds, KEY, "left")
    return rows.select(KEY, F.coalesce("frames", F.lit(0)).alias("frames"), share("cue_s").alias("cue_coverage"), share("frames").alias("frame_coverage"), F.col("cue_s").isNotNull().alias("has_cues")).withColumn("cues_vacuous", F.col("cue_coverage") >= VACUOUS)


def dispositions(found: DataFrame, lined: DataFrame, frames: DataFrame, cues: DataFrame, durations: DataFrame, segments: DataFrame, width: float = 60.0) -> DataFrame:
    """anchors() with one of ten dispositions each, by the first rule that fits."""
    spaces = namespaces(frames, cues, durations)
    # Labels of a second are gathered in a window, and spans are disjoint, so neither needs the anchors a second time.
    label = F.when(~F.col("foreign") & F.col("class").isin(CLASSES), F.col("class"))
    at = found.withColumn("anchor_id", F.concat_ws("-", KEY, "block", "k")).withColumn("classes", F.size(F.collect_set(label).over(Window.partitionBy(KEY, "at_s"))))
    framed = frames.select(KEY, F.floor("frame_s").cast("double").alias("at_s")).distinct().withColumn("on_frame", F.lit(True))
    spans = interval.coalesce_spans(cues.select(KEY, F.monotonically_increasing_id().alias("ord"), "start_s", "end_s").where("end_s >= start_s"), 1.0)
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    spans = spans.select(KEY, F.col("start_s").alias("c_start"), F.col("end_s").alias("c_end"), F.explode(F.sequence(bucket("start_s"), bucket("end_s"))).alias("bucket"))
    at = at.withColumn("bucket", bucket("at_s"))
    inside = (at[KEY] == spans[KEY]) & (at["bucket"] == spans["bucket"]) & (at["at_s"] >= spans["c_start"]) & (at["at_s"] <= spans["c_end"])
    at = at.join(spans, inside, "left").select(at["*"], F.col("c_start").isNotNull().alias("in_cue"))
    words = items(lined).select(KEY, "block", tx.item_words("raw").alias("words"))
    spoken = at.where(~F.col("foreign") & (F.col("class") == "SPOKEN")).join(words, [KEY, "block"]).where(F.size("words") >= witness.ITEM_WORDS)
    hits = witness.spoken_hits(spoken.select(KEY, F.col("anchor_id").alias("item_id"), "at_s", "words"), segments, words=tx.item_words)
    seen = hits.where(witness.passes(F.col("hits"), F.col("words"))).select(KEY, F.col("item_id").alias("anchor_id")).distinct().withColumn("heard", F.lit(True))
    rows = at.join(framed, [KEY, "at_s"], "left").join(seen, [KEY, "anchor_id"], "left").join(spaces, KEY, "left")
    cue_ok = F.coalesce(F.col("has_cues") & ~F.col("cues_vacuous"), F.lit(False))
    contained = F.when(F.col("in_cue"), "resolved").otherwise("unresolved")
    rule = F.when(F.col("foreign"), "foreign").when(F.col("class") == "VERBATIM", "verbatim")
    rule = rule.when(F.col("class").isin("NONE", "MULTI", "CONTESTED"), F.when(F.col("classes") == 1, "cross-referenced").otherwise("unattributable"))
    rule = rule.when(F.col("class") == "ON-SCREEN", F.when(F.coalesce("frames", F.lit(0)) == 0, "unchecked").when(F.col("on_frame"), "resolved").otherwise("unresolved"))
    rule = rule.when(F.col("class") == "SPOKEN", F.when(cue_ok, contained).when(F.col("heard"), "witnessed-spoken").otherwise("unchecked-spoken"))
    rule = rule.otherwise(F.when(cue_ok, contained).otherwise("unbound-inferred"))
    return rows.select(KEY, "block", "k", "line_no", "anchor", "class", rule.alias("disposition"))


def census(disposed: DataFrame) -> DataFrame:
    """One row per note: its anchors, one count per disposition, and whether these add up."""
    counts = [F.count_if(F.col("disposition") == d).alias(d.replace("-", "_")) for d in DISPOSITIONS]
    rows = disposed.groupBy(KEY).agg(F.count("*").alias("anchors"), *counts)
    return rows.withColumn("adds_up", F.col("anchors") == sum((F.col(d.replace("-", "_")) for d in DISPOSITIONS), F.lit(0)))


def corpus_census(per_note: DataFrame, spaces: DataFrame) -> DataFrame:
    """One row for the corpus: notes, anchors, resolved, unattributable, and how many recordings' cues are vacuous."""
    totals = per_note.agg(F.count("*").alias("notes"), F.coalesce(F.sum("anchors"), F.lit(0)).alias("anchors"), F.coalesce(F.sum("resolved"), F.lit(0)).alias("resolved"), F.coalesce(F.sum("unattributable"), F.lit(0)).alias("unattributable"))
    vacuous = spaces.agg(F.count_if("cues_vacuous").alias("n")).scalar()
    return totals.withColumn("vacuous", vacuous)


SPAN = [KEY, "span_no"]


def measure(lines: DataFrame, segments: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """The coverage record of each note (lines) over each span of its recording (segments), all spans in one pass.

    spans: recording_id, span_no, lo_s, hi_s; without them each recording is one span, 0, and the whole note is read. With
    them only lines that are stamped inside a span are what the note wrote about it. How rare a term is counts over the
    whole recording either way.

    rows, row_words and note_words in the span, rows_in_note, impossible and misshapen rows of the note; of each kind of
    salient token (figures, names, terms) how many are said (of_), carried by the text (carried_) and by rows (by_rows_),
    their sums wanted, carried and carried_by_rows, and recall; anchors, anchored_seconds and refused_seconds; dead minutes of
    minutes, the longest run dead_run and where it begins; near_rows and near_share; words_per_token and carried_per_row;
    verbatim, the share of words inside runs that the recording has, too; list_density.
    """
    from tidemark.operators import coverage
    from tidemark.operators.alignment import streams
    from tidemark.operators.sequence import dead_runs

    windowed = spans is not None
    asked = spans.select(*SPAN, "lo_s", "hi_s") if windowed else segments.groupBy(KEY).agg(F.min("start_s").alias("lo_s"), F.max("end_s").alias("hi_s")).select(KEY, F.lit(0).alias("span_no"), "lo_s", "hi_s")
    near = lambda df, low, high: interval.band_join(df, asked, low, high, F.col("lo_s"), F.col("hi_s"), 3600.0)
    # Lines and what they claim are read by several measures, and so are segments.
    claims = stored(claim_rows(quoted(lines)).where("not quoted"))
    segments = stored(segments)
    in_span = near(claims.where("kind = 'row'").select(KEY, "line_no", "at_s", "until_s", "claim"), F.col("at_s"), F.col("until_s"))
    row_sums = in_span.groupBy(*SPAN).agg(F.count("*").alias("rows"), F.sum(tx.word_count(F.col("claim"))).alias("row_words"))
    kinds = claims.groupBy(KEY).agg(F.count_if(F.col("kind") == "row").alias("rows_in_note"), F.count_if(F.col("kind") == "impossible").alias("impossible"), F.count_if(F.col("kind").isin("misshapen", "unread")).alias("misshapen"))

    # What the note wrote about a span.
    body = claims.select(KEY, "line_no", "text")
    if windowed:
        stamps = F.filter(F.transform(F.regexp_extract_all("text", F.lit(LOOSE_ANCHOR), F.lit(1)), clock.parse_clock), lambda s: s.isNotNull())
        stamped_lines = body.select(KEY, "line_no", "text", F.explode(stamps).alias("at_s"))
        scope = near(stamped_lines, F.col("at_s"), F.col("at_s")).select(*SPAN, "line_no", "text").distinct()
    else:
        scope = body.join(asked.select(*SPAN), KEY)
    note_words = scope.groupBy(*SPAN).agg(F.sum(tx.word_count(F.col("text"))).alias("note_words"))

    # Postings of the recording's tokens: where they are said, and whether as names.
    own = segments.select(KEY, "start_s", "end_s", F.array_distinct(tx.tokens("text")).alias("tokens"), tx.name_candidates("text").alias("names"))
    postings = own.select(KEY, "start_s", "end_s", F.explode("tokens").alias("token"), "names").withColumn("named", F.array_contains("names", F.col("token"))).drop("names")
    cutoff = segments.groupBy(KEY).agg(F.greatest(F.lit(1), F.least(F.lit(coverage.RARE), F.floor(F.count("*") / 20).cast("int"))).alias("cutoff"))
    often = postings.groupBy(KEY, "token").agg(F.count("*").alias("df"))
    said = near(postings, F.col("start_s"), F.col("end_s")).groupBy(*SPAN, "token").agg(F.bool_or("named").alias("named"))
    rare = (F.length("token") >= coverage.TERM_LETTERS) & (F.col("df") <= F.col("cutoff"))
    kind = F.when(F.col("token").rlike("[0-9]"), "figures").when(F.col("named"), "names").when(rare, "terms")
    wanted = said.join(often, [KEY, "token"]).join(cutoff, KEY).select(*SPAN, "token", kind.alias("kind")).where("kind is not null").withColumn("stem", tx.stem(F.col("token")))

    def held(texts: DataFrame, name: str) -> DataFrame:
        words = texts.select(*SPAN, F.explode(F.array_distinct(tx.carried(tx.tokens("text")))).alias("word")).distinct()
        both = wanted.select(*SPAN, "token", F.explode(F.array_distinct(F.array("token", "stem"))).alias("word")).join(words, [*SPAN, "word"])
        return both.select(*SPAN, "token").distinct().withColumn(name, F.lit(1))

    met = wanted.join(held(scope, "by_text"), [*SPAN, "token"], "left").join(held(in_span.select(*SPAN, F.col("claim").alias("text")), "by_row"), [*SPAN, "token"], "left")
    counts = [F.count("*").alias("wanted"), F.count("by_text").alias("carried"), F.count("by_row").alias("carried_by_rows")]
    for k in ("figures", "names", "terms"):
        of = F.col("kind") == k
        counts += [F.count_if(of).alias(f"of_{k}"), F.count(F.when(of, F.col("by_text"))).alias(f"carried_{k}"), F.count(F.when(of, F.col("by_row"))).alias(f"by_rows_{k}")]
    carried = met.groupBy(*SPAN).agg(*counts)

    at = near(_anchors_of(claims), F.col("at_s"), F.col("at_s"))
    second = F.floor("at_s")
    stamped = at.groupBy(*SPAN).agg(F.count_if("counts").alias("anchors"), F.count_distinct(F.when(F.col("counts"), second)).alias("anchored_seconds"), F.count_distinct(F.when(F.col("refused"), second)).alias("refused_seconds"))
    # Spans are recordings of their own to what reads one recording.
    alone = lambda df: df.withColumn(KEY, F.to_json(F.struct(*SPAN)))
    dead = dead_runs(alone(at.where("counts").select(*SPAN, "at_s")), alone(asked.select(*SPAN, "lo_s", "hi_s"))).select(F.col(KEY).alias("_span"), "dead", F.col("total").alias("minutes"), F.col("longest").alias("dead_run"), F.col("longest_start").alias("dead_run_at"))
    repeats = coverage.near_rows(alone(in_span.select(*SPAN, F.col("line_no").cast("long").alias("ord"), F.nullif(tx.normalise("claim"), F.lit("")).alias("text")))).groupBy(F.col(KEY).alias("_span")).agg(F.count("*").alias("near_rows"))
    wrote = scope.groupBy(*SPAN).agg(F.array_sort(F.collect_list(F.struct("line_no", tx.tokens(F.regexp_replace("text", LOOSE_ANCHOR, " ")).alias("t")))).alias("l"))
    wrote = wrote.select(*SPAN, F.flatten(F.col("l.t")).alias("words"))
    verbatim = coverage.verbatim_within(wrote, streams(segments).select(KEY, F.col("words").alias("said")), SPAN).select(*SPAN, F.col("share").alias("verbatim"))

    out = asked.withColumn("_span", F.to_json(F.struct(*SPAN)))
    for part, keys in ((row_sums, SPAN), (kinds, [KEY]), (note_words, SPAN), (carried, SPAN), (stamped, SPAN), (dead, ["_span"]), (repeats, ["_span"]), (verbatim, SPAN)):
        out = out.join(part, keys, "left")
    out = out.drop("_span").na.fill(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    shares = {"recall": ("carried", "wanted"), "carried_per_row": ("carried_by_rows", "rows"), "near_share": ("near_rows", "rows"), "words_per_token": ("row_words", "carried_by_rows"), "list_density": ("carried", "note_words")}
    return out.select("*", *(ratio(*pair).alias(name) for name, pair in shares.items()))


def span_text(lines: DataFrame, low: float, high: float) -> DataFrame:
    """Lines that are stamped inside a span; a line without such a stamp belongs to no stretch."""
    stamps = F.transform(F.regexp_extract_all("text", F.lit(LOOSE_ANCHOR), F.lit(1)), clock.parse_clock)
    return lines.where(F.exists(stamps, lambda s: F.coalesce((s >= low) & (s <= high), F.lit(False))))


def anchor_reach(found: DataFrame, frames: DataFrame, segments: DataFrame) -> DataFrame:
    """(recording_id, seconds, framed, spoken, few_framed): anchored seconds that are a frame's, or a segment's start."""
    at = found.where("not foreign").select(KEY, "at_s").distinct()
    on = lambda df, c: at.join(df.select(KEY, F.floor(c).cast("double").alias("at_s")).distinct(), [KEY, "at_s"], "left_semi").groupBy(KEY).count()
    framed, spoken = on(frames, "frame_s").withColumnRenamed("count", "framed"), on(segments, "start_s").withColumnRenamed("count", "spoken")
    rows = at.groupBy(KEY).agg(F.count("*").alias("seconds")).join(framed, KEY, "left").join(spoken, KEY, "left").na.fill(0)
    return rows.withColumn("few_framed", F.col("framed") * 2 < F.col("seconds"))


def density(lines: DataFrame, minutes: DataFrame) -> DataFrame:
    """(recording_id, words, minutes, wpm, low, high): words of a note per minute of its recording, and the corpus's band."""
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    rows = lines.groupBy(KEY).agg(F.sum(words).alias("words")).join(minutes, KEY).where("minutes > 0")
    rows = rows.withColumn("wpm", F.col("words") / F.col("minutes"))
    band = rows.agg(F.struct(F.min("wpm").alias("low"), F.max("wpm").alias("high"))).scalar()
    return rows.withColumn("band", band).select(KEY, "words", "minutes", "wpm", "band.low", "band.high")
