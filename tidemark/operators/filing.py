"""What notes declare and how they are kept: citations, sets, lanes, reports, densities, demotions, and the gates over them.

Notes are (note, frontmatter, body) rows, or their lines; files are listings (path, sha256, text). Findings are rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.functions import text as tx
from tidemark.functions.words import COUNTS
from tidemark.operators import notes, paths
from tidemark.operators.running import previous, running, total
from tidemark.operators.stages import stored

# Tokens of the notation, section names and marks.
CITE = r'\{\{CITE:([^#]*?)#"((?:(?!\{\{)[\s\S])*?)"\}\}'
CITE_START, SET_START = r"(?i)\{\{\s*CITE", r"(?i)\{\{\s*SET"
SET_TOKEN = r"\{\{SET:[^}]*\}\}|\{\{/SET\}\}"
COUNT_WORD = r"(?i)\b(?:\d+|" + "|".join(COUNTS) + r"|all|every)\b"
LANE, VIDEO_ID = r"^[a-z0-9][a-z0-9-]*$", r"^[A-Za-z0-9_-]{1,64}$"
CLAIMS, OBJECTIONS, SPECULATION, META = "Claims", "Strongest objection", "Speculation", ["", "Run notes", "Action"]
FALSIFIER = r"(?i)(\*?Falsifier:\*?|refuted by:)"
ORPHAN_MARK, DEMOTED_MARK = notes.MACHINE_MARKS
VERDICTS = ["SHIP", "SHIP-WITH-FIXES", "BLOCK", "unstated"]
STATUSES = ["capture", "distilled", "applied", "discarded"]


def plain_text(text: Column) -> Column:
    """Text as quotes are compared: without stars and backticks, space collapsed."""
    return F.trim(F.regexp_replace(F.translate(text, "*`", ""), r"\s+", " "))


def plain_lines(files: DataFrame) -> DataFrame:
    """(path, block, line_no, plain): lines as quotes are compared, and the block that no quote may leave."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("blank", F.trim("line") == "")
    lines = running(lines, ["line_no"], {"after": previous(F.col("blank"))}, keys=("path",), stretch=notes.LINES)
    starts = notes.is_block_start("line") | F.col("blank") | F.coalesce("after", F.lit(True))
    lines = lines.select("path", "line_no", starts.cast("long").alias("starts"), plain_text(F.col("line")).alias("plain"))
    return running(lines, ["line_no"], {"block": total(F.col("starts"))}, keys=("path",), stretch=notes.LINES).select("path", "block", "line_no", "plain")


#: Signs of the pieces by which quotes find blocks; a quote uses the longest that it has.
PIECES = [8, 2, 1]


def _pieces(text: Column, size: int) -> Column:
    """The different runs of size signs of a text."""
    signs = F.split(text, "")
    ends = F.when(F.size(signs) >= size, F.sequence(F.lit(1), F.size(signs) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(ends, lambda k: F.array_join(F.slice(signs, k, size), "")))


#: Different quotes of a file up to which each reads the whole file.
FEW_QUOTES = 200


def holding_blocks(quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, quote, block, place) of the blocks (path, block, whole) of its file that hold a quote (path, quote).

    Each different quote of a file is looked for once, however many notes cite it: in all blocks, where a file has few quotes,
    else in those that hold its rarest piece. No file that few quotes name is ever cut into pieces.
    """
    asked = quotes.select("path", "quote").where("quote <> ''").distinct()
    many = stored(asked.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > FEW_QUOTES).select("path"))
    within = lambda met: met.withColumn("place", F.instr(F.col("whole"), F.col("quote"))).where("place > 0").select("path", "quote", "block", "place")
    if not many.limit(1).count():
        return within(asked.join(blocks, "path"))
    few = within(asked.join(many, "path", "left_anti").join(blocks, "path"))
    return few.unionByName(_holding_pieces(asked.join(many, "path", "left_semi"), blocks))


def _holding_pieces(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """holding_blocks() by an index of the pieces that quotes ask for, which says in which blocks each is."""
    out = None
    for longer, size in zip([None, *PIECES], PIECES, strict=False):
        fits = F.length("quote") >= size
        own = asked.where(fits if longer is None else fits & (F.length("quote") < longer))
        wanted = own.select("path", "quote", F.explode(_pieces(F.col("quote"), size)).alias("piece"))
        # Blocks of files that no quote names have no pieces.
        cited = blocks.join(own.select("path").distinct(), "path", "left_semi")
        index = cited.select("path", "block", F.explode(_pieces(F.col("whole"), size)).alias("piece")).join(wanted.select("path", "piece").distinct(), ["path", "piece"], "left_semi")
        often = index.groupBy("path", "piece").agg(F.count("*").alias("blocks"))
        rarest = wanted.join(often, ["path", "piece"], "left").groupBy("path", "quote").agg(F.min(F.struct(F.coalesce("blocks", F.lit(0)).alias("blocks"), "piece")).alias("r"))
        near = rarest.where("r.blocks > 0").select("path", "quote", F.col("r.piece").alias("piece")).join(index, ["path", "piece"]).select("path", "quote", "block")
        met = near.join(blocks, ["path", "block"]).withColumn("place", F.instr(F.col("whole"), F.col("quote"))).where("place > 0").select("path", "quote", "block", "place")
        out = met if out is None else out.unionByName(met)
    return out


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


def _lines_before(text: Column, pattern: str) -> Column:
    """For each match of a pattern, in order, how many line ends stand before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.zip_with(F.slice(F.split(text, pattern), 1, F.size(found)), found, lambda gap, token: F.struct(_newlines(gap).alias("gap"), _newlines(token).alias("token")))
    add = lambda upto: F.aggregate(upto, F.struct(F.lit(0).alias("all"), F.lit(0).alias("before")), lambda s, x: F.struct((s["all"] + x["gap"] + x["token"]).alias("all"), (s["all"] + x["gap"]).alias("before")), lambda s: s["before"])
    return F.transform(own, lambda _, k: add(F.slice(own, 1, k + 1)))


def citations(bodies: DataFrame) -> DataFrame:
    """(note, k, path, quote, line_no) of every citation token of (note, body), in order; k and line_no count from 0."""
    part = lambda k: F.regexp_extract_all("body", F.lit(CITE), F.lit(k))
    pairs = F.arrays_zip(part(1).alias("path"), part(2).alias("quote"), _lines_before(F.col("body"), CITE).alias("line"))
    rows = bodies.select("note", F.posexplode(pairs).alias("k", "c"))
    return rows.select("note", F.col("k").cast("long").alias("k"), tx.one_line("c.path").alias("path"), plain_text(F.col("c.quote")).alias("quote"), F.col("c.line").cast("long").alias("line_no"))


def token_defects(bodies: DataFrame) -> DataFrame:
    """(note, line_no, code) of what opens a citation or a set and forms none, wherever it stands, and of sets that are unsound."""
    tokens, gaps = F.regexp_extract_all("body", F.lit(CITE), F.lit(0)), F.split("body", CITE)
    # Text between citations, and what follows the opening of each: another opening there is malformed.
    places = _lines_before(F.col("body"), CITE)
    open_ = lambda text, base: F.transform(_lines_before(text, CITE_START), lambda n: n + base)
    first = F.get(F.regexp_extract_all("body", F.lit(CITE_START), F.lit(0)), F.lit(0))
    inner = F.transform(tokens, lambda t, k: open_(F.substr(t, F.lit(3), F.length(t)), F.get(places, k)))
    outer = F.transform(gaps, lambda g, k: open_(g, F.when(k == 0, 0).otherwise(F.get(places, k - 1) + _newlines(F.get(tokens, k - 1)))))
    cites = bodies.where(first.isNotNull()).select("note", F.explode(F.flatten(F.concat(inner, outer))).alias("line_no"), F.lit("E-CITE-MALFORMED").alias("code"))
    begun, recorded = _lines_before(F.col("body"), SET_START), F.filter(_set_blocks(F.col("body")), lambda s: s["recorded"])
    # Openings that form a set are found in the same order, so the rest are those that the recorded ones don't account for.
    loose = bodies.select("note", F.posexplode(F.zip_with(begun, _set_starts(F.col("body")), lambda line, k: F.struct(line.alias("line"), k.alias("formed")))).alias("k", "s"), F.transform(recorded, lambda s: s["number"]).alias("sound"))
    malformed_ = loose.where(F.col("s.formed").isNull() | ~F.array_contains("sound", F.col("s.formed"))).select("note", F.col("s.line").alias("line_no"), F.lit("E-SET-MALFORMED").alias("code"))
    unsound = sets(bodies).where("code is not null").select("note", "line_no", "code")
    return cites.select("note", F.col("line_no").cast("long").alias("line_no"), "code").unionByName(malformed_.select("note", F.col("line_no").cast("long").alias("line_no"), "code")).unionByName(unsound)


def malformed(bodies: DataFrame) -> DataFrame:
    """(note, kind, opened, formed) of notes that open more citation or set tokens than they form."""
    count = lambda p: F.size(F.regexp_extract_all("body", F.lit(p), F.lit(0)))
    kind = lambda name, opened, formed: F.struct(F.lit(name).alias("kind"), count(opened).alias("opened"), count(formed).alias("formed"))
    kinds = F.array(kind("cite", CITE_START, CITE), kind("set", SET_START, r"\{\{SET:[^}]*\}\}"))
    return bodies.select("note", F.explode(kinds).alias("t")).select("note", "t.*").where("opened > formed")


def resolved_citations(bodies: DataFrame, files: DataFrame) -> DataFrame:
    """citations() with target_line, sha256 and code: why a citation doesn't hold, null where it does.

    A quote must stand within one block of the named file; its first line is the target. A file of null text couldn't be read.
    """
    cites = citations(bodies)
    cited = files.join(cites.select("path").distinct(), "path", "left_semi")
    blocks = plain_lines(cited).groupBy("path", "block").agg(F.array_sort(F.collect_list(F.struct("line_no", "plain"))).alias("l"))
    # The index, its sizes and the answers all read the blocks.
    blocks = stored(blocks.select("path", "block", F.array_join(F.filter(F.col("l.plain"), lambda p: p != ""), " ").alias("whole"), "l"))
    # The first block of a file that holds a quote is where it is found.
    holds = holding_blocks(cites, blocks.select("path", "block", "whole")).groupBy("path", "quote").agg(F.min_by("place", "block").alias("place"), F.min("block").alias("block"))
    # The first line that ends at the place or after it.
    upto = lambda s, x: s["at"] + F.length(x["plain"]) + F.when(x["plain"] != "", 1).otherwise(0)
    hit = lambda s, x: F.coalesce(s["hit"], F.when(upto(s, x) >= F.col("place"), x["line_no"].cast("int")))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("hit"))
    target = F.aggregate("l", start, lambda s, x: F.struct(upto(s, x).alias("at"), hit(s, x).alias("hit")), lambda s: s["hit"])
    lined = holds.join(blocks, ["path", "block"]).select("path", "quote", target.alias("target_line"))
    met = cites.where("quote <> ''").join(lined, ["path", "quote"]).select("note", "k", "target_line")
    first = met.groupBy("note", "k").agg(F.min("target_line").alias("target_line"))
    known = files.select("path", "sha256", F.lit(True).alias("there"), F.col("text").isNull().alias("unreadable"))
    rows = cites.join(known, "path", "left").join(first, ["note", "k"], "left")
    code = F.when(F.col("quote") == "", "E-CITE-EMPTY").when(F.col("path").contains(".."), "E-CITE-PATH").when(F.col("there").isNull(), "E-CITE-NOFILE").when(F.col("path") == F.col("note"), "E-CITE-SELF")
    code = code.when(F.col("unreadable"), "E-CITE-UNREADABLE").when(F.col("target_line").isNull(), "E-CITE-NOMATCH")
    return rows.select("note", "k", "line_no", "path", "quote", "target_line", F.when(code.isNull(), F.col("sha256")).alias("sha256"), code.alias("code"))


def _set_starts(body: Column) -> Column:
    """For each opening of a set however written, the number of the well-formed opening that it is, or null."""
    formed = F.transform(F.regexp_extract_all(body, F.lit(SET_START + r"(?:[^}]*\}\})?"), F.lit(0)), lambda t: t.rlike(r"^\{\{SET:[^}]*\}\}$"))
    return F.transform(formed, lambda ok, k: F.when(ok, F.size(F.filter(F.slice(formed, 1, k), lambda x: x))))


def _set_blocks(body: Column) -> Column:
    """array<struct(number, line, label, members, code, recorded, sound, token, after)> of a body's set tokens, in order.

    A set is an opening whose next token closes it. token is the token's text and after what follows it up to the next;
    closing tokens have no number. Of openings that nothing closes only the first is recorded.
    """
    none = F.array().cast("array<string>")
    tokens, gaps, lines = F.regexp_extract_all(body, F.lit(SET_TOKEN), F.lit(0)), F.split(body, SET_TOKEN), _lines_before(body, SET_TOKEN)
    is_open = lambda t: t.startswith("{{SET:")

    def grow(state: Column, line: Column) -> Column:
        head = F.slice(state, 1, F.size(state) - 1)
        more = F.concat(head, F.array(F.concat(F.element_at(state, -1), F.lit(" "), F.trim(line))))
        return F.when(line.rlike(notes.ITEM), F.concat(state, F.array(F.rtrim(line)))).when((F.size(state) > 0) & (F.trim(line) != ""), more).otherwise(state)

    def one(token: Column, k: Column) -> Column:
        after = F.coalesce(F.get(gaps, k + 1), F.lit(""))
        following = F.get(tokens, k + 1)
        members = F.when(is_open(token), F.aggregate(F.split(after, "\n"), none, grow)).otherwise(none)
        label = tx.one_line(F.regexp_extract(token, r"^\{\{SET:([^}]*)\}\}$", 1))
        closed = F.exists(F.slice(tokens, k + 2, F.size(tokens)), lambda t: ~is_open(t))
        code = F.when(~closed, "E-SET-UNCLOSED").when(is_open(following), "E-SET-NESTED").when(F.size(members) == 0, "E-SET-EMPTY").when(F.regexp_replace(label, "`[^`]*`", " ").rlike(COUNT_WORD), "E-SET-COUNT")
        # An unclosed set ends the reading: openings after it aren't sets.
        last_close = F.size(tokens) - F.array_position(F.reverse(F.transform(tokens, is_open)), F.lit(False))
        ended = F.when(F.forall(tokens, is_open), k > 0).otherwise(k > last_close + 1)
        number = F.size(F.filter(F.slice(tokens, 1, k), is_open))
        return F.struct(
            F.when(is_open(token), number).alias("number"), F.get(lines, k).alias("line"), label.alias("label"), members.alias("members"), F.when(is_open(token), code).alias("code"),
            (is_open(token) & ~ended).alias("recorded"), (is_open(token) & ~ended & code.isNull()).alias("sound"), token.alias("token"), after.alias("after"),
        )

    return F.transform(tokens, one)


def sets(bodies: DataFrame) -> DataFrame:
    """(note, k, label, members, code, line_no) of the sets that (note, body) opens. A member is a list item with the lines after it.

    A set that never closes, holds another, lists nothing or states a count itself has a code.
    """
    rows = bodies.select("note", F.explode(F.filter(_set_blocks(F.col("body")), lambda s: s["recorded"])).alias("s"))
    return rows.select("note", F.col("s.number").cast("long").alias("k"), "s.label", F.when(F.coalesce("s.code", F.lit("")).isin("E-SET-UNCLOSED", "E-SET-NESTED"), F.array().cast("array<string>")).otherwise(F.col("s.members")).alias("members"), "s.code", F.col("s.line").cast("long").alias("line_no"))


def rendered(bodies: DataFrame) -> DataFrame:
    """(note, body) with citations as paths in code and sound sets under a written count. Only tokens are touched."""
    rows = bodies.select("note", F.regexp_replace("body", CITE, "`$1`").alias("body"))
    rows = rows.select("note", "body", _set_blocks(F.col("body")).alias("tokens"))

    def shown(s: Column, k: Column) -> Column:
        head = F.concat(s["label"], F.lit(" ("), F.size(s["members"]).cast("string"), F.lit(" listed):\n\n"), F.array_join(s["members"], "\n"))
        # What follows a set is what follows its closing token; a rendered set never runs into it.
        tail = F.coalesce(F.get("tokens", k + 1)["after"], F.lit(""))
        closing = (k > 0) & F.coalesce(F.get("tokens", k - 1)["sound"], F.lit(False))
        own = F.when(s["sound"], F.concat(head, F.when(tail.startswith("\n\n"), "").otherwise("\n"))).when(closing, s["after"]).otherwise(F.concat(s["token"], s["after"]))
        return own

    lead = F.get(F.split("body", SET_TOKEN), F.lit(0))
    return rows.select("note", F.concat(lead, F.array_join(F.transform("tokens", shown), "")).alias("body"))


def enumerations(lines: DataFrame) -> DataFrame:
    """(note, line_no, stated, listed) where a line ends by stating how many follow and another number of items does.

    lines: note, line_no, text. The list is the items of the lines' next run; blank lines before it are passed over.
    """
    order = Window.partitionBy("note").orderBy("line_no")
    word = F.lower(F.regexp_extract("text", r"(?i)\b(" + "|".join(COUNTS) + r"|\d{1,3})\s+[a-z-]+(?:\s+[a-z-]+)?:\s*$", 1))
    values = F.create_map(*(F.lit(x) for pair in COUNTS.items() for x in pair))
    stated = F.coalesce(F.try_element_at(values, word), word.try_cast("int"))
    content = lines.where(F.trim("text") != "").withColumn("item", F.col("text").rlike(notes.ITEM) & ~F.col("text").rlike(r"^\s{2,}"))
    content = content.withColumn("stated", F.when(~F.col("item"), stated))
    run = F.sum((~F.col("item") & ~F.col("text").rlike(r"^\s+\S")).cast("long")).over(order)
    runs = content.withColumn("run", run).groupBy("note", "run").agg(F.min_by("line_no", "line_no").alias("line_no"), F.max("stated").alias("stated"), F.count_if("item").alias("listed"))
    return runs.where("stated is not null and listed > 0 and stated <> listed").select("note", "line_no", "stated", "listed")


def lanes(frontmatters: DataFrame) -> DataFrame:
    """(note, lanes, error) of (note, frontmatter): review lanes as a bracketed list; lanes is null where none is declared."""
    has = F.col("frontmatter").rlike(r"(?m)^reviews:[ \t]*(.*)$")
    raw = F.trim(F.substring_index(F.trim(F.regexp_extract("frontmatter", r"(?m)^reviews:[ \t]*(.*)$", 1)), "#", 1))
    block = F.col("frontmatter").rlike(r"(?m)^reviews:[ \t]*\n[ \t]+-[ \t]+\S")
    inner = F.trim(F.substr(raw, F.lit(2), F.length(raw) - 2))
    ids = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), lambda i: F.trim(i)))
    error = F.when(~has, None).when(block, "block-style").when(raw == "", None).when(~(raw.startswith("[") & raw.endswith("]")), "not-a-list").when(inner.rlike("[\"']"), "quoted")
    error = error.when(F.exists(ids, lambda i: ~i.rlike(LANE)), "not-an-id").when(F.size(F.array_distinct(ids)) < F.size(ids), "declared-twice")
    found = F.when(~has | error.isNotNull(), None).when(raw == "", F.array().cast("array<string>")).otherwise(ids)
    return frontmatters.select("note", found.alias("lanes"), error.alias("error"))


def roll_call(declared: DataFrame, reports: DataFrame) -> DataFrame:
    """(note, lane, file, code): declared lanes (note, lane) against reports (note, file, lane, note_sha256, sha256, verdict).

    A report belongs to the longest declared lane that its name begins with. note_sha256 is what the report reviewed,
    sha256 the note as it is.
    """
    named = reports.withColumnRenamed("lane", "report_lane").join(declared.select("note", F.col("lane").alias("fits")), "note", "left")
    fits = (F.col("report_lane") == F.col("fits")) | F.col("report_lane").startswith(F.concat(F.col("fits"), F.lit("-")))
    best = named.withColumn("fits", F.when(fits, F.col("fits"))).groupBy("note", "file").agg(F.max_by("fits", F.length("fits")).alias("lane"), F.first("note_sha256").alias("note_sha256"), F.first("sha256").alias("sha256"), F.first("verdict").alias("verdict"))
    rows = declared.join(best.where("lane is not null"), ["note", "lane"], "full_outer").unionByName(best.where("lane is null").select("note", "lane", "file", "note_sha256", "sha256", "verdict"))
    code = F.when(F.col("lane").isNull(), "E-LANE-UNDECLARED").when(F.col("file").isNull(), "E-LANE-MISSING").when(F.col("note_sha256") != F.col("sha256"), "E-LANE-STALE").when(~F.col("verdict").isin(VERDICTS), "E-LANE-VERDICT")
    return rows.select("note", "lane", "file", code.alias("code"))


def required_lanes(declared: DataFrame, required: list[str]) -> DataFrame:
    """(note, lane): required lanes that none of a note's lanes satisfies, by name or as its longest prefix."""
    wanted = declared.select("note").distinct().withColumn("lane", F.explode(F.array(*map(F.lit, required))))
    has = declared.select("note", F.col("lane").alias("own"))
    met = wanted.join(has, "note").where((F.col("own") == F.col("lane")) | F.col("own").startswith(F.concat(F.col("lane"), F.lit("-")))).select("note", "lane").distinct()
    return wanted.join(met, ["note", "lane"], "left_anti")


def typed_header(headers: DataFrame, types: dict[str, tuple[str, bool]]) -> DataFrame:
    """(note, field, code) of the first field of each note that is missing or has another form.

    headers: note, fields (a map); types: field -> (pattern, optional), in order.
    """
    value = lambda f: F.try_element_at("fields", F.lit(f))
    faults = [F.when(value(f).isNull(), None if optional else F.struct(F.lit(f).alias("field"), F.lit("E-HEADER-MISSING").alias("code"))).when(~value(f).rlike(pattern), F.struct(F.lit(f).alias("field"), F.lit("E-HEADER-FORM").alias("code"))) for f, (pattern, optional) in types.items()]
    return headers.select("note", F.coalesce(*faults).alias("f")).where("f is not null").select("note", "f.*")


def header_fields(frontmatters: DataFrame) -> DataFrame:
    """(note, fields): the key: value lines of (note, frontmatter) as a map; the first of a key counts, values as they read."""
    line = r"(?m)^([A-Za-z_][\w-]*)[ \t]*:[ \t]*(.*?)[ \t]*$"
    pairs = F.arrays_zip(F.regexp_extract_all("frontmatter", F.lit(line), F.lit(1)).alias("key"), F.regexp_extract_all("frontmatter", F.lit(line), F.lit(2)).alias("value"))
    rows = frontmatters.select("note", F.posexplode_outer(pairs).alias("k", "p")).groupBy("note", "p.key").agg(F.min_by("p.value", "k").alias("value")).withColumn("value", tx.header_value("value"))
    return rows.groupBy("note").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("key", "value")), lambda e: e["key"].isNotNull())).alias("fields"))


def duration_field(text: Column) -> Column:
    """Seconds of a one to three part duration whose later parts are below 60; null for others."""
    return F.when(F.trim(text).rlike(r"^\d+(?::\d{1,2}){0,2}$"), clock.parse_clock(text))


def declared_numbers(bodies: DataFrame) -> DataFrame:
    """(note, words, minutes, wpm): the first number of each kind that a body's density paragraphs state."""
    number = lambda p: F.regexp_replace(F.regexp_extract("para", p, 1), ",", "").try_cast("double")
    paras = bodies.select("note", F.posexplode(F.split("body", r"\n\s*\n")).alias("k", "para")).where(F.col("para").rlike("(?i)density"))
    rows = paras.select("note", "k", number(r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s+words\b").alias("words"), number(r"(?i)([0-9][0-9,.]*)\s+video-minutes?\b").alias("minutes"), number(r"(?i)([0-9][0-9,.]*)\s+words\s+per\s+video-minute\b").alias("wpm"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("k"))).alias(c)
    return rows.groupBy("note").agg(first("words"), first("minutes"), first("wpm"))


def sentence_around(text: Column, at: Column, reach: int = 300) -> Column:
    """The sentence of a text that holds a place (from 1), looking no further than reach either way."""
    before, after = F.substr(text, F.greatest(at - reach, F.lit(1)), F.least(at - 1, F.lit(reach))), F.substr(text, at, F.lit(reach))
    head, tail = F.regexp_replace(before, r"(?s)^.*[.!?]\s", ""), F.regexp_extract(after, r"(?s)^(.*?[.!?])(?=\s|$)", 1)
    return F.trim(F.concat(head, F.when(tail == "", after).otherwise(tail)))


def body_digest(body: Column) -> Column:
    """sha256 of a body without machine marks and integrity lines, trimmed."""
    lines = F.filter(F.split(body, "\n"), lambda line: ~line.startswith("> integrity:"))
    plain = F.array_join(lines, "\n")
    for mark in notes.MACHINE_MARKS:
        plain = F.replace(plain, F.lit(" " + mark), F.lit(""))
        plain = F.replace(plain, F.lit(mark), F.lit(""))
    return F.sha2(F.regexp_replace(plain, r"(?s)^\s+|\s+$", ""), 256)


def sectioned(lines: DataFrame) -> DataFrame:
    """(note, line_no, text, section_no, section, heading) of (note, line_no, text): second-level headings name sections."""
    order = Window.partitionBy("note").orderBy("line_no")
    is_head = F.col("text").rlike(r"^##\s+")
    rows = lines.withColumn("heading", is_head).withColumn("section_no", F.sum(is_head.cast("long")).over(order))
    return rows.withColumn("section", F.coalesce(F.last(F.when(is_head, F.regexp_extract("text", r"^##\s+(.*?)\s*$", 1)), True).over(order), F.lit("")))


def objections(lines: DataFrame) -> DataFrame:
    """(note, section_no, block, line_no, text): blocks of the objection section; a bullet at the margin begins one."""
    order = Window.partitionBy("note", "section_no").orderBy("line_no")
    rows = sectioned(lines).where((F.col("section") == OBJECTIONS) & ~F.col("heading"))
    blank = F.trim("text") == ""
    starts = blank | F.col("text").rlike(r"^-\s+") | F.coalesce(F.lag(blank).over(order), F.lit(True))
    return rows.withColumn("block", F.sum(starts.cast("long")).over(order)).where(~blank).select("note", "section_no", "block", "line_no", "text")


def demotion_counts(lines: DataFrame) -> DataFrame:
    """(note, claims, untagged, objections, speculation, orphans, demotions) of (note, line_no, text)."""
    rows = sectioned(lines).where("not heading")
    order = Window.partitionBy("note").orderBy("line_no")
    bullet = F.col("text").rlike(r"^\s*-\s+")
    claims = rows.where(F.col("section") == CLAIMS).withColumn("bullet", F.sum(bullet.cast("long")).over(order)).where("bullet > 0")
    whole = claims.groupBy("note", "bullet").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "text")))["text"], " ").alias("text"))
    tagged = F.col("text").rlike(notes.CLASS_MARK)
    counts = whole.groupBy("note").agg(F.count("*").alias("claims"), F.count_if(~tagged).alias("untagged"))
    held = objections(lines).groupBy("note", "section_no", "block").agg(F.max(F.col("text").rlike(FALSIFIER).cast("int")).alias("falsifiable"))
    against = held.groupBy("note").agg(F.count("*").alias("objections"), F.count_if(F.col("falsifiable") == 0).alias("speculation"))
    stamps = lambda df: df.select("note", F.explode(F.regexp_extract_all("text", F.lit(notes.ANCHOR), F.lit(0))).alias("stamp")).distinct()
    orphans = stamps(rows.where((F.col("section") != CLAIMS) & ~F.col("section").isin(META))).join(stamps(whole), ["note", "stamp"], "left_anti").groupBy("note").agg(F.count("*").alias("orphans"))
    out = lines.select("note").distinct()
    for part in (counts, against, orphans):
        out = out.join(part, "note", "left")
    out = out.na.fill(0)
    return out.withColumn("demotions", F.col("untagged") + F.col("speculation") + F.col("orphans"))


def demotion_median(counts: DataFrame) -> DataFrame:
    """(notes, median): the middle of all notes' demotions, between the two middles of an even number."""
    return counts.agg(F.count("*").alias("notes"), F.percentile("demotions", 0.5).alias("median"))


def tagged_claim(text: Column) -> Column:
    """A claim bullet without a class but with an anchor is called inferred behind its last anchor, and marked."""
    wants = text.rlike(r"^\s*-\s+") & ~text.rlike(notes.CLASS_MARK) & text.rlike(notes.ANCHOR)
    return F.when(wants, F.concat(F.regexp_replace(text, rf"(?s)^(.*{notes.ANCHOR})", "$1 `INFERRED`"), F.lit(" " + DEMOTED_MARK))).otherwise(text)


def demoted(lines: DataFrame) -> DataFrame:
    """(note, part, line_no, text): notes' lines in their new order and wording; rendering them again changes nothing.

    Claims without a class are tagged, anchors that no claim has are marked, and objections without a falsifier move to a
    section of their own behind. part orders the lines of a note before line_no does; a moved section begins with a line
    whose number is -1.
    """
    rows = sectioned(lines)
    claimed = rows.where((F.col("section") == CLAIMS) & ~F.col("heading")).groupBy("note").agg(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("text", F.lit(notes.ANCHOR), F.lit(0))))).alias("known"))
    weak = objections(lines).groupBy("note", "section_no", "block").agg(F.max(F.col("text").rlike(FALSIFIER).cast("int")).alias("ok"), F.collect_list("line_no").alias("numbers")).where("ok = 0")
    moved = weak.select("note", F.explode("numbers").alias("line_no")).withColumn("moved", F.lit(True))
    rows = rows.join(claimed, "note", "left").join(moved, ["note", "line_no"], "left")
    known = F.coalesce("known", F.array().cast("array<string>"))
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s)(.*?)({notes.ANCHOR}|$)"), F.lit(1))
    stamps = F.regexp_extract_all("text", F.lit(rf"(?s)(.*?)({notes.ANCHOR}|$)"), F.lit(2))
    follows = lambda k: F.coalesce(F.get(pieces, k + 1), F.lit("")).startswith(" " + ORPHAN_MARK)
    mark = F.array_join(F.transform(pieces, lambda p, k: F.concat(p, F.get(stamps, k), F.when((F.get(stamps, k) != "") & ~F.array_contains(known, F.get(stamps, k)) & ~follows(k), " " + ORPHAN_MARK).otherwise(""))), "")
    free = ~F.col("section").isin(META) & (F.col("section") != CLAIMS)
    text = F.when(F.col("heading"), F.col("text")).when(F.col("section") == CLAIMS, tagged_claim(F.col("text"))).when(free, mark).otherwise(F.col("text"))
    part = F.col("section_no") * 2 + F.coalesce("moved", F.lit(False)).cast("long")
    kept = rows.select("note", part.alias("part"), F.col("line_no").cast("long").alias("line_no"), text.alias("text"))
    heads = rows.where("moved").select("note", (F.col("section_no") * 2 + 1).alias("part"), F.lit(-1).cast("long").alias("line_no"), F.lit("## " + SPECULATION).alias("text")).distinct()
    return kept.unionByName(heads)


def integrity(lines: DataFrame) -> DataFrame:
    """(note, line): one sentence that counts a note's claims, demotions, objections and orphans."""
    counts = demotion_counts(lines)
    marks = lines.groupBy("note").agg(F.sum(F.size(F.split("text", DEMOTED_MARK)) - 1).alias("demoted"))
    said = F.format_string("> integrity: %d claims, %d demoted, %d objections, %d speculative, %d orphan anchors", "claims", "demoted", "objections", "speculation", "orphans")
    return counts.join(marks, "note").select("note", said.alias("line"))


def filing_refusals(notes_: DataFrame, existing: DataFrame) -> DataFrame:
    """(note, code): why a note can't be filed. notes_: note, recording_id, note_date, as_of, body; existing: recording_id, note."""
    other = existing.groupBy("recording_id").agg(F.min("note").alias("held_by"))
    rows = notes_.join(other, "recording_id", "left")
    named = F.col("note").rlike(r"^\d{4}-\d{2}-\d{2}--[a-z0-9-]+--\S+\.md$")
    codes = F.array(
        F.when(~named, "E-FILE-NAME"), F.when(F.try_to_date("note_date").isNull(), "E-FILE-DATE"), F.when(F.try_to_date("note_date") > F.col("as_of"), "E-FILE-FUTURE"),
        F.when(F.trim("body") == "", "E-FILE-EMPTY"), F.when(F.col("held_by").isNotNull() & (F.col("held_by") != F.col("note")), "E-FILE-DUPLICATE"),
    )
    return rows.select("note", F.explode(F.array_compact(codes)).alias("code"))


def status_defects(headers: DataFrame, files: DataFrame) -> DataFrame:
    """(note, code) of headers (note, status, applied_to): no state, unknown ones, and edges that only one of both claims."""
    rows = headers.join(files.select(F.col("path").alias("applied_to"), F.lit(True).alias("there")).distinct(), "applied_to", "left")
    status, target = F.nullif(F.trim("status"), F.lit("")), F.nullif(F.trim("applied_to"), F.lit(""))
    code = F.when(status.isNull(), "E-STATUS-MISSING").when(~status.isin(STATUSES), "E-STATUS-UNKNOWN").when((status != "applied") & target.isNotNull(), "E-STATUS-APPLIED")
    code = code.when((status == "applied") & target.isNull(), "E-STATUS-NOEDGE").when((status == "applied") & F.col("there").isNull(), "E-STATUS-EDGE")
    return rows.select("note", code.alias("code")).where("code is not null")


def sidecar_defects(expected: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(note, k, code): citations (note, k, path, target_line, sha256) against the sidecar written for them earlier."""
    own = expected.select("note", "k", F.struct("path", "target_line", "sha256").alias("now"))
    old = sidecars.select("note", "k", F.struct("path", "target_line", "sha256").alias("then"))
    rows = own.join(old, ["note", "k"], "full_outer")
    code = F.when(F.col("then").isNull(), "E-SIDECAR-MISSING").when(F.col("now").isNull(), "E-SIDECAR-EXTRA").when(~F.col("now").eqNullSafe(F.col("then")), "E-SIDECAR-STALE")
    return rows.select("note", "k", code.alias("code")).where("code is not null")


def anchor_range(found: DataFrame, durations: DataFrame) -> DataFrame:
    """Anchors (recording_id, at_s, foreign) of their own recording that lie past its end."""
    return found.where("not foreign").join(durations, "recording_id").where("at_s > duration_s").select("recording_id", "line_no", "anchor", "duration_s")


def verify_listing(expected: DataFrame, found: DataFrame, closed: bool = False) -> DataFrame:
    """(path, code) of (path, sha256) listings that differ: missing, changed and, for a copy that must be exact, extra."""
    rows = expected.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("got")), "path", "full_outer")
    code = F.when(F.col("want").isNull(), "extra" if closed else None).when(F.col("got").isNull(), "missing").when(F.col("want") != F.col("got"), "changed")
    return rows.select("path", code.alias("code")).where("code is not null")


def oracle_targets(declared: DataFrame, files: DataFrame, runs: str = "runs", root: str = "") -> DataFrame:
    """(note, oracle, path, related): the file that an oracle names, and whether it is the recording's own.

    The oracle's first word is a path or a pattern (see paths). A relative one is looked for in the recording's folder of
    runs, then in root; an absolute pattern only within one of both. related: a folder of the file, or the file, is named as
    the recording is. declared: note, recording_id, oracle; files: path.
    """
    token = F.regexp_extract("oracle", r"^\s*(\S+)", 1)
    rows = declared.select("note", F.col("recording_id").cast("string").alias("recording_id"), "oracle", token.alias("token")).withColumn("absolute", F.col("token").startswith("/"))
    own = F.when(F.coalesce("recording_id", F.lit("")) != "", F.concat(F.lit(f"{runs}/"), "recording_id", F.lit("/"), "token"))
    places = F.when(F.col("absolute"), F.array("token")).otherwise(F.array(own, F.concat(F.lit(f"{root}/" if root else ""), "token")))
    asked = rows.where("token <> ''").select("*", F.posexplode(places).alias("turn", "raw")).where("raw is not null").withColumn("pattern", paths.normal(F.col("raw")))
    anchored = F.regexp_extract(F.concat("pattern", F.lit("/")), rf"^((?:[^/*?\[]*/)*)", 1)
    within = [anchored.startswith(f"{base.rstrip('/')}/") if base else F.lit(True) for base in (runs, root)]
    asked = asked.where(~F.col("absolute") | ~F.col("token").rlike(paths.WILD) | within[0] | within[1])
    found = paths.resolved(asked, files)
    best = asked.join(found, "pattern").where("path is not null").groupBy("note", "oracle").agg(F.min_by("path", "turn").alias("path"))
    out = rows.join(best, ["note", "oracle"], "left")
    return out.select("note", "oracle", "path", F.coalesce(F.array_contains(F.split("path", "/"), F.col("recording_id")), F.lit(False)).alias("related"))


def bare_paths(lines: DataFrame) -> DataFrame:
    """(note, line_no, path): paths of the repository that stand in prose instead of in a citation."""
    pattern = r"(?<![A-Za-z0-9._/-])((?:docs|notes|scripts)/[A-Za-z0-9._/-]+\.(?:md|py|tsv|json))"
    return lines.select("note", "line_no", F.explode(F.regexp_extract_all(F.regexp_replace("text", CITE, ""), F.lit(pattern), F.lit(1))).alias("path"))


def report_name(lane: Column, batch: Column) -> Column:
    return F.concat(lane, F.lit("-"), F.format_string("%02d", batch), F.lit(".md"))


def with_lane(lanes_: Column, lane: Column) -> Column:
    """Declared lanes with one more, once."""
    return F.array_union(lanes_, F.array(lane))


def paired(notes_: DataFrame, renderings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, skipped): notes with their own recording's rendering, and those without one, by name."""
    both = notes_.join(renderings.select("recording_id", F.lit(True).alias("_has")).distinct(), "recording_id", "left")
    return both.where("_has").drop("_has"), both.where("_has is null").select("note", "recording_id")


Gate = Callable[[], DataFrame] | tuple[DataFrame, Column]


def _counted(conditions: dict[str, tuple[DataFrame, Column]]) -> dict[str, int]:
    """How many rows meet each gate's condition, in one pass over the rows that they share."""
    rows = next(iter(conditions.values()))[0]
    seen = Observation()
    marks = [F.count_if(F.coalesce(condition, F.lit(False))).alias(f"g{k}") for k, (_, condition) in enumerate(conditions.values())]
    # Only what the conditions read is computed; no row leaves its task.
    rows.observe(seen, *marks).write.format("noop").mode("append").save()
    return dict(zip(conditions, (seen.get[f"g{k}"] for k in range(len(marks))), strict=True))


def run_gates(gates: dict[str, Gate]) -> list[dict]:
    """[{gate, status, defects, error}] and the worst last (gate "all"): 0 clean, 1 with defects, 2 where a gate couldn't run.

    A gate is (rows, condition), whose defects are the rows that meet it, or a function that gives its findings. Gates over
    the same rows are counted by one job that reads these once; if it fails, each runs alone, so that only what can't run is
    named. Only numbers come to the driver.
    """
    found: dict[str, dict] = {}

    def note(name: str, count: Callable[[], int]) -> None:
        try:
            n = count()
            found[name] = {"gate": name, "status": int(n > 0), "defects": n, "error": None}
        except Exception as e:  # a gate that can't run is a result of its own and must not hide the others
            found[name] = {"gate": name, "status": 2, "defects": 0, "error": str(e).splitlines()[0][:200]}

    shared: dict[int, dict[str, tuple[DataFrame, Column]]] = {}
    for name, gate in gates.items():
        if isinstance(gate, tuple):
            shared.setdefault(id(gate[0]), {})[name] = gate
        else:
            note(name, lambda gate=gate: gate().count())
    for together in shared.values():
        try:
            for name, n in _counted(together).items():
                note(name, lambda n=n: n)
        except Exception:  # one of them can't run: which one shows by itself
            for name, gate in together.items():
                note(name, lambda name=name, gate=gate: _counted({name: gate})[name])
    rows = [found[name] for name in gates]
    return [*rows, {"gate": "all", "status": max((r["status"] for r in rows), default=2), "defects": sum(r["defects"] for r in rows), "error": None}]


def binding_control(lines: DataFrame) -> DataFrame:
    """(recording_id, bound, still_bound): anchors that touch decides, before and after prose is put around every class mark.

    A rule that binds by touch loses all of them; still_bound above 0 means that it binds by something else.
    """
    spread = lines.withColumn("text", F.regexp_replace("text", f"({notes.CLASS_MARK})", "said $1 said"))

    def by_touch(df: DataFrame, name: str) -> DataFrame:
        lined = notes.blocks(df)
        several = notes.items(lined).where(F.size(F.array_distinct(F.regexp_extract_all("raw", F.lit(notes.CLASS_MARK), F.lit(0)))) > 1).select("recording_id", "block")
        found = notes.anchors(lined).join(several, ["recording_id", "block"], "left_semi")
        return found.groupBy("recording_id").agg(F.count_if(F.col("class").isin(notes.CLASSES)).alias(name))

    return by_touch(lines, "bound").join(by_touch(spread, "still_bound"), "recording_id")


def grade_defects(stamps: DataFrame, build: str) -> DataFrame:
    """(note, code) of (note, graded, digest): the stamp "build digest" of the last clean grading against what is now."""
    was_build, was_digest = F.substring_index("graded", " ", 1), F.element_at(F.split("graded", " "), -1)
    code = F.when(F.col("graded").isNull(), "E-GRADE-MISSING").when(~F.col("graded").rlike(r"^\S+ [0-9a-f]{64}$"), "E-GRADE-FORM").when(was_digest != F.col("digest"), "E-GRADE-BODY").when(was_build != F.lit(build), "E-GRADE-BUILD")
    return stamps.select("note", code.alias("code")).where("code is not null")


def band_defects(densities: DataFrame, low: float, high: float) -> DataFrame:
    """(recording_id, wpm) of notes whose words a minute lie outside a declared band."""
    return densities.where((F.col("wpm") < low) | (F.col("wpm") > high)).select("recording_id", "wpm")


def declared_density(numbers: DataFrame, measured: DataFrame) -> DataFrame:
    """(note, code): declared_numbers() that aren't those of (note, words, minutes)."""
    rows = numbers.withColumnsRenamed({"words": "said_words", "minutes": "said_minutes"}).join(measured, "note")
    code = F.when(F.col("said_words").isNull(), "E-DENSITY-MISSING").when(F.col("said_words") != F.col("words"), "E-DENSITY-WORDS").when(F.abs(F.col("wpm") - F.col("words") / F.col("minutes")) > 0.5, "E-DENSITY-RATE")
    return rows.select("note", code.alias("code")).where("code is not null")


def package_targets(cites: DataFrame, packages: DataFrame) -> DataFrame:
    """(note, k, file, code) of citations whose path is name@version:path, against what is installed (name, version, path).

    Another version than the cited one is refused, even if it holds the same file.
    """
    spec = r"^([A-Za-z0-9._-]+)@([A-Za-z0-9._+!-]+):(\S+)$"
    part = lambda k: F.regexp_extract("path", spec, k)
    asked = cites.where(F.col("path").rlike(spec)).select("note", "k", part(1).alias("name"), part(2).alias("want"), part(3).alias("rel"))
    versions = packages.select("name", "version").distinct()
    held = packages.select("name", F.col("version").alias("want"), F.col("path").alias("file"))
    met = asked.join(held, ["name", "want"]).where((F.col("file") == F.col("rel")) | F.col("file").endswith(F.concat(F.lit("/"), F.col("rel")))).groupBy("note", "k").agg(F.min("file").alias("file"))
    rows = asked.join(versions, "name", "left").join(met, ["note", "k"], "left")
    code = F.when(F.col("version").isNull(), "E-CITE-NOPKG").when(F.col("version") != F.col("want"), "E-CITE-VERSION").when(F.col("file").isNull(), "E-CITE-NOFILE")
    return rows.select("note", "k", "file", code.alias("code"))


def _first(*codes: Column) -> Column:
    return F.coalesce(*codes, F.lit(None).cast("string"))


def note_refusals(runs: DataFrame, existing: DataFrame) -> DataFrame:
    """(run, note, code): the file that a run's note would be, or the first reason why it can't be opened.

    runs: run, video_id, duration (as written), title, stem (a name given instead of the title's, or null), note_date,
    rendering (of the run, or null where none reads as a transcript); existing: video_id of the notes that there are. A run
    that names no usable id or no duration can't be judged at all (USAGE). Two runs of one id get the same file.
    """
    there = existing.select("video_id", F.lit(True).alias("there")).where("video_id is not null").distinct()
    rows = runs.join(there, "video_id", "left").withColumn("name", F.coalesce(F.nullif("stem", F.lit("")), tx.slug(F.coalesce("title", F.lit("")))))
    code = _first(
        F.when(F.coalesce("video_id", F.lit("")) == "", "USAGE-NO-ID"), F.when(~F.col("video_id").rlike(VIDEO_ID), "USAGE-BAD-ID"), F.when(F.trim("duration").try_cast("double").isNull(), "USAGE-NO-DURATION"),
        F.when(F.col("there"), "E-NOTE-EXISTS"), F.when(~F.col("name").rlike(LANE), "E-NOTE-UNNAMEABLE"), F.when(F.col("rendering").isNull(), "E-NOTE-BLINDORACLE"),
    )
    note = F.concat(F.col("note_date").cast("string"), F.lit("--"), "name", F.lit("--"), "video_id", F.lit(".md"))
    return rows.select("run", F.when(code.isNull(), note).alias("note"), code.alias("code"))


def review_refusals(reviews: DataFrame, known: DataFrame, stamps: DataFrame) -> DataFrame:
    """(file, code): every reason why a review can't be filed.

    reviews: file, note, lane (it is filed for), and what its header says: said_lane, note_sha256, brief_sha256, or problem,
    why it has no header; known: note, sha256 (of its body now); stamps: note, lane, stamp of the briefs that were filed (null
    for a brief that doesn't describe itself). Without a brief there is nothing to echo.
    """
    given = stamps.select("note", "lane", "stamp", F.lit(True).alias("briefed")).distinct()
    rows = reviews.join(known.select("note", "sha256"), "note", "left").join(given, ["note", "lane"], "left")
    echo = F.coalesce("brief_sha256", F.lit(""))
    brief = F.when(F.col("briefed"), F.when(F.col("stamp").isNull(), "E-FILE-BADBRIEF").when(echo == "", "E-FILE-UNBRIEFED").when(echo != F.col("stamp"), "E-FILE-WRONGBRIEF"))
    other, stale = ~F.col("said_lane").eqNullSafe(F.col("lane")), ~F.col("note_sha256").eqNullSafe(F.col("sha256"))
    codes = F.when(F.col("problem").isNotNull(), F.array(F.lit("E-FILE-UNPARSED"))).otherwise(F.array_compact(F.array(brief, F.when(other, "E-FILE-MISLABELLED"), F.when(stale, "E-FILE-STALE"))))
    return rows.select("file", F.explode(codes).alias("code"))


def brief_refusals(briefs: DataFrame) -> DataFrame:
    """(note, lane, code): why a brief (note, video_id of its header, lane, text) can't be filed."""
    code = _first(F.when(F.coalesce("video_id", F.lit("")) == "", "USAGE-NO-ID"), F.when(~F.coalesce("lane", F.lit("")).rlike(LANE), "USAGE-BAD-LANE"), F.when(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")) == "", "E-BRIEF-EMPTY"))
    return briefs.select("note", "lane", code.alias("code")).where("code is not null")


def briefs(declared: DataFrame, batched: DataFrame) -> DataFrame:
    """(note, lane, batch, header, frames): what each lane is asked to review, one row for each batch of frames.

    declared: note, recording_id, lane; batched: recording_id, batch, path (as planning.batches gives them, with a path).
    """
    listed = batched.groupBy("recording_id", "batch").agg(F.sort_array(F.collect_list("path")).alias("frames"))
    header = F.format_string("# Review of %s: %s, batch %d of frames", "note", "lane", F.col("batch") + 1)
    return declared.join(listed, "recording_id").select("note", "lane", "batch", header.alias("header"), "frames")


def review_paths(note: Column, lane: Column) -> tuple[Column, Column, Column]:
    """(report, brief, sidecar): where the papers of a note's lane are, from the note's path."""
    folder, name = F.regexp_extract(note, r"^(.*/)", 1), F.regexp_replace(F.element_at(F.split(note, "/"), -1), r"\.md$", "")
    base = F.concat(folder, F.lit("reviews/"), name, F.lit("--"), lane)
    return F.concat(base, F.lit(".md")), F.concat(base, F.lit(".brief")), F.concat(folder, name, F.lit(".cites.tsv"))


def in_review_folder(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), "reviews")


def note_frame(title: Column, recording_id: Column, date: Column, lanes_: Column) -> Column:
    """The header of a new note."""
    return F.concat(F.lit("---\ntitle: "), tx.one_line(title), F.lit("\nvideo_id: "), recording_id, F.lit("\ndate: "), date, F.lit("\nstatus: capture\nreviews: ["), F.array_join(lanes_, ", "), F.lit("]\n---\n"))


def orphan_sidecars(sidecars: DataFrame, notes_: DataFrame) -> DataFrame:
    """Sidecars (note, path) of notes that are no more."""
    return sidecars.join(notes_.select("note").distinct(), "note", "left_anti")


def unclaimed_manifests(manifests: DataFrame, notes_: DataFrame) -> DataFrame:
    """(recording_id, code): manifests (recording_id, path) that no note claims, and those that a recording has twice."""
    counted = manifests.groupBy("recording_id").agg(F.count("*").alias("n"))
    alone = counted.join(notes_.select("recording_id").distinct(), "recording_id", "left_anti").select("recording_id", F.lit("E-MANIFEST-UNCLAIMED").alias("code"))
    return alone.unionByName(counted.where("n > 1").select("recording_id", F.lit("E-MANIFEST-TWICE").alias("code")))


def decode_refusals(lost: DataFrame, plan: DataFrame, segments: DataFrame, allow_lost: bool = False) -> DataFrame:
    """(recording_id, reason) of recordings whose rendering is refused: every chunk failed, some span is lost, or nothing was said."""
    chunks = plan.groupBy("recording_id").agg(F.count("*").alias("chunks"), F.count("failed").alias("failures"))
    gone = lost.groupBy("recording_id").agg(F.count("*").alias("lost"))
    said = segments.groupBy("recording_id").agg(F.count("*").alias("segments"))
    rows = chunks.join(gone, "recording_id", "left").join(said, "recording_id", "left").na.fill(0)
    reason = F.when(F.col("failures") == F.col("chunks"), "all-failed").when(F.col("segments") == 0, "empty").when((F.col("lost") > 0) & F.lit(not allow_lost), "lost-spans")
    return rows.select("recording_id", reason.alias("reason")).where("reason is not null")
