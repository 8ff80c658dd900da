"""Secret scans by corpus-wide ownership frequency. DataFrame expressions only.

Candidates of each text are assignments, access keys, hex runs (the base) and other runs of credential letters with a digit
and a letter (kind token). A candidate's value, as a digest, is counted over the whole corpus: in how many repositories and
how many owners' it occurs, and whether it is ever assigned to a secret's name. A value of COPIED_OWNERS owners and
COPIED_REPOSITORIES repositories and more is a copied example. A value of one owner alone that looks live is a live
credential; a token is reported only if it is one, so a secret that is named in one place is found wherever else it stands.
Base spans are always reported; the census says for each whether it is copied or live.

A value looks live if it has LIVE_LENGTH characters, LIVE_VARIETY different ones, letters and digits, and no placeholder word;
a token must besides be assigned or keyed somewhere or have TOKEN_LENGTH characters with letters of both cases.

Places: Spark has no expression for the places of all matches, so a text is split at them, and a place is the length of all
that stands before. Sums run over blocks of BLOCK matches, so a text of any length takes time in proportion to its matches.
Values never leave the scan; only their SHA-256 digests are stored or shuffled. Digests that a third of all rows have are
counted by (value, owner, repository) first, and meet their rows in a join whose large partitions Spark splits.

Cases: null text counts as empty; a null owner or repository is an unnamed one of its own; rows with equal or null ids stay
rows of their own; repeated rows are one repository; extra columns of any name are ignored; an empty table gives no row;
letters beyond ASCII never belong to a candidate, and places count code points; ties between spans that start together go by
kind as listed, then end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed

#: Kinds in order, their patterns, the group that is the value, and the least characters that it needs.
KINDS = ["assign", "access", "hex", "token"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
#: A match of these is a maximal run, so asking for the length in the pattern keeps the matches that are long enough.
ACCESS, HEX, TOKEN = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}", r"[A-Za-z0-9+/_.=-]{12,}"
ASSIGNED_LENGTH = 12

COPIED_OWNERS, COPIED_REPOSITORIES = 3, 5
LIVE_LENGTH, LIVE_VARIETY, TOKEN_LENGTH = 12, 8, 20
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|change_me|your_|xxxx|test|todo|12345|abcdef"
BLOCK = 256


def _starts(sizes: Column) -> Column:
    """For an array of sizes, what stands before each: sums over blocks first, then within each block."""
    nothing = F.array().cast("array<long>")
    at = lambda start, part: F.aggregate(
        part, F.struct(start.cast("long").alias("at"), nothing.alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"]
    )
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, n: a + n))
    return F.flatten(F.zip_with(at(F.lit(0), sums), blocks, at))


def _found(text: Column, kind: int, pattern: str, matches: Column, value: Column | None = None) -> Column:
    """array<struct(start, kind, end, value)> of all matches; value: of each match (default: the whole of it)."""
    gaps = F.transform(F.slice(F.split(text, pattern), 1, F.size(matches)), lambda g: F.length(g).cast("long"))
    starts = _starts(F.zip_with(gaps, matches, lambda g, m: g + F.length(m)))
    spans = F.transform(
        F.arrays_zip(starts.alias("at"), gaps.alias("gap"), matches.alias("m"), (matches if value is None else value).alias("v")),
        lambda z: F.struct((z["at"] + z["gap"]).alias("start"), F.lit(kind).alias("kind"), (z["at"] + z["gap"] + F.length(z["m"])).alias("end"), z["v"].alias("value")),
    )
    # Without a match nothing is split.
    return F.when(F.size(matches) > 0, spans).otherwise(F.array())


def looks_live(value: Column) -> Column:
    varied = F.size(F.array_distinct(F.split(value, ""))) >= LIVE_VARIETY
    return (F.length(value) >= LIVE_LENGTH) & varied & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(f"(?i:{PLACEHOLDERS})")


def candidates(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """(doc_id, row, owner, repository, found) of every row: the candidates' places, digests and whether they look live.

    found: array<struct(start, kind, end, digest, live, strong)>, by start, kind and end. Tokens that overlap a base span of
    their text are left out. The result is a checkpoint: places and digests, no text.
    """
    id_column = F.col("doc_id")
    read = docs.select(id_column.alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    all_of = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    read = read.select("*", all_of(ASSIGN).alias("assign"), all_of(ACCESS).alias("access"), all_of(HEX).alias("hex"), all_of(TOKEN).alias("token"))
    content = F.col("text")
    assigned = F.filter(_found(content, 0, ASSIGN, F.col("assign"), F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))), lambda s: F.length(s["value"]) >= ASSIGNED_LENGTH)
    tokens = F.filter(_found(content, 3, TOKEN, F.col("token")), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    # A full stop may end a sentence, so it ends no value.
    bare = lambda s: F.rtrim(s["value"], F.lit("."))
    told = lambda s, end: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), end.alias("end"), F.sha2(bare(s), 256).alias("digest"), looks_live(bare(s)).alias("live"),
        ((F.length(bare(s)) >= TOKEN_LENGTH) & bare(s).rlike("[A-Z]") & bare(s).rlike("[a-z]")).alias("strong"),
    )
    base = F.concat(assigned, _found(content, 1, ACCESS, F.col("access")), _found(content, 2, HEX, F.col("hex")))
    read = read.select("doc_id", "owner", "repository", F.transform(base, lambda s: told(s, s["end"])).alias("base"), F.transform(tokens, lambda s: told(s, s["end"] - F.length(s["value"]) + F.length(bare(s)))).alias("token"))
    apart = lambda s: F.size(F.filter("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))) == 0
    # Only tokens that look live can ever be reported.
    found = F.array_sort(F.concat("base", F.filter("token", lambda s: s["live"] & apart(s))))
    return checkpointed(read.select("doc_id", F.monotonically_increasing_id().alias("row"), "owner", "repository", found.alias("found")))


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repositories, named, copied, owned) of every candidate value of candidates()."""
    each = found.select("owner", "repository", F.explode("found").alias("s")).groupBy(F.col("s.digest").alias("digest"), "owner", "repository").agg(F.bool_or(F.col("s.kind") < 2).alias("named"))
    by_owner = each.groupBy("digest", "owner").agg(F.count("*").alias("repositories"), F.bool_or("named").alias("named"))
    by_value = by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.bool_or("named").alias("named"))
    copied = (F.col("owners") >= COPIED_OWNERS) & (F.col("repositories") >= COPIED_REPOSITORIES)
    return by_value.select("*", copied.alias("copied"), (F.col("owners") == 1).alias("owned"))


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_copied, n_live) of every row.

    spans: the base spans and the tokens that are live credentials, as kind:start:end. n_copied and n_live count, among the
    spans reported, those whose value is a copied example, and those that are of one owner alone and look live.
    """
    found = candidates(docs, text, owner, repository)
    census = checkpointed(ownership(found).where("copied or owned").select("digest", "named", "copied", "owned"))
    spans = found.select("row", F.explode("found").alias("s")).select("row", "s.*").join(census, "digest")
    live = F.col("owned") & F.col("live") & ((F.col("kind") < 3) | F.col("named") | F.col("strong"))
    judged = spans.select("row", "start", "kind", "end", "copied", live.alias("is_live")).where("kind < 3 or is_live")
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when(F.col("kind") == 3, F.struct("start", "kind", "end"))).alias("added"), F.count_if("copied").alias("n_copied"), F.count_if("is_live").alias("n_live")
    )
    out = found.join(by_row, "row", "left")
    base = F.filter("found", lambda s: s["kind"] < 3)
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    every = F.array_sort(F.concat(plain, F.coalesce("added", F.array().cast("array<struct<start:long,kind:int,end:long>>"))))
    return out.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(every).alias("spans"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
    )
