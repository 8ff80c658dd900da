"""What a note carries of a recording: document frequency, salience, recall, verbatim runs, near rows, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.alignment import similarity_from
from tidemark.operators.sequence import KEY

RARE, TERM_LETTERS, VERBATIM_RUN = 3, 4, 12


def document_frequency(segments: DataFrame) -> DataFrame:
    """(recording_id, token, df): in how many of a recording's segments a token occurs."""
    return segments.select(KEY, F.explode(F.array_distinct(tx.tokens("text"))).alias("token")).groupBy(KEY, "token").agg(F.count("*").alias("df"))


def salient(segments: DataFrame) -> DataFrame:
    """(recording_id, token, kind): figures, else names, else rare terms. Every token has one kind."""
    sizes = segments.groupBy(KEY).agg(F.greatest(F.lit(1), F.least(F.lit(RARE), F.floor(F.count("*") / 20).cast("int"))).alias("cutoff"))
    # A segment's tokens are split into names and others before they are listed, so each text is read once.
    own = segments.select(KEY, F.array_distinct(tx.tokens("text")).alias("tokens"), tx.name_candidates("text").alias("names"))
    names = F.transform(F.array_intersect("tokens", "names"), lambda w: F.struct(w.alias("token"), F.lit(True).alias("named")))
    others = F.transform(F.array_except("tokens", "names"), lambda w: F.struct(w.alias("token"), F.lit(False).alias("named")))
    marked = F.concat(names, others)
    counted = own.select(KEY, F.explode(marked).alias("t")).groupBy(KEY, "t.token").agg(F.count("*").alias("df"), F.bool_or("t.named").alias("named"))
    rare = (F.length("token") >= TERM_LETTERS) & (F.col("df") <= F.col("cutoff"))
    kind = F.when(F.col("token").rlike("[0-9]"), "figures").when(F.col("named"), "names").when(rare, "terms")
    return counted.join(sizes, KEY).select(KEY, "token", kind.alias("kind")).where("kind is not null")


def recall(wanted: DataFrame, notes: DataFrame) -> DataFrame:
    """(recording_id, kind, wanted, held): how many salient tokens the recording's note carries, as they are or stemmed.

    notes: recording_id, text.
    """
    held = notes.select(KEY, F.explode(F.array_distinct(tx.carried(tx.tokens("text")))).alias("held")).distinct()
    both = wanted.withColumn("stem", tx.stem(F.col("token")))
    exact = held.select(KEY, F.col("held").alias("token"), F.lit(1).alias("exact"))
    stems = held.select(KEY, F.col("held").alias("stem"), F.lit(1).alias("by_stem"))
    met = both.join(exact, [KEY, "token"], "left").join(stems, [KEY, "stem"], "left")
    hit = F.coalesce("exact", "by_stem").isNotNull()
    return met.groupBy(KEY, "kind").agg(F.count("*").alias("wanted"), F.count_if(hit).alias("held"))


def verbatim_share(notes: DataFrame, passages: DataFrame, run: int = VERBATIM_RUN) -> DataFrame:
    """(note_id, words, verbatim, share): words of a note inside runs that some passage also has.

    notes: note_id, text; passages: text. Runs meet by equality, so only shared ones are ever joined; covered words are
    counted from the runs' distances, without listing the words.
    """
    # Tokens are a column of their own: inside the shingles they would be found anew for each.
    words = F.col("words")
    told = passages.select(tx.tokens("text").alias("words"))
    said = told.select(F.explode(F.array_distinct(tx.shingles(words, run))).alias("gram")).distinct()
    notes = notes.select("note_id", tx.tokens("text").alias("words"))
    wrote = notes.select("note_id", F.posexplode(tx.shingles(words, run)).alias("at", "gram"))
    hits = wrote.join(said, "gram", "left_semi").select("note_id", "at")
    step = F.col("at") - F.lag("at").over(Window.partitionBy("note_id").orderBy("at"))
    covered = hits.select("note_id", F.least(F.coalesce(step, F.lit(run)), F.lit(run)).alias("gain")).groupBy("note_id").agg(F.sum("gain").alias("verbatim"))
    sizes = notes.select("note_id", F.greatest(F.size(words), F.lit(0)).cast("long").alias("words"))
    return sizes.join(covered, "note_id", "left").select("note_id", "words", F.coalesce("verbatim", F.lit(0)).cast("long").alias("verbatim")).withColumn("share", F.when(F.col("words") > 0, F.col("verbatim") / F.col("words")).otherwise(0.0))


def verbatim_within(wrote: DataFrame, said: DataFrame, keys: list[str], run: int = VERBATIM_RUN) -> DataFrame:
    """(keys, share): words of each text (keys, words) inside runs that its own recording (recording_id, said) has, too."""
    grams = said.select(KEY, F.explode(F.array_distinct(tx.shingles(F.col("said"), run))).alias("gram"))
    hits = wrote.select(*keys, F.posexplode(tx.shingles(F.col("words"), run)).alias("at", "gram")).join(grams, [KEY, "gram"], "left_semi").select(*keys, "at")
    step = F.col("at") - F.lag("at").over(Window.partitionBy(*keys).orderBy("at"))
    covered = hits.select(*keys, F.least(F.coalesce(step, F.lit(run)), F.lit(run)).alias("gain")).groupBy(*keys).agg(F.sum("gain").alias("covered"))
    rows = wrote.select(*keys, F.size("words").alias("n")).join(covered, keys, "left")
    return rows.select(*keys, F.when(F.col("n") > 0, F.coalesce("covered", F.lit(0)) / F.col("n")).otherwise(0.0).alias("share"))


def near_rows(rows: DataFrame, reach: int = 5, ratio: float = 0.85) -> DataFrame:
    """(recording_id, ord, like_ord): rows that repeat one of the few before them; like_ord is the earliest such row."""
    order = Window.partitionBy(KEY).orderBy("ord")
    # A row travels as one struct: lags of a struct made by the window would take each text through the exchange twice.
    own = rows.select(KEY, "ord", F.struct("ord", F.length("text").alias("n"), "text").alias("own"))
    held = own.withColumn("near", F.array(*(F.lag("own", k).over(order) for k in range(1, reach + 1))))
    # A ratio can't exceed twice the shorter length over both, which spares most of the comparisons.
    both, shorter = lambda o: F.col("own.n") + o["n"], lambda o: F.least("own.n", o["n"])
    may = F.filter("near", lambda o: (both(o) == 0) | (2.0 * shorter(o) / both(o) >= ratio))
    pairs = held.select(KEY, "ord", "own", F.explode(may).alias("other"))
    met = pairs.select(KEY, "ord", F.col("other.ord").alias("like_ord"), similarity_from(ratio)("own.text", "other.text").alias("r")).where(F.col("r") >= ratio)
    return met.groupBy(KEY, "ord").agg(F.min("like_ord").alias("like_ord"))


def region_census(found: DataFrame) -> DataFrame:
    """(recording_id, only_base, only_other): words that only one of two renderings has, of alignment.regions()."""
    words = lambda c: F.sum(F.size(F.filter(F.split(c, " "), lambda w: w != "")))
    return found.groupBy(KEY).agg(words("base").alias("only_base"), words("other").alias("only_other"))


def bind_classes(item: Column) -> Column:
    """The evidence class of an item that names exactly one; NONE without any, MULTI with several."""
    found = F.array_distinct(F.regexp_extract_all(item, F.lit(r"\b(ON-SCREEN|SPOKEN|INFERRED)\b"), F.lit(1)))
    return F.when(F.size(found) == 0, "NONE").when(F.size(found) == 1, F.element_at(found, 1)).otherwise("MULTI")
