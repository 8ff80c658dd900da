"""Text expressions. All are built-in Spark expressions; Unicode-library functions are at the end, as pandas UDFs."""

from __future__ import annotations

import html
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import needles
from tidemark.functions.words import COLONS, POINTING, STOPWORDS, UNNAMING

# Words that change the meaning of a line whatever its size.
SALIENT_WORDS = """
no not never none nor neither cannot can't don't doesn't didn't won't wouldn't shouldn't isn't aren't wasn't weren't
without unless except rarely hardly zero one two three four five six seven eight nine ten eleven twelve twenty thirty
forty fifty sixty seventy eighty ninety hundred thousand million billion half double triple percent
""".split()
# Suffix, replacement; the first that leaves at least four letters applies.
SUFFIXES = [("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")]


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def normalise(text: Column | str) -> Column:
    """Lower-case tokens, joined by single spaces."""
    return F.array_join(tokens(text), " ")


def content_tokens(text: Column | str) -> Column:
    """Tokens without a digit."""
    return F.filter(tokens(text), lambda w: ~w.rlike("[0-9]"))


def alnum(text: Column | str) -> Column:
    """Lower case with everything but letters, digits and spaces made a space, single-spaced and trimmed."""
    spaced = F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(spaced, " +", " "))


def stem(word: Column) -> Column:
    out = word
    for suffix, replacement in reversed(SUFFIXES):
        cut = F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(replacement))
        out = F.when(word.endswith(suffix) & (F.length(word) - len(suffix) >= 4), cut).otherwise(out)
    return out


def carried(words: Column) -> Column:
    """Words and their stems."""
    return F.array_union(F.transform(words, stem), words)


def is_salient(words: Column) -> Column:
    return F.exists(words, lambda w: w.isin(SALIENT_WORDS) | w.rlike("[0-9]"))


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def proper_nouns(text: Column | str) -> Column:
    """Distinct capitalised words of at least four letters that aren't all capitals, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z][A-Za-z][A-Za-z-]{2,}\b"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: w != F.upper(w)))


def name_candidates(text: Column | str) -> Column:
    """Lower-cased words that are capitalised where no sentence begins."""
    sentences = F.split(text, "[.!?]+")
    words = F.flatten(F.transform(sentences, lambda s: F.slice(_raw(s), 2, 1_000_000)))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) > 1) & w.rlike("^[A-Z]") & (F.lower(w) != "i")), F.lower))


def _raw(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9']+"), F.lit(0))


def id_shaped(text: Column | str) -> Column:
    """Tokens of eleven characters with a digit, a capital and a small letter."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_-]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) == 11) & w.rlike("[0-9]") & w.rlike("[A-Z]") & w.rlike("[a-z]"))


def shingles(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces; none if there are fewer words."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.array_join(F.slice(words, k, n), " "))


def base64_forms(word: Column) -> Column:
    """Standard, URL-safe and unpadded base64 renderings of a word."""
    plain = F.base64(F.encode(word, "UTF-8"))
    url = F.translate(plain, "+/", "-_")
    return F.array_distinct(F.array(plain, url, F.rtrim(plain, F.lit("=")), F.rtrim(url, F.lit("="))))


def tolerance(word: Column) -> Column:
    """Edits allowed when a word is matched."""
    return F.when(F.length(word) >= 6, 2).otherwise(1)


def bounded_edits(a: Column, b: Column, cap: int) -> Column:
    """Edit distance, or cap + 1 where it is larger."""
    found = F.levenshtein(a, b, cap)
    return F.when(found < 0, cap + 1).otherwise(found)


def item_words(text: Column | str) -> Column:
    """Distinct words of four and more letters outside markup, without stop words; parts of hyphenated words count too."""
    plain = F.regexp_replace(text, r"(?s)`[^`]*`|<!--.*?-->|\{\{[^}]*\}\}|[*_>#|]", " ")
    found = F.regexp_extract_all(F.lower(plain), F.lit("[a-z][a-z'-]{3,}"), F.lit(0))
    parts = F.filter(F.flatten(F.transform(F.filter(found, lambda w: w.contains("-")), lambda w: F.split(w, "-"))), lambda w: F.length(w) >= 4)
    return F.array_except(F.array_union(found, parts), F.array(*map(F.lit, STOPWORDS)))


def candidates(text: Column | str) -> Column:
    """proper_nouns() outside code spans, without words that name no one, by themselves or as the head of a compound."""
    words = proper_nouns(F.regexp_replace(text, "`[^`]*`", " "))
    known = lambda w: w.isin(UNNAMING)
    return F.filter(words, lambda w: ~known(F.lower(w)) & ~known(F.element_at(F.split(F.lower(w), "-"), 1)))


def points(text: Column | str) -> Column:
    """Whether a line points at what is shown."""
    return F.rlike(F.col(text) if isinstance(text, str) else text, F.lit(r"(?i)\b(?:" + "|".join(POINTING) + ")"))


def recording_id(platform: Column, display: Column, source: Column) -> Column:
    """The platform's id, else the display id, else one from the source's digest; empty ids don't count."""
    own = F.concat(F.lit("local-"), F.substring(F.sha2(source, 256), 1, 10))
    return F.coalesce(F.nullif(platform, F.lit("")), F.nullif(display, F.lit("")), own)


def one_line(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def moments(text: Column) -> Column:
    """Sorted distinct seconds that a (plainly written) line names: clock stamps, 1h02m03s forms that aren't round
    numbers of five seconds, and t= parameters."""
    clock = r"(?<![\d:])\d{1,3}:[0-5]\d(?::[0-5]\d)?(?![\d:])(?!\.\d)"
    unit = r"(?i)(?<![0-9A-Za-z.])P?T?(?=\d)(?:\d{1,2}(?:h|\s*(?:hr|hrs|hour|hours))\s*)?(?:\d{1,3}(?:m|\s*(?:min|mins|minute|minutes))\s*)?(?:\d{1,4}(?:s|\s*(?:sec|secs|second|seconds)))?(?![0-9A-Za-z])"
    stamps = F.transform(F.regexp_extract_all(text, F.lit(clock), F.lit(0)), lambda s: F.aggregate(F.split(s, ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + x.cast("long")))
    field = lambda s, letter: F.coalesce(F.regexp_extract(F.lower(s), rf"(\d+)\s*{letter}", 1).try_cast("long"), F.lit(0).cast("long"))
    spelt = F.transform(F.regexp_extract_all(text, F.lit(unit), F.lit(0)), lambda s: field(s, "h") * 3600 + field(s, "m") * 60 + field(s, "s"))
    given = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(?<![0-9A-Za-z])t=(\d{1,5})(?:s)?(?![0-9A-Za-z])"), F.lit(1)), lambda s: s.cast("long"))
    return F.array_sort(F.array_distinct(F.concat(stamps, F.filter(spelt, lambda s: s % 5 != 0), given)))


def is_round_pair(seconds: Column) -> Column:
    """Two whole minutes: a coincidence, not a fingerprint."""
    return (F.size(seconds) == 2) & F.forall(seconds, lambda s: s % 60 == 0)


def plainly(text: Column) -> Column:
    """The text with every way of writing a digit or a colon written plainly; text that is plain already skips Python."""
    return F.coalesce(_folded(F.when(text.rlike(r"[^\x09-\x0d\x20-\x7e]"), text)), text)


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    colons = str.maketrans(dict.fromkeys(COLONS, ":"))

    def one(t: str) -> str:
        plain = unicodedata.normalize("NFKC", t.translate(colons))
        shown = (c for c in plain if c.isspace() or unicodedata.category(c) not in ("Cf", "Cc"))
        return "".join(c if (d := unicodedata.decimal(c, None)) is None else str(d) for c in shown)

    return text.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities decoded (Spark has no such function)."""
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def percent_decoded(text: pd.Series) -> pd.Series:
    """Percent escapes decoded; a plus sign stays one, unlike in url_decode."""
    return text.map(unquote, na_action="ignore")


@F.pandas_udf(T.StringType())
def squashed(text: pd.Series) -> pd.Series:
    """Letters and digits only, compatibility-normalised, lookalikes folded, without case."""
    return text.map(needles.squashed, na_action="ignore")


@F.pandas_udf(T.StringType())
def slug(text: pd.Series) -> pd.Series:
    """First eight ASCII words joined by dashes, without accents."""

    def one(t: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
        return "-".join([w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in plain).split()][:8])

    return text.map(one, na_action="ignore")


def header_value(value: Column | str) -> Column:
    """A header's value as it reads: compatibility forms folded, unseen signs at its ends and quotes around it taken off.

    Values of visible ASCII without quotes at an end skip Python.
    """
    value = F.col(value) if isinstance(value, str) else value
    plain = value.rlike(r"^(?:[\x21\x23-\x26\x28-\x7e](?:[\x20-\x7e]*[\x21\x23-\x26\x28-\x7e])?)?$")
    return F.coalesce(_shown(F.when(~plain, value)), value)


@F.pandas_udf(T.StringType())
def _shown(text: pd.Series) -> pd.Series:
    unseen = lambda c: c.isspace() or unicodedata.category(c) in ("Cc", "Cf", "Zs", "Zl", "Zp")

    def one(t: str) -> str:
        t, size = unicodedata.normalize("NFKC", t), -1
        while len(t) != size:
            size = len(t)
            seen = [k for k, c in enumerate(t) if not unseen(c)]
            t = t[seen[0] : seen[-1] + 1] if seen else ""
            if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
                t = t[1:-1]
        # Quotes alone are nothing.
        return t if t.strip("\"'") else ""

    return text.map(one, na_action="ignore")


def cue_text(text: Column | str) -> Column:
    """A caption line without tags, entities, no-break and zero-width spaces, single-spaced."""
    plain = F.regexp_replace(F.regexp_replace(unescape(strip_tags(text)), " ", " "), "​", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))
