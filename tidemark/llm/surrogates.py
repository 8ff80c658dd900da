"""PII surrogates: detected entities get keyed, type-consistent replacements.

Kinds: email, phone, IPv4, payment card or account number, IBAN, social-security number, credential, person name.

Most surrogates come from a keyed permutation of all strings of one format: every letter stays a letter of its script,
case and kind (vowel or consonant), every digit a digit, and all else stays. An additive Feistel network over the mixed
radices of the positions makes it a bijection, so different entities of a format never share a surrogate and equal
entities always do, in any document (coreference), without a table. Card numbers keep their first digit and Luhn
validity, IBANs their country and check digits, addresses their first octet, phones their country code; e-mail domains
under reserved names stay. Given names are permuted within the list of their script and gender. Emails and names are
matched without regard to case and written in the case found.

Names are found by a listed given name, a form of address, or an introduction ("met", "my name is"), and from then on by any
of their words alone. A name is replaced word by word, so "Schmidt" is what "Maria Schmidt" has become.

The key is the caller's secret: whoever has it can undo the permutations, and without it nobody can repeat them.

Within a document a surrogate must differ from every entity of the document and from the other surrogates; on a
collision that entity alone takes the next tweak of the key, in order of first appearance, and a larger space once
tweaks run out. Such an entity may have another surrogate in another document: distinctness within a document comes
before coreference across documents.

Cases: null text stays null with no entities; a null doc_id stays null; an empty table gives no row; text without entities is
unchanged to the byte; repeated rows, ties (of two entities that begin together the first kind listed is taken) and texts of
any length are treated alike and whole; nothing depends on other rows, and columns of other names aren't read.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import record_batch, rewritten, text_slices

# Fixed lists of common given names by script and gender; each list is a class within which names are permuted.
GIVEN = {
    ("latin", "f"): "Maria Anna Sophie Laura Julia Clara Emma Alice Elena Lucia Carmen Claire Camille Ingrid Heike Sabine Susan Emily Sarah Linda Mary Patricia Jennifer Elizabeth Barbara Jessica Karen Lisa Nancy Sandra Ashley Kimberly Betty Margaret Donna Michelle".split(),
    ("latin", "m"): "John James Robert Michael David Thomas Peter Paul Pierre Jean Louis Hans Klaus Stefan Carlos Miguel Javier Antonio Daniel Martin William Richard Joseph Christopher Charles Matthew Anthony Steven Donald Andrew Joshua".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Александр Дмитрий Сергей Андрей Алексей Михаил Николай Владимир Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα Δήμητρα Βασιλική".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Παναγιώτης Βασίλης Χρήστος".split(),
}
# Fixed forms of address, after which one or two capitalised words are a name.
TITLES = "Mr. Mrs. Ms. Miss Dr. Prof. Sir Lady Herr Frau Monsieur Madame Mademoiselle Señor Señora Señorita Господин Госпожа Κύριος Κυρία".split()

# Fixed words after which two capitalised words are a name, whatever lists say.
INTRODUCTIONS = "met named contact signed regards sincerely heiße namens getroffen rencontré nommé appelle llamo encontró llamado".split()

_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
_ALPHABETS = [
    "0123456789",
    _VOWELS,
    _CONSONANTS,
    "àáâãäåæèéêëìíîïòóôõöøùúûüýÿ",
    "çñðþß",
    "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщ",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
]
_CLASS_OF = {c: (alphabet, k) for alphabet in _ALPHABETS for k, c in enumerate(alphabet)}
_HEX = "0123456789abcdef"


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode("utf-8", "replace"), hashlib.sha256).digest(), "big")


def permuted(text: str, key: bytes, tweak: object = 0, alphabet: str | None = None, rounds: int = 8) -> str:
    """The image of text under a keyed permutation of all texts of its format.

    Letters keep script, case and kind, digits stay digits; with an alphabet, its symbols are one kind instead.
    """
    places = []
    for at, c in enumerate(text):
        low = c.lower()
        found = (alphabet, alphabet.index(low)) if alphabet and low in alphabet else None if alphabet else _CLASS_OF.get(low)
        if found:
            places.append((at, c != low, *found))
    if not places:
        return text
    form = ",".join(f"{at}:{letters[0]}" for at, _, letters, _ in places) + f"/{len(text)}"
    halves = [places[::2], places[1::2]]
    values, sizes = [], []
    for half in halves:
        value, size = 0, 1
        for _, _, letters, k in half:
            value, size = value * len(letters) + k, size * len(letters)
        values.append(value)
        sizes.append(size)
    for step in range(rounds):
        own = step % 2
        values[own] = (values[own] + _number(key, form, tweak, step, values[1 - own])) % sizes[own]
    out = list(text)
    for half, value in zip(halves, values, strict=True):
        for at, upper, letters, _ in reversed(half):
            value, k = divmod(value, len(letters))
            out[at] = letters[k].upper() if upper and len(letters[k].upper()) == 1 else letters[k]
    return "".join(out)


def luhn_digit(digits: str) -> int:
    """The check digit of a number without one."""
    total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _refilled(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def _email(entity: str, key: bytes, tweak: int) -> str:
    local, _, domain = entity.rpartition("@")
    labels = domain.split(".")
    if "example" not in [x.lower() for x in labels[-2:]]:
        labels = [*(permuted(x, key, ("domain", tweak)) for x in labels[:-1]), labels[-1]]
    return f"{permuted(local, key, ('email', tweak))}@{'.'.join(labels)}"


def _phone(entity: str, key: bytes, tweak: int) -> str:
    digits = re.sub(r"\D", "", entity)
    kept = max(0, len(digits) - 10) if entity.startswith("+") else 0
    return _refilled(entity, digits[:kept] + permuted(digits[kept:], key, ("phone", tweak)))


def _card(entity: str, key: bytes, tweak: int) -> str:
    digits = re.sub(r"\D", "", entity)
    body = digits[0] + permuted(digits[1:-1], key, ("card", tweak))
    off = (int(digits[-1]) - luhn_digit(digits[:-1])) % 10
    return _refilled(entity, body + str((luhn_digit(body) + off) % 10))


def _ip(entity: str, key: bytes, tweak: int) -> str:
    first, *rest = (int(x) for x in entity.split("."))
    value = (rest[0] << 16) | (rest[1] << 8) | rest[2]
    left, right = value >> 12, value & 0xFFF
    for step in range(8):
        left, right = right, (left + _number(key, "ip", tweak, first, step, right)) & 0xFFF
    value = left << 12 | right
    return f"{first}.{value >> 16}.{(value >> 8) & 255}.{value & 255}"


def _iban(entity: str, key: bytes, tweak: int) -> str:
    body = permuted(entity[4:], key, ("iban", tweak))
    as_number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if as_number(entity[4:] + entity[:4]) % 97 != 1:
        return entity[:4] + body
    return f"{entity[:2]}{98 - as_number(body + entity[:2] + '00') % 97:02d}{body}"


def _secret(entity: str, key: bytes, tweak: int) -> str:
    if not all(c in _HEX for c in entity.lower()):
        return permuted(entity, key, ("secret", tweak))
    out = permuted(entity.lower(), key, ("secret", tweak), _HEX)
    return out.upper() if entity == entity.upper() else out


@lru_cache(maxsize=1)
def _given() -> dict[str, tuple[str, str]]:
    return {name.lower(): group for group, names in GIVEN.items() for name in names}


def _like(pattern: str, word: str) -> str:
    return word.upper() if pattern.isupper() and len(pattern) > 1 else word


def _person(entity: str, key: bytes, tweak: int) -> str:
    out = []
    for word in re.split(r"(\s+|-)", entity):
        group = _given().get(word.lower())
        if group:
            names = GIVEN[group]
            at = next(k for k, n in enumerate(names) if n.lower() == word.lower())
            shift = 1 + _number(key, "given", *group) % (len(names) - 1)
            out.append(_like(word, names[(at + shift + tweak) % len(names)]))
        else:
            out.append(permuted(word, key, ("surname", tweak)))
    return "".join(out)


SURROGATES: dict[str, Callable[[str, bytes, int], str]] = {"email": _email, "phone": _phone, "card": _card, "ip": _ip, "iban": _iban, "ssn": lambda e, key, tweak: permuted(e, key, ("ssn", tweak)), "secret": _secret, "person": _person}

# Longer and stricter kinds come first; digits never continue on either side of a match.
_MARKED = re.compile(
    r"(?P<email>[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}[A-Z0-9]{11,30})(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?P<secret>[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{16,})(?![A-Za-z0-9])"
    r"|(?<![\d.])(?P<ip>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?!\.?\d)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<!\w)(?P<card>\d(?:[ -]?\d){12,18})(?!\w)"
    r"|(?<!\w)(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
)


@lru_cache(maxsize=1)
def _people() -> tuple[frozenset[str], re.Pattern]:
    names = sorted((n for group in GIVEN.values() for n in group), key=len, reverse=True)
    titles = "|".join(re.escape(t) for t in TITLES)
    given = "|".join([*names, *(n.upper() for n in names)])
    upper = "[^\\W\\d_a-zß-öø-ÿа-яα-ω]"
    name = f"{upper}[^\\W\\d_]+(?:-{upper}[^\\W\\d_]+)?"
    pattern = re.compile(f"(?<!\\w)(?:(?:{titles})[ ](?:(?:{titles})[ ])*(?P<titled>{name}(?:[ ]{name})?)|(?P<full>(?:{given})[ ]{name})|(?:{'|'.join(INTRODUCTIONS)}),?[ ](?P<introduced>{name}[ ]{name}))(?!\\w)")
    return frozenset([*(t.rstrip(".") for t in TITLES), *INTRODUCTIONS, *names, *(n.upper() for n in names)]), pattern


#: Letters that a part of a name needs to be looked for by itself.
ALONE = 3


def _name_words(entity: str) -> list[str]:
    """The words of a name, and what stands between them, in turns."""
    return re.split(r"(\s+|-)", entity)


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order, without overlaps."""
    out = []
    if re.search(r"\d|@", text):
        for m in _MARKED.finditer(text):
            start, end = m.span()
            if m.lastgroup == "email":
                # A full stop or dash that ends the sentence before isn't part of the address.
                start += len(m[0]) - len(m[0].lstrip(".-+"))
            out.append((start, end, m.lastgroup))
    words, people = _people()
    # A listed name, title or introduction has no word character on either side, so it is one whole run of them.
    if not words.isdisjoint(re.findall(r"\w+", text)):
        marked, parts = len(out), set()
        for m in people.finditer(text):
            start, end = m.span(m.lastgroup)
            if all(end <= a or start >= b for a, b, _ in out[:marked]):
                out.append((start, end, "person"))
                parts.update(w for w in _name_words(m[m.lastgroup])[::2] if len(w) >= ALONE)
        if parts:
            # Whoever was named may be named again by one part of the name.
            taken = sorted(out)
            alone = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(parts | {w.upper() for w in parts}, key=len, reverse=True))) + r")(?!\w)")
            starts = [a for a, _, _ in taken]
            for m in alone.finditer(text):
                near = bisect_right(starts, m.start()) - 1
                if (near < 0 or taken[near][1] <= m.start()) and (near + 1 == len(taken) or taken[near + 1][0] >= m.end()):
                    out.append((*m.span(), "person"))
    return sorted(out)


def _candidates(kind: str, entity: str, key: bytes) -> Iterator[str]:
    """Surrogates by tweak, then from ever larger spaces, so that one that is free always follows.

    Names leave their lists for permuted letters; where a format may be used up, the last candidates are longer.
    """
    yield from (SURROGATES[kind](entity, key, tweak) for tweak in range(64))
    more = (lambda e, key, tweak: permuted(e, key, ("any", tweak))) if kind == "person" else SURROGATES[kind]
    yield from (more(entity, key, tweak) for tweak in range(64, 4096))
    longer = more(entity, key, 4096)
    for number in count():
        if kind in ("person", "email"):
            # The number in letters goes before the domain of an address, and after a name.
            letters = "".join("aeioubcdfg"[int(d)] for d in str(number))
            local, at, domain = longer.partition("@")
            yield f"{local}{_like(entity, letters) if entity.isupper() else letters}{at}{domain}"
        else:
            yield f"{longer}{number}"


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with all entities replaced, and what was found.

    Names are replaced word by word, so a part of a name gets what it has in the whole one.
    """
    found = entities(text)
    if not found:
        return text, found
    # What is replaced: whole entities, and the words of names, which count as one whatever their case.
    pieces = [(kind, piece) for a, b, kind in found for piece in (_name_words(text[a:b])[::2] if kind == "person" else [text[a:b]])]
    same = lambda kind, piece: piece.lower() if kind == "person" else piece
    originals = {same(kind, piece) for kind, piece in pieces}
    chosen: dict[tuple[str, str], int] = {}
    used: set[str] = set()
    for kind, piece in pieces:
        if (kind, same(kind, piece)) not in chosen:
            number, surrogate = next((n, s) for n, s in enumerate(_candidates(kind, piece, key)) if same(kind, s) not in used and same(kind, s) not in originals)
            chosen[kind, same(kind, piece)] = number
            used.add(same(kind, surrogate))

    @lru_cache(maxsize=None)
    def surrogate_of(kind: str, piece: str) -> str:
        return next(islice(_candidates(kind, piece, key), chosen[kind, same(kind, piece)], None))

    out, at = [], 0
    for a, b, kind in found:
        out.append(text[at:a])
        if kind == "person":
            out += [surrogate_of(kind, w) if k % 2 == 0 else w for k, w in enumerate(_name_words(text[a:b]))]
        else:
            out.append(surrogate_of(kind, text[a:b]))
        at = b
    return "".join([*out, text[at:]]), found


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_entities", pa.int32()), ("kinds", pa.string()), ("text", pa.string())])


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, n_entities, kinds, text) of every row of (doc_id, text); kinds is a sorted, comma-separated list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch):
                done = [replaced(t, key) if t is not None else (None, []) for t in texts]
                yield record_batch(_SCHEMA, {"doc_id": batch.column(0).slice(start, len(texts)), "n_entities": [len(f) for _, f in done], "kinds": [",".join(sorted({k for *_, k in f})) for _, f in done], "text": [t for t, _ in done]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_entities int, kinds string, text string")


def rewrite(docs: DataFrame, key: bytes) -> DataFrame:
    """All columns of docs, with surrogates in their texts."""
    return rewritten(docs, lambda texts: [replaced(t, key)[0] if t is not None else None for t in texts])
