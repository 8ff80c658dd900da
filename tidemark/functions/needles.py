"""Finding refused names in whole texts, however they are written: one automaton for all names and all their forms.

A text is read as its runs of letters and digits, compatibility-normalised, with letters that look like Latin ones folded and
letters that draw as nothing dropped. A name is found where whole neighbouring runs spell it, whatever stands between them
(signs, spaces, line ends), but never across the end of a sentence: a stop, space, and a capital. Texts are read as they are,
with percent escapes decoded, and with entities decoded; base64 forms of a name are looked for as they are.

The automaton reads a text once for all names. Runs, lines and columns are worked out only for texts in which it finds one.
"""

from __future__ import annotations

import base64
import html
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate
from urllib.parse import unquote

import ahocorasick

from tidemark.functions.words import LOOKALIKES

# The least characters of a base64 form that is looked for, signs that end a sentence, letters that aren't seen.
FORM_FLOOR = 12
SENTENCE_END = ".!?;"
UNSEEN = "ᅟᅠㅤ"

#: Ways a name is written, in the order in which they are reported.
WAYS = ["base64", "base64-url", "base64-bare", "squashed", "percent", "entities"]
_FOLD = str.maketrans({**LOOKALIKES, **dict.fromkeys(UNSEEN)})
_RUN = re.compile(r"[^\W_]+")
_BREAK = re.compile(rf"[{SENTENCE_END}]\s*[^\S\n]")


def plain(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text).translate(_FOLD)


def squashed(text: str) -> str:
    """Letters and digits of a text, as names are compared; empty for a name that has none."""
    return "".join(_RUN.findall(plain(text))).casefold()


def _breaks(text: str, runs: list[tuple[int, int]], first: int, last: int) -> frozenset[int]:
    """Where, in letters and digits after the first run, sentences end between runs[first:last]; text as plain() gives it."""
    sizes = accumulate(len(text[a:b].casefold()) for a, b in runs[first:last])
    return frozenset(at for k, at in zip(range(first + 1, last), sizes, strict=False) if text[runs[k][0]].isupper() and _BREAK.search(text, runs[k - 1][1], runs[k][0]))


def base64_forms(name: str) -> list[tuple[int, str]]:
    """(way, form) of the distinct base64 forms that are long enough to mean something."""
    raw = base64.b64encode(name.encode()).decode()
    forms = [raw, raw.translate(str.maketrans("+/", "-_")), raw.rstrip("=")]
    return [(k, f) for k, f in enumerate(forms) if len(f) >= FORM_FLOOR and f != name and f not in forms[:k]]


def under_floor(name: str) -> bool:
    """Whether some base64 form of a name is too short to be looked for."""
    raw = base64.b64encode(name.encode()).decode()
    return len(raw.rstrip("=")) < FORM_FLOOR


@lru_cache(maxsize=4)
def automata(names: tuple[str, ...]) -> tuple[ahocorasick.Automaton | None, ahocorasick.Automaton | None]:
    """(squashed, base64): for each form the names (by number) that have it; None without forms."""
    spelt: dict[str, list] = {}
    coded: dict[str, list] = {}
    for k, name in enumerate(names):
        if form := squashed(name):
            # A name that holds the end of a sentence is found only where one ends.
            runs = [m.span() for m in _RUN.finditer(plain(name))]
            spelt.setdefault(form, []).append((k, _breaks(plain(name), runs, 0, len(runs))))
            for way, code in base64_forms(name):
                coded.setdefault(code, []).append((k, way))
    made = []
    for forms in (spelt, coded):
        machine = ahocorasick.Automaton()
        for form, whose in forms.items():
            machine.add_word(form, (len(form), whose))
        if forms:
            machine.make_automaton()
        made.append(machine if forms else None)
    return made[0], made[1]


def _variants(text: str, entities: tuple[tuple[str, str], ...] | None) -> list[tuple[int, str]]:
    """The text, and what its lines read with escapes decoded, each on one line still."""

    def opened(line: str) -> str:
        if entities is None:
            return html.unescape(line)
        for entity, sign in entities:
            line = line.replace(entity, sign)
        return line

    out = [(3, text)]
    for way, sign, decode in ((4, "%", unquote), (5, "&", opened)):
        if sign in text:
            read = "\n".join(decode(line).replace("\n", " ").replace("\r", " ") for line in text.split("\n"))
            if read != text:
                out.append((way, read))
    return out


def _spelt(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(line, column, name) where whole runs of a text spell a name, in order; columns count normalised characters."""
    text = plain(text)
    hits = list(machine.iter("".join(_RUN.findall(text)).casefold()))
    if not hits:
        return []
    runs = [m.span() for m in _RUN.finditer(text)]
    sizes = [len(text[a:b].casefold()) for a, b in runs]
    starts = [0, *accumulate(sizes)]
    number = {at: k for k, at in enumerate(starts)}
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    found = []
    for end, (size, whose) in hits:
        first, last = number.get(end + 1 - size), number.get(end + 1)
        if first is None or last is None:
            continue
        at, breaks = runs[first][0], _breaks(text, runs, first, last)
        line = bisect_right(lines, at)
        found += [(end + 1 - size, line, at - lines[line - 1] + 1, k) for k, own in whose if own == breaks]
    return [f[1:] for f in sorted(found)]


def find(text: str, names: tuple[str, ...], entities: tuple[tuple[str, str], ...] | None = None) -> list[tuple[int, int, int, str]]:
    """(line, column, name, way) of a text, one for each line (from 1) and name (by number), by the first way that finds it.

    entities: the entities to decode, in turn, and their signs; without them all that HTML has, with or without a semicolon.
    """
    spelt, coded = automata(names)
    if spelt is None:
        return []
    text = "\n".join(text.splitlines())
    found: dict[tuple[int, int], tuple[int, int]] = {}
    if coded is not None and (hits := list(coded.iter(text))):
        lines = [0, *(m.end() for m in re.finditer("\n", text))]
        for end, (size, whose) in hits:
            line = bisect_right(lines, end + 1 - size)
            for name, way in whose:
                best = (way, end + 2 - size - lines[line - 1])
                found[line, name] = min(found.get((line, name), best), best)
    for way, variant in _variants(text, entities):
        for line, column, name in _spelt(variant, spelt):
            found.setdefault((line, name), (way, column))
    return sorted((line, column, name, WAYS[way]) for (line, name), (way, column) in found.items())
