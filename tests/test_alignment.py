"""Longest matching blocks against the standard library's matcher, on random sequences and on one long pair."""

import difflib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import blocks
from tidemark.functions import text as tx
from tidemark.operators import alignment


def opcodes(x, y):
    return [c for c in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if c[0] != "equal"]


def changed(rng, x, symbols):
    y = list(x)
    for _ in range(rng.randrange(8)):
        if y and rng.random() < 0.5:
            y.pop(rng.randrange(len(y)))
        else:
            y.insert(rng.randrange(len(y) + 1), rng.randrange(symbols))
    return y


@pytest.mark.parametrize("symbols", [1, 2, 4, 30])
def test_blocks_of_many_pairs_at_once(symbols):
    rng = random.Random(symbols)
    pairs = []
    for _ in range(250):
        x = [rng.randrange(symbols) for _ in range(rng.randrange(40))]
        pairs.append((x, changed(rng, x, symbols) if rng.random() < 0.6 else [rng.randrange(symbols) for _ in range(rng.randrange(40))]))
    a, b = (np.asarray([s for p in pairs for s in p[k]], dtype=np.int64) for k in (0, 1))
    ends = [np.cumsum([0, *(len(p[k]) for p in pairs)]) for k in (0, 1)]
    whole = np.stack([np.arange(len(pairs)), ends[0][:-1], ends[0][1:], ends[1][:-1], ends[1][1:]], axis=1)
    rest, left = blocks.split(a, b, whole)
    assert not len(rest)
    expected = sorted((k, i + ends[0][k], j + ends[0][k], m + ends[1][k], n + ends[1][k]) for k, p in enumerate(pairs) for _, i, j, m, n in opcodes(*p))
    assert sorted(map(tuple, left.tolist())) == expected


def test_ratios():
    rng = random.Random(4)
    pairs = [("".join(rng.choice("ab é") for _ in range(rng.randrange(30))), "".join(rng.choice("ab é") for _ in range(rng.randrange(30)))) for _ in range(300)]
    assert blocks.ratios(pairs).tolist() == [difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in pairs]


def spoken(rng, words, recording, tokens):
    """Segments of a few words each."""
    rows, at = [], 0
    while at < len(tokens):
        step = rng.randrange(1, 9)
        rows.append((recording, float(at), len(rows), " ".join(tokens[at : at + step])))
        at += step
    return rows


def renderings(spark, streams):
    rng, schema = random.Random(1), "recording_id long, start_s double, ord int, text string"
    return [spark.createDataFrame([r for key, pair in streams.items() if pair[k] is not None for r in spoken(rng, None, key, pair[k])] or [(-1, 0.0, 0, None)], schema) for k in (0, 1)]


def expected_regions(x, y, times, least=3):
    found = []
    for tag, i, j, k, m in opcodes(x, y):
        weighty = any(w in tx.SALIENT_WORDS or any(c.isdigit() for c in w) for w in x[i:j] + y[k:m])
        found.append((tag, times[i] if i < len(times) else times[-1] if times else 0.0, max(j - i, m - k), " ".join(x[i:j]), " ".join(y[k:m]), weighty))
    return sorted((r for r in found if r[2] >= least or r[5]), key=lambda r: (not r[5], -r[2])), found


@pytest.mark.parametrize("local", [alignment.LOCAL_TOKENS, 30])
def test_align_and_regions_by_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(alignment, "LOCAL_TOKENS", local)
    monkeypatch.setattr(alignment, "SPLIT_LEVELS", 1)
    rng = random.Random(2)
    vocabulary = [*"abcdefgh", "not", "7", "two"]
    streams = {}
    for key in range(30):
        x = [rng.choice(vocabulary) for _ in range(rng.randrange(90))]
        y = [w for w in x if rng.random() > 0.1]
        y = [rng.choice(vocabulary) if rng.random() < 0.1 else w for w in y]
        streams[key] = (x, y) if key % 5 else (x, [rng.choice(vocabulary) for _ in range(rng.randrange(60))])
    streams |= {40: (["one", "word"], None), 41: (None, ["other"])}
    base, other = renderings(spark, streams)
    found, aligned = {}, {r.recording_id: r for r in alignment.align(base, other).collect()}
    for r in alignment.regions(base, other).orderBy("recording_id", "rank").collect():
        found.setdefault(r.recording_id, []).append((r.tag, r.at_s, r.size, r.base, r.other, r.is_salient))
    starts = {}
    for r in base.orderBy("recording_id", "ord").collect():
        starts.setdefault(r.recording_id, []).extend([r.start_s] * len((r.text or "").split()))
    for key, (x, y) in streams.items():
        x, y = x or [], y or []
        if not x and not y:
            continue
        shown, every = expected_regions(x, y, starts.get(key, []))
        assert found.get(key, []) == shown
        want = (difflib.SequenceMatcher(None, x, y, autojunk=False).ratio(), len(every), sum(r[2] >= 3 for r in every), sum(r[5] for r in every))
        assert (aligned[key].ratio, aligned[key].regions, aligned[key].substantial, aligned[key].salient) == want


def test_a_long_pair_is_split_over_tasks(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(2000)]
    x = [words[int(rng.paretovariate(0.7)) % 2000] for _ in range(100_000)]
    y = [rng.choice(words) if rng.random() < 0.05 else w for w in x if rng.random() > 0.02]
    base, other = (spark.createDataFrame([(1, float(k), k, " ".join(s[k : k + 50])) for k in range(0, len(s), 50)], "recording_id long, start_s double, ord int, text string") for s in (x, y))
    rows, closed = alignment.opened(alignment.paired(base, other))
    assert rows.count() > 4 and rows.where(F.size("a") + F.size("b") > alignment.LOCAL_TOKENS).count() == 0 and closed
    dealt = alignment._dealt(rows).groupBy(F.spark_partition_id()).count().count()
    assert dealt > 1
    (r,) = alignment.align(base, other).collect()
    assert 0.9 < r.ratio < 0.96 and r.regions > 3000


def test_unified_diff_by_the_standard_library(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(60):
        x = [rng.choice("abcdef") for _ in range(rng.randrange(40))]
        y = changed(rng, x, 3)
        rows.append(("\n".join(x) + rng.choice(["", "\n"]), "\n".join(map(str, y)) + rng.choice(["", "\n"])))
    rows += [("", ""), ("a", "a"), ("", "a\n"), ("a\nb\n", "")]
    lines = lambda t: t.splitlines(keepends=True)
    found = spark.createDataFrame(rows, "x string, y string").select("x", "y", alignment.unified_diff("x", "y").alias("d")).collect()
    assert all(r.d == "".join(difflib.unified_diff(lines(r.x), lines(r.y), "before", "after")) for r in found)
    assert spark.createDataFrame([(None, "a\n")], "x string, y string").select(alignment.unified_diff("x", "y").alias("d")).first().d.endswith("+a\n")


def test_long_texts_are_compared_in_steps(spark, monkeypatch):
    rows = spark.createDataFrame([(1, k, "the quick brown fox jumps over the lazy dog " * 40 + str(k % 3)) for k in range(12)], "recording_id long, ord long, text string")
    from tidemark.operators import coverage

    monkeypatch.setattr(alignment, "STEP_SIGNS", 500)
    assert coverage.near_rows(rows).count() == 11


def test_spared_pairs_are_below_the_ratio():
    """most pairs were matched sign by sign, though the runs of signs that they share rule them out."""
    rng = random.Random(11)
    pairs = [("", ""), ("", "a"), ("a", "b"), ("ab", "ab")]
    for _ in range(600):
        a = "".join(rng.choice("abcde é") for _ in range(rng.randrange(60)))
        b = list(a)
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "x", "a"])
        pairs += [(a, "".join(b)), (a, "".join(rng.sample(a, len(a))))]
    may = alignment.may_reach(pairs, 0.85)
    exact = alignment.similarity.func(*(pd.Series(c) for c in zip(*pairs, strict=True)))
    found = alignment.similarity_from(0.85).func(*(pd.Series(c) for c in zip(*pairs, strict=True)))
    assert not (~may & (exact.to_numpy() >= 0.85)).any() and (~may).sum() > 300
    assert all(e == f for e, f in zip(exact, found, strict=True) if e >= 0.85 or f >= 0.85)


def in_order(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


@pytest.mark.parametrize("look", [1, 3, 64])
def test_signs_shared_in_order(look, monkeypatch):
    monkeypatch.setattr(blocks, "LOOK_SIGNS", look)
    rng = random.Random(look)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé 𝄞") for _ in range(rng.randrange(25))) for _ in range(2))
        shared, held = in_order(a, b), blocks.places(a)
        assert [blocks.share_in_order(held, len(a), b, k) for k in range(30)] == [k <= shared for k in range(30)]


def test_texts_of_the_same_signs_are_told_apart(monkeypatch):
    """texts of one language share their signs and most runs of three; each such pair was matched block by block."""
    rng = random.Random(1)
    words = ["".join(rng.choice("eeeetttaaooiinnsshhrdlu") for _ in range(rng.randrange(2, 8))) for _ in range(200)]
    line = lambda: " ".join(rng.choice(words) for _ in range(80))[:400]
    apart = [(line(), line()) for _ in range(60)]
    near = [(a, a[:100] + "xyz" + a[110:]) for a, _ in apart]
    pairs = [p for two in zip(apart, near, strict=True) for p in two]
    assert alignment.may_reach(pairs, 0.85).tolist() == [False, True] * 60
    matched = []
    monkeypatch.setattr(blocks, "ratios", lambda some, f=blocks.ratios: matched.extend(some) or f(some))
    found = alignment.similarity_from(0.85).func(*(pd.Series(c) for c in zip(*pairs, strict=True)))
    assert matched == near and [r >= 0.85 for r in found] == [False, True] * 60
    # Texts too long to be read for their order are matched, not left out.
    monkeypatch.setattr(alignment, "ORDER_SIGNS", 399)
    assert alignment.may_reach(near, 0.85).all()
    assert [r >= 0.85 for r in alignment.similarity_from(0.85).func(*(pd.Series(c) for c in zip(*pairs, strict=True)))] == [False, True] * 60


def test_near_rows_by_the_standard_library(spark):
    from tidemark.operators import coverage

    rng = random.Random(8)
    rows = []
    for recording in range(6):
        for k in range(60):
            known = [t for r, _, t in rows[-7:] if r == recording and t]
            text = list(rng.choice(known)) if known and rng.random() < 0.7 else [rng.choice("abcd é𝄞") for _ in range(rng.randrange(40))]
            for _ in range(rng.randrange(5)):
                text.insert(rng.randrange(len(text) + 1), rng.choice(["", "x", "a"]))
            rows.append((recording, 2 * k, rng.choice([None, "", "".join(text), "".join(text), "".join(text)])))
    expected = {}
    for recording in range(6):
        own = [(k, t) for r, k, t in rows if r == recording]
        for at, (k, t) in enumerate(own):
            like = [j for j, o in own[max(0, at - 5) : at] if t is not None and o is not None and difflib.SequenceMatcher(None, t, o, autojunk=False).ratio() >= 0.85]
            if like:
                expected[recording, k] = like[0]
    found = coverage.near_rows(spark.createDataFrame(rows, "recording_id long, ord long, text string").repartition(3)).collect()
    assert {(r.recording_id, r.ord): r.like_ord for r in found} == expected and len(found) == len(expected) > 50
