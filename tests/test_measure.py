"""The coverage record against a reading note by note, over whole recordings and over spans."""

import difflib
import random
import re

import pytest

from tidemark.operators import filing, notes

WORD = re.compile(r"[a-z0-9']+")


def stem(w):
    for suffix, more in [("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")]:
        if w.endswith(suffix) and len(w) - len(suffix) >= 4:
            return w[: -len(suffix)] + more
    return w


def seconds(stamp):
    total = 0
    for k, p in enumerate(map(int, stamp.split(":"))):
        if k and p > 59:
            return None
        total = total * 60 + p
    return float(total)


def record(lines, segments, span):
    """One note over one span; rows here are always well written."""
    windowed = span is not None
    lo, hi = span or (min(s[0] for s in segments), max(s[1] for s in segments))
    rows = []
    for line in lines:
        m = re.match(r"^\s*[-*]\s+`\[(\d+:\d\d)\]`\s+`([A-Z-]+)`\s+[—–-]+\s*(.*)$", line)
        if m:
            rows.append((seconds(m[1]), m[3].strip()))
    inside = [r for r in rows if lo <= r[0] <= hi]
    stamps = lambda line: [s for s in map(seconds, re.findall(r"\[(\d+:\d\d)\]", line)) if s is not None]
    scope = [line for line in lines if not windowed or any(lo <= s <= hi for s in stamps(line))]
    cutoff = max(1, min(3, len(segments) // 20))
    df = {}
    for s in segments:
        for t in set(WORD.findall(s[2].lower())):
            df[t] = df.get(t, 0) + 1
    kinds = {}
    for s in segments:
        if not (s[0] <= hi and s[1] >= lo):
            continue
        named = {w.lower() for sentence in re.split(r"[.!?]+", s[2]) for w in re.findall(r"[A-Za-z0-9']+", sentence)[1:] if len(w) > 1 and w[0].isupper() and w.lower() != "i"}
        for t in WORD.findall(s[2].lower()):
            best = 0 if any(c.isdigit() for c in t) else 1 if t in named else 2 if len(t) >= 4 and df[t] <= cutoff else 9
            kinds[t] = min(kinds.get(t, 9), best)
    wanted = {t: ("figures", "names", "terms")[k] for t, k in kinds.items() if k < 9}
    carried = lambda texts: {x for text in texts for t in WORD.findall(text.lower()) for x in (t, stem(t))}
    text, row = carried(scope), carried(r[1] for r in inside)
    hit = lambda t, held: t in held or stem(t) in held
    out = {"lo_s": lo, "hi_s": hi, "rows": len(inside), "rows_in_note": len(rows), "impossible": 0, "misshapen": 0, "row_words": sum(len(r[1].split()) for r in inside), "note_words": sum(len(line.split()) for line in scope)}
    out |= {"wanted": len(wanted), "carried": sum(hit(t, text) for t in wanted), "carried_by_rows": sum(hit(t, row) for t in wanted)}
    for kind in ("figures", "names", "terms"):
        own = [t for t, k in wanted.items() if k == kind]
        out |= {f"of_{kind}": len(own), f"carried_{kind}": sum(hit(t, text) for t in own), f"by_rows_{kind}": sum(hit(t, row) for t in own)}
    anchors = [s for line in lines for s in stamps(line) if len(WORD.findall(re.sub(r"`?\[\d+:\d\d\]`?", " ", line).lower())) >= 4 and lo <= s <= hi]
    out |= {"anchors": len(anchors), "anchored_seconds": len(set(anchors)), "refused_seconds": 0}
    minutes = max(1, int((hi - lo) // 60) + 1)
    live = {int((a - lo) // 60) for a in anchors}
    runs, k = [(0, 0)], 0
    while k < minutes:
        n = 0
        while k + n < minutes and k + n not in live:
            n += 1
        runs.append((n, -k))
        k += n + 1
    best = max(r[0] for r in runs)
    out |= {"dead": minutes - len(live), "minutes": minutes, "dead_run": best, "dead_run_at": lo + 60 * -max(r for r in runs if r[0] == best)[1] if best else lo}
    keys = [" ".join(WORD.findall(r[1].lower())) for r in inside]
    out["near_rows"] = sum(bool(key) and any(o and difflib.SequenceMatcher(None, key, o, autojunk=False).ratio() >= 0.85 for o in keys[max(0, k - 5) : k]) for k, key in enumerate(keys))
    said, wrote = WORD.findall(" ".join(s[2] for s in segments).lower()), WORD.findall(re.sub(r"`?\[\d+:\d\d\]`?", " ", "\n".join(scope)).lower())
    grams = {tuple(said[k : k + 12]) for k in range(len(said) - 11)}
    marked = {k + j for k in range(len(wrote) - 11) if tuple(wrote[k : k + 12]) in grams for j in range(12)}
    out["verbatim"] = len(marked) / len(wrote) if wrote else 0.0
    ratio = lambda a, b: out[a] / out[b] if out[b] else 0.0
    return out | {"recall": ratio("carried", "wanted"), "carried_per_row": ratio("carried_by_rows", "rows"), "near_share": ratio("near_rows", "rows"), "words_per_token": ratio("row_words", "carried_by_rows"), "list_density": ratio("carried", "note_words")}


@pytest.fixture(scope="module")
def made():
    rng = random.Random(11)
    words = "market growth prices Berlin Paris 1994 42nd companies dragging because inflation numbers policy not really simply".split()
    segments = {r: [(7.0 * k, 7.0 * k + 6, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 20))) + rng.choice([".", ""])) for k in range(60)] for r in (1, 2)}
    lines = {}
    for r, own in segments.items():
        lines[r] = [f"- `[{k // 60:02d}:{k % 60:02d}]` `SPOKEN` — " + " ".join(rng.choice(words) for _ in range(rng.randrange(2, 9))) for k in sorted(rng.sample(range(420), 25))]
        lines[r] += lines[r][-2:] + ["prose about " + own[3][2], f"then [02:{r:02d}] " + own[5][2] + " " + own[6][2], "nothing"]
    return lines, segments


@pytest.mark.parametrize("windowed", [False, True])
def test_records(spark, made, windowed):
    lines, segments = made
    body = spark.createDataFrame([(r, k, t) for r, own in lines.items() for k, t in enumerate(own)], "recording_id long, line_no int, text string")
    said = spark.createDataFrame([(r, k, *s) for r, own in segments.items() for k, s in enumerate(own)], "recording_id long, ord long, start_s double, end_s double, text string")
    asked = [(r, k, lo, hi) for r in lines for k, (lo, hi) in enumerate([(0.0, 100.0), (90.0, 300.0), (0.0, 426.0), (5000.0, 6000.0)])]
    spans = spark.createDataFrame(asked, "recording_id long, span_no int, lo_s double, hi_s double") if windowed else None
    found = {(r.recording_id, r.span_no): r.asDict() for r in notes.measure(body, said, spans).collect()}
    wanted = {(r, k): record(lines[r], segments[r], (lo, hi)) for r, k, lo, hi in asked} if windowed else {(r, 0): record(lines[r], segments[r], None) for r in lines}
    assert found.keys() == wanted.keys()
    for key, want in wanted.items():
        got = {k: v for k, v in found[key].items() if k not in ("recording_id", "span_no")}
        assert got.keys() == want.keys()
        assert {k: (got[k], v) for k, v in want.items() if got[k] != pytest.approx(v, abs=1e-9)} == {}, key


def test_quotes_by_their_rarest_piece(spark):
    rng = random.Random(3)
    files = {f"f{k}.md": "\n".join(rng.choice(["", "# head", "- item", ""]) + "".join(rng.choice("abcé ") for _ in range(rng.randrange(30))) for _ in range(30)) for k in range(4)}
    listing = spark.createDataFrame([(p, f"s{p}", t) for p, t in files.items()] + [("gone.md", "s", None)], "path string, sha256 string, text string")
    texts = [t for t in files.values()]
    quotes = [(rng.choice([*files]), (lambda t, a: t[a : a + rng.choice([1, 2, 3, 9, 14])])(rng.choice(texts), rng.randrange(300)).replace('"', "")) for _ in range(150)] + [("gone.md", "abc"), ("f0.md", "zzzzzzzzz")]
    bodies = spark.createDataFrame([("n", "\n".join(f'{{{{CITE:{p}#"{q}"}}}}' for p, q in quotes))], "note string, body string")
    found = filing.resolved_citations(bodies, listing).collect()
    blocks = filing.plain_lines(listing).collect()
    wholes = {}
    for b in sorted(blocks, key=lambda b: (b.path, b.block, b.line_no)):
        wholes.setdefault((b.path, b.block), []).append((b.line_no, b.plain))
    for r in found:
        hits = []
        for (path, block), own in wholes.items():
            whole, ends = "", []
            for line_no, plain in own:
                whole += ("" if not plain or not whole else " ") + plain
                ends.append((len(whole), line_no))
            at = whole.find(r.quote)
            if path == r.path and r.quote and at >= 0:
                hits.append((block, next(n for end, n in ends if end > at)))
        if not r.quote:
            assert r.code == "E-CITE-EMPTY"
        elif r.path == "gone.md":
            assert r.code == "E-CITE-UNREADABLE"
        else:
            assert (r.code, r.target_line) == ((None, min(hits)[1]) if hits else ("E-CITE-NOMATCH", None)), (r.quote, r.path)
    plan = filing.holding_blocks(filing.citations(bodies), listing.selectExpr("path", "0 as block", "text as whole"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("instr") < plan.rindex("Join")  # the tree is printed from the top: the search stands above the joins
