"""Scans of whole texts: refused names in any spelling, by a reading sign by sign, and the findings by line."""

import base64
import random
import unicodedata

import pytest

from tidemark.functions import needles
from tidemark.functions.words import LOOKALIKES
from tidemark.operators import scan
from tidemark.plans import evidence

NAMES = ["acme private", "日本", "Dr. Who", "a1", "", "...", "straße", "ab", "abc", "b c"]


def by_signs(text, names):
    """Runs of letters and digits, one sign at a time; every start and every number of runs is tried."""
    text = unicodedata.normalize("NFKC", "\n".join(text.splitlines())).translate(str.maketrans({**LOOKALIKES, **dict.fromkeys(needles.UNSEEN)}))

    def runs_of(t):
        runs, line, column, inside = [], 1, 1, False
        for k, c in enumerate(t):
            if c.isalnum():
                if not inside:
                    back = k - 1
                    ends = False
                    # A space somewhere before this run whose nearest sign before is a stop.
                    while back >= 0 and not t[back].isalnum():
                        if t[back].isspace() and t[back] != "\n":
                            j = back
                            while j >= 0 and t[j].isspace():
                                j -= 1
                            ends = ends or (j >= 0 and t[j] in needles.SENTENCE_END)
                        back -= 1
                    runs.append(["", line, column, bool(runs) and ends and c.isupper()])
                runs[-1][0] += c.casefold()
            inside = c.isalnum()
            line, column = (line + 1, 1) if c == "\n" else (line, column + 1)
        return runs

    runs, found = runs_of(text), {}
    for k in range(len(runs)):
        for number, name in enumerate(names):
            own = runs_of(unicodedata.normalize("NFKC", name).translate(str.maketrans(LOOKALIKES)))
            want, marks = "".join(r[0] for r in own), [sum(len(x[0]) for x in own[:j]) for j, r in enumerate(own) if r[3]]
            for stop in range(k + 1, len(runs) + 1):
                met = "".join(r[0] for r in runs[k:stop])
                if want and met == want and marks == [sum(len(x[0]) for x in runs[k : k + j]) for j, r in enumerate(runs[k:stop]) if j and r[3]]:
                    found.setdefault((runs[k][1], number), runs[k][2])
                if len(met) > 30:
                    break
    return sorted((line, column, number, "squashed") for (line, number), column in found.items())


def test_names_are_found_as_signs_say():
    rng = random.Random(5)
    parts = ["acme", "private", "Private", "ACME", "日本", "dr", "Dr", "Who", "who", "a", "1", "b", "c", "ab", "strasse", "STRAẞE", "аcme", "ｐrivate", "x", "ﬀ", "é", "C"]
    joints = [" ", "-", "_", ". ", ".", "! ", "\n", ".\n", ". \n", "\r\n", "", "  ", "; (", "** ", " ", "ᅠ"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) + rng.choice(joints) for _ in range(rng.randrange(12)))
        assert needles.find(text, tuple(NAMES)) == by_signs(text, NAMES), repr(text)


def rows(found):
    return sorted((r.source_id, r.line_no, r.column, r.name, r.way) for r in found.collect())


def test_ways_of_writing(spark):
    coded = base64.b64encode(b"acme private").decode()
    texts = {
        "broken": "see ac\nthe acme\nprivate page", "lookalike": "the асme privаte page", "sentence": "sold the acme. Private buyers came", "wrapped": "acme.\nPrivate", "inside": "xacme private acme privates",
        "percent": "one\n%61cme%20private", "entity": "acme &#112;rivate", "newline": "a%0Ab\nacme%0Aprivate", "base64": f"key={coded} and {coded}", "twice": "acme private, acme-private\nacme private", "none": "nothing", "han": "in 日本 but not 日本語",
    }
    files = spark.createDataFrame([*texts.items(), ("null", None), ("empty", "")], "source_id string, text string").repartition(3)
    expected = [
        ("base64", 1, 5, 1, "base64"), ("broken", 2, 5, 1, "squashed"), ("entity", 1, 1, 1, "entities"), ("han", 1, 4, 2, "squashed"), ("lookalike", 1, 5, 1, "squashed"), ("newline", 2, 1, 1, "percent"),
        ("percent", 2, 1, 1, "percent"), ("twice", 1, 1, 1, "squashed"), ("twice", 2, 1, 1, "squashed"), ("wrapped", 1, 1, 1, "squashed"),
    ]
    assert rows(scan.literals(files, NAMES[:2])) == expected
    assert rows(scan.literals(files, ["", "...", " "])) == rows(scan.literals(files, [])) == []
    assert rows(scan.literals(files.limit(0), NAMES)) == []


@pytest.mark.parametrize("size", [1 << 20, 60, 1])
def test_names_beyond_one_automaton_take_turns(spark, monkeypatch, size):
    monkeypatch.setattr(scan, "AUTOMATON_BYTES", size)
    names = [f"name{k}" for k in range(40)]
    assert len(scan._turns(names)) == {1 << 20: 1, 60: 19, 1: 40}[size]
    files = spark.createDataFrame([(k, f"x name{k}; Name-{k + 1} end") for k in range(0, 40, 7)], "source_id long, text string")
    assert [r[3] for r in rows(scan.literals(files, names))] == [n for k in range(0, 40, 7) for n in (k + 1, k + 2) if n <= 40]


def test_findings_of_whole_texts(spark):
    sets = spark.createDataFrame([(1, [7, 13, 61])], "set_id long, seconds array<long>")
    text = "clean\nid Qm4Zt8Xv2Ly and Qm4Zt8Xv2Ly\nfrom 0:07 to 0:13\r\n# 1999-01-01 exempt: x\n# reaped on 1999-01-01\nwritten 1999-01-01\nacme\nprivate"
    found = scan.findings(spark.createDataFrame([("f", text)], "source_id string, text string"), ["acme private"], sets)
    assert sorted((r.line_no, r.code, r.name, r.column) for r in found.collect()) == [
        (2, scan.ID, None, None), (2, scan.ID, None, None), (3, scan.STAMPS, None, None), (4, scan.DATED, None, None), (5, scan.DATED, None, None), (7, scan.LITERAL, 1, 1)
    ]
    assert scan.findings(spark.createDataFrame([("f", text)], "source_id string, text string"), [], sets, allowed=["Qm4Zt8Xv2Ly"]).where(f"code = '{scan.ID}'").count() == 0


def test_a_long_text_and_many_names(spark):
    text = "lorem ipsum dolor " * 60_000 + "acme_private" + " sit amet" * 1000
    names = [f"secret {k} name" for k in range(20_000)] + ["acme private"]
    files = spark.createDataFrame([("long", text)], "source_id string, text string")
    assert rows(scan.literals(files, names)) == [("long", 1, 60_000 * 18 + 1, 20_001, "squashed")]


def test_entities_are_those_that_the_sql_decodes(spark, tmp_path):
    """a title cut within an entity, or an entity that the SQL doesn't name, moved the columns after it."""
    text = "<title>a&amp</title> &copy; b the&nbsp;of"
    spark.createDataFrame([(1, text)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = evidence.refused_literals(spark, str(tmp_path)).collect()
    assert (row.line_no, row["column"], row.name, row.way) == (1, text.index("the&") + 1, 4, "entities")
    assert needles.find(text, ("the.of",))[0][1] < text.index("the&") + 1
