"""Queries whose results once left out rows, on small tables with answers known by hand."""

from tidemark.plans import evidence, intervals

LONG = " ".join(["alpha"] * 120)


def written(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_truth_vs_claim_reads_every_document(spark, tmp_path):
    documents = ([(k, 600 if k < 4 else 100) for k in range(8)], "doc_id long, n_chars long")
    labels = ([(0, 1), (3, 0), (6, 0), (1, 1), (9, 1), (10, 0)], "doc_id long, quality int")
    found = evidence.truth_vs_claim(spark, written(spark, tmp_path, documents=documents, labels=labels)).collect()
    expected = {0: "correct", 3: "mispaired", 6: "correct", 1: "correct", 9: "unread", 10: "unread", 2: "extra", 4: "extra", 5: "extra", 7: "extra"}
    assert len(found) == len(expected) and {r.name: r.verdict for r in found} == expected


def turns(count):
    """Turns of one conversation, a user's first; each pair says the same words."""
    words = "alpha bravo charlie delta golf hotel"
    return [("c", k, "user" if k % 2 == 0 else "assistant", words) for k in range(count)], "conv_id string, turn long, role string, text string"


def test_spoken_vote_scores_items_after_the_first_minute(spark, tmp_path):
    (row,) = evidence.spoken_vote(spark, written(spark, tmp_path, conversations=turns(40))).collect()
    assert (row.spoken, row.beyond, row.short, row.witnessed, row.unwitnessed) == (20, 0, 0, 20, 0)


def test_thin_spans_reach_the_end_of_a_long_conversation(spark, tmp_path):
    rows = [("c", k, "user" if k % 2 == 0 else "assistant", "hm" if k % 2 == 0 else LONG) for k in range(40)] + [("d", 0, "assistant", LONG), ("d", 2, "assistant", LONG), ("d", 20, "user", "")]
    found = intervals.thin_spans(spark, written(spark, tmp_path, conversations=(rows, "conv_id string, turn long, role string, text string"))).collect()
    assert sorted((r.recording_id, r.chunk) for r in found) == [*(("c", k) for k in range(20)), ("d", 0), ("d", 1)]
