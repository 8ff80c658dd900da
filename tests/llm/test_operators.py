"""Each training-data operator against a brute-force version, on a small table of awkward rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import fingerprint, induced_sort, language_id, media, near_dedup, packing, piece_bpe, sharding, suffix_dedup, surrogates, url_filter
from tidemark.llm.queries import tokenizer_path

KEY = b"tests"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, rep long, bucket int, h long, part int, kind string"


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    words = {"en": "the and of with there thing water other house people".split(), "de": "und der nicht auch über schön groß werden zwischen straße".split()}
    rows: list[tuple] = []

    def add(text, lang="en"):
        rows.append((len(rows), text, lang, "src", len(text or ""), 1, 2, 3, 4, 5, "k"))

    base = {lang: [" ".join(rng.choice(w) + rng.choice(["", "s", "en"]) for _ in range(120)) for _ in range(6)] for lang, w in words.items()}
    for _ in range(60):
        lang = rng.choice(["en", "de"])
        text = rng.choice(base[lang]).split(" ")
        for _ in range(rng.choice([0, 0, 1, 6, 40])):
            text[rng.randrange(len(text))] = rng.choice(words[lang])
        add(" ".join(text), lang)
    for text in (None, "", " ", "a", "one two three four", "one two three four", "?! 123", "x" * 5000, "ab" * 700, "\n\n", "日本語のテキスト", "é ▁ <|endoftext|> it's", "Call +1 (212) 555-0198 or mail ana.b@mail.example.com"):
        add(text, None)
    add(" ".join(base["en"] * 40))
    rows.append(rows[3])
    rows.append(rows[3])
    rows.append((None, base["en"][0], "en", None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_induced_sort_spills_and_recurses():
    rng = np.random.default_rng(2)
    for n, symbols in ((1, 1), (50, 2), (400, 3), (700, 5)):
        text = np.tile(rng.integers(0, symbols, max(1, n // 3)), 3).astype(np.uint16)
        n = len(text)
        pool = induced_sort.Pool(budget=200, base=0, depth=255, block=8)
        found = [(a, b) for at, lcp in induced_sort.suffixes(text, symbols, pool) for a, b in zip(at.tolist(), lcp.tolist(), strict=True)][::-1]
        order = sorted(range(n), key=lambda k: text[k:].tolist())
        assert [a for a, _ in found] == order
        for (a, lcp), (b, _) in zip(found, found[1:], strict=False):
            x, y = text[a:].tolist(), text[b:].tolist()
            assert lcp == min(255, next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y))))
        assert n < 390 or pool.spilled


def removed_by_brute_force(rows, length=100):
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        kept = [True] * len(raw)
        for at in range(len(raw) - length + 1):
            window = raw[at : at + length]
            if seen.setdefault(window, (doc, at)) != (doc, at):
                kept[at : at + length] = [False] * length
        runs = sum(not k and (at == 0 or kept[at - 1]) for at, k in enumerate(kept))
        out[doc] = (len(raw), kept.count(False), runs, hashlib.sha256(bytes(b for b, k in zip(raw, kept, strict=True) if k)).hexdigest())
    return out


@pytest.mark.parametrize("budget", [64 << 20, 1000])
def test_suffix_dedup(docs, rows, budget):
    found = suffix_dedup.dedup(docs, budget=budget).collect()
    assert len(found) == len(rows)
    expected = removed_by_brute_force([(r[0], r[1]) for r in rows])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == expected


def test_suffix_dedup_splits_hot_minimizers(rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", 1)
    import pyarrow as pa

    own = [(r[0] if r[0] is not None else suffix_dedup._LAST_ID, r[1] or "") for r in dict.fromkeys((r[0], r[1]) for r in rows)]
    batch = pa.record_batch({"doc_id": [o[0] for o in own], "text_hash": [0] * len(own), "text": pa.array([o[1].encode() for o in own], pa.binary())})
    to = lambda f, batches, order=False: list(f(iter(sorted(batches, key=lambda b: b.column(1)[0].as_py()) if order else batches)))
    spans = to(suffix_dedup._meet(1), to(suffix_dedup._cut(1), [batch]))
    texts = to(suffix_dedup._text_blocks(1), [batch])
    more = to(suffix_dedup._compare(1, 1 << 20), to(suffix_dedup._contents(1), [*spans, *texts]))
    found = {d: tuple(r) for b in to(suffix_dedup._apply, [*spans, *more, *texts]) for d, *r in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True)}
    expected = removed_by_brute_force([(o[0], o[1]) for o in own])
    assert found == expected


def test_suffix_dedup_sorts_groups_of_bounded_size(rows, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 5_000)
    sizes, repeats = [], suffix_dedup._repeats
    monkeypatch.setattr(suffix_dedup, "_repeats", lambda pieces, raw, pool: (sizes.append(len(raw)), repeats(pieces, raw, pool))[1])
    own = [(r[0] if r[0] is not None else suffix_dedup._LAST_ID, r[1] or "") for r in dict.fromkeys((r[0], r[1]) for r in rows)]
    batch = pa.record_batch({"doc_id": [o[0] for o in own], "text_hash": [0] * len(own), "text": pa.array([o[1].encode() for o in own], pa.binary())})
    to = lambda f, batches: list(f(iter(batches)))
    spans = to(suffix_dedup._meet(1), to(suffix_dedup._cut(1), [batch]))
    texts = to(suffix_dedup._text_blocks(1), [batch])
    contents = to(suffix_dedup._contents(3), [*spans, *texts])
    assert sum(b.num_rows for b in contents) <= 3
    more = to(suffix_dedup._compare(1, 1 << 20), contents)
    assert len(sizes) > 3 and max(sizes) < sum(sizes) / 3
    found = {d: tuple(r) for b in to(suffix_dedup._apply, [*spans, *more, *texts]) for d, *r in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True)}
    assert found == removed_by_brute_force([(o[0], o[1]) for o in own])


def test_rewrite_keeps_columns(docs, rows, empty):
    out = suffix_dedup.rewrite(docs)
    assert out.schema.names == docs.schema.names and out.count() == len(rows)
    row = {r.doc_id: r for r in out.collect()}
    assert row[0].text == rows[0][1] and row[0].n_chars == len(rows[0][1]) and row[0].kind == "k"
    assert suffix_dedup.rewrite(empty).count() == 0 and suffix_dedup.dedup(empty).count() == 0


def components_by_brute_force(rows):
    sets = defaultdict(set)
    for doc, text in rows:
        if doc is None:
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] |= {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_near_dedup(docs, rows, empty):
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    expected = components_by_brute_force([(r[0], r[1]) for r in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    found = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(31)} | {100 + k: 100 for k in range(50)}


def test_shingles_are_distinct_words(rows):
    texts = [r[1] for r in rows]
    values, sizes = near_dedup.shingle_sets(texts)
    for text, size in zip(texts, sizes.tolist(), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        assert size == (len({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}) if words else 0)


def test_sharding(docs, rows, empty):
    found = sharding.shard(docs, 4).collect()
    assert len(found) == len(rows) and {r.law for r in found} == {"bytes"}
    by_text = defaultdict(set)
    text_of = {r[0]: r[1] for r in rows}
    for r in found:
        text = text_of[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.grown_shard) == (len(text.encode()) + 1, zlib.crc32(text.encode()), None)
        by_text[text].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for shard in range(4):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty).count() == 0


def smallest_capacity(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle, used, fill = (low + high) // 2, 1, 0
        for s in sizes:
            if fill + s > middle:
                used, fill = used + 1, 0
            fill += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("seed", range(4))
def test_minimax_capacity(spark, seed, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    monkeypatch.setattr(sharding, "LEVEL_SEGMENTS", 20)
    rng = random.Random(seed)
    groups = [(rng.randrange(-(1 << 63), 1 << 63), rng.choice([1, 5, 40, 900 if seed % 2 else 3])) for _ in range(300)]
    capacity, starts = sharding.boundaries(spark.createDataFrame(groups, "h long, bytes long"), 5)
    groups.sort()
    assert capacity == smallest_capacity([b for _, b in groups], 5)
    sums = Counter()
    for h, size in groups:
        sums[sum(h + (1 << 63) >= s for s in starts)] += size
    assert max(sums.values()) == capacity and len(starts) == 4


def test_packing(docs, rows, empty):
    path = tokenizer_path("word_bpe_49k.json")
    found = packing.pack(docs, path).collect()
    encoder = packing.WordEncoder(path)
    expected = Counter()
    for r in rows:
        ids = [*encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            cut = ids[at : at + 2048]
            expected[(r[0], piece, at, len(cut), zlib.crc32(np.asarray(cut, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= -(-sum(r.length for r in found) // 2048) + 1
    assert packing.pack(empty, path).count() == 0


def test_two_fit_replaces_the_smallest():
    counts = np.zeros(11, dtype=np.int64)
    counts[[6, 3, 2]] = 1, 1, 2
    # 6 and 3 leave a gap of 1, which 2 and 2 in place of 3 close.
    assert packing.two_fit(counts, 10) == [(1, [6, 2, 2]), (1, [3])]
    rng = np.random.default_rng(3)
    for _ in range(30):
        counts = np.concatenate([[0], rng.integers(0, 50, 64)])
        used = np.zeros(65, dtype=np.int64)
        for times, pattern in packing.two_fit(counts, 64):
            assert times > 0 and sum(pattern) <= 64
            used += np.bincount(pattern, minlength=65) * times
        assert (used == counts).all()


def test_word_encoder_is_the_tokenizer():
    rng = random.Random(4)
    encoder = packing.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    signs = list("ab  eÉé日\n\t<>|s't/.,19²½ªµß×÷ 😀İΣ\x85")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(400)] + ["<|startoftext|> a", "it's"]
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [found.tolist() for found in encoder.encode(texts)] == expected


def test_sentencepiece(docs, rows, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    library = piece_bpe.codec(path).library
    expected = {}
    for r in rows:
        ids = library.encode(r[1] or "", add_bos=True, add_eos=True)
        expected[r[0]] = (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    found = piece_bpe.encode_decode(docs, path).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == expected
    assert piece_bpe.encode_decode(empty, path).count() == 0


def test_sentencepiece_on_odd_texts():
    rng = random.Random(6)
    own = piece_bpe.MergeCodec(tokenizer_path("piece_bpe_32k.model"))
    signs = list("ab  e▁é日\n\t<>s/.,1 ​﻿ 😀\0")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(500)]
    ids = own.encode(texts)
    decoded = own.decode_all(ids)
    own.check(texts, ids, decoded)
    assert [own.decode(np.frombuffer(b, "<u4").tolist()).encode() for b in ids] == decoded


def test_media(docs, rows, empty):
    found = {r.doc_id: r for r in media.media_columns(docs).collect()}
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        row = found[r[0]]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.decode(bytes(row.media)).tobytes() == payload and row.media_sha256 == hashlib.sha256(row.media).hexdigest()
    assert media.media_columns(empty).count() == 0


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_filters_and_checks(channels):
    rng = np.random.default_rng(channels)
    samples = rng.integers(0, 256, (9, 7, channels) if channels > 1 else (9, 7)).astype(np.uint8)
    for kind in (media.NONE, media.SUB, media.UP):
        data = media.encode(samples, 6, kind)
        assert (media.decode(data) == samples).all()
        for at in (9, 20, 45, len(data) - 3):
            with pytest.raises(ValueError):
                media.decode(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    rows = samples.reshape(9, -1).astype(np.int64)
    for kind in (media.AVERAGE, media.PAETH):
        raw = np.zeros((9, rows.shape[1] + 1), dtype=np.uint8)
        raw[:, 0] = kind
        for y in range(9):
            for x in range(rows.shape[1]):
                left, up = rows[y, x - channels] if x >= channels else 0, rows[y - 1, x] if y else 0
                corner = rows[y - 1, x - channels] if y and x >= channels else 0
                base = left + up - corner
                guess = (left + up) // 2 if kind == media.AVERAGE else min((left, up, corner), key=lambda v: abs(base - v))
                raw[y, x + 1] = (rows[y, x] - guess) & 255
        assert (media.unfilter(raw, channels) == rows).all()


def test_fingerprints(docs, rows, empty):
    found = fingerprint.neighbours(docs).collect()
    assert len(found) == len(rows)
    whole = [r for r in rows if Counter(x[0] for x in rows)[r[0]] == 1]
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    after = {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    by_id = {r.doc_id: r for r in found}
    for r in whole:
        text, row = r[1] or "", by_id[r[0]]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[r[0]][:half]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        same = fingerprint.as_text(*fingerprint.digests([text.encode()]))[0]
        assert row.fingerprint == same and row.near_edited == pytest.approx(fingerprint.compare(same, row.edited_fingerprint))
        assert row.near_next == pytest.approx(fingerprint.compare(same, fingerprint.as_text(*fingerprint.digests([after[r[0]].encode()]))[0]))
    assert fingerprint.neighbours(empty).count() == 0
    assert fingerprint.neighbours(docs.where("doc_id = 0")).count() == 1


def test_triplets_by_brute_force():
    texts = [b"", b"ab", b"abc", bytes(range(256)) * 3]
    counts = fingerprint.triplet_counts(texts)
    assert counts.sum(axis=1).tolist() == [0, 0, 1, 766]
    assert (counts[2] == fingerprint.triplet_counts([b"abc"])[0]).all()


def test_language_id(docs, rows, empty):
    found = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for r in rows:
        row = found[r[0]]
        assert row.held_out == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1)
        if not any(c.isalpha() for c in r[1] or ""):
            assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)
        elif r[2]:
            assert row.lang_pred == r[2] and 0.5 < row.score <= 1 and not row.rejected
    assert language_id.identify(empty).count() == 0


def test_kneser_ney_is_a_distribution():
    texts = ["the cat sat on the mat and the dog sat too", "another thing"]
    grams, _ = language_id.grams_of(texts)
    model = language_id.KneserNey(*language_id._counted(grams), symbols=len(np.unique(grams & np.uint64(0xFFFF))))
    symbols = np.unique(grams & np.uint64(0xFFFF))
    for context in (grams[5], grams[20], np.uint64(0x7A7A007A0000)):
        every = (context & ~np.uint64(0xFFFF)) | symbols
        # What is left over belongs to symbols that were never seen.
        assert 0.9 < np.exp(model.logp(every)).sum() <= 1.0001


def test_url_filter(spark):
    urls = [(1, "https://A.Example.com/en/7?x"), (2, "http://x.example.net/de/81#t"), (3, "http://example.net/de/9"), (4, None), (5, "no scheme"), (6, "ftp://bad.example.org/x"), (7, "http://www.fine.org/es/"), (8, "http://notexample.com/en/7"), (8, "http://notexample.com/en/7")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(6, 0, 1)] * 40 + [(3, 1, 0)] * 40 + [(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert [(found[k].host, found[k].path, found[k].rule, found[k].verdict) for k in range(1, 9)] == [
        ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("x.example.net", "/de/81", "example.net/de/8", "block"), ("example.net", "/de/9", "net/de/", "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("bad.example.org", "/x", None, "block"), ("www.fine.org", "/es/", "org/es/", "block"), ("notexample.com", "/en/7", "com/en/", "block"),
    ]
    assert url_filter.judge(pages, labels).count() == len(urls)
    assert url_filter.judge(pages, labels.limit(0)).where("rule is null and verdict = 'block'").count() == 0
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_surrogates(docs, rows, empty):
    found = {r.doc_id: r for r in surrogates.surrogates(docs, KEY).collect()}
    for r in rows:
        assert r[1] is None or "555-0198" in r[1] or found[r[0]].text == r[1]
    text = "Ana ana.b@x.example.com, +1 (212) 555-0198, 10.1.2.3, 4111 1111 1111 1111; ANA.B@X.EXAMPLE.COM Mr. Juan Pérez, Maria Pérez"
    out, kinds = surrogates.replaced(text, KEY)
    assert Counter(k for *_, k in kinds) == {"email": 2, "phone": 1, "ip": 1, "card": 1, "person": 2}
    for original in ("ana.b@", "555-0198", "10.1.2.3", "4111 1111", "Pérez", "Juan"):
        assert original not in out
    email = re.search(r"\S+@x\.example\.com", out)[0]
    assert email.upper() in out.replace(email, "", 1)
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", out)[0].replace(" ", "")
    assert surrogates.luhn_digit(card[:-1]) == int(card[-1])
    family = re.findall(r"(?:Mr\. )?\w+ (\w+)", out.split(" ", 5)[-1])
    assert len(set(re.findall(r"(\w+)(?:,|$)", out[out.index("Mr. ") :]))) == 1, family
    assert surrogates.replaced(out, KEY)[0] != out and surrogates.surrogates(empty, KEY).count() == 0
    assert surrogates.replaced(text, b"other key")[0] != out


def test_rare_grams_stay_in_large_models(spark):
    common, rare = "the and of with there thing water other house people " * 200, "zqxj vkwq"
    rows = spark.range(900).selectExpr("id as doc_id", "'en' as lang").crossJoin(spark.createDataFrame([(common,)], "text string"))
    rows = rows.unionByName(spark.createDataFrame([(1000, "en", rare)], "doc_id long, lang string, text string"))
    (found,) = language_id.predict(spark.createDataFrame([(1, rare)], "doc_id long, text string"), language_id.fit(rows)).collect()
    many, few = language_id.grams_of([common])[0], language_id.grams_of([rare])[0]
    grams, counts = language_id._merged([(k, n * times) for own, times in ((many, 900), (few, 1)) for k, n in [language_id._counted(own)]])
    model = language_id.KneserNey(grams, counts, symbols=len(np.unique(grams & np.uint64(0xFFFF))))
    assert counts.sum() * 2.0**-22 > 2
    assert found.cross_entropy == pytest.approx(-model.logp(few).mean(), rel=1e-5)


def test_names_after_signs_are_found():
    for text, names in [('She said "John Smith" left.', ["John Smith"]), ("(Mrs. Jones) wrote", ["Jones"]), ("then\u2014Maria Lopez, «Анна Петрова»", ["Maria Lopez", "Анна Петрова"]), ("[JOHN SMITH]", ["JOHN SMITH"]), ("William Brown met Elizabeth Jones.", ["William Brown", "Elizabeth Jones"])]:
        out, found = surrogates.replaced(text, KEY)
        assert [text[a:b] for a, b, _ in found] == names
        assert not any(name in out for name in names)
    assert surrogates.replaced("Johnny Smith and xJohn Smith, Mrs Jones", KEY)[1] == []


def test_collisions_find_a_free_surrogate():
    names = surrogates.GIVEN["greek", "f"]
    for text in ("; ".join(f"Κυρία {n}" for n in names), "; ".join(f"{c}@x.example.com" for c in "aeiou")):
        out, found = surrogates.replaced(text, KEY)
        originals = [text[a:b] for a, b, _ in found]
        changed = [x.removeprefix("Κυρία ") for x in out.split("; ")]
        assert len(set(originals)) == len(originals) == len(set(changed)) and not set(originals) & set(changed)


def test_surrogates_are_a_bijection():
    assert len({surrogates.permuted(f"{k:04d}", b"k") for k in range(10_000)}) == 10_000
    assert len({surrogates._ip(f"10.0.{a}.{b}", b"k", 0) for a in range(40) for b in range(256)}) == 40 * 256
    for names in surrogates.GIVEN.values():
        assert len({surrogates._person(n, b"k", 0) for n in names}) == len(names)
        assert all(surrogates._person(n, b"k", 0) in names and surrogates._person(n, b"k", 0) != n for n in names)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(found) > 20 and sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found)
