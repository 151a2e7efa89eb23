"""The operators against brute force, on planted cases and on awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import _arrays as A
from ledgerloom.llm import _exchange as X
from ledgerloom.llm import _superkmers as K
from ledgerloom.llm import decontamination, language_id, line_dedup, lyndon, near_dedup, packing, quality_rules, substring_dedup, suffix_dedup, token_counts, toxicity
from ledgerloom.llm import queries as registered

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def invented(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "tu", "ré", "sen"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, repeated lines, long texts, nulls, empties, ties and repeated rows."""
    r, out = random.Random(3), []
    base, passage = [invented(i, 120) for i in range(12)], invented(99, 60)
    for i, b in enumerate(base):
        out += [b, "\n".join(b[k : k + 200] for k in range(0, len(b), 200)), f"{b[:100]} {passage} {b[100:]}"]
        words = b.split()
        for _ in range(2):
            changed = list(words)
            changed[r.randrange(len(words))] = "other"
            out.append(" ".join(changed))
        out.append(b)
    out += ["", " \t\n ", None, "x", "one two", passage, "a " * 300, "b\n" * 50, invented(7, 6000), "é" * 3000, "same line of five words here\n" * 4 + "end", "\n"]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(out)]
    rows += [(5, out[5], "en", "s", 1), (5, "another text under the same number, long enough to be looked at twice", None, None, None), (None, base[0], None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).withColumns({"tie": F.lit("t"), "n_words": F.lit(-1), "rest": F.lit(0), "id_key": F.lit("k"), "score": F.lit(2.0)}).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(docs):
    """(doc_id, text) in the order of the corpus: by id, null last, then text, null first."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))


def bag(rows):
    return collections.Counter(map(repr, rows))


# Arrays.


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t ", max_size=12), max_size=6))
def test_words_lines_and_windows(texts):
    import pyarrow as pa

    data, offsets = A.string_buffers(pa.array(texts, pa.string()))
    s, e, first = A.words(data, offsets)
    found = [[data[a:b].tobytes().decode() for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]], strict=True)] for i in range(len(texts))]
    assert found == [WORD.findall(t) for t in texts]
    ls, le, lf = A.lines(data, offsets)
    assert [[data[a:b].tobytes().decode() for a, b in zip(ls[lf[i] : lf[i + 1]], le[lf[i] : lf[i + 1]], strict=True)] for i in range(len(texts))] == [t.split("\n") for t in texts]
    h = A.span_hashes(data, s, e)
    words = [w for f in found for w in f]
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(i))
    for k in (1, 2, 3):
        w = A.window_hashes(h, k)
        runs = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        assert len(w) == max(0, len(runs)) and all((w[i] == w[j]) == (runs[i] == runs[j]) for i in range(len(runs)) for j in range(i))
    assert (A.sliding_min(h, 3) == [min(h[i : i + 3]) for i in range(len(h) - 2)]).all() if len(h) > 2 else True


def test_long_spans_and_blocks():
    data = np.frombuffer(b"x" * 9000 + b" " + b"x" * 8999 + b"y", np.uint8)
    s, e, _ = A.words(data, np.array([0, len(data)]))
    h = A.span_hashes(data, s, e)
    assert h[0] != h[1]
    long = np.arange(3 << 20, dtype=np.uint64) % np.uint64(1 << 20)
    w = A.window_hashes(long, 5)
    assert (w[: 1 << 20] == w[1 << 20 : 2 << 20]).all()
    keys = np.array([3, 1, 3, 1, 2], np.uint64)
    assert A.stable_order(keys).tolist() == [1, 3, 4, 0, 2]


def test_super_kmers_cover_every_window_and_cut_documents_agree(monkeypatch):
    h = np.random.default_rng(1).integers(0, 50, 5000).astype(np.uint64)
    first = np.array([0, 10, 10, 3000, 5000])
    doc, start, count, *_ = K.super_kmers(h, first, 20, 8)
    covered = collections.Counter((int(d), int(s) + i) for d, s, c in zip(doc, start, count, strict=True) for i in range(c))
    assert covered == collections.Counter((d, i) for d in range(4) for i in range(max(0, first[d + 1] - first[d] - 19)))
    monkeypatch.setattr(K, "CHUNK", 700)
    doc, start, count, *_ = K.super_kmers(h, first, 20, 8)
    assert covered == collections.Counter((int(d), int(s) + i) for d, s, c in zip(doc, start, count, strict=True) for i in range(c))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(s):
    s = [*s, 0]
    assert lyndon.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("pattern", ["a", "ab", "aab", "abaab", "ba"])
def test_suffix_array_of_periods(pattern):
    s = [ord(c) for c in pattern * 400] + [0]
    assert lyndon.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_blobs_round_trip():
    texts = np.frombuffer(b"abcdef", np.uint8)
    (x,), data, offsets = X.unpack_texts(X.pack_texts([np.array([7, 8])], texts, np.array([4, 0]), np.array([2, 3])), (np.int64,))
    assert x.tolist() == [7, 8] and data.tobytes() == b"efabc" and offsets.tolist() == [0, 2, 5]
    columns = [np.arange(5, dtype=np.int64), np.array([1, 2, 3, 4, 255], np.uint8)]
    assert all((a == b).all() for a, b in zip(X.unpack(X.pack(columns), (np.int64, np.uint8)), columns, strict=True))
    assert [len(c) for c in X.gather([], (np.int64,))] == [0]


# 1: near duplicates.


def _aligned_share(a, b):
    """Words in the longest common subsequence, against the longer text's words."""
    at = [0] * (len(b) + 1)
    for x in a:
        before = at[:]
        for j, y in enumerate(b):
            at[j + 1] = before[j] + 1 if x == y else max(before[j + 1], at[j])
    return at[-1] / max(len(a), len(b), 1)


def _links(texts):
    """Pairs of different texts that are similar, and the classes that they make."""
    words = [tuple(WORD.findall(t or "")) for t in texts]
    counts = [collections.Counter(w) for w in words]
    first, root, links = {}, list(range(len(texts))), []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, w in enumerate(words):
        if not w:
            continue
        j = first.setdefault(w, i)
        root[i] = j
        if j != i:
            continue
        for j in set(first.values()) - {i}:
            most = max(len(w), len(words[j]))
            if 5 * min(len(w), len(words[j])) >= 4 * most and 5 * (counts[i] & counts[j]).total() >= 4 * most and _aligned_share(w, words[j]) >= 0.8:
                links.append((j, i))
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(len(texts))]


def test_near_duplicates_by_brute_force(docs):
    rows = ordered(docs)
    links, wanted = _links([t for _, t in rows])
    got = {r.text: r for r in near_dedup.classes(X.numbered(docs)).join(X.numbered(docs), ["doc_id", "tie"]).collect()}
    found = {t: (r.class_doc, r.class_tie) for t, r in got.items()}
    hit = sum(found[rows[i][1]] == found[rows[j][1]] for i, j in links)
    assert len(links) > 60 and hit >= 0.95 * len(links)
    for i, (_, t) in enumerate(rows):  # nothing is joined that isn't similar
        if not WORD.search(t or ""):
            continue
        own = [j for j, (_, u) in enumerate(rows) if found[u] == found[t]]
        assert {wanted[j] for j in own} == {wanted[i]}
    report = near_dedup.near_duplicates(docs).collect()
    assert len(report) == len(rows) and sum(r.kept for r in report) == len({(r.class_doc, r.class_tie) for r in near_dedup.classes(X.numbered(docs)).collect()})


@pytest.mark.parametrize(("folder", "least"), [("sf0.01", 50), ("sf0.1", 700)])
def test_near_duplicate_recall(spark, folder, least):
    """At least 0.9 of all similar pairs of different texts are in one class; exact copies always."""
    real = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(real).collect()}
    texts, first = [], {}
    for r in real.orderBy("doc_id").collect():
        own = near_dedup.Words.of(zstandard.ZstdCompressor().compress((r.text or "").encode()))
        if (k := own.hashes.tobytes()) and first.setdefault(k, r.doc_id) != r.doc_id:
            assert found[r.doc_id] == found[first[k]]
        elif k:
            texts.append((len(own), r.doc_id, own))
    texts.sort(key=lambda x: x[:2])
    size = np.array([x[0] for x in texts])
    tally = np.stack([np.bincount((w.labelled % np.uint64(256)).astype(np.int64), minlength=256) for _, _, w in texts])
    rare = collections.Counter(h for _, _, w in texts for h in w.labelled.tolist())
    index, n, hit = collections.defaultdict(list), 0, 0
    for x, (m, i, w) in enumerate(texts):  # the exact join: similar texts share one of their rarest words, and enough words of any kind
        met = set()
        for h in sorted(w.labelled.tolist(), key=lambda h: (rare[h], h))[: m - -(-4 * m // 5) + 1]:
            met.update(index[h])
            index[h].append(x)
        met = np.array(sorted(met), np.int64)
        met = met[(5 * size[met] >= 4 * m) & (5 * np.minimum(tally[met], tally[x]).sum(1) >= 4 * m)]
        for j in met.tolist():
            if near_dedup.linked(texts[j][2], w):
                n, hit = n + 1, hit + (found[i] == found[texts[j][1]])
    assert n >= least and hit >= 0.9 * n, (n, hit)


def test_near_duplicate_filter_keeps_columns(docs, nothing):
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in near_dedup.near_duplicates(docs).collect())
    assert near_dedup.near_duplicates(nothing).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert near_dedup.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64), 100) == best[-1][-1]


def test_alignments_stay_in_the_band():
    for n, band in ((9000, 600), (300, 20)):
        a = np.arange(n, dtype=np.uint64)
        b = np.concatenate([a[: n // 3], a[n // 3 + 10 : n // 2], a[:5] + np.uint64(10**6), a[n // 2 :]])
        assert near_dedup.common_subsequence(a, b, band) == n - 10 and near_dedup.linked(near_dedup.Words(a), near_dedup.Words(b))
        turned = np.concatenate([a[n // 2 :], a[: n // 2]])  # the same words in another order
        assert not near_dedup.linked(near_dedup.Words(a), near_dedup.Words(turned))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 6)), max_size=6))
def test_links_are_those_of_the_whole_alignment(a, changes):
    b = list(a)
    for at, x in changes:
        b[at % len(b) : at % len(b) + x % 3] = [x] if x % 2 else []
        b = b or [1]
    wide = lambda x: near_dedup.Words(A.mix(np.array(x, np.uint64)))
    assert near_dedup.linked(wide(a), wide(b)) == (_aligned_share(a, b) >= 0.8)


def test_bucket_links_join_what_is_similar():
    r = np.random.default_rng(2)
    passage, own = r.integers(0, 2**62, 40).astype(np.uint64), [r.integers(0, 2**62, 60).astype(np.uint64) for _ in range(30)]
    texts = [near_dedup.Words(x) for x in [np.concatenate([passage, o]) for o in own] + [np.concatenate([passage, own[4][:-2]])]]
    assert near_dedup.bucket_links(texts, list(range(31)), [True] * 31) == [(4, 30)]
    assert near_dedup.bucket_links(texts, list(range(31)), [False] * 31) == []


def test_buckets_in_bands_of_length(docs, monkeypatch):
    wanted = bag(map(tuple, near_dedup.near_duplicates(docs).collect()))
    monkeypatch.setattr(near_dedup, "BANDED", 2)
    assert bag(map(tuple, near_dedup.near_duplicates(docs).collect())) == wanted


# 2 and 6: repeated passages.


def _removed_words(rows):
    seen, out = set(), []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone.update(range(k, k + 20))
            seen.add(g)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substrings_by_brute_force(docs, nothing):
    assert bag(map(tuple, substring_dedup.dedup(docs).collect())) == bag(_removed_words(ordered(docs)))
    texts = {r.kept_sha256: r.kept_text for r in substring_dedup.dedup(docs, keep_text=True).collect()}
    assert all(hashlib.sha256(t.encode()).hexdigest() == h for h, t in texts.items())
    assert substring_dedup.dedup(nothing).count() == 0


def _removed_bytes(rows):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] != i:
                gone[k : k + 50] = b"\1" * 50
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def test_bytes_by_brute_force(docs, nothing):
    assert bag(map(tuple, suffix_dedup.dedup(docs).collect())) == bag(_removed_bytes(ordered(docs)))
    assert suffix_dedup.dedup(nothing).count() == 0


def test_earliest_places_and_parts():
    r = random.Random(5)
    texts = list({bytes(r.choice(b"ab") for _ in range(r.randint(8, 40))) for _ in range(30)})
    least = [r.randrange(100) for _ in texts]
    k = 6
    wanted = {}
    for t, d in zip(texts, least, strict=True):
        for i in range(len(t) - k + 1):
            wanted[t[i : i + k]] = min(d, wanted.get(t[i : i + k], 1000))

    def fine(given, documents, found):
        for t, (other, place) in zip(given, found, strict=True):
            for x in range(len(t) - k + 1):
                assert given[other[x]][place[x] : place[x] + k] == t[x : x + k] and documents[other[x]] == wanted[t[x : x + k]]

    fine(texts, least, suffix_dedup.earliest_places(texts, least, k))
    for part in suffix_dedup._parts(texts, k, 100):
        given = [texts[i][a:b] for i, a, b in part]
        fine(given, [least[i] for i, _, _ in part], suffix_dedup.earliest_places(given, [least[i] for i, _, _ in part], k))


def test_only_strings_that_texts_share_are_sorted(monkeypatch):
    """Suffix arrays get what two texts share, once and whole, also where a bucket's texts are more than one part takes."""
    r, k, m = random.Random(6), suffix_dedup.WINDOW, suffix_dedup.GRAM
    letters = [bytes(r.choice(b"abcdefgh") for _ in range(40)) for _ in range(1600)]
    common = [bytes(r.choice(b"abcdefgh") for _ in range(60)) for _ in range(40)]
    texts = list(dict.fromkeys(a + common[r.randrange(40)] + b for a, b in zip(letters[::2], letters[1::2], strict=True)))
    documents = np.array([r.randrange(10_000) for _ in texts])
    hashes = np.concatenate([A.window_hashes(A.BYTE_CODES[np.frombuffer(t, np.uint8)], k) for t in texts])
    wanted, given = {}, []
    for t, d in zip(texts, documents.tolist(), strict=True):
        for i in range(len(t) - k + 1):
            wanted[t[i : i + k]] = min(d, wanted.get(t[i : i + k], d))
    sort = suffix_dedup.earliest_places
    monkeypatch.setattr(suffix_dedup, "earliest_places", lambda t, *a: given.append(sum(map(len, t))) or sort(t, *a))
    for limit in (1 << 20, 2000):
        monkeypatch.setattr(suffix_dedup, "PART_BYTES", limit)
        given.clear()
        text, place = suffix_dedup.earliest_strings(texts, documents, hashes, k)
        at = 0
        for t in texts:
            for i in range(len(t) - k + 1):
                assert texts[text[at]][place[at] : place[at] + k] == t[i : i + k] and documents[text[at]] == wanted[t[i : i + k]]
                at += 1
        assert len(given) > 10 if limit == 2000 else sum(given) < sum(map(len, texts)) // 2
    # Texts of one minimizer each are dealt without reading any byte twice.
    doc, start, count, *_ = K.super_kmers(A.BYTE_CODES[np.frombuffer(b"".join(texts), np.uint8)], np.concatenate([[0], np.cumsum([len(t) for t in texts])]), k, m)
    pieces = list({texts[d][s : s + c + k - 1] for d, s, c in zip(doc.tolist(), start.tolist(), count.tolist(), strict=True)})
    assert sum(b - a for part in suffix_dedup._parts(pieces, k, 50_000) for _, a, b in part) < 1.02 * sum(map(len, pieces))


def test_records_of_many_pieces_travel_together():
    n, r = 500, np.random.default_rng(3)
    dealt, out, sent = X.Dealt(n), [], []
    for _ in range(400):
        sent.append(r.integers(0, 1 << 40, 1000))
        out += dealt.add((sent[-1] % n).astype(np.int32), [sent[-1]])
    out += dealt.flush()
    assert sum(b.num_rows for b in out) <= n * 2  # a blob for each bucket from every piece would be 400 * n
    got = {k: np.concatenate([X.unpack(x.as_py(), [np.int64])[0] for b in out for k2, x in zip(b.column(0).to_pylist(), b.column(2), strict=True) if k2 == k]) for k in (0, 7, n - 1)}
    every = np.concatenate(sent)
    assert all(sorted(v.tolist()) == sorted(every[every % n == k].tolist()) for k, v in got.items())


@pytest.mark.parametrize("size", [60, 5000, (1 << 20) + 300])
def test_hashes_of_some_places(size):
    h = np.random.default_rng(4).integers(0, 1 << 62, size).astype(np.uint64)
    some = A.WindowHashes(h)
    for k in (14, 18, 50):
        at = np.array([0, 3, size - k])
        assert (some.every(k) == A.window_hashes(h, k)).all() and (some.at(k, at) == A.window_hashes(h, k)[at]).all()


def test_only_verified_windows_count():
    """Paths that a collision of hashes would name are cut down to the windows that are equal at the source."""
    texts = [b"a b  c d e f g h", b"a b c d X f g h i"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.array([0, 16, 33])
    for bounds, (start, size, wanted) in ((K.WordBounds(), (0, 8, [(0, 2), (5, 1)])), (K.ByteBounds(), (0, 8, [(0, 2)]))):
        path = [np.array([x]) for x in (1, 0, start)] + [np.array([size - 2], np.int32)] + [np.array([x]) for x in (0, 0, 0)]
        a, b = bounds(data, offsets, np.array([0]), np.array([0]), np.array([size]))
        answer = X.pack_texts([np.array([0]), np.array([0]), np.array([0])], data, a, b - a)
        sources = K.Sources({K.REPEATS: [X.pack(path)], K.ANSWERS: [answer]}, bounds)
        doc, at, count = sources.verified(np.array([0, 1]), np.array([0, 0]), data, offsets, 3)
        assert doc.tolist() == [1] * len(wanted) and list(zip(at.tolist(), count.tolist(), strict=True)) == wanted


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20), st.integers(1, 4), st.integers(-3, 3)), max_size=30, unique_by=lambda x: x[:2]))
def test_chains_cover_the_same_windows(rows):
    columns = [np.array([r[0] for r in rows], np.int64), np.zeros(len(rows), np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), np.full(len(rows), 9), np.zeros(len(rows), np.int64), np.array([r[1] + r[3] for r in rows], np.int64)]
    spread = lambda c: {(int(d), int(s) + i, int(x) + i) for d, _, s, n, _, _, x in zip(*c, strict=True) for i in range(int(n))}
    found = K.chain(*columns)
    assert spread(found) == spread(columns) and len(found[0]) <= len(rows)


def test_more_buckets_for_larger_files(spark, tmp_path, monkeypatch):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/d")
    given = spark.read.parquet(f"{tmp_path}/d")
    assert X.bucket_count(given) == 4
    monkeypatch.setattr(X, "BUCKET_BYTES", 1500)
    assert X.bucket_count(given) > 8
    rows = ordered(given)
    assert bag(map(tuple, substring_dedup.dedup(given).collect())) == bag(_removed_words(rows))
    assert bag(map(tuple, suffix_dedup.dedup(given).collect())) == bag(_removed_bytes(rows))
    assert collections.Counter(repr(tuple(r)) for r in line_dedup.line_report(given).collect()) == _removed_lines(rows)


def test_marks_are_never_missed():
    rng = np.random.default_rng(3)
    ids, ties = rng.integers(0, 2**62, 500), rng.integers(0, 3, 500)
    bits = np.zeros(X.DOC_BITS, bool)
    for at in X.Marked.places(ids[:100], ties[:100]):
        bits[at] = True
    found = X.Marked(np.packbits(bits)).has(ids, ties)
    assert found[:100].all() and found[100:].sum() < 5


# 3: token counts.


def test_token_counts_by_plain_dynamic_programming(docs, nothing):
    scores = token_counts.piece_scores(token_counts.default_vocabulary())
    low = token_counts.byte_score(scores)

    def best(word):
        t = token_counts.MARK + word
        at = [(0.0, 0)] + [None] * len(t)
        for e in range(1, len(t) + 1):
            found = [(at[s][0] + scores[t[s:e]], -at[s][1] - 1) for s in range(max(0, e - 20), e) if t[s:e] in scores]
            if t[e - 1] not in scores:
                n = len(t[e - 1].encode())
                found.append((at[e - 1][0] + n * low, -at[e - 1][1] - n))
            s, n = max(found)
            at[e] = (s, -n)
        return at[-1][::-1]

    for limit, depth in ((10**6, 64), (5, 64), (10**6, 3)):
        trie = token_counts.ForwardTrie(scores, limit, depth)
        for w in ("hello", "hell", "unbelievable漢字", "x" * 200, "réeuxment", "🙂🙂", ""):
            n, s = trie[w]
            assert n == best(w)[0] and abs(s - best(w)[1]) < 1e-6
    trie = token_counts.ForwardTrie(scores)
    _ = trie["prefix"], trie["prefixes"]
    assert trie.nodes_made == len("prefixes") + 1
    got = {(r.doc_id, r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs).collect()}
    assert got == {(i, len(WORD.findall(t or "")), sum(best(w)[0] for w in WORD.findall(t or ""))) for i, t in ordered(docs)}
    assert token_counts.token_counts(nothing).count() == 0


# 4: language ID.


def test_language_id_on_held_out_documents(spark, docs, nothing):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(real)
    rows = language_id.classify(real, model).join(real.select("doc_id", "lang"), "doc_id").where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and sum(r.rejected for r in rows) <= 0.03 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in language_id.classify(spark.createDataFrame([(1, None), (2, ""), (3, "12 - 3"), (4, "the and of that" * 5000)], "doc_id long, text string"), model).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(odd[i].rejected for i in (1, 2, 3)) and odd[4].lang_pred == "en"
    assert language_id.accepted(docs, model).columns == docs.columns
    empty = language_id.fit(nothing)
    assert {r.lang_pred for r in language_id.classify(docs, empty).collect()} == {"und"} and language_id.classify(nothing, model).count() == 0


# 5: lines.


def _removed_lines(rows):
    earlier, out = [], collections.Counter()
    for i, t in rows:
        gone = []
        for n, line in enumerate((t or "").split("\n")):
            if s := frozenset(WORD.findall(line)):
                if any(5 * len(s & x) >= 4 * len(s | x) for x in earlier):
                    gone.append(n)
                earlier.append(s)
        out[repr((i, t.count("\n") + 1 if t else 0, len(gone), gone))] += 1
    return out


@pytest.mark.parametrize(("first", "group"), [(3, 1500), (1, 1500), (1, 3)])
def test_lines_by_brute_force(docs, monkeypatch, first, group):
    monkeypatch.setattr(line_dedup, "FIRST", first)
    monkeypatch.setattr(line_dedup, "LARGE_GROUP", group)
    numbered = X.numbered(docs)
    gone = collections.defaultdict(list)
    for r in line_dedup.removed_lines(numbered, first=first).distinct().collect():
        gone[r.doc, r.tie].append(r.line)
    got = collections.Counter(repr((None if r.doc_id == X.LAST_ID else r.doc_id, r.text.count("\n") + 1 if r.text else 0, len(g := sorted(gone[r.doc_id, r.tie])), g)) for r in numbered.collect())
    assert got == _removed_lines(ordered(docs))


def test_equal_digests_are_verified():
    texts = [b"a b", b"c d", b"b a", b"a b", b"d c", b"e"]
    same, place = np.zeros(6, np.uint64), [np.array([5, 4, 3, 2, 1, 0]), np.zeros(6, np.int64), np.zeros(6, np.int64)]
    lead, copies = line_dedup.settle(same, place, texts.__getitem__)
    assert lead.tolist() == [3, 4, 5] and copies.tolist() == [0, 1, 2]
    assert [x.tolist() for x in line_dedup.settle(same[:0], [p[:0] for p in place], texts.__getitem__)] == [[], []]


def test_line_filter(docs, nothing):
    report = line_dedup.line_report(docs)
    assert collections.Counter(repr(tuple(r)) for r in report.collect()) == _removed_lines(ordered(docs))
    kept = line_dedup.without_lines(docs)
    assert kept.columns == docs.columns
    wholly = sum(r.n_lines > 0 and r.n_lines == r.n_removed for r in report.collect())
    assert kept.count() == docs.count() - wholly
    assert line_dedup.line_report(nothing).count() == 0


def test_line_query_has_lines_of_any_length(spark, tmp_path):
    more = ["a b c d\nend\n\nx y z", "d c b a e\nend\none two\nz y x\nx y z w", "one two\nend end\n \nb a c d"]
    spark.createDataFrame(corpus() + [(200 + i, t, "en", "s", None) for i, t in enumerate(more)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    earlier, wanted = [], collections.Counter()
    for i, t in ordered(spark.read.parquet(f"{tmp_path}/documents.parquet")):
        gone = []
        for n, line in enumerate((t or "").split("\n")):
            if s := frozenset(WORD.findall(line)):
                if any(5 * len(s & x) >= 4 * len(s | x) for x in earlier):
                    gone.append(n)
                earlier.append(s)
        wanted[repr((i, t.count("\n") + 1 if t else 0, len(gone), ",".join(map(str, gone))))] += 1
    got = registered.queries()["op5_line_dedup"](spark, str(tmp_path)).collect()
    assert collections.Counter(repr(tuple(r)) for r in got) == wanted
    assert {r.doc_id: r.removed_lines for r in got if (r.doc_id or 0) >= 200} == {200: "1", 201: "0,1,2,3", 202: "0,1,3"}


# 7: decontamination.


def _hits(items, rows):
    """(id, words, hit words, items, contaminated) of rows (id, text), from windows of items (id, text)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= {x for x in own if x is not None}
                    hit.update(range(k, k + n))
        out.append((i, len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination_by_brute_force(spark, docs, nothing):
    items = [("a", " ".join(invented(0, 120).split()[30:60]).upper().replace("É", "é")), ("b", "one  two"), ("c", None), ("d", "..."), (None, invented(1, 120)), ("e", "É é K")]
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("extra", F.lit(1))
    wanted = collections.Counter(repr((i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bad)) for i, n, hit, found, bad in _hits(items, ordered(docs)))
    assert collections.Counter(repr(tuple(r)) for r in decontamination.contamination(docs, bench).collect()) == wanted
    clean = decontamination.without_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for r, n in wanted.items() if r.endswith("False)"))
    assert not any(r.contaminated for r in decontamination.contamination(docs, bench.limit(0)).collect())
    assert decontamination.contamination(nothing, bench).count() == 0


def test_large_benchmarks_are_shuffled(spark, docs, monkeypatch):
    items = [("a", " ".join(invented(0, 120).split()[30:60])), ("b", "one  two")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    wanted = collections.Counter(repr((i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bad)) for i, n, hit, found, bad in _hits(items, ordered(docs)))
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    assert collections.Counter(repr(tuple(r)) for r in decontamination.contamination(docs, bench).collect()) == wanted


def test_decontamination_plan_has_no_python(spark, docs):
    bench = spark.createDataFrame([(1, invented(0, 120))], "item_id long, text string")
    plan = decontamination.contamination(spark.read.parquet(f"{FOLDER}/documents.parquet"), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# 8: toxicity.


def test_toxicity_on_held_out_documents(spark, docs, nothing):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = language_id.fit(real)
    network = toxicity.fit(real, labels, model, toxic_rows=400, other_rows=1200)
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    rows = toxicity.score(real.where(held), network).join(labels, "doc_id").collect()
    hit = sum(r.score >= 0.3 and r.toxic for r in rows)
    assert hit >= 0.8 * sum(r.toxic for r in rows) and hit >= 0.85 * sum(r.score >= 0.3 for r in rows)
    odd = toxicity.score(docs, network).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.fit(real, labels.where("toxic = 0"), model) is None and toxicity.fit(nothing, labels, model) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0} and toxicity.score(nothing, network).count() == 0


def test_calibration_has_all_labels_at_their_true_ratio(spark):
    rng = np.random.default_rng(6)
    toxic = rng.random(8000) < 0.1
    logit = rng.normal(np.where(toxic, 1.5, -1.5), 1)
    found = spark.createDataFrame([(i, float(x), "xx") for i, x in enumerate(logit)], "doc_id long, logit double, language string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    of = lambda y, n: [int(i) for i in np.flatnonzero(toxic == y)[:n]]
    shifts = []
    for learned in ([], of(1, 400) + of(0, 800)):  # half of the toxic rows, a ninth of the others
        network = toxicity._begin([rng.integers(0, toxicity.BUCKETS, (9, 3)) for _ in range(2)], np.array([0, 1]), rng)
        toxicity.calibrate(network, found, labels, learned)
        shifts.append(network.language_shift["xx"])
    middle = np.log(toxicity.DECISION / (1 - toxicity.DECISION))
    free = {r.doc_id for r in labels.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) != 2).collect()}
    x, y = np.array([logit[i] for i in sorted(free)]), np.array([toxic[i] for i in sorted(free)])
    f1 = lambda t: 2 * (y & (x >= t)).sum() / (y.sum() + (x >= t).sum())
    best = max(map(f1, x))
    assert f1(shifts[0] + middle) >= best - 0.005 and f1(shifts[1] + middle) >= best - 0.02


def test_scores_dont_depend_on_the_batch():
    rng = np.random.default_rng(0)
    network = toxicity._begin([rng.integers(0, toxicity.BUCKETS, (50, 3)) for _ in range(6)], np.array([0, 1] * 3), rng)
    docs = [rng.integers(0, toxicity.BUCKETS, (n, 3)).astype(np.int32) for n in (0, 1, 300, 64)]
    together = network.logits(np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
    assert np.allclose(together, [network.logits(d, np.array([0, len(d)]))[0] for d in docs], atol=1e-5)


# 9: quality rules.


def test_statistics_by_brute_force(docs, nothing):
    def stats(t):
        t = t or ""
        w = WORD.findall(t)
        runs = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)

    rules = quality_rules.RuleList(())
    got = collections.Counter(repr(tuple(r)) for r in quality_rules.apply_rules(docs, rules).collect())
    wanted = collections.Counter()
    for i, t in ordered(docs):
        s = stats(t)
        bad = s[0] < 50 or 100 * s[4] > 50 * s[0]
        wanted[repr((i, *s, bad, not bad))] += 1
    assert got == wanted and quality_rules.text_statistics(nothing).count() == 0


def test_rules_are_found_and_equal_in_spark_and_numpy(spark):
    r = np.random.default_rng(4)
    x = r.random((600, len(quality_rules.FEATURES)))
    bad = (x[:, 2] > 0.7) | ((x[:, 1] < 0.2) & (x[:, 4] > 0.5))
    rules = quality_rules.learn_rules(x, bad)
    assert 2 <= len(rules.rules) and (rules.keeps(x) == ~bad).mean() > 0.97 and "drop if" in str(rules)
    assert str(quality_rules.learn_rules(x[:0], bad[:0])) == "keep all"
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learned = quality_rules.fit(docs, labels)
    rows = quality_rules.apply_rules(docs, learned).join(labels, "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in rows if not r.base_failed) >= 0.95 * sum(not r.base_failed for r in rows)
    assert quality_rules.fit(docs, labels.limit(0)).rules == ()


# 10: packing.


def test_ids_are_those_of_the_other_library():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    other, own = Tokenizer.from_file(path), packing.tokenizer(path)
    texts = [t for _, t, *_ in corpus() if t] + ["don't  stop\r\n\t x", "漢字 🙂‍ ١٢ Ⅷ½", "\x00\x1c  a", "a<|endoftext|>b", " 's 'LL"]
    assert all(own.ids(t) == other.encode(t, add_special_tokens=False).ids for t in texts)


def test_packing_is_gapless_and_nearly_full(docs, nothing):
    own = packing.tokenizer(packing.default_vocabulary())
    for group, size in ((40_000, 2048), (8, 128)):
        rows = packing.pack(packing.token_pieces(docs, size=size), size=size, group_rows=group).collect()
        bins = collections.defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for own_bin in bins.values():
            at = 0
            for o, n in sorted(own_bin):
                assert o == at
                at += n
            assert at <= size
        total = sum(r.length for r in rows)
        assert len(bins) <= (-(-total // size) + 1 if group > 100 else 1.15 * total / size + 1)
        wanted = collections.Counter()
        for i, t in ordered(docs):
            ids = np.array([*own.ids(t), 0], "<u4")
            for k, (s, n) in enumerate(packing.cuts(len(ids), size)):
                wanted[repr((i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))] += 1
        assert collections.Counter(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == wanted
    assert packing.pack(packing.token_pieces(nothing)).count() == 0


@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit(lengths):
    bins, offset, fill = packing.best_fit(np.array(lengths, np.int64), 20)
    for b in range(len(fill)):
        own = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
        assert sum(n for _, n in own) == fill[b] <= 20 and all(o + n == p for (o, n), (p, _) in zip(own, own[1:], strict=False))
    assert packing.cuts(5, 2) == [(0, 1), (1, 2), (3, 2)] and packing.cuts(4, 2) == [(0, 2), (2, 2)]


# The pipeline and the registered queries.


def test_pipeline_by_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    model = language_id.fit(docs)
    left = [r for r in docs.collect() if not (p := model.predict(r.text))[0] == "und" and p[2] >= language_id.MIN_MARGIN]
    earlier, kept = [], []
    for r in sorted(left, key=lambda r: r.doc_id):
        out = []
        for line in r.text.split("\n"):
            if s := frozenset(WORD.findall(line)):
                same = any(5 * len(s & x) >= 4 * len(s | x) for x in earlier)
                earlier.append(s)
                if same:
                    continue
            out.append(line)
        if out:
            kept.append((r.doc_id, "\n".join(out)))
    classes = _links([t for _, t in kept])[1]
    first = {kept[i][0] for i, c in enumerate(classes) if c == i}
    bad = {i for i, *_, contaminated in _hits([(r.item_id, r.text) for r in bench.collect()], kept) if contaminated}
    own = packing.tokenizer(packing.default_vocabulary())
    wanted = {i: len(own.ids(t)) + 1 for i, t in kept if i in first and i not in bad}
    found = collections.Counter()
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        found[r.doc_id] += r.length
    assert dict(found) == wanted


def test_pipeline_stages_keep_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns, name


def test_every_operator_is_registered():
    names = list(registered.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(registered.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_statements(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = registered.queries()[name](spark, FOLDER)
    assert bag(map(tuple, got.collect())) == bag(con.execute(registered.oracle_sql()[name]).fetchall())
