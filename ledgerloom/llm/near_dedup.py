"""MinHash near-dedup (op 1): Order MinHash sketches, and verification by banded alignment.

A text's k-mers are its runs of ``SHINGLE`` words, each labelled with how often it has occurred before.  For each of
``SKETCHES`` hash functions the ``PICKED`` labelled k-mers with the smallest hashes are kept in the order in which they stand in the
text; their hash is one sketch.  Two texts agree in a sketch the more often the more k-mers they share in the same
order.  Texts that agree in one are candidates.  A candidate pair is aligned word by word: the longest common subsequence
of words, within a band about the diagonal as wide as the threshold allows, against the words of the longer text is the similarity,
and ``THRESHOLD`` or more is a link.  An alignment that reaches the threshold never leaves the band, so the band loses
none.  Classes are the connected components.

Equal texts are one node throughout, so copies cost a row each.  In a bucket of texts that agree in a sketch no
list of all pairs is made.  The members are dealt into as many shares as there are shuffle partitions; in each share a leader, the
text that shares most buckets, is aligned with the others, and the leaders with the leader of the whole bucket, so that a bucket that holds
a third of all texts is spread over all tasks.  Only where the bucket then still has several components the rest is
joined: an exact prefix-filter join of the members' words, rarest in the bucket first, names the pairs that can be similar
at all, and those of different components are aligned until the components are joined.  Similar texts differ in length by a quarter at
most, so a bucket of more than ``BANDED`` members is joined in bands of length.  So no link of the bucket is
lost, and texts that only share a passage are never aligned.  A task of this join holds the words of one bucket and band.

Defined results: null and empty texts, and texts without words, are classes of their own, one for each row; a text of fewer words than a
shingle has one k-mer, all its words; very long texts are sketched and aligned whole, in a piece of their own; equal texts and repeated rows
are one class; rows of one doc_id are ordered by their texts; a null doc_id is the last one; the class id is the smallest doc_id of the class;
extra columns, whatever their names, are ignored or kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _arrays as A
from ledgerloom.llm import _exchange as X
from ledgerloom.llm._spark import LAST_ID, cut, shuffle_partitions
from ledgerloom.operators.graph import components

SHINGLE, THRESHOLD = 5, (4, 5)
SKETCHES, PICKED = 24, 3
#: Buckets of more members are joined in bands of length; places of a member's tally of words.
BANDED, TALLY = 64, 512
_SEEDS = np.random.default_rng(41).integers(1, 2**62, 2 * SKETCHES, dtype=np.int64).astype(np.uint64)


def _node() -> Column:
    return F.struct(F.col("doc_id").alias("doc"), F.col("tie").alias("tie"))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer hashes, first k-mer of each document, number of words of each document)."""
    starts, ends, first = A.words(data, offsets)
    n_words = np.diff(first)
    h = A.span_hashes(data, starts, ends)
    grams = A.window_hashes(h, k)
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    out_first = np.concatenate([[0], np.cumsum(n)])
    long = n_words >= k
    out = np.zeros(out_first[-1], np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(doc)) - out_first[doc] + first[doc]
    of_long = long[doc]
    out[of_long] = grams[at[of_long]]
    for i in np.flatnonzero(~long & (n_words > 0)):
        own = h[first[i] : first[i + 1]]
        out[out_first[i]] = A.window_hashes(own, len(own))[0]
    return out, out_first, n_words


def order_sketches(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sketches, content hashes): of each document its SKETCHES sketches and two hashes of its whole sequence of k-mers."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    out, content = np.zeros((n, SKETCHES), np.uint64), np.zeros((n, 2), np.uint64)
    if not len(grams):
        return out, content
    keys = A.join2(doc.astype(np.uint64), grams)
    order = A.stable_order(keys)
    s = keys[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    before = np.empty(len(s), np.int64)
    before[order] = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    labelled = A.join2(grams, before.astype(np.uint64))
    full = np.flatnonzero(np.diff(first) > 0)
    begin = first[:-1][full]
    place = (np.arange(len(grams)) - first[doc]).astype(np.uint64)
    for c in range(2):
        content[full, c] = np.add.reduceat(A.mix(grams + A.mix(place * np.uint64(2) + np.uint64(c))), begin)
    compact = np.repeat(np.arange(len(full)), np.diff(first)[full])
    top = np.uint64(2**64 - 1)
    for j in range(SKETCHES):
        h = (labelled ^ _SEEDS[j]) * (_SEEDS[SKETCHES + j] | np.uint64(1))
        h ^= h >> np.uint64(32)
        picked = []
        for _ in range(PICKED):
            least = np.minimum.reduceat(h, begin)
            at = np.flatnonzero(h == least[compact])
            at = at[h[at] != top]
            own = compact[at]
            where = np.full(len(full), len(grams), np.int64)
            where[own[::-1]] = at[::-1]
            picked.append(where)
            h[where[where < len(grams)]] = top
        places = np.sort(np.stack(picked, 1), 1)
        total = np.full(len(full), _SEEDS[j])
        for c in range(PICKED):
            total = A.join2(total, np.where(places[:, c] < len(grams), labelled[np.minimum(places[:, c], len(grams) - 1)], np.uint64(7)))
        out[full, j] = total
    return out, content


def common_subsequence(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence within ``band`` of the diagonal, bit-parallel.

    A row of the alignment is one integer with a bit for each element of ``a``; a block of rows only touches the bits within its band.
    """
    same = min(len(a), len(b))
    differ = np.flatnonzero(a[:same] != b[:same])
    head = int(differ[0]) if len(differ) else same
    a, b = a[head:], b[head:]
    same = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - same :][::-1] != b[len(b) - same :][::-1])
    tail = int(differ[0]) if len(differ) else same
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(i)
    values, step, n = b.tolist(), 256, len(a)
    v = (1 << n) - 1
    for j0 in range(0, len(values), step):
        lo, hi = max(0, j0 - band), min(n, j0 + step + band)
        if lo >= hi:
            break
        mask = (1 << (hi - lo)) - 1
        part = (v >> lo) & mask
        for x in values[j0 : j0 + step]:
            bits = 0
            for i in places.get(x, ()):
                if lo <= i < hi:
                    bits |= 1 << (i - lo)
            if bits:
                u = part & bits
                part = ((part + u) | (part - u)) & mask
        v = (v & ~(mask << lo)) | (part << lo)
    return head + tail + n - v.bit_count()


class Words:
    """A text's words as hashes, in order, and the same with occurrence numbers, ascending."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        order = np.argsort(hashes, kind="stable")
        s = hashes[order]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        self.labelled = np.sort(A.join2(s, (np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))).astype(np.uint64)))

    def __len__(self) -> int:
        return len(self.hashes)

    @classmethod
    def of(cls, packed: bytes) -> Words:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        starts, ends, _ = A.words(raw, np.array([0, len(raw)]))
        return cls(A.span_hashes(raw, starts, ends))


def linked(a: Words, b: Words, t: tuple[int, int] = THRESHOLD) -> bool:
    """Are ``t`` or more of the longer text's words aligned?  Words that the texts don't share at all settle most pairs."""
    longer = max(len(a), len(b))
    need = -(-t[0] * longer // t[1])
    if min(len(a), len(b)) < need or not longer:
        return False
    if len(np.intersect1d(a.labelled, b.labelled, assume_unique=True)) < need:
        return False
    return common_subsequence(a.hashes, b.hashes, longer - need) >= need


_SKETCH = "doc_id long, tie long, n long, words long, c0 long, c1 long, sketches array<long>"


def sketch_table(docs: DataFrame) -> DataFrame:
    """Of each ``numbered`` document its number of k-mers, content hashes and sketches."""

    def run(ids, ties, data, offsets):
        grams, first, n_words = shingles(data, offsets)
        sketches, content = order_sketches(grams, first)
        n = np.diff(first)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, SKETCHES * len(n) + 1, SKETCHES), pa.int32()), pa.array(sketches.view(np.int64).reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ties), pa.array(n), pa.array(n_words), pa.array(content[:, 0].view(np.int64)), pa.array(content[:, 1].view(np.int64)), flat], names=[c.split()[0] for c in _SKETCH.split(", ")])

    return X.over_pieces(docs, run, _SKETCH)


def _payloads(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the asked nodes, the text compressed."""
    n = X.bucket_count(docs)

    def ask(batches):
        for batch in batches:
            ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if len(ids):
                yield X.scatter(X.document_bucket(ids, n), [ids, ties], 1)

    def work(_, sides):
        asked = set(zip(*(c.tolist() for c in X.gather(sides.get(1, []), (np.int64, np.int64))), strict=True))

        def tell(ids, ties, data, offsets):
            own = [i for i, k in enumerate(zip(ids.tolist(), ties.tolist(), strict=True)) if k in asked]
            packed = [zstandard.ZstdCompressor(level=1).compress(data[offsets[i] : offsets[i + 1]].tobytes()) for i in own]
            yield pa.RecordBatch.from_arrays([pa.array(ids[own], pa.int64()), pa.array(ties[own], pa.int64()), pa.array(packed, pa.binary())], names=["doc", "tie", "text"])

        return (tell,)

    side = nodes.select("node.doc", "node.tie").mapInArrow(ask, X.BLOBS)
    return X.with_documents(docs, n, [side], work, "doc long, tie long, text binary").select(F.struct("doc", "tie").alias("node"), "text")


def _aligned(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""
    side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"{s}_text"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a.doc", "a.tie", F.col("b.doc").alias("b_doc"), F.col("b.tie").alias("b_tie"), "a_text", "b_text")

    def run(batches):
        for batch in batches:
            seen: dict[bytes, Words] = {}

            def words(packed):
                if packed not in seen:
                    if len(seen) > 200:
                        seen.clear()
                    seen[packed] = Words.of(packed)
                return seen[packed]

            ok = [linked(words(x.as_py()), words(y.as_py())) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            kept = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(kept) for i in range(4)], names=["doc", "tie", "b_doc", "b_tie"])

    found = joined.mapInArrow(run, "doc long, tie long, b_doc long, b_tie long")
    return found.select(F.struct("doc", "tie").alias("a"), F.struct(F.col("b_doc").alias("doc"), F.col("b_tie").alias("tie")).alias("b"))


def length_band(n: Column, t: tuple[int, int] = THRESHOLD) -> Column:
    """Bands of length such that similar texts are in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(t[1] / t[0])) * (1 - 1e-9)).cast("int")


def bucket_links(texts: list[Words], component: list, fresh: list[bool], t: tuple[int, int] = THRESHOLD) -> list[tuple[int, int]]:
    """Links that join the components among the members of a bucket as far as their similarities do.

    A word, with its occurrence number, common to two similar members is among the first ``size - ceil(t * size) + 1`` of either, in the order of
    rarity in the bucket.  Pairs of members that both aren't ``fresh`` are left to another call.
    """
    every, count = np.unique(np.concatenate([x.labelled for x in texts]), return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, count))] = np.arange(len(every))
    alone = np.sort(count) == 1  # by rank: a word of one member meets nobody
    size = np.array([len(x) for x in texts])
    tally = np.stack([np.bincount((x.labelled % np.uint64(TALLY)).astype(np.int64), minlength=TALLY).astype(np.uint32) for x in texts])
    root = {c: c for c in component}

    def find(x):
        while root[x] != x:
            x = root[x] = root[root[x]]
        return x

    index: dict[int, list[int]] = {}
    out = []
    for i, own in enumerate(texts):
        n = len(own)
        prefix = np.sort(rank[np.searchsorted(every, own.labelled)])[: n - -(-t[0] * n // t[1]) + 1]
        met: set[int] = set()
        for r in prefix[~alone[prefix]].tolist():
            met.update(index.setdefault(r, []))
            index[r].append(i)
        own_root = find(component[i])
        js = np.array(sorted(j for j in met if (fresh[i] or fresh[j]) and find(component[j]) != own_root), np.int64)
        if not len(js):
            continue
        need = -(-t[0] * np.maximum(size[js], n) // t[1])
        js, need = js[np.minimum(size[js], n) >= need], need[np.minimum(size[js], n) >= need]
        # Words that fall into the same of TALLY places are at least as many as the shared ones.
        most = np.concatenate([np.minimum(tally[own], tally[i]).sum(1) for own in np.array_split(js, len(js) // 256 + 1)])
        for j in js[most >= need].tolist():
            a, b = find(component[i]), find(component[j])
            if a != b and linked(texts[j], own, t):
                root[a] = b
                out.append((j, i))
    return out


def _rest(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the components of each bucket."""
    band = F.when(F.col("size") > BANDED, length_band(F.col("words"))).otherwise(F.lit(None))
    dealt = members.withColumn("own", F.coalesce(band, F.lit(0))).withColumn("band", F.explode(F.when(band.isNull(), F.array(F.lit(0))).otherwise(F.array(band, band + 1))))
    joined = dealt.join(texts, "node").select("bucket", "band", (F.col("own") == F.col("band")).alias("fresh"), "node.doc", "node.tie", F.col("component.doc").alias("c_doc"), F.col("component.tie").alias("c_tie"), "text")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "c_doc", "c_tie", "fresh")), strict=True)
            held += [Words.of(x.as_py()) for x in batch.column("text")]
        if len({r[2:4] for r in rows}) < 2:
            return
        order = sorted(range(len(rows)), key=lambda i: rows[i][:2])
        rows, held = [rows[i] for i in order], [held[i] for i in order]
        found = bucket_links(held, [r[2:4] for r in rows], [r[4] for r in rows])
        columns = list(zip(*((*rows[j][:2], *rows[i][:2]) for j, i in found), strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "tie", "b_doc", "b_tie"])
        A.release()

    # Few bytes and much work: dealt by number, which isn't merged into a few tasks.
    dealt = joined.repartition(shuffle_partitions(members.sparkSession), "bucket", "band")
    found = dealt.groupBy("bucket", "band").applyInArrow(run, "doc long, tie long, b_doc long, b_tie long")
    return found.select(F.struct("doc", "tie").alias("a"), F.struct(F.col("b_doc").alias("doc"), F.col("b_tie").alias("tie")).alias("b"))


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links (a, b) that join all classes of the nodes, which are representatives of equal texts with their sketches."""
    share = F.pmod(F.xxhash64("node"), F.lit(max(16, shuffle_partitions(docs.sparkSession)))).cast("int")
    held = nodes.where("n > 0").select("node", "words", share.alias("share"), F.posexplode("sketches").alias("j", "h")).select("node", "words", F.xxhash64("j", "h").alias("bucket"), "share")
    key = ["bucket", "share"]
    counted = held.groupBy(*key).agg(F.count("*").alias("n"))
    size = counted.groupBy("bucket").agg(F.sum("n").alias("size")).where("size > 1")  # of at most a row for each share
    members = held.join(counted.select(*key).join(size, "bucket"), key)
    central = members.groupBy("node").agg(F.sum("size").alias("centrality"))
    members = cut(members.join(central, "node"))
    texts = cut(_payloads(docs, members.select("node").distinct()))
    order = F.struct("centrality", F.negate(F.col("node.doc")).alias("d"), F.negate(F.col("node.tie")).alias("t"))
    local = members.groupBy(*key).agg(F.max(F.struct(order.alias("o"), "node")).alias("best"))
    top = local.groupBy("bucket").agg(F.max("best").alias("best"))
    to_local = members.join(local, key).select("node", F.col("best.node").alias("leader"))
    to_top = local.select("bucket", F.col("best.node").alias("node")).join(top.select("bucket", F.col("best.node").alias("leader")), "bucket").select("node", "leader")
    led = to_local.unionByName(to_top).where(F.col("node") != F.col("leader"))
    found = cut(_aligned(led.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct(), texts), small=True)
    named = components(found)
    members = members.join(named, "node", "left").select(*key, "node", "words", "size", F.coalesce("component", F.col("node")).alias("component"))
    # A bucket of two was compared whole.
    ends = [F.min("component").alias("lo"), F.max("component").alias("hi")]
    spread = members.where("size > 2").groupBy(*key).agg(*ends).groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    several = spread.where("lo != hi").select("bucket")
    return found.unionByName(cut(_rest(members.join(several, "bucket", "left_semi"), texts), small=True))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, class_doc, class_tie) of every ``numbered`` document."""
    table = cut(sketch_table(docs))
    content = ["n", "c0", "c1"]
    nodes = cut(table.where("n > 0").groupBy(*content).agg(F.min(F.struct(_node().alias("node"), "words", "sketches")).alias("least")).select(*content, "least.node", "least.words", "least.sketches"))
    named = components(links(docs, nodes))
    named = nodes.select(*content, "node").join(named, "node", "left").select(*content, F.coalesce("component", "node").alias("class"))
    out = table.select("doc_id", "tie", *content).join(named, content, "left")
    of_class = F.coalesce("class", _node())
    return out.select("doc_id", "tie", of_class["doc"].alias("class_doc"), of_class["tie"].alias("class_tie"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) of every document; one of each class is kept."""
    named = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    kept = (F.col("doc_id") == F.col("class_doc")) & (F.col("tie") == F.col("class_tie"))
    return classes(X.numbered(docs)).select(named("doc_id").alias("doc_id"), named("class_doc").alias("class_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The first document of each class, with all columns; one of equal rows."""
    numbered = X.numbered(docs, rest=True)
    first = classes(numbered.drop("rest")).where((F.col("doc_id") == F.col("class_doc")) & (F.col("tie") == F.col("class_tie"))).select("doc_id", "tie").distinct()
    return numbered.join(first, ["doc_id", "tie"], "left_semi").select("rest.*")
