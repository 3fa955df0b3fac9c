"""SimHash near-duplicates by pivot distance tables.

A table of Hamming distances to reference fingerprints (pivots) is computed once, for each distinct fingerprint. By the
triangle inequality two fingerprints within ``radius`` differ by at most ``radius`` in every coordinate, so a pair whose
maximum coordinate difference is larger is discarded unseen; survivors are verified on the fingerprints themselves. The
table can't be the key of a join: the distances of unrelated fingerprints to one pivot lie within the radius more often
than not (0.57), so each coordinate would repeat rows as often as it thins pairs. Pairs are therefore looked for inside
buckets: the 64 bits are cut into blocks, of which two fingerprints within the radius agree in all but ``radius``, and a
bucket holds those that agree in one choice of blocks. Inside a bucket rows are sorted by the table, a window of its first
coordinate is searched, and the other coordinates discard all but about one in ten thousand of the unrelated.

A bucket emits a spanning forest of its links, never all pairs of a group; buckets beyond ``BUCKET_ROWS`` are cut into
chunks and compared chunk by chunk over many tasks, so each link is still seen.

The pipeline's stage (``keep_one_of_each``) asks for shingle sets with a similarity of 0.8, where fingerprints differ in
eight bits on average and in up to seventeen; no affordable choice of blocks finds all of these. SimHash comes first: pairs
of fingerprints up to ``NEAR`` bits apart that meet in buckets are verified on the shingle sets (``fingerprint_links``). An
exact join of the sets then finds the links between what these left apart, so none is lost.

Defined results: null and word-less texts have fingerprint zero and link like any other; rows without doc_id take part
but give no component number (null if a component has no other); repeated rows share one component.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm import linejoin
from tracewarden.llm.common import discard, materialize, table

RADIUS = 4
#: The pipeline's fingerprints are candidates up to NEAR bits apart; its blocks bring together all that are up to SURE apart.
NEAR, SURE = 12, 6
SHINGLE = 4
SEED = 42
#: Members of a bucket that one task compares; larger buckets are cut into chunks of half as many.
BUCKET_ROWS = 4096
#: Reference fingerprints of the distance table; fixed, so that every worker builds the same table.
PIVOTS = np.random.default_rng(20240229).integers(0, 2**64, 16, dtype=np.uint64)
FINGERPRINTS = "doc_id long, fp long"


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles, repeats included; bytes.lower() and bytes.split() know ASCII alone."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
    else:
        words = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in words], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long). Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FINGERPRINTS)


def _choices(n: int, radius: int) -> list[np.uint64]:
    """Bit masks of the block choices. More blocks give longer keys, so that buckets stay small as n grows."""
    for blocks in range(radius + 1, 2 * radius + 1):
        if n <= 2 ** (64 * (blocks - radius) // blocks + 3):
            break
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [np.uint64(sum(c)) for c in itertools.combinations(masks, blocks - radius)]


def pivot_table(distinct: DataFrame) -> DataFrame:
    """fp and its distances to all pivots, a byte each, in two longs; the first distance leads."""
    far = [f"cast(bit_count(fp ^ {int(p.view(np.int64))}L) AS bigint)" for p in PIVOTS]
    packed = [F.expr(" | ".join(f"shiftleft({f}, {56 - 8 * k})" for k, f in enumerate(far[i : i + 8]))) for i in (0, 8)]
    return distinct.select("fp", packed[0].alias("far0"), packed[1].alias("far1"))


def table_of(far0: np.ndarray, far1: np.ndarray) -> np.ndarray:
    """The distances (a row a fingerprint) of the two longs."""
    return np.stack([far0, far1], axis=1).astype(">i8").view(np.int8).reshape(-1, len(PIVOTS))


def _bucket_rows(table_: DataFrame, masks: list) -> DataFrame:
    """key, fp, far0, far1 for each choice of blocks; key is a hash of the choice and of the bits chosen (equal bits, equal key)."""
    signed = [int(np.int64(np.uint64(m).view(np.int64))) for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])
    return table_.select("fp", "far0", "far1", F.explode(keys).alias("key"))


def survivors(table_a: np.ndarray, table_b: np.ndarray, radius: int) -> np.ndarray:
    """Places of the rows of two tables (or of one row and a table) with no coordinate further apart than the radius."""
    at = np.flatnonzero((np.abs(table_a[..., :4] - table_b[..., :4]) <= radius).all(axis=-1))
    a = table_a[at] if table_a.ndim == 2 else table_a
    return at[(np.abs(a[..., 4:] - table_b[at][..., 4:]) <= radius).all(axis=-1)]


def _forest(fps: np.ndarray, table_: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within one bucket: a breadth-first search that looks at the unreached alone.

    Rows are sorted by the table's first coordinate.
    """
    out = []
    waiting, queue = np.ones(len(fps), bool), []
    rest, lead = np.arange(len(fps)), table_[:, 0]
    while len(rest) or queue:
        if queue:
            i = queue.pop()
        else:
            i, rest = int(rest[0]), rest[1:]
            waiting[i] = False
        if not len(rest):
            break
        window = rest[np.searchsorted(lead[rest], lead[i] - radius) : np.searchsorted(lead[rest], lead[i] + radius, "right")]
        hit = window[survivors(table_[i], table_[window], radius)]
        hit = hit[np.bitwise_count(fps[hit] ^ fps[i]) <= radius]
        if len(hit):
            out.append((np.full(len(hit), fps[i]), fps[hit]))
            waiting[hit] = False
            rest = rest[waiting[rest]]
            queue.extend(hit.tolist())
    return out


def _compare(radius: int):
    """Over rows sorted by bucket and table: emits the links of each bucket as (a, b). A bucket is bounded, so is what is held."""

    def pairs_of(keys: np.ndarray, fps: np.ndarray, far0: np.ndarray, far1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        small = np.repeat((sizes > 1) & (sizes <= 24), sizes)
        k, f, table_ = keys[small], fps[small], table_of(far0[small], far1[small])
        for lag in range(1, 24):  # all small buckets at once, neighbours at distance lag
            at = np.flatnonzero(k[lag:] == k[:-lag])
            if not len(at):
                break
            at = at[survivors(table_[at], table_[at + lag], radius)]
            at = at[np.bitwise_count(f[at] ^ f[at + lag]) <= radius]
            found.append((f[at], f[at + lag]))
        for s, n in zip(starts[sizes > 24].tolist(), sizes[sizes > 24].tolist()):
            found += _forest(fps[s : s + n], table_of(far0[s : s + n], far1[s : s + n]), radius)
        return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (fps[:0], fps[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for b in itertools.chain(batches, [None]):
            if b is not None:
                fresh = [c.to_numpy() for c in b.columns]
                fresh[1] = fresh[1].view(np.uint64)
                held = [np.concatenate(x) for x in zip(held, fresh)]
                keys = held[0]
                if not len(keys) or keys[0] == keys[-1]:
                    continue
                cut = int(np.searchsorted(keys, keys[-1])) if (keys[1:] >= keys[:-1]).all() else len(keys) - int((keys[::-1] != keys[-1]).argmax())
            else:
                cut = len(held[0])
            if cut:
                a, c = pairs_of(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=["a", "b"])

    return run


def near_links(distinct: DataFrame, n: int, radius: int = RADIUS, sure: int | None = None) -> DataFrame:
    """Links a, b between distinct fingerprints that connect all that are within the radius of one another.

    With sure, for callers that find the rest in another way: blocks are those of this smaller radius, so links beyond it
    need a bucket in common, and the chunks of a large bucket meet its first chunk only.
    """
    rows = _bucket_rows(materialize(pivot_table(distinct), "pivots"), _choices(n, radius if sure is None else sure))
    half = BUCKET_ROWS // 2
    hot = rows.groupBy("key").count().filter(F.col("count") > BUCKET_ROWS).select("key", F.ceil(F.col("count") / half).cast("int").alias("chunks"))
    marked = rows.join(hot, "key", "left")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    # a chunk meets each chunk, itself included: block (i, j) holds chunks i and j
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    if sure is not None:  # block (0, j) holds chunks 0 and j
        others = F.when(own == 0, F.sequence(F.lit(1), F.col("chunks") - 1)).otherwise(F.array(F.lit(0)))
    blocks = F.when(F.col("chunks").isNull(), F.array(F.col("key"))).otherwise(
        F.transform(others, lambda j: F.xxhash64(F.col("key"), F.least(own, j), F.greatest(own, j)))
    )
    dealt = marked.select(F.explode(blocks).alias("key"), "fp", "far0", "far1").repartition("key").sortWithinPartitions("key", "far0", "far1")
    return dealt.mapInArrow(_compare(radius), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links: smallest label by rounds of neighbour minima and pointer jumps.

    Each round is written to the shared folder, so a lost executor costs that round at most.
    """
    both = materialize(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")), "links")
    labels = materialize(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        nearer = labels.join(seen, "node", "left").select("node", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        fresh = materialize(nearer.join(jump, "next", "left").select("node", F.least("next", "far").alias("root"), "was"), "labels")
        if fresh.filter(F.col("root") != F.col("was")).isEmpty():
            return fresh.select("node", "root")
        labels = fresh.select("node", "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of those reachable)."""
    each = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_links(distinct.select("fp"), distinct.count(), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return each.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles_of(texts: list[str], shingle: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of every word shingle, and a one for each text; words as in ``fingerprint``.

    A text of fewer words, or of none, has one shingle of all of them.
    """
    raw = [t.encode().lower() for t in texts]
    _, starts, _, h = linejoin.word_spans(raw)
    text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]) - 1, starts)
    factors = np.random.default_rng(shingle).integers(1, 2**63, shingle, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    whole = np.flatnonzero(text[shingle - 1 :] == text[: max(len(text) - shingle + 1, 0)])
    long = np.zeros(len(whole), np.uint64)
    for k, f in enumerate(factors):
        long += h[whole + k] * f
    counts = np.bincount(text, minlength=len(texts))
    few = np.flatnonzero(counts < shingle)
    first = (np.cumsum(counts) - counts)[few]
    short = counts[few].astype(np.uint64) + np.uint64(1)
    for k, f in enumerate(factors):
        more = counts[few] > k
        short[more] += h[first[more] + k] * f
    line = np.r_[text[whole], few]
    order = np.argsort(line, kind="stable")
    return linejoin._mix(np.r_[long, short], 5)[order], line[order], np.ones(len(texts), np.int64)


_MET = ["word", "block", "s1", "n", "place", "sort_id"]


def _meetings(threshold: float, every: bool):
    """Over a task's postings: pairs a, b of sets that may match, and "b may have more" as a null a.

    With every, all pairs of sets under different labels whose second is open, and nothing else.
    """
    names = [*_MET, *(["open", "label"] if every else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = linejoin.runs(batches, names)
        if cols is None:
            return
        n, place, s1, ids = (cols[k] for k in ("n", "place", "s1", "sort_id"))
        named, full = np.zeros(len(n), np.int16), np.zeros(len(n), bool)
        out = []
        for i, j in linejoin.neighbours(cols, threshold, full):
            fits = 1 + np.minimum(n[i] - place[i], n[j] - place[j]) >= threshold / (1 + threshold) * (n[i] + n[j]) - 1e-9
            if every:
                fits &= (cols["open"][i] > 0) & (cols["label"][i] != cols["label"][j])
            i, j = i[fits], j[fits]
            if not every:
                left = named[i] < linejoin.NAMED
                full[i[~left]] = True
                i, j = i[left], j[left]
                named[i] += 1
            out.append((j, i))
        a = np.concatenate([x for x, _ in out] or [np.zeros(0, np.int64)])
        b = np.concatenate([x for _, x in out] or [np.zeros(0, np.int64)])
        m = np.flatnonzero(full | (cols["block"] > 0) & (not every))  # chunks met one other chunk only
        yield linejoin.pairs_batch(s1[a].view(np.int64), s1[b].view(np.int64), ids[a], ids[b], s1[m].view(np.int64), ids[m])

    return run


def _each_once(pairs: DataFrame) -> DataFrame:
    """Pairs a, b (ia, ib) written once, a < b."""
    swap = F.col("a") > F.col("b")  # of a null and b neither
    named = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("ia", "ib"), ("ib", "ia"))]
    return materialize(pairs.select(*named).distinct(), "met")


def _met(dealt: DataFrame, threshold: float, every: bool) -> DataFrame:
    return _each_once(dealt.mapInArrow(_meetings(threshold, every), linejoin._PAIRS))


def _alike(docs: DataFrame, pairs: DataFrame, threshold: float, parts, known: DataFrame | None = None) -> DataFrame:
    """Links a, b among the pairs that connect all that match on whole sets: one pair of each set, then those still apart.

    Pairs that the known links connect are not looked at; the links returned include these.
    """
    if known is not None:
        pairs = materialize(_labelled(pairs, known, "a", "b").filter("label_a != label_b").select("a", "b", "ia", "ib"), "apart")
    sets = linejoin.needed_sets(docs, pairs, parts)
    one = materialize(pairs.groupBy("b").agg(F.min_by("a", F.xxhash64("a", "b")).alias("a")).select("a", "b"), "one")
    links = materialize(linejoin.verified(sets, one, threshold), "alike")
    links = links if known is None else known.union(links)
    rest = _labelled(pairs.select("a", "b").join(one, ["a", "b"], "left_anti"), links, "a", "b").filter("label_a != label_b")
    late = materialize(linejoin.verified(sets, rest, threshold), "alike")
    discard(sets, one)
    return links.union(late)


def _labelled(df: DataFrame, links: DataFrame, *names: str) -> DataFrame:
    """df with label_<name>: the component of each named column's set under the links, itself if it has none."""
    roots = components(links)
    for name in names:
        df = df.join(roots.select(F.col("node").alias(name), F.col("root").alias(f"label_{name}")), name, "left")
        df = df.withColumn(f"label_{name}", F.coalesce(f"label_{name}", name))
    return df


def set_fingerprints(docs: DataFrame, parts) -> DataFrame:
    """s1, fp, id: every shingle set, its SimHash (each shingle once) and the sort_id of its first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.uint64(1)
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0).to_numpy()
            for i, j in linejoin._chunks(texts):
                sets = linejoin.LineSets(texts[i:j], None, parts)
                half, fps = sets.sizes.astype(np.uint64) // np.uint64(2), np.zeros(len(sets.s1), np.uint64)
                for k in map(np.uint64, range(64)):
                    fps |= (np.add.reduceat((sets.h >> k) & one, sets.starts) > half).astype(np.uint64) << k
                at = sets.text_of[sets.lines] + i
                yield pa.RecordBatch.from_arrays([pa.array(sets.s1.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(ids[at])], names=["s1", "fp", "id"])

    found = docs.select("sort_id", "text").mapInArrow(run, "s1 long, fp long, id long")
    return materialize(found.groupBy("s1").agg(F.first("fp").alias("fp"), F.min("id").alias("id")), "fingerprints")


def fingerprint_links(docs: DataFrame, threshold: float, parts) -> DataFrame:
    """Links a, b of sets of near or equal fingerprints that match on whole sets; docs has sort_id and text.

    One set stands for all of its fingerprint: the others are compared with it, and it with those of fingerprints nearby.
    """
    prints = set_fingerprints(docs, parts)
    leads = materialize(prints.groupBy("fp").agg(F.min(F.struct("s1", "id")).alias("lead")).select("fp", "lead.s1", "lead.id"), "leads")
    a, b = (leads.select(F.col("fp").alias(f"fp_{x}"), F.col("s1").alias(x), F.col("id").alias(f"i{x}")) for x in "ab")
    near = near_links(leads.select("fp"), leads.count(), NEAR, SURE).toDF("fp_a", "fp_b").join(a, "fp_a").join(b, "fp_b")
    same = prints.select(F.col("fp").alias("fp_a"), F.col("s1").alias("b"), F.col("id").alias("ib")).join(a, "fp_a").filter("a != b")
    pairs = _each_once(near.select("a", "b", "ia", "ib").union(same.select("a", "b", "ia", "ib")))
    links = _alike(docs, pairs, threshold, parts)
    discard(prints, leads, pairs)
    return links


def _places(blocks: DataFrame) -> DataFrame:
    """s1, sort_id, tie of the first place of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                sets = linejoin.Sets.unpack(blob.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(sets["s1"].view(np.int64)), pa.array(sets["sort_id"]), pa.array(sets["tie"])], names=["s1", "sort_id", "tie"])

    return blocks.select("blob").mapInArrow(run, "s1 long, sort_id long, tie long")


def later_copies(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """sort_id, tie of the documents of which another of their component comes first.

    Components are those of links of Jaccard similarity of at least threshold. docs has sort_id, tie and text. What near
    fingerprints link is one; the rest is found by an exact join of shingle sets by prefixes, as in ``linejoin``: sets
    first meet few others a shingle, and what that links is one as well; then all pairs of different components that went
    unnamed are met.
    """

    def parts(texts: list[str]):
        return shingles_of(texts, shingle)

    near = fingerprint_links(docs, threshold, parts)
    rarity = linejoin.count_words(docs, parts)
    table_, n_parts = linejoin.set_table(docs, rarity, threshold, parts)
    blocks = linejoin.blocks_of(table_)
    chunks = linejoin.hot_words(blocks, rarity)
    met = _met(linejoin.postings_by_word(blocks, _MET, chunks, every=False), threshold, every=False)
    links = _alike(docs, met.filter(F.col("a").isNotNull()), threshold, parts, near)
    open_ = materialize(met.filter(F.col("a").isNull()).select(F.col("b").alias("s1")).distinct(), "open")
    if not open_.isEmpty():
        roots = components(links).select(F.col("node").alias("s1"), "root")
        labels = linejoin.by_part(roots, n_parts, "root").select("part", F.col("s1").alias("label_keys"), F.col("root").alias("label_values"))
        keyed = blocks.join(linejoin.by_part(open_, n_parts).withColumnRenamed("s1", "open"), "part", "left").join(labels, "part", "left")
        dealt = linejoin.postings_by_word(keyed, [*_MET, "open", "label"], chunks, every=True, words=linejoin.words_of_sets(keyed))
        links = links.union(_alike(docs, _met(dealt, threshold, every=True), threshold, parts))
    roots = components(links).withColumnRenamed("node", "s1")
    rooted = materialize(_places(blocks).join(roots, "s1"), "rooted")
    first = rooted.groupBy("root").agg(F.min(F.struct("sort_id", "s1")).alias("first"))
    later = rooted.join(first, "root").filter(F.struct("sort_id", "s1") != F.col("first")).select("sort_id", "tie")
    gone = materialize(later.union(table_.filter(F.col("blob").isNull()).select("sort_id", "tie")).distinct(), "gone")
    discard(table_, met, open_, rooted)
    return gone


def keep_one_of_each(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The document with the smallest id of each component, all columns kept; rows without an id come after all others.

    Of equal rows one stays, and of rows of one component that share the smallest id as well.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**62) + F.pmod(F.xxhash64(text), F.lit(2**61)))
    keyed = docs.withColumn("_own_id", own).withColumn("_text_hash", F.xxhash64(text))
    gone = later_copies(keyed.select(F.col("_own_id").alias("sort_id"), F.col("_text_hash").alias("tie"), text.alias("text")), shingle, threshold)
    gone = gone.select(F.col("sort_id").alias("_own_id"), F.col("tie").alias("_text_hash"))
    return keyed.join(gone, ["_own_id", "_text_hash"], "left_anti").dropDuplicates(["_own_id", "_text_hash"]).select(*docs.columns)


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of all documents whose fingerprints differ in at most four bits."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
