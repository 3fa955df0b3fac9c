"""Line deduplication by an exact set-similarity join with prefix, positional and length filters.

A line is the set of its words (runs of anything but ASCII white space). Lines whose sets have Jaccard similarity of at
least ``THRESHOLD`` match; a line goes if some earlier line, in the order (doc_id, place in the text), matches it. Lines
without a word are left alone.

1. Word occurrences are counted over all texts in a table of fixed size; it orders words by rarity.
2. Each line's words are ordered, rarest first; its prefix is indexed: two sets that match share a word of their prefixes.
   Lines with equal sets are one set, found by a 128-bit sum of word hashes; each task keeps the first of those it meets,
   and the sets are dealt by hash, so that every set is known once, with its true first place. That alone decides sets too
   small to match any but an equal one (up to three words at 0.8; four words match five), which are not indexed.
3. Postings are dealt by word in packed arrays. Lines that share a prefix word are compared in the order of their first
   places: length filter, positional filter, and a bitmap of word parities that bounds the symmetric difference from below
   (128 bits). A line names its first few candidates only and says if it may have more, so a group of copies never emits
   all its pairs. A word with more than ``CHUNK`` postings is cut into chunks; each chunk meets one of them in this round.
4. Candidates are verified on their whole sets. Lines that may have more and no match yet are compared with all others of
   their words in a second round, chunk by chunk; it decides them exactly.

Words are compared by 64-bit hashes: a chain of mixing steps over eight bytes at a time (one step can't map two words of up
to eight bytes to one hash), and XXH3 for words of more than ``SHORT`` bytes. The order of lines is (doc_id, place in the text), then a hash of the set.

Defined results: a null text stays null; repeated rows (same id, same text) are one document and get equal results; a null
doc_id sorts first; texts keep the order of the lines that stay; an emptied text is the empty string; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import discard, key_or_min, materialize, shuffle_width, table

THRESHOLD = 0.8
#: Places of the table that counts words, of the one that counts postings, and bounds of the filter of sets to verify; they
#: bound what is shipped to executors.
COUNT_BITS, POSTING_BITS, FILTER_BITS = 20, 20, (20, 29)
_SEGMENT = 2**14
#: Candidates that a line names for one word before it says "more".
NAMED = 3
#: Postings of a word that one task compares with one another; a word with more is cut into chunks of at most so many.
CHUNK = 8192
#: Text that is hashed at once.
CHUNK_BYTES = 1 << 20
#: Text whose sets, and sets whose postings, a task holds before it sends them on.
HELD_CHARS, HELD_SETS = 64 << 20, 200_000
#: Postings of a task at about.
TASK_POSTINGS = 4_000_000
#: Words of up to so many bytes are hashed in arrays, eight bytes at a time.
SHORT = 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def eight_from(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, but for the last eight places."""
    return np.ndarray(len(padded) - 8, np.uint64, padded, 0, (1,))


def equal_words(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each word has the bytes of word other[k]."""
    eight, sizes = eight_from(padded), ends - starts
    equal = sizes == sizes[other]
    for at in range(0, SHORT, 8):
        long = np.flatnonzero(equal & (sizes > at))
        mask = _MASKS[np.minimum(sizes[long] - at, 8)]
        equal[long] = eight[starts[long] + at] & mask == eight[starts[other[long]] + at] & mask
    for k in np.flatnonzero(equal & (sizes > SHORT) & (other != np.arange(len(other)))).tolist():
        o = other[k]
        equal[k] = np.array_equal(padded[starts[k] : ends[k]], padded[starts[o] : ends[o]])
    return equal


def word_spans(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by line feeds and followed by eight zeros, and start, end and hash of every word in them."""
    padded = np.frombuffer(b"\n".join(raw) + b"\n" + bytes(8), np.uint8)
    buffer = padded[:-8]
    space = (buffer == 32) | (buffer - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edges = np.r_[0, edges]
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    eight = eight_from(padded)
    h = _mix(eight[starts] & _MASKS[np.minimum(sizes, 8)], 11)
    h += sizes.astype(np.uint64)
    for at in range(8, SHORT, 8):
        long = np.flatnonzero(sizes > at)
        if not len(long):
            break
        h[long] = _mix(h[long], 12) ^ _mix(eight[starts[long] + at] & _MASKS[np.minimum(sizes[long] - at, 8)], 13 + at)
    for k in np.flatnonzero(sizes > SHORT).tolist():
        h[k] = xxhash.xxh3_64_intdigest(padded[starts[k] : ends[k]].tobytes(), 64)
    return padded, starts, ends, _mix(h, 1)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and line of every word, and the number of lines of each text; lines are counted through all texts."""
    raw = [t.encode() for t in texts]
    buffer, starts, _, h = word_spans(raw)
    breaks = np.flatnonzero(buffer == 10)
    lines = np.repeat(np.arange(len(breaks)), np.diff(np.r_[0, np.searchsorted(starts, breaks)]))
    return h, lines, np.array([r.count(b"\n") + 1 for r in raw], np.int64)


def _chunks(texts: list[str], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about `limit` characters together."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _by_line(line: np.ndarray, h: np.ndarray, rarity: np.ndarray | None) -> np.ndarray:
    """Order by line, rarity and hash. One sort of a packed key does, unless two hashes of a line share its bits."""
    if len(line) and line[-1] < 2**20:
        key = line.astype(np.uint64) << np.uint64(44)
        key |= h >> np.uint64(20) if rarity is None else (rarity.astype(np.uint64) << np.uint64(28)) | (h >> np.uint64(36))
        order = np.argsort(key)
        key = key[order]
        tied = np.flatnonzero(key[1:] == key[:-1])
        if not (h[order[tied]] != h[order[tied + 1]]).any():
            return order
    return np.lexsort((h, line) if rarity is None else (h, rarity, line))


class LineSets:
    """The word sets of the lines of some texts: hashes sorted by (line, order), with their bounds."""

    def __init__(self, texts: list[str], rarity: np.ndarray | None, parts=words_of):
        h, line, per_text = parts(texts)
        self.text_of = np.repeat(np.arange(len(texts)), per_text)
        self.number = np.concatenate([np.arange(n) for n in per_text]) if len(texts) else np.zeros(0, np.int64)
        order = _by_line(line, h, None if rarity is None else rarity[h >> np.uint64(64 - COUNT_BITS)])
        h, line = h[order], line[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (line[1:] != line[:-1])] if len(h) else np.zeros(0, bool)
        h, line = h[new], line[new]
        sizes = np.bincount(line, minlength=len(self.number)) if len(line) else np.zeros(len(self.number), np.int64)
        self.h, self.lines = h, np.flatnonzero(sizes)
        self.sizes = sizes[self.lines]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bitmaps: list[np.ndarray] = []
        if not len(self.starts):
            self.s1 = self.s2 = np.zeros(0, np.uint64)
            return
        self.s1 = np.add.reduceat(_mix(self.h, 2), self.starts)
        if rarity is not None:
            self.s2 = np.add.reduceat(_mix(self.h, 3), self.starts)
            spot = _mix(self.h, 4) >> np.uint64(57)  # one of 128 bits
            bit = np.uint64(1) << (spot & np.uint64(63))
            low = spot < 64
            self.bitmaps = [np.bitwise_xor.reduceat(bit * half, self.starts) for half in (low, ~low)]


def count_words(docs: DataFrame, parts=words_of) -> np.ndarray:
    """Rarity class of each place of the count table (an octave has eight), over all words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(2**COUNT_BITS, np.uint32), [], 0

        def add_up() -> None:
            np.add(total, np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32), out=total)

        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for i, j in _chunks(texts):
                h, _, _ = parts(texts[i:j])
                held.append((h >> np.uint64(64 - COUNT_BITS)).astype(np.int32))
                n += len(h)
                if n >= 1 << 21:
                    add_up()
                    held, n = [], 0
        if held:
            add_up()
        segments = [total[a : a + _SEGMENT].tobytes() for a in range(0, len(total), _SEGMENT)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(segments)), pa.int32()), pa.array(segments, pa.binary())], names=["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1)):
                sums[s] = sums.get(s, 0) + np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["segment", "counts"])

    rows = docs.select("text").mapInArrow(run, "segment int, counts binary").repartition("segment").mapInArrow(add, "segment int, counts binary").toArrow()
    total = np.zeros(2**COUNT_BITS, np.int64)
    for s, c in zip(rows.column("segment").to_pylist(), rows.column("counts").to_pylist()):
        total[s * _SEGMENT : (s + 1) * _SEGMENT] = np.frombuffer(c, np.int64)
    return np.floor(8 * np.log2(np.maximum(total, 1))).clip(0, 65535).astype(np.uint16)


def _prefix(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[k] .. starts[k] + sizes[k] - 1 for all k in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of integers of one length, each in as few bytes as its values need."""
    narrow = []
    for x in columns:
        if x.dtype.kind == "i" and len(x) and x.min() >= 0:
            x = x.view(f"u{x.itemsize}")
        if x.dtype.kind == "u" and x.itemsize > 1:
            x = x.astype(np.min_scalar_type(x.max() if len(x) else 0))
        narrow.append(x)
    head = np.array([len(columns[0]), *[x.itemsize if x.dtype.kind == "u" else -x.itemsize for x in narrow]], np.int32)
    return head.tobytes() + b"".join(x.tobytes() for x in narrow)


def _unpack(blob: bytes, kinds: list[np.dtype]) -> list[np.ndarray]:
    head = np.frombuffer(blob, np.int32, len(kinds) + 1)
    n, at, out = int(head[0]), 4 * (len(kinds) + 1), []
    for size, kind in zip(head[1:].tolist(), kinds):
        x = np.frombuffer(blob, f"u{size}" if size > 0 else f"i{-size}", n, at)
        at += n * abs(size)
        out.append(x.astype(kind, copy=False) if x.itemsize < kind.itemsize else x.view(kind))
    return out


_SETS = {"s1": "u8", "s2": "u8", "sort_id": "i8", "tie": "i8", "line": "i4", "n": "i4", "bits0": "u8", "bits1": "u8", "size": "i4"}
_SET_KINDS = [np.dtype(k) for k in _SETS.values()]


class Sets:
    """Sets of words with their first places: columns by name, and their prefixes (32 bits of a hash) in a row."""

    def __init__(self, columns: list[np.ndarray], prefix: np.ndarray):
        self.columns, self.prefix = columns, prefix
        self.starts = np.cumsum(self["size"], dtype=np.int64) - self["size"]

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[list(_SETS).index(name)]

    def __len__(self) -> int:
        return len(self.columns[0])

    def take(self, at: np.ndarray) -> Sets:
        return Sets([x[at] for x in self.columns], self.prefix[_ragged(self.starts[at], self["size"][at])])

    def pack(self) -> bytes:
        return _pack(self.columns) + self.prefix.tobytes()

    @staticmethod
    def unpack(blob: bytes) -> Sets:
        columns = _unpack(blob, _SET_KINDS)
        n = int(columns[-1].sum())
        return Sets(columns, np.frombuffer(blob, np.uint32, n, len(blob) - 4 * n))

    @staticmethod
    def concat(parts: list[Sets]) -> Sets:
        return Sets([np.concatenate(x) for x in zip(*(p.columns for p in parts))], np.concatenate([p.prefix for p in parts]))

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each set has its first place, and where it has others; a place that is there twice counts once."""
        order = np.argsort(self["s1"], kind="stable")
        s1 = self["s1"][order]
        same = s1[1:] == s1[:-1]
        many = np.r_[same, False] | np.r_[False, same]
        some = order[many]
        some = some[np.lexsort([self[x][some] for x in ("tie", "line", "sort_id", "s2", "s1")])]
        before = [(self[x][some[1:]] == self[x][some[:-1]]) for x in ("s1", "s2", "sort_id", "line", "tie")]
        first = np.r_[True, ~(before[0] & before[1])][: len(some)]
        again = np.r_[False, before[0] & before[1] & before[2] & before[3] & before[4]][: len(some)]
        return np.concatenate([order[~many], some[first]]), some[~first & ~again]


_TABLE = "part int, postings int, blob binary, sort_id long, tie long, line int, s1 long"
_TABLE_NAMES = [x.split()[0] for x in _TABLE.split(", ")]


def _emit(sets: Sets, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of _TABLE: blobs of sets by part, and a row for each place that isn't its set's first."""
    if not len(sets):
        return
    firsts, others = sets.firsts()
    if len(others):
        nothing = [pa.nulls(len(others), k) for k in (pa.int32(), pa.int32(), pa.binary())]
        places = [pa.array(np.ascontiguousarray(sets[x][others]).view(f"i{sets[x].itemsize}")) for x in ("sort_id", "tie", "line", "s1")]
        yield pa.RecordBatch.from_arrays([*nothing, *places], names=_TABLE_NAMES)
    part = (sets["s1"][firsts] >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    kept, part = sets.take(firsts[order]), part[order]
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    rows: list[tuple] = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        for i in range(a, b, HELD_SETS):
            j = min(b, i + HELD_SETS)
            block = kept.take(np.arange(i, j))
            rows.append((int(part[a]), len(block.prefix), block.pack()))
    for i in range(0, len(rows), 64):
        some = list(zip(*rows[i : i + 64]))
        nothing = [pa.nulls(len(some[0]), k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int32()), pa.array(some[1], pa.int32()), pa.array(some[2], pa.binary()), *nothing], names=_TABLE_NAMES)


def set_table(docs: DataFrame, rarity: np.ndarray, threshold: float, parts=words_of) -> tuple[DataFrame, int]:
    """The distinct line sets of docs (sort_id, tie, text), written as rows of _TABLE, and the number of parts.

    A row is either a block of sets of one part, or another place (sort_id, tie, line) of the set s1. A task sends one place
    of a set for HELD_CHARS of text at most, so a line that most documents hold doesn't pile up.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(rarity)
    width = shuffle_width(docs.sparkSession)
    n_parts = 4 * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            ids, ties = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j in _chunks(texts):
                sets = LineSets(texts[i:j], shipped.value, parts)
                if not len(sets.lines):
                    continue
                at = sets.text_of[sets.lines] + i
                size = np.where(sets.sizes >= threshold * (sets.sizes + 1) - 1e-9, _prefix(sets.sizes, threshold), 0)
                words = (sets.h[_ragged(sets.starts, size)] >> np.uint64(32)).astype(np.uint32)
                columns = [sets.s1, sets.s2, ids[at], ties[at], sets.number[sets.lines], sets.sizes, *sets.bitmaps, size]
                held.append(Sets([x.astype(k, copy=False) for x, k in zip(columns, _SET_KINDS)], words))
                chars += sum(map(len, texts[i:j]))
                if chars >= HELD_CHARS:
                    yield from _emit(Sets.concat(held), n_parts)
                    held, chars = [], 0
        if held:
            yield from _emit(Sets.concat(held), n_parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            blobs = b.column(2)
            known = blobs.is_valid().to_numpy(zero_copy_only=False)
            held += [Sets.unpack(blobs[i].as_buffer()) for i in np.flatnonzero(known).tolist()]
            if not known.all():
                yield b.filter(pa.array(~known))
        if held:
            yield from _emit(Sets.concat(held), n_parts)

    found = docs.select("sort_id", "tie", "text").mapInArrow(run, _TABLE)
    # places that are settled go anywhere; blocks go by part
    dealt = found.repartition(width, F.coalesce("part", F.pmod(F.xxhash64("sort_id", "line"), F.lit(n_parts)).cast("int")))
    return materialize(dealt.mapInArrow(merge, _TABLE), "sets"), n_parts


def blocks_of(sets: DataFrame) -> DataFrame:
    return sets.filter(F.col("blob").isNotNull()).select("part", "postings", "blob")


def by_part(keys: DataFrame, n_parts: int, *values: str) -> DataFrame:
    """part and arrays of s1 and of the values, to be joined to the blocks that hold these sets."""
    part = F.pmod(F.shiftrightunsigned("s1", 32), F.lit(n_parts)).cast("int").alias("part")
    return keys.groupBy(part).agg(F.collect_list(F.struct("s1", *values)).alias("k")).select("part", *[F.col(f"k.{x}").alias(x) for x in ("s1", *values)])


def looked_up(of: np.ndarray, keys, values=None) -> np.ndarray:
    """For each element of `of` the value of its key (without values: 1), 0 where there is none; keys are an Arrow list of longs."""
    out = np.zeros(len(of), np.int64)
    if keys is None or not keys.is_valid or not len(keys):
        return out
    k = keys.values.to_numpy(zero_copy_only=False)
    order = np.argsort(k)
    at = np.searchsorted(k[order], of)
    at[at == len(k)] = 0
    hit = k[order][at] == of
    out[hit] = 1 if values is None else values.values.to_numpy(zero_copy_only=False)[order][at[hit]]
    return out


def hot_words(blocks: DataFrame, rarity: np.ndarray) -> np.ndarray:
    """Chunks of each place of the table that counts postings: 1, or more where it has more than CHUNK of them.

    Only places with so many occurrences of words are counted; at most 2 ** POSTING_BITS rows reach the driver.
    """
    maybe = rarity >= math.floor(8 * math.log2(CHUNK))
    chunks = np.ones(2**POSTING_BITS, np.uint32)
    if not maybe.any():
        return chunks
    shipped = blocks.sparkSession.sparkContext.broadcast(np.packbits(maybe))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(shipped.value).astype(bool)
        total = np.zeros(2**POSTING_BITS, np.int64)
        for b in batches:
            for blob in b.column(0):
                at = Sets.unpack(blob.as_buffer()).prefix >> np.uint32(32 - POSTING_BITS)
                at = at[may[at]]
                total += np.bincount(at, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    counted = blocks.select("blob").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).filter(F.col("n") > CHUNK).toArrow()
    chunks[counted.column("at").to_numpy()] = np.ceil(counted.column("n").to_numpy() / (CHUNK // 2))
    return chunks


#: Columns of a posting; words are 32 bits of a hash, which at worst brings candidates that fail.
_POSTING = {"word": "u4", "block": "u4", "s1": "u8", "n": "i4", "place": "i4", "sort_id": "i8", "line": "i4", "bits0": "u8", "bits1": "u8", "open": "u1", "label": "i8"}


def postings_by_word(blocks: DataFrame, names: list[str], chunks: np.ndarray, every: bool, words: np.ndarray | None = None) -> DataFrame:
    """Postings (the named columns) dealt by word and block as packed arrays: part, blob.

    blocks has blob, and for every (the second round) open (keys) and label_keys, label_values, arrays or null; words is a
    filter of the words that take part. A word of several chunks is dealt in blocks. In the first round each chunk meets
    chunk 0; for every, all chunks meet one another, and the postings are repeated as often.
    """
    spark = blocks.sparkSession
    shipped, allowed = spark.sparkContext.broadcast(chunks), None if words is None else spark.sparkContext.broadcast(words)
    total = blocks.agg(F.sum("postings")).first()[0] or 0
    width = max(shuffle_width(spark), math.ceil(total / TASK_POSTINGS))
    n_parts = 4 * width

    def flush(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        cols = {k: np.concatenate([x[k] for x in held]) for k in names}
        part = (_mix(cols["word"].astype(np.uint64) | (cols["block"].astype(np.uint64) << np.uint64(32)), 6) >> np.uint64(16)) % np.uint64(n_parts)
        order = np.argsort(part.astype(np.uint32), kind="stable")
        part = part[order]
        cols = [x[order] for x in cols.values()]
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]).tolist()
        for i in range(0, len(edges) - 1, 256):
            bounds = list(zip(edges[i : i + 257], edges[i + 1 : i + 257]))
            blobs = [_pack([x[a:b] for x in cols]) for a, b in bounds]
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in bounds], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            row = dict(zip(b.schema.names, b.columns))
            for i in range(b.num_rows):
                sets = Sets.unpack(row["blob"][i].as_buffer())
                size = sets["size"]
                of = np.repeat(np.arange(len(sets)), size)
                place = np.arange(len(of)) - np.repeat(sets.starts, size) + 1
                word, at = sets.prefix, np.arange(len(of))
                if allowed is not None:
                    at = np.flatnonzero(_hits(allowed.value, _mix(word.astype(np.uint64), 7).view(np.int64)))
                block = np.zeros(len(at), np.uint32)
                g = shipped.value[word[at] >> np.uint32(32 - POSTING_BITS)]
                if (g > 1).any():
                    own = (_mix(sets["s1"][of[at]], 8) % g.astype(np.uint64)).astype(np.int64)
                    # in the first round chunk 0 goes to all other chunks' blocks; for every, each chunk goes to g blocks
                    times = np.where(g == 1, 1, g if every else np.where(own == 0, g - 1, 1)).astype(np.int64)
                    other = _ragged(np.zeros(len(at), np.int64), times)
                    g, own, at = (np.repeat(x, times) for x in (g.astype(np.int64), own, at))
                    if every:
                        block = np.minimum(own, other) * g + np.maximum(own, other)
                    else:
                        block = np.where(own == 0, other + 1, own)
                    block = np.where(g == 1, 0, block).astype(np.uint32)
                cols = {"word": word[at], "block": block, "place": place[at].astype(np.int32)}
                of = of[at]
                if every:
                    keys = sets["s1"].view(np.int64)
                    cols["open"] = looked_up(keys, row["open"][i])[of].astype(np.uint8)
                    if "label" in names:
                        label = looked_up(keys, row["label_keys"][i], row["label_values"][i])
                        cols["label"] = np.where(label == 0, keys, label)[of]
                held.append({k: cols[k] if k in cols else sets[k][of] for k in names})
                n += len(at)
                if n >= 2_000_000:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return blocks.drop("part", "postings").mapInArrow(run, "part int, blob binary").repartition(width, "part")


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> dict[str, np.ndarray] | None:
    """Of a task's postings those whose word has others (open ones, if that is told): columns sorted by run (word and block), size and s1."""
    kinds = [np.dtype(_POSTING[k]) for k in names]
    found = [_unpack(x.as_buffer(), kinds) for b in batches for x in b.column(1)]
    if not found:
        return None
    cols = dict(zip(names, map(np.concatenate, zip(*found))))
    del found
    key = cols["word"].astype(np.uint64) | (cols["block"].astype(np.uint64) << np.uint64(32))
    by = np.argsort(key)
    same = key[by[1:]] == key[by[:-1]]
    by = by[np.r_[same, False] | np.r_[False, same]]
    by = by[np.lexsort((cols["s1"][by], cols["n"][by], key[by]))]
    cols = {k: x[by] for k, x in cols.items()}
    key = key[by]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    cols["run"] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))
    use = np.ones(len(starts), bool)
    if "open" in cols and len(starts):
        use &= np.maximum.reduceat(cols["open"], starts) > 0
    if "label" in cols and len(starts):
        use &= np.minimum.reduceat(cols["label"], starts) != np.maximum.reduceat(cols["label"], starts)
    return cols if use.all() else {k: x[use[cols["run"]]] for k, x in cols.items()}


def neighbours(cols: dict[str, np.ndarray], threshold: float, full: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i, j of all pairs of one run whose sizes may match, n[j] <= n[i]; the i marked as full come no more."""
    run, n, s1 = cols["run"], cols["n"], cols["s1"]
    least = np.ceil(threshold * n - 1e-9).astype(n.dtype)
    live = np.arange(1, len(run))
    lag = 0
    while len(live):
        lag += 1
        live = live[np.searchsorted(live, lag) :]
        other = live - lag
        near = (run[live] == run[other]) & (n[other] >= least[live])
        live, other = live[near], other[near]
        differ = s1[live] != s1[other]
        yield (live, other) if differ.all() else (live[differ], other[differ])
        if full is not None:
            live = live[~full[live]]


_PAIRS = "a long, b long, ia long, ib long"


def pairs_batch(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, more: np.ndarray, imore: np.ndarray) -> pa.RecordBatch:
    """Pairs a, b with the sort_ids of their first places, and "b may have more" as a null a; each once."""
    rows = np.unique(np.stack([np.r_[a, more], np.r_[b, more], np.r_[ia, imore], np.r_[ib, imore], np.r_[np.zeros(len(a), np.int64), np.ones(len(more), np.int64)]]), axis=1) if len(a) or len(more) else np.zeros((5, 0), np.int64)
    hole = rows[4] == 1
    return pa.RecordBatch.from_arrays([pa.array(rows[0], mask=hole), pa.array(rows[1]), pa.array(rows[2], mask=hole), pa.array(rows[3])], names=["a", "b", "ia", "ib"])


_LINE_POSTING = ["word", "block", "s1", "n", "place", "sort_id", "line", "bits0", "bits1"]


def _candidates(threshold: float, every: bool):
    """Over a task's postings: pairs a (earlier), b (later), and "b may have more" as a null a.

    With every, all pairs in which the later set is open are named and nothing else.
    """
    names = [*_LINE_POSTING, *(["open"] if every else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = runs(batches, names)
        if cols is None:
            return
        n, place, bits0, bits1, s1, ids = (cols[k] for k in ("n", "place", "bits0", "bits1", "s1", "sort_id"))
        first = cols["line"].astype(np.int64)
        if len(n) and ids.min() >= 0 and ids.max() < 2**39 and first.max() < 2**24:
            first |= ids << 24
        else:
            order = np.lexsort((first, ids))
            step = (first[order[1:]] != first[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])
            first[order] = np.cumsum(np.r_[0, step])[: len(n)]
        named = np.zeros(len(n), np.int16)
        more = (cols["block"] > 0) & (not every)  # chunks met one other chunk only
        out = []
        for i, j in neighbours(cols, threshold):
            least = np.ceil(threshold / (1 + threshold) * (n[i] + n[j]) - 1e-9)
            fits = 1 + np.minimum(n[i] - place[i], n[j] - place[j]) >= least
            i, j, apart = i[fits], j[fits], (n[i] + n[j] - 2 * least)[fits]
            fits = np.bitwise_count(bits0[i] ^ bits0[j]) + np.bitwise_count(bits1[i] ^ bits1[j]) <= apart
            i, j = i[fits], j[fits]
            late = (first[i] > first[j]) | ((first[i] == first[j]) & (s1[i] > s1[j]))
            later, earlier = np.where(late, i, j), np.where(late, j, i)
            if every:
                wanted = cols["open"][later] > 0
            else:
                wanted = named[later] < NAMED
                more[later[~wanted]] = True
                np.add.at(named, later[wanted], 1)
            out.append((earlier[wanted], later[wanted]))
        a = np.concatenate([x for x, _ in out] or [np.zeros(0, np.int64)])
        b = np.concatenate([x for _, x in out] or [np.zeros(0, np.int64)])
        m = np.flatnonzero(more)
        yield pairs_batch(s1[a].view(np.int64), s1[b].view(np.int64), ids[a], ids[b], s1[m].view(np.int64), ids[m])

    return run


def _bits(df: DataFrame, value: str, bits: int) -> np.ndarray:
    """A filter of 2 ** bits bits (64 MB at most) of a column of uniform longs."""
    at = F.expr(f"cast(shiftrightunsigned({value}, {64 - bits + 6}) AS int)")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({value}, {64 - bits}) & 63 AS int))")
    rows = df.select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(2 ** (bits - 6), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _hits(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be in the filter; those that were put in all are."""
    place = values.view(np.uint64) >> np.uint64(64 - 6 - int(len(bits)).bit_length() + 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _filter_bits(n: int) -> int:
    """Sixteen bits an element, within bounds."""
    return min(max(math.ceil(math.log2(16 * n + 1)), FILTER_BITS[0]), FILTER_BITS[1])


def words_of_sets(blocks: DataFrame) -> np.ndarray:
    """A filter of the prefix words of the sets that `open` of their blocks names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = dict(zip(b.schema.names, b.columns))
            for i in range(b.num_rows):
                sets = Sets.unpack(row["blob"][i].as_buffer())
                at = np.flatnonzero(looked_up(sets["s1"].view(np.int64), row["open"][i]))
                word = np.unique(sets.prefix[_ragged(sets.starts[at], sets["size"][at])])
                yield pa.RecordBatch.from_arrays([pa.array(_mix(word.astype(np.uint64), 7).view(np.int64))], names=["word"])

    words = materialize(blocks.filter(F.col("open").isNotNull()).select("blob", "open").mapInArrow(run, "word long").distinct(), "words")
    out = _bits(words, "word", _filter_bits(words.count()))
    discard(words)
    return out


def _sets(docs: DataFrame, needed: DataFrame, parts=words_of) -> DataFrame:
    """s1, words (array<long>) of the sets needed (s1, id: the sort_id of the first place).

    Filters skip most documents before they are hashed, and most sets of the others.
    """
    hashed = needed.select("s1", F.xxhash64("id").alias("spot"))
    bits = _filter_bits(needed.count())
    of_docs, of_sets = (docs.sparkSession.sparkContext.broadcast(_bits(hashed, x, bits)) for x in ("spot", "s1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for b in batches:
            texts = [b.column(1)[i].as_py() or "" for i in np.flatnonzero(_hits(of_docs.value, b.column(0).to_numpy())).tolist()]
            for i, j in _chunks(texts):
                sets = LineSets(texts[i:j], None, parts)
                s1, words = [], []
                for k in np.flatnonzero(_hits(of_sets.value, sets.s1)).tolist():
                    s = int(sets.s1[k].view(np.int64))
                    if s not in given:
                        given.add(s)
                        s1.append(s)
                        words.append(sets.h[sets.starts[k] : sets.starts[k] + sets.sizes[k]].view(np.int64))
                if s1:
                    yield pa.RecordBatch.from_arrays([pa.array(s1, pa.int64()), pa.array(words, pa.list_(pa.int64()))], names=["s1", "words"])

    found = docs.select(F.xxhash64("sort_id").alias("spot"), "text").mapInArrow(run, "s1 long, words array<long>")
    return found.join(needed.select("s1"), "s1", "left_semi").groupBy("s1").agg(F.first("words").alias("words"))


def needed_sets(docs: DataFrame, pairs: DataFrame, parts=words_of) -> DataFrame:
    """The whole sets of all pairs a, b (ia, ib), written once."""
    ids = materialize(pairs.select(F.col("a").alias("s1"), F.col("ia").alias("id")).union(pairs.select("b", "ib")).distinct(), "needed")
    sets = materialize(_sets(docs, ids, parts), "whole")
    discard(ids)
    return sets


def verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b whose whole sets match."""
    left = sets.select(F.col("s1").alias("a"), F.col("words").alias("wa"))
    right = sets.select(F.col("s1").alias("b"), F.col("words").alias("wb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return joined.filter(common >= threshold * (F.size("wa") + F.size("wb") - common) - 1e-9).select("a", "b")


def _matched(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """s1 of the later sets of the pairs that match: the first candidate of each decides most, the others the rest."""
    sets = needed_sets(docs, pairs)
    # any of its candidates, so that no set stands first in all pairs of a group
    one = materialize(pairs.groupBy("b").agg(F.min_by("a", F.xxhash64("a", "b")).alias("a")).select("a", "b"), "one")
    # written as joined: where a set has many candidates, the join may then be split
    found = materialize(verified(sets, one, threshold).select(F.col("b").alias("s1")), "matched")
    rest = pairs.select("a", "b").join(found.withColumnRenamed("s1", "b"), "b", "left_anti").join(one, ["a", "b"], "left_anti")
    late = materialize(verified(sets, rest, threshold).select(F.col("b").alias("s1")), "matched")
    discard(sets, one)
    return found.union(late).distinct()


def _first_places(blocks: DataFrame, removed: DataFrame, n_parts: int) -> DataFrame:
    """sort_id, tie, line of the first places of the sets removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sets = Sets.unpack(b.column(0)[i].as_buffer())
                at = np.flatnonzero(looked_up(sets["s1"].view(np.int64), b.column(1)[i]))
                yield pa.RecordBatch.from_arrays([pa.array(sets[x][at]) for x in ("sort_id", "tie", "line")], names=["sort_id", "tie", "line"])

    keyed = blocks.join(by_part(removed, n_parts), "part").select("blob", "s1")
    return keyed.mapInArrow(run, "sort_id long, tie long, line int")


def later_matches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """sort_id, tie, gone (array of line numbers from 0) of the documents that lose lines.

    docs has sort_id (long), tie (long) and text.
    """
    rarity = count_words(docs)
    table_, n_parts = set_table(docs, rarity, threshold)
    blocks = blocks_of(table_)
    chunks = hot_words(blocks, rarity)
    dealt = postings_by_word(blocks, _LINE_POSTING, chunks, every=False)
    named = materialize(dealt.mapInArrow(_candidates(threshold, every=False), _PAIRS).distinct(), "named")
    pairs = named.filter(F.col("a").isNotNull())
    removed = _matched(docs, pairs, threshold)
    open_ = materialize(named.filter(F.col("a").isNull()).select(F.col("b").alias("s1")).distinct().join(removed, "s1", "left_anti"), "open")
    if not open_.isEmpty():
        keyed = blocks.join(by_part(open_, n_parts).withColumnRenamed("s1", "open"), "part", "left")
        dealt = postings_by_word(keyed, [*_LINE_POSTING, "open"], chunks, every=True, words=words_of_sets(keyed))
        more = dealt.mapInArrow(_candidates(threshold, every=True), _PAIRS).distinct()
        more = materialize(more.join(pairs.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "ia", "ib"), "named")
        removed = removed.union(_matched(docs, more, threshold)).distinct()
    others = table_.filter(F.col("blob").isNull()).select("sort_id", "tie", "line")
    places = others.union(_first_places(blocks, removed, n_parts))
    gone = materialize(places.groupBy("sort_id", "tie").agg(F.array_sort(F.collect_set("line")).alias("gone")), "gone")
    discard(table_, named, open_)
    return gone


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with the text without its later matches, and lines_gone (their number); one shuffle of texts."""
    text = F.col("text").cast("string")
    keyed = docs.withColumn("_line_sort_id", key_or_min("doc_id")).withColumn("_line_tie", F.xxhash64(text))
    gone = later_matches(keyed.select(F.col("_line_sort_id").alias("sort_id"), F.col("_line_tie").alias("tie"), text.alias("text")), threshold)
    gone = gone.select(F.col("sort_id").alias("_line_sort_id"), F.col("tie").alias("_line_tie"), F.col("gone").alias("_line_gone"))
    joined = keyed.join(gone.hint("shuffle_hash"), ["_line_sort_id", "_line_tie"], "left")  # texts needn't be sorted
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_line_gone", i)), "\n")
    changed = joined.withColumn("text", F.when(F.col("_line_gone").isNull(), F.col("text")).otherwise(kept))
    lost = F.when(F.col("_line_gone").isNull(), 0).otherwise(F.size("_line_gone")).cast("long").alias("lines_gone")
    return changed.select(*docs.columns, lost)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines that match an earlier one: counts of lines and the digest of what stays."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    before = docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long"))
    done = dedup_lines(before)
    return done.select("doc_id", "n_lines", F.col("lines_gone").alias("n_gone"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
