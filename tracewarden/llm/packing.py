"""Packing of tokenized documents into sequences of bounded length by a swap-based local search.

Documents are tokenized word by word with a cache, cut into pieces only where longer than a sequence, and dealt to
groups of bounded size. Each group starts from a best-fit placement; the search then moves a document, or exchanges one
for one, two for one or one for two, from the emptiest bin into underfull ones whenever that increases the sum of
squared fills, until that bin is empty or nothing improves. What lies in poorly filled bins of all groups is packed
once more together.

Defined results: a null text counts as the empty text and yields one piece with the end token alone; repeated rows and
rows without an id are packed like any other; an empty table packs into nothing.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.bpe import byte_alphabet
from tracewarden.llm.common import materialize, table
from tracewarden.llm.linejoin import _chunks, equal_words, word_spans

CAPACITY = 4096
#: Pieces a group holds at about: one task packs a group, so this bounds its memory and time.
GROUP_PIECES = 20_000
#: Bins filled less than this are packed again with those of other groups.
REPACK_BELOW = 0.98
#: Text whose words are encoded together.
RUN_BYTES = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids of whole texts, put together from the ids of their words (runs of anything but ASCII white space).

    The vocabulary's pre-tokenizer drops white space and never looks across it, so a text's ids are those of its words.
    The words of a run of texts are found, hashed and made unique in arrays; the unique ones are cut into pre-tokens and
    merged by rank in one call of a library of byte merges. There a private character marks the end of a pre-token, and
    merges of a byte with that mark come first, which gives the vocabulary's symbols for word ends. Words with rarer
    letters or special tokens go through the public tokenizer itself.
    """

    MARK = "\ue000"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix, mark = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"], self.MARK.encode()
        to_byte = {c: b for b, c in byte_alphabet().items()}

        def raw(token: str) -> bytes:
            whole = token.endswith(suffix) and token != suffix
            return bytes(to_byte[c] for c in (token[: -len(suffix)] if whole else token)) + (mark if whole else b"")

        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        ids = [vocab[byte_alphabet()[b]] for b in range(256)]
        for n in range(1, len(mark) + 1):
            for b in range(256):
                ranks[bytes([b]) + mark[:n]] = len(ids)
                ids.append(vocab[byte_alphabet()[b] + suffix])
        self.separator = ranks[b"\n" + mark]
        for m in spec["model"]["merges"]:
            left, right = m if isinstance(m, list) else m.split(" ")
            ranks[raw(left + right)] = len(ids)
            ids.append(vocab[left + right])
        self.id_of = np.array(ids, np.uint32)
        self.merge = tiktoken.Encoding("words", pat_str=f"[^{self.MARK}]+{self.MARK}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + r"|\n").findall

    def encode_whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of each word's. Letters below U+0240, no special token."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        parts = self.pieces((b"\n".join(words) + b"\n").decode().lower())
        ranks = np.array(self.merge(self.MARK.join(parts) + self.MARK), np.int64)
        ends = np.flatnonzero(ranks == self.separator)
        sizes = np.diff(np.r_[-1, ends]) - 1
        return self.id_of[np.delete(ranks, ends)], sizes

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        raw = [t.encode() for t in texts]
        buffer, starts, ends, h = word_spans(raw)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        apart = np.flatnonzero(~equal_words(buffer, starts, ends, first[which]))  # of words with equal hashes: stand for themselves
        which[apart] = len(first) + np.arange(len(apart))
        first = np.r_[first, apart]
        joined = buffer.tobytes()
        rare = np.r_[0, np.cumsum(buffer > 0xC8)]
        rare[1:-1] += np.cumsum((buffer[:-1] == ord("<")) & (buffer[1:] == ord("|")))
        a, b = starts[first], ends[first]
        odd = rare[b] > rare[a]
        words = [joined[i:j] for i, j in zip(a[~odd].tolist(), b[~odd].tolist())]
        flat, n = self.encode_plain(words)
        others = [self.encode_whole(joined[i:j].decode()) for i, j in zip(a[odd].tolist(), b[odd].tolist())]
        sizes = np.zeros(len(first), np.int64)
        sizes[~odd], sizes[odd] = n, [len(x) for x in others]
        offsets = np.zeros(len(first), np.int64)
        offsets[~odd] = np.cumsum(n) - n
        offsets[odd] = len(flat) + np.cumsum(sizes[odd]) - sizes[odd]
        flat = np.concatenate([flat, *others])
        n = sizes[which]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        ids = flat[np.repeat(offsets[which] - (end - n), n) + np.arange(total)]
        edges = np.cumsum([len(r) + 1 for r in raw])  # where each text ends in the buffer
        cuts = np.r_[0, end][np.searchsorted(starts, edges)]
        return np.split(ids, cuts[:-1])


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Map-only."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            rows: list[tuple] = []
            keys, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i, j in _chunks(texts, RUN_BYTES):
                for key, ids in zip(keys[i:j], tok.encode_many(texts[i:j])):
                    packed = ids.tobytes() + end
                    for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                        part = packed[at : at + 4 * capacity]
                        rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item indices; items in falling length, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        room -= need
        by_room[room].append(b)
        rooms |= 1 << room
    return bins


class LocalSearch:
    """Empties bins by exchanges that raise the sum of squared fills; that sum is a bounded integer, so it ends."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.size = lengths.astype(np.int64)
        self.capacity = capacity
        self.of = np.empty(len(lengths), np.int64)
        self.items = [set(b) for b in bins]
        for k, b in enumerate(bins):
            self.of[b] = k
        self.fill = np.array([int(self.size[b].sum()) for b in bins], np.int64)

    def _put(self, item: int, to: int) -> None:
        was = self.of[item]
        self.items[was].discard(item)
        self.items[to].add(item)
        self.fill[was] -= self.size[item]
        self.fill[to] += self.size[item]
        self.of[item] = to

    def _gain(self, donor: int, delta: np.ndarray, fill: np.ndarray) -> np.ndarray:
        """Change of the squared fills if delta moves from donor into bins so filled; -1 where it may not."""
        allowed = (delta > 0) & (delta <= self.capacity - fill)
        return np.where(allowed, (fill + delta) ** 2 - fill**2 + (self.fill[donor] - delta) ** 2 - self.fill[donor] ** 2, -1)

    def improve(self, donor: int) -> bool:
        """The best single step out of the donor, if one raises the objective."""
        own = sorted(self.items[donor], key=lambda i: -self.size[i])
        room = self.capacity - self.fill
        room[donor] = 0
        live = (self.fill > 0) & (room > 0)
        if not live.any():
            return False
        targets = np.flatnonzero(live)
        for i in own:  # move
            gain = self._gain(donor, np.full(len(targets), self.size[i]), self.fill[targets])
            if gain.max() > 0:
                self._put(i, int(targets[gain.argmax()]))
                return True
        others = np.flatnonzero(live[self.of])
        if not len(others):
            return False
        size, fill = self.size[others], self.fill[self.of[others]]
        best, step = 0, None
        for i in own:  # one for one
            gain = self._gain(donor, self.size[i] - size, fill)
            k = int(gain.argmax())
            if gain[k] > best:
                best, step = int(gain[k]), ((i,), (int(others[k]),))
        if step is None:
            for a, i in enumerate(own):  # two for one
                for j in own[a + 1 :]:
                    gain = self._gain(donor, self.size[i] + self.size[j] - size, fill)
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, step = int(gain[k]), ((i, j), (int(others[k]),))
        if step is None:  # one for two of the same bin
            for i in own:
                for t in targets.tolist():
                    inside = sorted(self.items[t])
                    if len(inside) < 2:
                        continue
                    z = self.size[inside]
                    p, q = np.triu_indices(len(inside), 1)
                    gain = self._gain(donor, self.size[i] - z[p] - z[q], np.full(len(p), self.fill[t]))
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, step = int(gain[k]), ((i,), (inside[p[k]], inside[q[k]]))
        if step is None:
            return False
        give, take = step
        to = int(self.of[take[0]])
        for x in take:
            self._put(x, donor)
        for x in give:
            self._put(x, to)
        return True

    def run(self) -> np.ndarray:
        """Bin of each item once no donor improves or the number of bins has reached its lower bound."""
        least = math.ceil(int(self.size.sum()) / self.capacity)
        done: set[int] = set()
        while int((self.fill > 0).sum()) > least:
            open_bins = [int(k) for k in np.argsort(self.fill, kind="stable") if 0 < self.fill[k] < self.capacity and int(k) not in done]
            if not open_bins:
                break
            donor = open_bins[0]
            while self.items[donor] and self.improve(donor):
                pass
            done.add(donor)
        return self.of


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin number of each length (1 to capacity)."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    return LocalSearch(lengths, best_fit(lengths, capacity), capacity).run()


def _pack_groups(pieces: DataFrame, level: int, capacity: int, group_pieces: int) -> DataFrame:
    """Adds sequence_id, place (the offset) and fill to pieces, group by group; rows are dealt in turn, a group a task."""
    n = pieces.count()
    groups = max(1, math.ceil(n / group_pieces))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows.column("length").to_numpy()
        bins = pack_lengths(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.r_[True, np.diff(bins[order]) != 0][: len(order)]
        base = np.repeat(ends[first] - lengths[order][first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
        offset = np.empty(len(order), np.int64)
        offset[order] = ends - lengths[order] - base
        fill = np.bincount(bins, weights=lengths)[bins].astype(np.int64) if len(bins) else bins
        sequence = bins + (TaskContext.get().partitionId() << 32) + (level << 62)
        yield from pa.table([*(rows.column(c) for c in names[:5]), pa.array(sequence), pa.array(offset), pa.array(fill)], names=names).to_batches()

    dealt = pieces.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(groups)
    return dealt.mapInArrow(run, PIECES + ", sequence_id long, offset long, fill long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces (written once) with sequence_id and offset. Groups are dealt by row, so equal ids never pile up in one."""
    pieces = materialize(pieces, "pieces")
    first = materialize(_pack_groups(pieces, 0, capacity, group_pieces), "packed")
    low = F.col("fill") < int(REPACK_BELOW * capacity)
    again = _pack_groups(first.filter(low), 1, capacity, group_pieces)
    return first.filter(~low).unionByName(again).drop("fill")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack_pieces(tokenize_pieces(docs, path, capacity, end_id), capacity)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
