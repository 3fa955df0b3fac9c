"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by concatenation of vocabulary strings.

Defined results: a null text counts as the empty text and has no ids; special tokens found in a text become their
ids, as the public library does by default; repeated rows give repeated rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where this is found, the white space before a word doesn't split off at each blank.
_ODD_SPACE = re.compile(r"\s (?:\s|\Z)")
_CONTROL = re.compile("[\x1c-\x1f]")
#: Entries of each of the two generations of a worker's cache: a full one becomes the old one, from which what is asked for
#: again is taken over. It bounds memory (about 200 bytes an entry) and never changes a result.
CACHE_ENTRIES = 500_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class BytePairEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.byte_id = [vocab[alphabet[b]] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.merge: list[tuple[int, int, int]] = []
        for r, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            pair = vocab[left], vocab[right]
            self.rank.setdefault(pair, r)
            self.merge.append((*pair, vocab[left + right]))
        to_byte = {c: b for b, c in alphabet.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k: v.to_bytes(4, "little") for k, v in special.items()}
        self.strings: list[bytes] = [b""] * (1 + max(*vocab.values(), *special.values()))
        for token, i in (vocab | special).items():
            self.strings[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pretoken = regex.compile(PRETOKEN).findall
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def merge_word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token: the queue holds (rank, position); an entry whose two symbols are gone is stale."""
        ids = [self.byte_id[b] for b in raw]
        n = len(ids)
        if n == 1:
            return ids
        after, before, rank, merge = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank.get, self.merge
        bits = n.bit_length()
        low = (1 << bits) - 1
        queue = [r << bits | i for i, r in enumerate(map(rank, zip(ids, ids[1:]))) if r is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & low
            left, right, new = merge[entry >> bits]
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (r := rank((new, ids[j]))) is not None:
                    heappush(queue, r << bits | i)
            if (p := before[i]) >= 0 and (r := rank((ids[p], new))) is not None:
                heappush(queue, r << bits | p)
        return [x for x in ids if x >= 0]

    def _piece(self, chunk: str) -> bytes:
        """Packed ids of a run of text that holds no special token."""
        found = self.words.get(chunk)
        if found is None:
            found = self.old_words.get(chunk)
            if found is None:
                parts = self.pretoken(chunk)
                found = array("I", self.merge_word(chunk.encode())).tobytes() if len(parts) == 1 else b"".join(map(self._piece, parts))
            if len(chunk) <= 64:
                if len(self.words) >= CACHE_ENTRIES:
                    self.words, self.old_words = {}, self.words
                self.words[chunk] = found
        return found

    def _plain(self, text: str) -> bytes:
        if _ODD_SPACE.search(text) or _CONTROL.search(text):
            return b"".join([self._piece(p) for p in self.pretoken(text)])
        first, *rest = text.split(" ")
        rest = [" " + x for x in rest]
        out = list(map(self.words.get, rest))
        if None in out:
            out = [self._piece(c) if x is None else x for c, x in zip(rest, out)]
        return (self._piece(first) if first else b"") + b"".join(out)

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.split_special is None or not self.split_special.search(text):
            return self._plain(text)
        return b"".join([self.special.get(x) or self._plain(x) for x in self.split_special.split(text) if x])

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("I").tolist()

    def decode(self, ids: list[int]) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    """One encoder a Python worker and vocabulary."""
    return BytePairEncoder(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (array<int>) of every whole text, batch by batch; map-only, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key, text from ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            texts = [bpe.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"{key} long, text string")


def round_trip_digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, without keeping ids of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        sha = hashlib.sha256
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                packed = bpe.encode_packed(t.as_py() or "")
                counts.append(len(packed) // 4)
                ids_sha.append(sha(packed).hexdigest())
                text_sha.append(sha(bpe.decode(memoryview(packed).cast("I").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(key, text).mapInArrow(run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents through the public 50k byte-level vocabulary and back."""
    import public_tokenizers

    from tracewarden.llm.common import table

    return round_trip_digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
