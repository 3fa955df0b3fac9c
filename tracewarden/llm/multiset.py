"""Homomorphic multiset fingerprints of documents, in DataFrame functions alone.

A document is the multiset of its paragraphs (its non-empty lines). Each paragraph is hashed to a wide vector by way of its
SHA-256 digest (so no two paragraphs can be built that agree in all hashes), and the
fingerprint is the sum of these vectors modulo powers of two: it doesn't depend on the order of paragraphs, and a
paragraph is inserted or deleted by adding or subtracting its vector. The vector has

* the number 1, so that the sum counts paragraphs,
* eight 32-bit words, summed modulo 2^32, for equality,
* 120 single bits, summed modulo 2^14 in lanes of packed longs. With +1 and -1 for a bit the lanes are projections of
  the multiset onto random signs; the mean square of a difference estimates the size of the symmetric difference of
  two documents, and so their likeness.

Defined results: null and empty texts have the fingerprint of the empty multiset; equal texts have equal fingerprints;
rows are ordered by doc_id (null first), ties by text, and the last is followed by the first; a lone row follows itself;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewarden.llm.common import key_or_min, shuffle_width, table

WORD = 2**32 - 1
#: Lanes lie 15 bits apart and hold 14; the bit between takes the carry and is cleared after each sum.
BITS = sum(1 << s for s in (0, 15, 30, 45))
LANES = BITS * (2**14 - 1)
GUARD = BITS << 14
#: Functions of the digest; the salt comes first, else all would be functions of one 64-bit hash.
_HASHES = [f"xxhash64({k}, d)" for k in range(6)]
_WORDS = [f"shiftrightunsigned(v.h{k // 2}, {32 * (k % 2)}) & {WORD}L" for k in range(8)]
_SIGNS = [f"shiftrightunsigned(v.h{4 + k // 15}, {k % 15}) & {BITS}L" for k in range(30)]
WIDTH = 1 + len(_WORDS) + len(_SIGNS)


def vector(text: str) -> Column:
    """array<bigint> of WIDTH sums for the paragraphs of a string column or expression."""
    zero = "named_struct(" + ", ".join(f"'c{k}', 0L" for k in range(WIDTH)) + ")"
    parts = ["a.c0 + 1L"] + [f"(a.c{k + 1} + ({w})) & {WORD}L" for k, w in enumerate(_WORDS)] + [f"(a.c{k + 9} + ({s})) & {LANES}L" for k, s in enumerate(_SIGNS)]
    step = "named_struct(" + ", ".join(f"'c{k}', {e}" for k, e in enumerate(parts)) + ")"
    digests = f"transform(filter(split({text}, '\\n', -1), p -> p <> ''), p -> sha2(p, 256))"
    hashed = f"transform({digests}, d -> named_struct({', '.join(f'{chr(39)}h{k}{chr(39)}, {h}' for k, h in enumerate(_HASHES))}))"
    done = "array(" + ", ".join(f"a.c{k}" for k in range(WIDTH)) + ")"
    return F.expr(f"aggregate({hashed}, {zero}, (a, v) -> {step}, a -> {done})")


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the union of two multisets, from their vectors."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, k: _modulo(x["a"] + x["b"], k))


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of a multiset without another that it holds."""

    def less(x: Column, k: Column) -> Column:
        apart = F.when(k == 0, x["a"] - x["b"]).when(k < 9, x["a"] + F.lit(WORD + 1) - x["b"]).otherwise(x["a"].bitwiseOR(F.lit(GUARD)) - x["b"])
        return _modulo(apart, k)

    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), less)


def _modulo(total: Column, k: Column) -> Column:
    return F.when(k == 0, total).when(k < 9, total.bitwiseAND(F.lit(WORD))).otherwise(total.bitwiseAND(F.lit(LANES)))


def as_text(vec: str) -> Column:
    """The fingerprint as one string of hex digits."""
    return F.expr(f"lower(array_join(transform({vec}, (x, k) -> lpad(hex(x), CASE WHEN k < 9 THEN 8 ELSE 15 END, '0')), ''))")


def likeness(a: str, b: str) -> Column:
    """0 to 1 from two vectors: one less the estimated share of paragraphs that only one document has."""
    lanes = " + ".join(f"power(2 * (((pmod(shiftright(z.x, {s}) - shiftright(z.y, {s}), 16384) + 8192) & 16383) - 8192) - ({a}[0] - {b}[0]), 2)" for s in (0, 15, 30, 45))
    low = f"zip_with(slice({a}, 10, 30), slice({b}, 10, 30), (x, y) -> named_struct('x', x, 'y', y))"
    apart = f"aggregate({low}, 0D, (t, z) -> t + {lanes}) / 120D"
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D ELSE greatest(0D, 1D - ({apart}) / ({a}[0] + {b}[0])) END")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, vector of every whole text. Map-only."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("vector", vector("text"))
    return d.select("doc_id", as_text("vector").alias("fingerprint"), "vector")


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, next_text: the text of the next row in the order (doc_id, text); the last is followed by the first.

    Rows are dealt to ranges of doc_id by quantiles of all ids. The first rows of each range are also sent to the range
    before, so that texts are shuffled once and no task sees more than a range.
    """
    d = docs.select(key_or_min("doc_id").alias("sort_id"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = d.agg(F.percentile_approx("sort_id", [k / buckets for k in range(1, buckets)] or [0.5], 10_000)).first()[0] if buckets > 1 else None
    if not cuts:
        cuts = []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= F.col("sort_id"))) if cuts else F.lit(0)
    starts = sorted((r[0], r[1]) for r in d.select(bucket.alias("b"), "sort_id").groupBy("b").agg(F.min("sort_id")).collect())
    before = {first: starts[k - 1][0] for k, (_, first) in enumerate(starts)}  # k = 0 goes round to the last
    own = F.struct(bucket.cast("int").alias("b"), F.lit(0).alias("halo"))
    to = F.array(own)
    if before:
        pairs = [x for first, b in before.items() for x in (F.lit(first).cast("long"), F.lit(b))]
        target = F.create_map(*pairs)[F.col("sort_id")]
        to = F.when(target.isNull(), to).otherwise(F.array(own, F.struct(target.cast("int").alias("b"), F.lit(1).alias("halo"))))
    dealt = d.select("sort_id", "doc_id", "text", F.explode(to).alias("to")).select("sort_id", "doc_id", "text", "to.b", "to.halo")
    order = Window.partitionBy("b").orderBy("halo", "sort_id", "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).filter("halo = 0").drop("b", "halo", "sort_id")


def edited(text: str = "text", following: str = "next_text") -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the next text."""
    half = f"cast(floor(length({text}) / 2) AS int)"
    return F.expr(f"concat(substring({text}, 1, length({text}) - {half}), substring({following}, 1, {half}))")


def op4_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and their likeness to the edited and to the next text."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    d = with_next(docs, 4 * shuffle_width(spark))
    d = d.withColumn("edited", edited()).withColumn("v", vector("text")).withColumn("e", vector("edited")).withColumn("w", vector("next_text"))
    return d.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text("v").alias("fingerprint"),
        as_text("e").alias("edited_fingerprint"), likeness("v", "e").alias("near_edited"), likeness("v", "w").alias("near_next"),
    )
