"""Personal data in texts: fixed kinds by pattern, more by bootstrapped contextual extraction. DataFrame functions alone.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its test. They are the seeds of a
graph between lexical patterns (the one and the two words before an identifier-like token) and instances (the tokens).
A pattern's confidence for a kind is the smoothed mean of its instances' scores; an instance that no base span covers
scores by a noisy or over its confident patterns. After a few rounds, instances that confident patterns vouch for are
added as spans, wherever they occur. Patterns and instances of all documents take part.

Offsets are code points, end exclusive. Matches are placed by walking over the pieces between them, so a text is read a
fixed number of times; the patterns are written with possessive quantifiers and anchored at run starts, which matches
what the plain patterns match without their quadratic and recursive cases.

Defined results: a null text counts as empty and has no spans; repeated rows get equal spans; a null doc_id is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: kind: what the text must hold, its pattern, its test of a match m
PATTERNS = {
    "email": ("contains({t}, '@')", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    "ip": ("contains({t}, '.') AND rlike({t}, '[0-9]')", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", rf"rlike({{m}}, r'\A(?:{_PART}\.){{{{3}}}}{_PART}\z')"),
    "card": ("rlike({t}, '[0-9]')", r"[0-9](?:[ -]?[0-9])++", "length(translate({m}, ' -', '')) BETWEEN 14 AND 19 AND luhn_check(translate({m}, ' -', ''))"),
    "phone": ("contains({t}, '+')", r"\+[0-9][ ().0-9-]+[0-9]", "length(translate({m}, '+ ().-', '')) BETWEEN 10 AND 15"),
}
#: Identifier-like tokens: words with a digit or an at sign, and the groups of digits that follow one, a blank apart.
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [(+]?[0-9][0-9().+-]*+(?!\S))*+"
#: What a token's value begins after: signs, but for a plus and for digits in parentheses that more digits follow.
_LEAD = r"\A(?:(?!\([0-9]++\)[ 0-9-])[^\p{L}\p{N}+@])*+"
#: Matches that are walked over at once.
_STRIDE = 256
_SPAN = "array<struct<start: bigint, kind: int, end: bigint>>"
_OCCURRENCE = "array<struct<start: bigint, end: bigint, value: string, one: string, two: string>>"

#: What a token must at least look like to be added as a kind: contexts alone also stand before years and counts.
SHAPES = {"email": r"\S@\S", "ip": r"[0-9]+[.:][0-9]+[.:][0-9]+", "card": r"(?:[0-9][^0-9]*+){8}", "phone": r"(?:[0-9][^0-9]*+){7}"}
ROUNDS = 3
#: A pattern counts from so many different instances and seeds on, and from this confidence on.
MIN_INSTANCES, MIN_SEEDS, MIN_CONFIDENCE = 4, 2, 0.7
#: An instance is added from this score on.
MIN_SCORE = 0.7


def _walk(text: str, guard: str, pattern: str, kind: str, item: str, keep: str) -> Column:
    """Array of items for the matches m that pass keep; z.g is the piece before, a.p the place where the piece begins."""
    split, found = f"split({text}, r'{pattern}', -1)", f"regexp_extract_all({text}, r'{pattern}', 0)"
    step = f"named_struct('p', a.p + length(z.g) + coalesce(length(z.m), 0), 'o', CASE WHEN z.m IS NOT NULL AND {keep} THEN concat(a.o, array({item})) ELSE a.o END)"
    pieces = f"zip_with({split}, {found}, (g, m) -> named_struct('g', g, 'm', m))"  # the last piece has no match after it
    empty = f"cast(array() AS {kind})"
    # stride by stride, so that an item is copied with the others of its stride only, and not with all before it
    inner = f"aggregate(slice(w, k * {_STRIDE} + 1, {_STRIDE}), named_struct('p', c.p, 'o', {empty}), (a, z) -> {step}, a -> named_struct('p', a.p, 'o', concat(c.o, array(a.o))))"
    outer = f"aggregate(sequence(0, (size(w) - 1) div {_STRIDE}), named_struct('p', 0L, 'o', cast(array() AS array<{kind}>)), (c, k) -> {inner}, c -> flatten(c.o))"
    return F.expr(f"CASE WHEN {guard} THEN element_at(transform(array({pieces}), w -> {outer}), 1) ELSE {empty} END")


def base_spans(text: str, kind: str) -> Column:
    """Spans (start, kind, end) of one kind in a string column; kind is the place in KINDS."""
    guard, pattern, keep = PATTERNS[kind]
    item = f"named_struct('start', a.p + length(z.g), 'kind', {KINDS.index(kind)}, 'end', a.p + length(z.g) + length(z.m))"
    return _walk(text, guard.format(t=text), pattern, _SPAN, item, keep.format(m="z.m"))


def occurrences(text: str) -> Column:
    """Identifier-like tokens with their bounds, value, and the one and two words before them (lower case)."""
    lead = f"regexp_extract(z.m, r'{_LEAD}', 0)"
    core = f"regexp_extract(z.m, r'{_LEAD}(.*[\\p{{L}}\\p{{N}}])', 1)"
    before = "lower(right(z.g, 80))"
    item = (
        f"named_struct('start', a.p + length(z.g) + length({lead}), 'end', a.p + length(z.g) + length({lead}) + length({core}), 'value', {core}, "
        rf"'one', regexp_extract({before}, r'(\S+)\s+\z', 1), 'two', regexp_extract({before}, r'(\S+\s+\S+)\s+\z', 1))"
    )
    return _walk(text, f"rlike({text}, '[0-9@]')", _TOKEN, _OCCURRENCE, item, rf"rlike({core}, r'@|[0-9].*[0-9]') AND length({core}) >= 4")


def spans_text(spans: str) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform(array_sort({spans}), s -> concat(element_at({names}, s.kind + 1), ':', s.start, ':', s.end)), ',')")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, one array of spans a kind, base (all of them, sorted) and the occurrences. Map-only."""
    d = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", row_key().alias("row_key"), *[base_spans("text", k).alias(k) for k in KINDS], occurrences("text").alias("found"))
    return d.withColumn("base", F.array_sort(F.concat(*KINDS)))


def row_key() -> Column:
    """Ties added spans to rows: equal rows are one, rows that share an id but not a text are not."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _graph(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences (row_key, start, end, value, seed) and edges (pattern, value, seed); seed is a kind or -1."""
    each = scanned.filter(F.size("found") > 0).select("row_key", "base", F.explode("found").alias("o"))
    over = F.filter("base", lambda s: (s["start"] < F.col("o.end")) & (s["end"] > F.col("o.start")))
    each = each.select("row_key", "o.*", F.coalesce(F.get(over, F.lit(0))["kind"], F.lit(-1)).alias("seed"))
    each = each.distinct()
    patterns = F.filter(F.array(F.concat(F.lit("1 "), F.col("one")), F.concat(F.lit("2 "), F.col("two"))), lambda p: F.length(p) > 2)
    edges = each.select(F.explode(patterns).alias("pattern"), "value", "seed").groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    return each.select("row_key", "start", "end", "value", "seed"), edges


def _confidence(scored: DataFrame) -> DataFrame:
    """pattern, c0 to c3 from edges with s0 to s3; a pattern without enough instances and seeds has none."""
    sums = [(F.sum(f"s{k}") / (F.count("*") + 1)).alias(f"c{k}") for k in range(len(KINDS))]
    enough = (F.col("n") >= MIN_INSTANCES) & (F.col("seeds") >= MIN_SEEDS)
    out = scored.groupBy("pattern").agg(*sums, F.count("*").alias("n"), F.count_if(F.col("seed") >= 0).alias("seeds")).filter(enough)
    best = F.greatest(*[F.col(f"c{k}") for k in range(len(KINDS))])
    return out.filter(best >= MIN_CONFIDENCE).drop("n", "seeds")


def _scores(edges: DataFrame, confidence: DataFrame) -> DataFrame:
    """value, s0 to s3 of the instances that are no seeds: noisy or over confident patterns."""
    strong = [F.when(F.col(f"c{k}") >= MIN_CONFIDENCE, F.col(f"c{k}")).otherwise(0.0) for k in range(len(KINDS))]
    joined = edges.filter("seed < 0").join(confidence, "pattern")
    either = joined.groupBy("value").agg(*[(1 - F.exp(F.sum(F.log(F.greatest(1 - c, F.lit(1e-9)))))).alias(f"s{k}") for k, c in enumerate(strong)])
    return either.select("value", *[F.when(F.col("value").rlike(SHAPES[kind]), F.col(f"s{k}")).otherwise(0.0).alias(f"s{k}") for k, kind in enumerate(KINDS)])


def discover(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """row_key, added: spans that the patterns vouch for and no base span covers."""
    found, edges = _graph(scanned)
    found, edges = materialize(found, "occurrences"), materialize(edges, "edges")
    seeded = [F.when(F.col("seed") == k, 1.0).otherwise(0.0).alias(f"s{k}") for k in range(len(KINDS))]
    scores = None
    for _ in range(rounds):
        if scores is None:
            scored = edges.select("pattern", "seed", *seeded)
        else:
            known = edges.filter("seed >= 0").select("pattern", "seed", *seeded)
            open_ = edges.filter("seed < 0").join(scores, "value", "left").select("pattern", "seed", *[F.coalesce(f"s{k}", F.lit(0.0)).alias(f"s{k}") for k in range(len(KINDS))])
            scored = known.unionByName(open_)
        scores = materialize(_scores(edges, _confidence(scored)), "scores")
    best = F.array_max(F.array(*[F.struct(F.col(f"s{k}").alias("score"), F.lit(-k).alias("kind")) for k in range(len(KINDS))]))
    good = scores.withColumn("best", best).filter(F.col("best.score") >= MIN_SCORE).select("value", (-F.col("best.kind")).alias("kind"))
    new = found.filter("seed < 0").join(good, "value")
    return new.groupBy("row_key").agg(F.collect_set(F.struct("start", "kind", "end")).cast(_SPAN).alias("added"))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, base and spans (array of start, kind, end), and an array a kind."""
    scanned = materialize(scan(docs), "scanned")
    added = discover(scanned)
    out = scanned.drop("found").join(added, "row_key", "left")
    return out.withColumn("spans", F.array_sort(F.array_union("base", F.coalesce("added", F.array().cast(_SPAN))))).drop("added")


def redact(text: str, spans: str) -> Column:
    """The text with each run of overlapping spans replaced by its first kind in angle brackets."""
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    gap = f"substring({text}, cast(a.p + 1 AS int), cast(s.start - a.p AS int))"
    step = (
        f"CASE WHEN s.start >= a.p THEN named_struct('p', s.end, 'o', concat(a.o, array({gap}, element_at({names}, s.kind + 1)))) "
        "ELSE named_struct('p', greatest(a.p, s.end), 'o', a.o) END"
    )
    done = f"array_join(concat(a.o, array(substring({text}, cast(a.p + 1 AS int)))), '')"
    walked = f"aggregate(array_sort({spans}), named_struct('p', 0L, 'o', cast(array() AS array<string>)), (a, s) -> {step}, a -> {done})"
    return F.expr(f"CASE WHEN size({spans}) > 0 THEN {walked} ELSE {text} END")


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with all spans replaced in their texts; other columns stay as they are."""
    found = find_pii(docs).filter(F.size("spans") > 0).select("row_key", "spans").groupBy("row_key").agg(F.first("spans").alias("_pii_spans"))
    keyed = docs.withColumn("_pii_row_key", row_key())
    joined = keyed.join(found.withColumnRenamed("row_key", "_pii_row_key"), "_pii_row_key", "left")
    hidden = F.when(F.col("_pii_spans").isNotNull(), redact("text", "_pii_spans")).otherwise(F.col("text"))
    return joined.withColumn("text", hidden).select(*docs.columns)


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    """Base and added spans of all documents."""
    found = find_pii(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))
