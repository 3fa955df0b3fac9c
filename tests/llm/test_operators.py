"""The training-data operators against brute force, exact round trips and held-out accuracy, and on awkward tables."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"
public_tokenizers = pytest.importorskip("public_tokenizers")

from tracewarden import llm  # noqa: E402
from tracewarden.llm import bpe, chat, langid, linejoin, mih, multiset, packing, pii, simhash, warc  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "call +1 (555) 123-4567 now\n" + "x" * 50_000


def documents(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
    for name in ("score", "key", "root", "vector", "sort_id", "tie", "gone", "_n", "count", "spans") if extra else ():
        df = df.withColumn(name, F.lit("clash"))
    return df


AWKWARD = [(None, None), (None, "null id"), (1, None), (2, ""), (3, "  \n\t"), (4, "a"), (5, LONG), (6, "same text of five words"), (6, "same text of five words"), (7, "same text of five words"), (8, "ünï çødé ### </turn> \\ |   \x1c end"), (9, "4539578763621486 a.b@c.de 1.2.3.4")]


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def query(spark, sf, n):
    name = next(x for x in llm.queries() if x.startswith(f"op{n}_"))
    return [r.asDict() for r in llm.queries()[name](spark, sf).collect()]


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.execute(llm.oracle_sql()[name])
    order = [c[0] for c in result.description]
    want = sorted((tuple(r[order.index(c)] for c in sorted(order)) for r in result.fetchall()), key=str)
    df = llm.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(order)
    assert sorted((tuple(r[c] for c in sorted(order)) for r in df.collect()), key=str) == want


# --- language ID


def test_language_accuracy(spark, sf, docs):
    rows = query(spark, sf, 1)
    lang = {i: x for i, _, x in docs}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_awkward(spark):
    df = documents(spark, AWKWARD, extra=True)
    model = langid.fit(df.select("doc_id", "text", "lang"))
    out = langid.predict(df.select("doc_id", "text"), model).collect()
    assert len(out) == len(AWKWARD)
    assert all(r["lang_pred"] == "und" for r in out if not any(c.isalpha() for c in r["text"] or ""))
    assert langid.predict(df.select("doc_id", "text"), langid.fit(df.limit(0))).filter("lang_pred <> 'und'").isEmpty()
    assert langid.predict(df.limit(0).select("doc_id", "text"), model).count() == 0
    clash = langid.predict(df.withColumn("lang_pred", F.lit(1)), model)
    assert clash.columns.count("score") == clash.columns.count("lang_pred") == 1 and clash.count() == len(AWKWARD)


# --- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def spans_text(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans(spark, sf, docs):
    text = {i: t for i, t, _ in docs}
    for r in query(spark, sf, 2):
        want = base_spans(text[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in want) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(spans_text(want).encode()).hexdigest()
        assert set(filter(None, spans_text(want).split(","))) <= set(r["spans"].split(","))


def test_base_spans_of_random_texts(spark):
    rng = random.Random(3)
    atoms = ["a", "b.c", "@", ".", "-", "_", "%", "+", "+1", " ", "(", ")", "255", "256", "0", "00012", "4539578763621486", "7", "é", "🙂", "\n", "a@b.c", "1.2.3.4", "+1 555 123 4567"]
    rows = [(k, "".join(rng.choice(atoms) for _ in range(rng.randrange(14)))) for k in range(3000)] + AWKWARD
    out = pii.scan(documents(spark, rows, extra=True)).select("doc_id", "base").collect()
    want = collections.Counter((i, tuple(base_spans(t))) for i, t in rows)
    assert collections.Counter((r["doc_id"], tuple(tuple(s) for s in r["base"])) for r in out) == want


def test_contexts_find_unseen(spark):
    seeds = [(k, f"my card number is {n} thanks") for k, n in enumerate(["4539578763621486", "4485275742308327", "4716461583322103", "4929939187355598", "4556737586899855", "4532015112830366", "4024007103939509", "4916338506082832"])]
    other = [(100, "my card number is 4539-XX63-6214-99 thanks"), (101, "the year is 1984 thanks")]
    rows = {r["doc_id"]: r for r in pii.find_pii(documents(spark, seeds + other)).collect()}
    assert [tuple(s) for s in rows[100]["spans"]] == [(18, 2, 35)] and not rows[100]["base"]
    assert not rows[101]["spans"]
    clean = pii.redact_documents(documents(spark, seeds + other + AWKWARD, extra=True)).collect()
    assert len(clean) == len(seeds + other + AWKWARD) and all("4539578763621486" not in (r["text"] or "") for r in clean)
    assert pii.find_pii(documents(spark, [])).count() == 0


def test_phones_are_found_by_context(spark):
    """A phone is one instance, whatever blanks it holds; one without a plus is found after the same words."""
    rows = [(k, f"please call me at +1 (0{k}7) 555-77{k}3 today") for k in range(10, 20)] + [(50, "please call me at (017) 555-7713 today"), (51, "please call me at 9 today")]
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find_pii(documents(spark, rows)).collect()}
    assert found[50] == [(18, 3, 32)] and found[51] == [] and found[10] == [(18, 3, 37)]


def test_many_matches(spark):
    """Far more matches than a stride."""
    text = " ".join(f"u{k}@x.org 10.0.{k % 256}.1" for k in range(3000))
    row = pii.scan(documents(spark, [(1, text)])).first()
    assert [tuple(s) for s in row["base"]] == base_spans(text)
    assert [tuple(o) for o in row["found"]] == brute_occurrences(text)


JAVA_S = "\t\n\x0b\x0c\r "
TOKEN = regex.compile(rf"(?<![^{JAVA_S}])[^{JAVA_S}0-9@]*+[0-9@][^{JAVA_S}]*+(?: [(+]?[0-9][0-9().+-]*+(?![^{JAVA_S}]))*+")
LEAD = r"\A(?:(?!\([0-9]++\)[ 0-9-])[^\p{L}\p{N}+@])*+"


def brute_occurrences(text):
    """start, end, value, one and two words before."""
    out, last = [], 0
    for m in TOKEN.finditer(text):
        gap, last = text[last : m.start()], m.end()
        core = regex.match(LEAD + r"(.*[\p{L}\p{N}])", m[0])
        if not core or len(core[1]) < 4 or not re.search(r"@|[0-9].*[0-9]", core[1]):
            continue
        before = gap[-80:].lower()
        one, two = regex.search(rf"([^{JAVA_S}]+)[{JAVA_S}]+\Z", before), regex.search(rf"([^{JAVA_S}]+[{JAVA_S}]+[^{JAVA_S}]+)[{JAVA_S}]+\Z", before)
        out.append((m.start() + core.start(1), m.start() + core.end(1), core[1], one[1] if one else "", two[1] if two else ""))
    return out


def brute_spans(rows):
    """All spans of each text by the same rounds over plain dictionaries."""
    base = {i: base_spans(t) for i, t in rows}
    occurrences, edges = [], {}
    for i, t in rows:
        for start, end, value, one, two in brute_occurrences(t or ""):
            over = [k for a, k, b in base[i] if a < end and b > start]
            seed = over[0] if over else -1
            occurrences.append((i, start, end, value, seed))
            for p in [f"1 {one}"] * bool(one) + [f"2 {two}"] * bool(two):
                edges[p, value] = max(seed, edges.get((p, value), -1))
    scores = {}
    for _ in range(pii.ROUNDS):
        of = collections.defaultdict(list)
        for (p, v), seed in edges.items():
            of[p].append(([float(seed == k) for k in range(4)] if seed >= 0 else scores.get(v, [0.0] * 4), seed))
        strong = {}
        for p, got in of.items():
            c = [sum(s[k] for s, _ in got) / (len(got) + 1) for k in range(4)]
            if len(got) >= pii.MIN_INSTANCES and sum(s >= 0 for _, s in got) >= pii.MIN_SEEDS and max(c) >= pii.MIN_CONFIDENCE:
                strong[p] = [x if x >= pii.MIN_CONFIDENCE else 0.0 for x in c]
        scores = {}
        for (p, v), seed in edges.items():
            if seed < 0 and p in strong:
                scores[v] = [1 - (1 - a) * (1 - b) for a, b in zip(scores.get(v, [0.0] * 4), strong[p])]
        scores = {v: [x if re.search(pii.SHAPES[kind].replace("*+", "*"), v) else 0.0 for x, kind in zip(s, pii.KINDS)] for v, s in scores.items()}
    added = collections.defaultdict(set)
    for i, start, end, value, seed in occurrences:
        best = max(scores.get(value, [0.0]))
        if seed < 0 and best >= pii.MIN_SCORE:
            added[i].add((start, scores[value].index(best), end))
    return {i: spans_text(sorted(added[i] | set(base[i]))) for i, _ in rows}


def test_all_spans_by_brute_force(spark, docs):
    """The rounds over all documents, with some identifiers defaced, so that only contexts can find them."""
    rng = random.Random(9)
    rows = [(i, re.sub(r"@|\+(?=[0-9])", lambda m: "" if m[0] == "+" else m[0], t) if t and rng.random() < 0.3 else t) for i, t, _ in docs]
    cards = [c for c in (f"45395787636{k:05d}" for k in range(400)) if luhn(c)]
    rows += [(1000 + k, f"my card number is 4539-57XX-6214-9{k} ok") for k in range(6)] + [(2000 + k, f"my card number is {c}") for k, c in enumerate(cards)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(documents(spark, rows)).select("doc_id", pii.spans_text("spans").alias("spans")).collect()}
    want = brute_spans(rows)
    assert got == want and any(want[i] != spans_text(base_spans(t)) for i, t in rows)


# --- chat


def test_chat_round_trip(spark):
    rng = random.Random(1)
    atoms = ["\\", "#", "###", "</turn>", "</turn>\n", ":", ":\n", "### user:\n", "x", "\n", "é🙂", ""]
    rows = [(c, t, rng.choice(["user", "assistant", None, "a:b", "x\\"]), rng.choice([None, "".join(rng.choice(atoms) for _ in range(rng.randrange(8)))])) for c in range(300) for t in range(rng.randrange(1, 5))]
    rows += [(None, None, "user", "null ids"), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (400, 0, "assistant", LONG)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash")).withColumn("at", F.lit(1))
    rendered = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in chat.read_back(rendered).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(want)
    for c, ts in want.items():
        ts.sort()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in ts).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256("".join(x for _, _, r, x in ts if r == "assistant").encode()).hexdigest()
        assert got[c]["n_turns"] == len(ts)
    assert chat.format_conversations(turns.limit(0)).count() == 0
    for r in rendered.limit(50).collect():
        assert not re.search(r"(?<!\n)### (user|assistant):\n", r["formatted"][4:].replace("</turn>\n### ", ""))


# --- fingerprints


def test_fingerprints(spark, sf, docs):
    texts = [t or "" for _, t, _ in docs]
    rows = {r["doc_id"]: r for r in query(spark, sf, 4)}
    for k, (i, _, _) in enumerate(docs):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        h = len(t) // 2
        assert rows[i]["n_chars"] == len(t)
        assert rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()
    assert len({r["fingerprint"] for r in rows.values()}) == len({tuple(sorted(filter(None, t.split("\n")))) for t in texts})
    mean = lambda c: sum(r[c] for r in rows.values()) / len(rows)
    assert mean("near_edited") > mean("near_next") + 0.2


def test_fingerprint_algebra(spark):
    rows = [(1, "p one\nq two\nr three"), (2, "r three\np one\nq two"), (3, "p one\nq two"), (4, "r three"), (5, "p one\nq two\nr three\nr three")]
    v = {r["doc_id"]: r for r in multiset.fingerprints(documents(spark, rows)).collect()}
    assert v[1]["fingerprint"] == v[2]["fingerprint"] != v[5]["fingerprint"]
    pair = spark.createDataFrame([(v[3]["vector"], v[4]["vector"], v[1]["vector"])], "a array<long>, b array<long>, c array<long>")
    both = pair.select(multiset.add(F.col("a"), F.col("b")).alias("s"), multiset.subtract(F.col("c"), F.col("b")).alias("d"), multiset.likeness("c", "a").alias("near")).first()
    assert both["s"] == v[1]["vector"] and both["d"] == v[3]["vector"] and 0 < both["near"] < 1


def brute_vector(text):
    """The sums of a fingerprint, from the digests of the paragraphs."""
    out = [0] * multiset.WIDTH
    for p in filter(None, text.split("\n")):
        d = hashlib.sha256(p.encode()).hexdigest()
        h = [xxhash.xxh64_intdigest(d, xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42)) for k in range(6)]
        out[0] += 1
        for k in range(8):
            out[1 + k] = (out[1 + k] + (h[k // 2] >> 32 * (k % 2))) % 2**32
        for k in range(30):
            lanes = h[4 + k // 15] >> k % 15
            for s in (0, 15, 30, 45):
                out[9 + k] = out[9 + k] & ~((2**15 - 1) << s) | (((out[9 + k] >> s) + (lanes >> s & 1)) % 2**14) << s
    return out


def brute_likeness(a, b):
    if a == b:
        return 1.0
    apart = 0
    for x, y in zip(a[9:], b[9:]):
        for s in (0, 15, 30, 45):
            d = ((x >> s) - (y >> s) + 8192) % 16384 - 8192
            apart += (2 * d - (a[0] - b[0])) ** 2
    return max(0.0, 1 - apart / 120 / (a[0] + b[0]))


def test_fingerprints_by_brute_force(spark, sf, docs):
    texts = [t or "" for _, t, _ in docs]
    rows = {r["doc_id"]: r for r in query(spark, sf, 4)}
    hexed = lambda v: "".join(f"{x:0{8 if k < 9 else 15}x}" for k, x in enumerate(v))
    for k, (i, _, _) in enumerate(docs):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        h = len(t) // 2
        v, e, w = map(brute_vector, (t, t[: len(t) - h] + nxt[:h], nxt))
        assert (rows[i]["fingerprint"], rows[i]["edited_fingerprint"]) == (hexed(v), hexed(e))
        assert rows[i]["near_edited"] == pytest.approx(brute_likeness(v, e)) and rows[i]["near_next"] == pytest.approx(brute_likeness(v, w))


def test_fingerprints_of_paragraphs_that_collide(spark):
    """Two paragraphs of equal XXH64 (whose rounds can be undone) have different fingerprints."""
    m, p1, p2 = 2**64, 11400714785074694791, 14029467366897019727
    rotl, rotr = lambda x, k: (x << k | x >> 64 - k) % m, lambda x, k: (x >> k | x << 64 - k) % m
    seed = (42 + p1 + p2) % m  # of the first lane
    lane = lambda acc, x: rotl((acc + x * p2) % m, 31) * p1 % m
    word = lambda x: x.to_bytes(8, "little")
    rng = random.Random(5)
    while True:  # change the first stripe's first lane, undo that in the second's
        a, b, c = (int.from_bytes(bytes(rng.randrange(33, 127) for _ in range(8)), "little") for _ in range(3))
        want = lane(lane(seed, a), b)
        acc = rotr(want * pow(p1, -1, m) % m, 31)
        d = (acc - lane(seed, c)) * pow(p2, -1, m) % m
        one, other = (word(x) + b"x" * 24 + word(y) + b"y" * 24 for x, y in ((a, b), (c, d)))
        if b"\n" not in other:
            break
    assert xxhash.xxh64_intdigest(one, 42) == xxhash.xxh64_intdigest(other, 42) and one != other
    df = spark.createDataFrame([(1, bytearray(one)), (2, bytearray(other))], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    assert df.select(F.xxhash64("text")).distinct().count() == 1
    assert len({r["fingerprint"] for r in multiset.fingerprints(df).collect()}) == 2


def test_fingerprints_awkward(spark):
    df = documents(spark, AWKWARD, extra=True)
    for buckets in (1, 3, 50):
        out = multiset.with_next(df, buckets).collect()
        order = sorted(((i is not None, i or 0, t or "") for i, t in AWKWARD))
        want = collections.Counter((o[2], order[(k + 1) % len(order)][2]) for k, o in enumerate(order))
        assert collections.Counter((r["text"], r["next_text"]) for r in out) == want
    assert multiset.with_next(df.limit(0), 5).count() == 0
    assert multiset.fingerprints(df).count() == len(AWKWARD)


# --- BPE


def test_bpe_is_the_librarys(spark, sf, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for r in query(spark, sf, 5):
        text = docs[r["doc_id"]][1] or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    e, rng = bpe.encoder(path), random.Random(2)
    pool = " \n\t\x1c\x1f\x85\xa0​　ab'stZé日١Ⅷ²_-🙂́\x00\r"
    for k in range(5000):
        s = "".join(rng.choice(pool) for _ in range(rng.randrange(14))) + "<|endoftext|>" * (k % 50 == 0)
        assert e.encode(s) == t.encode(s, add_special_tokens=False).ids
        assert e.decode(e.encode(s)) == s
    df = documents(spark, AWKWARD, extra=True)
    encoded = bpe.encode_documents(df, path)
    assert sorted(r["text"] for r in bpe.decode_documents(encoded, path).collect()) == sorted(t or "" for _, t in AWKWARD)
    assert bpe.encode_documents(df.limit(0), path).count() == 0


# --- lines


def brute_lines(rows):
    """Removed lines: some earlier line's set is similar."""
    sets, inverted, out = [], collections.defaultdict(list), {}
    for key, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            w = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            again = False
            if w:
                common = collections.Counter(y for x in w for y in inverted[x])
                again = any(c >= 0.8 * (len(w) + len(sets[y]) - c) - 1e-9 for y, c in common.items())
                for x in w:
                    inverted[x].append(len(sets))
                sets.append(w)
            if not again:
                kept.append(line)
        out[key] = "\n".join(kept)
    return out


def test_lines(spark, sf, docs):
    want = brute_lines([(i, t) for i, t, _ in docs])
    rows = query(spark, sf, 6)
    assert len(rows) == len(docs)
    assert all(r["kept_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest() for r in rows)


@pytest.mark.parametrize("chunk", [8192, 24])
def test_lines_of_many_variants(spark, monkeypatch, chunk):
    """A group of near copies far larger than the candidates named, so that the second round decides; words cut into chunks."""
    monkeypatch.setattr(linejoin, "CHUNK", chunk)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(30)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(30)] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(words) + "\n" + " ".join(rng.choice(base) for _ in range(rng.randrange(3, 9)))))
    want = brute_lines(rows)
    monkeypatch.setattr(linejoin, "NAMED", 1)
    got = {r["doc_id"]: r["text"] for r in linejoin.dedup_lines(documents(spark, rows, extra=True)).collect()}
    assert got == want


def test_short_lines(spark):
    """Lines of few different words: equal sets match, and four words match five that hold them."""
    rows = [
        (1, "Les.\nAnd ornd.\n\n \na b c d\nv w x y z"), (2, "Les.\nornd. And\n\nLes. And\na b c d e\nv w x y\na b c"),
        (3, "Les. Les. Les.\na b c d f g\nb a c\nv w x\n一二三四五六\n"), (4, "\n一二三四五六\nha ha ha ha ha ha ha\nha"),
    ]
    got = {r["doc_id"]: r["text"] for r in linejoin.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "\nLes. And\na b c", 3: "a b c d f g\nv w x\n一二三四五六\n", 4: "\nha ha ha ha ha ha ha"}


def test_lines_out_of_order(spark, monkeypatch):
    """A set that is met first with a later id: its pair goes unnamed, and another set has removed it by the second round."""
    c = [f"c{k}" for k in range(16)]
    x, y, w, z = (" ".join(q) for q in (["g", "h", "u", "v", *c], ["h", "v", "y1", "y2", *c], ["h", "u", "v", "w1", *c], ["g", "u", "z1", "z2", *c]))
    rows = [(100, x), (0, z), (1, x), (50, y), (70, w), (200, "u v " * 5)]
    want = brute_lines(sorted(rows))
    assert want[50] == ""
    monkeypatch.setattr(linejoin, "NAMED", 1)
    assert {r["doc_id"]: r["text"] for r in linejoin.dedup_lines(documents(spark, rows).coalesce(1)).collect()} == want


def test_lines_in_any_order(spark):
    """A set that is first met with a late id, many variants, rows shuffled over several partitions."""
    ten = [f"t{k}" for k in range(10)]
    rows = [(100, " ".join(ten)), (5, " ".join(ten)), (1, " ".join([*ten, "one"]))] + [(i, " ".join([*ten[:9], f"v{i}"])) for i in range(10, 50)]
    want = brute_lines(sorted(rows))
    rng = random.Random(7)
    for width in (1, 5):
        rng.shuffle(rows)
        assert {r["doc_id"]: r["text"] for r in linejoin.dedup_lines(documents(spark, rows).repartition(width)).collect()} == want


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_words_that_collide_under_polynomials(spark):
    """Words whose polynomial hashes modulo 2^64 agree for any base are told apart."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    h, _, _ = linejoin.words_of([f"{one} {other} {one}"])
    assert h[0] == h[2] != h[1]
    rows = [(1, f"w x y z {one}"), (2, f"w x y {one}"), (3, other), (4, one), (5, other)]
    assert {r["doc_id"]: r["text"] for r in linejoin.dedup_lines(documents(spark, rows)).collect()} == brute_lines(rows) | {}
    tok = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for text, ids in zip((one, f"{one} {other}", other), tok.encode_many([one, f"{one} {other}", other])):
        assert ids.tolist() == tok.tokenizer.encode(text, add_special_tokens=False).ids


def test_lines_awkward(spark):
    out = linejoin.dedup_lines(documents(spark, AWKWARD, extra=True)).collect()
    assert len(out) == len(AWKWARD)
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r["text"])
    assert by[6] == ["same text of five words"] * 2 and by[7] == [""] and by[1] == [None] and by[2] == [""]
    assert linejoin.dedup_lines(documents(spark, [])).count() == 0


# --- WARC


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 500
    rows = [(3, "http://a", big), (1, "http://b", big), (2, None, None), (4, "u", "small"), (5, "u", "small"), (None, "n", big), (6, "u", LONG), (7, "u", "é" * 99), (7, "u", "é" * 99), (8, "u\r\nX: y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("refers_to", F.lit(9))
    manifest = warc.write_archives(pages, f"file://{tmp_path}/a", 3, roll_bytes=400).orderBy("name").collect()
    assert len(manifest) > 3 and sum(f["records"] for f in manifest) == len(rows)
    assert not [f for f in os.listdir(tmp_path / "a") if f.startswith("_temporary")] and (tmp_path / "a/manifest/_SUCCESS").exists()
    assert all(os.path.getsize(tmp_path / "a" / f["name"]) == f["bytes"] for f in manifest)
    again = warc.write_archives(pages, f"file://{tmp_path}/b", 3, roll_bytes=400).orderBy("name").collect()
    assert [f["sha256"] for f in again] == [f["sha256"] for f in manifest], "equal input, equal bytes"
    got = warc.read_archives(spark, f"file://{tmp_path}/a", payloads=True).collect()
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == sorted([(0, "revisit", 1), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (7, "revisit", 7), (8, "response", None)], key=lambda x: x[:2])
    assert {r["payload"].decode() for r in got if r["record_type"] == "response"} == {h or "" for _, _, h in rows}
    for r in got:
        if r["payload"] is not None:
            assert r["payload_digest"] == hashlib.sha256(r["payload"]).hexdigest()
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/c", 2)
    assert warc.read_archives(spark, f"file://{tmp_path}/c").count() == 0


def test_heavy_payloads(spark, monkeypatch):
    """A payload that a third of all pages have is joined in parts, and each page is noted once."""
    monkeypatch.setattr(warc, "LEAST_HEAVY", 7)
    rows = [(k, "u", ("hot" if k % 3 == 0 else f"pair {k // 6}") * 60) for k in range(300)]
    got = {r["page_id"]: r["refers_to"] for r in warc.find_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    first: dict = {}
    for k, _, h in rows:
        first.setdefault(h, []).append(k)
    assert got == {k: ks[0] for ks in first.values() if len(ks) > 1 for k in ks}


# --- packing


def test_packing(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = set(), 0
    for i, text, _ in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        want |= {(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)}
    rows = query(spark, sf, 8)
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows} == want
    check_layout(rows)
    assert len({r["sequence_id"] for r in rows}) <= math.ceil(total / 4096) + 1


def check_layout(rows, capacity=4096):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity


def test_local_search(spark):
    rng = np.random.default_rng(3)
    sizes = np.array([4] * 6 + [3] * 6 + [6, 6, 5, 5, 7, 3], np.int64)
    start = [[k] for k in range(len(sizes))]
    search = packing.LocalSearch(sizes, start, 10)
    before = int((search.fill**2).sum())
    of = search.run()
    assert len(set(of.tolist())) < len(sizes) and int((search.fill**2).sum()) > before
    assert max(np.bincount(of, weights=sizes)) <= 10
    for _ in range(20):
        z = rng.integers(1, 60, 80)
        b = packing.pack_lengths(z, 100)
        assert max(np.bincount(b, weights=z)) <= 100 and len(set(b.tolist())) <= math.ceil(z.sum() / 100) + 2


def test_packing_awkward(spark):
    df = documents(spark, AWKWARD, extra=True)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [r.asDict() for r in packing.pack_documents(df, path).collect()]
    check_layout(rows)
    assert len([r for r in rows if r["piece"] == 0]) == len(AWKWARD)
    t = packing.tokenizer(path)
    for got, (_, text) in zip(t.encode_many([x or "" for _, x in AWKWARD]), AWKWARD):
        assert got.tolist() == t.tokenizer.encode(text or "", add_special_tokens=False).ids
    assert packing.pack_documents(documents(spark, []), path).count() == 0
    small = packing.pack_pieces(packing.tokenize_pieces(df, path, 7), 7, group_pieces=50)
    check_layout([r.asDict() for r in small.collect()], 7)


# --- SimHash


def brute_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius):
            p, q = find(i), find(i + 1 + int(j))
            parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(a))]


def test_simhash(spark, sf, docs):
    fps = [brute_fingerprint(t) for _, t, _ in docs]
    root = brute_components(fps)
    want = {(docs[k][0], f"{fps[k]:016x}", docs[root[k]][0]) for k in range(len(docs))}
    assert {tuple(r[c] for c in ("doc_id", "fingerprint", "component_id")) for r in query(spark, sf, 9)} == want


@pytest.mark.parametrize("limit", [4096, 8])
def test_dense_fingerprints(spark, monkeypatch, limit):
    """Clusters, chains and noise; with small buckets, which are cut into chunks, and with large ones."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", limit)
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(3):
        x = rng.getrandbits(64)
        for _ in range(150):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
        for _ in range(30):  # a chain
            x ^= sum(1 << b for b in rng.sample(range(64), 4))
            fps.add(x)
    fps = sorted(fps)
    root = brute_components(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    links = simhash.near_links(df, len(fps))
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    groups = collections.defaultdict(set)
    for f, r in zip(fps, root):
        groups[r].add(int(np.uint64(f).view(np.int64)))
    got = collections.defaultdict(set)
    for n, r in found.items():
        got[r].add(n)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)
    assert links.count() < 40 * len(fps), "no quadratic output"


def test_pivot_table(spark, sf):
    """No linked pair is discarded, and nearly all others are."""
    texts = duckdb.sql(f"SELECT text FROM '{sf.replace('sf0.001', 'sf0.01')}/documents.parquet'").fetchall()
    fps = np.unique(np.array([brute_fingerprint(t) for (t,) in texts], np.uint64))
    rows = simhash.pivot_table(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")).toPandas()
    table = simhash.table_of(rows["far0"].to_numpy(), rows["far1"].to_numpy())
    fps = rows["fp"].to_numpy().view(np.uint64)
    assert (table == np.bitwise_count(fps[:, None] ^ simhash.PIVOTS)).all()
    kept = linked = 0
    for i in range(len(fps) - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4)
        left = simhash.survivors(table[i], table[i + 1 :], 4)
        assert set(near.tolist()) <= set(left.tolist())
        kept, linked = kept + len(left), linked + len(near)
    pairs = len(fps) * (len(fps) - 1) // 2
    print(f"{pairs} pairs, {pairs - kept} discarded by the pivot table, {kept} verified, {linked} links")
    assert kept < 0.01 * pairs


def test_simhash_awkward(spark):
    df = documents(spark, AWKWARD, extra=True)
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(AWKWARD)
    c = {r["doc_id"]: r["component_id"] for r in out}
    assert c[1] == c[2] == c[3] == 1 and c[7] == c[6] == 6
    kept = simhash.keep_one_of_each(df)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 8, 9] and kept.columns == df.columns
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [8192, 24])
def test_near_copies(spark, docs, monkeypatch, chunk):
    """The pipeline's near copies against brute force over all pairs, most of them near the threshold."""
    rng = random.Random(8)
    rows = [(i, t) for i, t, _ in docs][:120] + [(900, ""), (901, " \n"), (902, "Two words"), (903, "two  WORDS"), (904, "two word")]
    for g in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([30, 60, 200]))]
        for k in range(25 if g else 80):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 20)):
                words[rng.randrange(len(base))] = f"v{rng.randrange(999)}"
            rows.append((1000 + 100 * g + k, " ".join(words) + " end" * rng.randrange(2)))
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a  # rows are in the order of their ids
    want = sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)
    rng.shuffle(rows)
    monkeypatch.setattr(linejoin, "NAMED", 1)
    monkeypatch.setattr(linejoin, "CHUNK", chunk)
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(documents(spark, rows, extra=True)).collect()) == want


@pytest.mark.parametrize("limit", [4096, 8])
def test_fingerprints_of_near_copies(spark, monkeypatch, limit):
    """Fingerprints link near copies alone, and all up to SURE bits apart in small buckets; what they leave apart is found too."""
    rng = random.Random(9)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 150, 400]))]
        for k in range(5 if g else 60):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 40)):
                words[rng.randrange(len(base))] = f"v{rng.randrange(999)}"
            rows.append((100 * g + k, " ".join(words)))
    sets, fps, s1 = [], [], []
    for _, t in rows:
        h = set(simhash.shingles_of([t])[0].tolist())
        sets.append(h)
        fps.append(sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64)))
        s1.append(int(linejoin.LineSets([t], None, simhash.shingles_of).s1.view(np.int64)[0]))
    pairs = [(i, j, (fps[i] ^ fps[j]).bit_count()) for i in range(len(rows)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) and s1[i] != s1[j]]
    alike = {frozenset((s1[i], s1[j])) for i, j, _ in pairs}
    monkeypatch.setattr(simhash, "BUCKET_ROWS", limit)
    df = documents(spark, rows)
    keyed = df.select(F.col("doc_id").alias("sort_id"), F.lit(0).cast("long").alias("tie"), "text")
    links = simhash.fingerprint_links(keyed, 0.8, simhash.shingles_of)
    assert {frozenset((r["a"], r["b"])) for r in links.collect()} <= alike
    root = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    found = {d: [root.get(s1[i], s1[i]) == root.get(s1[j], s1[j]) for i, j, x in pairs if x == d] for d in range(65)}
    print({d: (sum(x), len(x)) for d, x in found.items() if x})
    if limit > 8:
        assert all(all(found[d]) for d in range(simhash.SURE + 1)) and any(found[d] for d in range(simhash.SURE + 1))
    assert sum(map(sum, found.values())) > 0.7 * len(pairs), "most links are found by fingerprints"
    want = sorted(r["doc_id"] for r in simhash.keep_one_of_each(df).collect())
    search, asked = simhash.near_links, []
    monkeypatch.setattr(simhash, "near_links", lambda distinct, n, *radii: asked.append(radii) or search(distinct, n, *radii).limit(0))
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(df).collect()) == want and asked == [(simhash.NEAR, simhash.SURE)]


# --- nearest neighbours


def test_neighbours(spark, sf):
    v = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in v]), np.array([r[1] for r in v], float)
    got = collections.defaultdict(dict)
    for r in query(spark, sf, 10):
        got[r["query_id"]][r["rank"]] = r
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    hits = 0
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, 21))
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & {r["vec_id"] for r in ranks.values()})
        assert all(r["score"] == pytest.approx(s[ids == r["vec_id"]][0], abs=1e-12) for r in ranks.values())
    assert hits / (20 * len(got)) >= 0.9


def test_neighbours_awkward(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(v) for v in rng.normal(size=8) * (1 + k % 3)]) for k in range(40)]
    rows += [(40, rows[0][1]), (41, rows[0][1]), (41, rows[0][1]), (60, None), (80, [0.0] * 8), (100, [float("nan")] * 8), (120, [None] + [1.0] * 7), (140, [1.0] * 3), (None, [1.0] * 8), (160, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x")).withColumn("score", F.lit(0))
    out = mih.search(df, F.col("vec_id") % 20 == 0).collect()
    assert {r["query_id"] for r in out} == {0, 20, 40}
    zero = [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == 0), key=lambda r: r["rank"])]
    same = [r for r in zero if r in (40, 41)]
    assert same == sorted(same) and 0 not in zero
    assert mih.search(df.limit(0), F.lit(True)).count() == 0
    few = mih.search(df.filter("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert sorted(r["rank"] for r in few) == [1, 2, 3, 4]


@pytest.mark.parametrize("sparse", [0, 8])
def test_probing_finds_what_the_pigeonhole_promises(monkeypatch, sparse):
    monkeypatch.setattr(mih, "SPARSE", sparse)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, (20, 4), dtype=np.uint64)
    codes = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, (20, 4)).astype(np.uint64)), rng.integers(0, 2**64, (200, 4), dtype=np.uint64)])
    for step in (0, 1, 3):
        index = mih.SubstringIndex(codes, codes.view(np.uint16), step)
        for q in base:
            parts = np.bitwise_count(codes.view(np.uint16) ^ q.view(np.uint16))
            assert index.probe(q.view(np.uint16)).tolist() == np.flatnonzero(parts.min(axis=1) <= step).tolist()
            far = np.bitwise_count(codes ^ q).sum(axis=1)
            radius = 16 * (step + 1) - 1
            assert index.within(q, q.view(np.uint16), radius).tolist() == np.flatnonzero(far <= radius).tolist()


def recall(spark, rows, is_query):
    """Recall against brute force, and the share of rows that queries probe and rerank."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    df = spark.createDataFrame([(int(i), [float(v) for v in w]) for i, w in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)
    got = collections.defaultdict(set)
    for r in mih.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    hasher = mih.Hasher(x[:8192], float(np.sqrt((x * x).sum(axis=1)).max()), 20)
    codes = hasher.codes(x)
    index = mih.SubstringIndex(codes, hasher.parts(codes), hasher.step)
    hits, probed, reranked, asks = 0, 0, 0, ids[is_query(ids)]
    for q in asks.tolist():
        at = int(np.flatnonzero(ids == q)[0])
        s = x @ x[at]
        s[at] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & got[q])
        code = hasher.codes(x[at : at + 1], query=True)
        probed += len(index.probe(hasher.parts(code)[0]))
        reranked += len(index.within(code[0], hasher.parts(code)[0], hasher.radius))
    n = len(asks) * len(ids)
    print(f"recall {hits / 20 / len(asks):.3f}, step {hasher.step}, radius {hasher.radius} of {hasher.bits}, probed {probed / n:.3f}, reranked {reranked / n:.3f}")
    return hits / 20 / len(asks), probed / n


def test_recall_of_the_table(spark, sf):
    """Unclustered vectors: neighbours nearly at right angles, so much is probed."""
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf.replace('sf0.001', 'sf0.01')}/embeddings.parquet' ORDER BY vec_id").fetchall()
    found, _ = recall(spark, rows, lambda i: i % 20 == 0)
    assert found >= 0.95


def test_recall_of_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(100, 32))
    rows = [(k, centres[k % 100] + 0.2 * rng.normal(size=32)) for k in range(4000)]
    found, probed = recall(spark, rows, lambda i: i % 20 == 0)
    assert found >= 0.95 and probed < 0.3
