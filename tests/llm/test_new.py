"""The prefix trie, substring deduplication and collocations against plain computations; pipeline stages on odd columns."""

import collections
import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkveil.llm import collocations, prefix_trie, substring_dedup
from tests.llm.brute import WORD, lower

TURNS = "conv_id long, turn long, role string, text string"


# ------------------------------------------------------------------ prefix trie
def trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends, kids = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        turns = tuple(own.get(first, [])[:h] + turns[h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        saved, leaves = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0), int(not kids[p])
        for k in kids[p]:
            s, n = below(k)
            saved, leaves = saved + s, leaves + n
        return saved, leaves

    out = []
    for p, m in list(members.items()):
        saved, leaves = below(p)
        told = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves, saved, told))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_trie_is_the_plain_one(spark, seed):
    """Nulls, ties, repeated turns, copies over many partitions, turnless conversations, negative ids."""
    rng, rows = random.Random(seed), []
    for c in range(-7, rng.choice([1, 40, 150])):
        if rng.random() < 0.15:
            continue
        copy = rng.random() < 0.5
        for t in range(rng.choice([1, 3, 9, 20])):
            rows.append((c, t, "u", f"x{t}") if copy else (rng.choice([c, c, c, None]), rng.choice([t, t, None]), rng.choice(["u", None]), rng.choice(["a", "", None, "é" * 3])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).withColumn("key", F.lit("mine")).withColumn("family", F.lit(0)).withColumn("a.b", F.lit(1))
    for parts in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = prefix_trie.prefix_trie(df).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sorted(map(tuple, got), key=str) == trie(rows)


def test_trie_of_nothing_and_of_long_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(none).count() == 0 and prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)).count() == 0
    rows = [(c, t, "u", "long " * 50_000 + str(t)) for c in (5, 6) for t in range(12)]
    assert sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()), key=str) == trie(rows)


# ------------------------------------------------------------------ substring dedup
def without_repeats(rows):
    docs = [(2**63 - 1 if k is None else k, WORD.findall(t or "")) for k, t in rows]
    least = {}
    for k, w in docs:
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            least[key] = min(least.get(key, k), k)
    out = []
    for (k, w), (own, _) in zip(docs, rows, strict=True):
        gone = {j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < k for j in range(i, i + 13)}
        out.append((own, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("chunk", [40, 1_000_000])
def test_substrings_are_the_plain_ones(spark, monkeypatch, seed, chunk):
    """Passages over many documents, within one, in copies, at equal and null ids; in small chunks and large ones."""
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", chunk)
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(rng.choice([2, 30, 400]))] + ["É", "日本"]
    passages = [[rng.choice(names) for _ in range(rng.randint(9, 60))] for _ in range(5)]
    rows = []
    for k in range(rng.choice([5, 150])):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += [rng.choice(names) for _ in range(rng.randint(0, 30))] + (rng.choice(passages) if rng.random() < 0.5 else [])
        rows.append((rng.choice([k, k, k, 7, None]), rng.choice([" ", "\n", " \t\x0b"]).join(words) if rng.random() > 0.05 else None))
    rows += [rows[0], rows[-1]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, substring_dedup.without_repeats(df).collect()), key=str) == without_repeats(rows)


def test_substrings_of_long_texts_and_odd_columns(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(2, long), (1, "x " + long + " y"), (3, "a " * 40_000), (4, "a " * 12), (5, "a " * 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    odd = df.withColumn("id", F.lit(1)).withColumn("mark", F.lit(2)).withColumn("spans", F.lit(None).cast("string")).withColumn("a.b", F.lit(0))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(odd).collect()}
    assert got == {1: (60_002, 0), 2: (60_000, 60_000), 3: (40_000, 0), 4: (12, 0), 5: (13, 13)}
    assert substring_dedup.substring_dedup(df.where("doc_id > 9")).count() == 0


def test_anchors_are_winnowed():
    """Equal windows have equal anchors at equal places, and there are far fewer anchors than windows."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    hashes = substring_dedup.WordHashes().of([w.encode() for w in words + words[100:300]])
    at, doc, anchor, place, extension = substring_dedup.anchored_windows(hashes, __import__("numpy").array([4000, 4200]))
    second = dict(zip(at[doc == 1] - 4000, zip(anchor[doc == 1], place[doc == 1] - 4000, extension[doc == 1], strict=True), strict=True))
    first = dict(zip(at[doc == 0], zip(anchor[doc == 0], place[doc == 0], extension[doc == 0], strict=True), strict=True))
    assert all(first[k + 100] == (a, p + 100, e) for k, (a, p, e) in second.items()) and len(second) == 188
    assert len(set(place[doc == 0])) < 0.3 * len(first)


# ------------------------------------------------------------------ collocations
def phrases(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inner = collections.Counter()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inner[lang, p[i : i + k]] = max(inner[lang, p[i : i + k]], a)
    out = []
    for (lang, p), a in found.items():
        if 100 * inner[lang, p] < 80 * a:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    ranked, rank = [], collections.Counter()
    for lang, score, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("chunk", [50, 1_000_000])
def test_collocations_are_the_plain_ones(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
    rng = random.Random(seed)
    names = ["Aa", "b", "c d", "é", "日本", "x.y", "e\tf", "\x1c"] + [f"w{k}" for k in range(rng.choice([2, 10]))]
    gaps = [" "] * 8 + [". ", ",", "\n", "\t", "  ", "; ", "\x0b"]
    text = lambda: "".join(rng.choice(names) + rng.choice(gaps) for _ in range(rng.randint(0, 120)))
    rows = [(text() if rng.random() > 0.05 else None, rng.choice(["de", "en", None, "en", ""])) for _ in range(rng.choice([20, 120]))]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumn("piece", F.lit(1)).withColumn("a.b", F.lit(2))
    assert sorted(map(tuple, collocations.collocations(df, 5, 40).collect())) == phrases(rows, 5, 40)


def test_collocations_of_nothing_of_long_pieces_and_exact_products(spark, monkeypatch):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(df).count() == 0
    rows = [(" ".join(f"a{k % 7} b{k % 5}" for k in range(20_000)), "en"), ("one two " * 30, None)]
    assert sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, "text string, lang string")).collect())) == phrases(rows, 30, 2000)
    big = 9 * 10**17
    grams = spark.createDataFrame([("en", "a", 1, 2 * big), ("en", "b", 1, 3 * big + 1), ("en", "a b", 2, big)], "lang string, gram string, n_words int, f long")
    (row,) = collocations.scored(grams).collect()
    assert row.score == 2_000_000 * big // (5 * big + 1)


def test_chunks_are_counted_in_arrow(monkeypatch):
    """Pieces reach a chunk as they are written; their words are lowered, parted and numbered there, for each language by itself."""
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 12)
    rows = [("de", "A b\t b", 2), ("en", "a B", 3), ("de", "É a b", 1), ("en", "a", 5), ("de", "b  b b b b b b b b b b b b b", 1), ("en", "x \x1c", 1)]
    table = pa.table({"lang": [r[0] for r in rows], "piece": [r[1] for r in rows], "times": [r[2] for r in rows]})
    held = list(collocations.chunks(iter(table.to_batches(max_chunksize=4))))
    assert [len(x) for x in held] == [5, 1] and pa.concat_tables(held).equals(table)
    got, want = collections.Counter(), collections.Counter()
    for part in collocations.send_grams(3, None)(iter(table.to_batches(max_chunksize=4))):
        for own in pa.ipc.open_stream(part["payload"][0].as_py()):
            got.update({(r["lang"], r["gram"], r["n_words"]): r["f"] for r in own.to_pylist()})
    for lang, piece, times in rows:
        w = re.findall("[^\x20\x09]+", lower(piece))
        for n in (1, 2):
            for k in range(len(w) - n + 1):
                want[lang, " ".join(w[k : k + n]), n] += times
    assert got == want


def test_few_bits_let_too_many_pass_never_too_few(spark, monkeypatch):
    """A bit map that is too small for the pairs costs work, not results."""
    rng = random.Random(9)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(400)), "en") for _ in range(6)]
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(collocations, "PAIR_BITS", 10)
    assert sorted(map(tuple, collocations.collocations(df, 3, 500).collect())) == phrases(rows, 3, 500)


# ------------------------------------------------------------------ pipeline stages and the columns beside
def test_stages_give_every_column_back(spark, data, tmp_path):
    """Columns with a dot, and with the names that the stages use themselves, come back as they were; a repeated id too."""
    import corpus_pipeline as cp

    names = ["__fresh", "__mark", "__at", "__again", "__gone", "__kept", "kept", "text_sha256", "a.b", "a`c", "part", "id", "__id", "__uid"]
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    secret = F.concat("text", F.lit(" password = hunter2hunter2 "))
    docs = docs.unionByName(docs.limit(1)).withColumn("text", F.when(F.col("doc_id") % 3 == 0, secret).otherwise(F.col("text")))
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")))
    cols = docs.columns
    for step, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == cols, step
        out.write.parquet(f"{tmp_path}/{step}")
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{step}")
        rows = docs.collect()
        assert rows, step
        for r in rows:
            assert [r[n] for n in names] == [f"{k}-{r.doc_id}" for k in range(len(names))], step
    assert stage_count(cp, spark, docs, data) == docs.count()


def stage_count(cp, spark, docs, data):
    return cp.STAGES[-1][1](spark, docs, data).select("doc_id").distinct().count()


# ------------------------------------------------------------------ packing of short texts
def test_short_texts_lose_next_to_nothing(spark):
    """Twenty thousand empty texts take five sequences, as many of eight tokens forty; mixed lengths a few per cent more than
    their tokens. Each sequence is gapless and no longer than it may be."""
    import public_tokenizers

    from inkveil.llm.packing import bundled, pack

    rng = random.Random(4)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    empty = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    eight = empty.withColumn("text", F.lit("one two three four five six seven"))
    mixed = spark.createDataFrame([(k, " ".join(["one"] * rng.randint(0, 300))) for k in range(3000)], "doc_id long, text string").repartition(3)
    for df, least, most in ((empty, 5, 5), (eight, 40, 40), (mixed, 1, None)):
        at, total = collections.defaultdict(int), 0
        for r in pack(df, tokenizer).select("sequence_id", "offset", "length").orderBy("sequence_id", "offset").collect():
            assert r.offset == at[r.sequence_id]
            at[r.sequence_id] += r.length
            total += r.length
        assert least <= len(at) <= (most or 1.05 * total / 4096 + 1) and max(at.values()) <= 4096
    demand, rows = bundled({-8: 130, -100: 6, 32: 7}, 4096, 16)
    assert demand == {32: 7 + 2 + 1, 1: 1, 7: 1} and rows == [(-100, 5, 1, 32, 7, 7, 0), (-8, 64, 2, 32, 8, 1, 0)]
