"""Periodic runs, divergence of sources and packing against brute force, with every awkward row."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sanilake.llm import class_lm, decontamination, divergence, packing, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string"


# ---------------------------------------------------------------- 11


def by_force(words, least, exponent):
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            part = words[start : i + q]
            if i > start and len(part) >= max(least, exponent * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                found.append((start, len(part), q))
            i += 1
    return sorted(found)


def periodic_words(rng, n, kinds):
    out = []
    while len(out) < n:
        if rng.random() < 0.4:
            out += [rng.randrange(kinds) for _ in range(rng.randint(1, 30))]
        elif rng.random() < 0.3 and out:
            k = rng.randrange(len(out))
            out += out[k : k + 40]
        else:
            p = [rng.randrange(kinds) for _ in range(rng.randint(1, 14))]
            out += (p * 20)[: rng.randint(2, 90)]
    return out[:n]


@pytest.mark.parametrize("rule", [periodic_runs.RunRule(), periodic_runs.RunRule(4, 2), periodic_runs.RunRule(10, 4)])
def test_runs_of_words(rule):
    rng, some = random.Random(rule.least), 0
    for _ in range(150):
        words = periodic_words(rng, rng.randint(0, 160), rng.choice((1, 2, 3, 9, 100)))
        want = by_force(words, rule.least, rule.exponent)
        assert periodic_runs.find_runs(words, rule) == want
        values = np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        kept = periodic_runs.surviving(values, np.zeros(len(words), np.int64), rule)
        parts = [(s + a, n, q) for a, b in kept for s, n, q in periodic_runs.find_runs(words[a:b], rule)]
        assert sorted(parts) == want  # masking loses none
        some += len(want)
    assert some > 100


def test_the_least_overlap():
    assert periodic_runs.RunRule(24, 3).k == 16 and periodic_runs.RunRule(4, 2).k == 2
    assert periodic_runs.surviving(np.arange(500, dtype=np.uint64), np.zeros(500, np.int64), periodic_runs.RunRule()) == []


def run_rows():
    rng = random.Random(4)
    word = lambda k: f"w{k}é"
    texts = [None, "", " \n\t", "a", "ab " * 23, "ab " * 24, " ".join(["x y z"] * 9) + " x", " ".join(map(word, range(40)))]
    texts += [" ".join(map(word, periodic_words(rng, rng.randint(30, 400), rng.choice((2, 5, 50))))) for _ in range(25)]
    texts += [" ".join(map(word, list(range(5)) * 5 + list(range(5, 30)) + list(range(5)) * 5))]  # two runs of one exponent
    return [(k, t, "en", "s") for k, t in enumerate(texts)] + [(5, texts[5], "en", "s"), (None, texts[-1], None, None)]


def test_periodic_runs(spark):
    docs = spark.createDataFrame(run_rows(), SCHEMA).withColumns({"runs": F.lit("taken"), "text_in": F.lit(1), "N_words": F.lit(0)}).repartition(3)
    found = periodic_runs.periodic_runs(docs)
    assert found.columns.count("runs") == 1 and "text_in" in found.columns and "N_words" not in found.columns
    got = found.collect()
    assert len(got) == len(run_rows()) and Counter(r["doc_id"] for r in got)[5] == 2
    for r in got:
        words = WORD.findall(r["text"] or "")
        runs = by_force(words, 24, 3)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert (r["n_words"], [tuple(x) for x in r["runs"]]) == (len(words), runs)
        assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (tuple(r["top_run"]) if r["top_run"] else None) == best
    assert periodic_runs.periodic_runs(docs.where("false")).count() == 0


def test_a_very_long_text_of_runs(spark):
    rng = random.Random(8)
    words = [str(rng.randrange(10**6)) for _ in range(150_000)] + ["a", "b", "c"] * 30_000 + [str(rng.randrange(10**6)) for _ in range(150_000)]
    r = periodic_runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(x) for x in r["runs"]] == [(150_000, 90_000, 3)] and len(r["collapsed"].split()) == 300_003


# ---------------------------------------------------------------- 12


def audit(rows, rule):
    """The contract, in dictionaries."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= rule.least_docs}
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())
        v = len(kept)
        share = lambda c: {t: 1 + rule.scale * (c[t] + rule.smooth) // (sum(c.values()) + rule.smooth * v) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, rule.top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)}
    return out


def audit_rows():
    rng = random.Random(6)
    vocabulary = ["The", "the", "naïve", "ÀB", "日本", "x1y", "_b", "don't"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(vocabulary[: rng.choice((8, 20, 68))]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "é", "", None])) for k in range(160)]
    rows += [(900, None, "en", "empty"), (901, "", "de", "alone"), (902, "1 2 3", "de", "digits"), (903, "Word", "de", "alone")]
    return rows + rows[:7] + [(None, None, None, None)]


@pytest.mark.parametrize("rule", [divergence.Audit(least_docs=5, top=3), divergence.Audit(least_docs=1, top=50), divergence.Audit(least_docs=1000)])
def test_divergence(spark, rule, monkeypatch):
    docs = spark.createDataFrame(audit_rows(), SCHEMA).withColumns({"term": F.lit("x"), "n": F.lit(1), "rank": F.lit(1), "z": F.lit(2)}).repartition(4)
    got = {tuple(r) for r in divergence.divergence(docs, rule).collect()}
    assert got == audit(audit_rows(), rule)
    assert divergence.divergence(docs.where("false"), rule).count() == 0


def test_shards_are_cut_between_terms(spark):
    """A chunk never ends inside a term, however many rows it has."""
    rows = spark.range(900).select(F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 9).cast("string"))).alias("term"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("docs"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        kept = divergence.by_shard(rows, divergence.KEEP.format(least=1), "lang string, source string, term string, n long, lang_n long, lead boolean", pending=20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    totals = Counter("hot" if k < 700 else f"t{k % 9}" for k in range(900))
    assert len(kept) == 900 and all(r["lang_n"] == totals[r["term"]] for r in kept) and sum(r["lead"] for r in kept) == 10


def test_counts_beyond_32_bits_are_exact(spark):
    n = 10**13
    got = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(3 * n).cast("long"), divergence.Audit()), divergence.share(F.lit(5).cast("long"), F.lit(0).cast("long"), divergence.Audit())).first()
    assert tuple(got) == (1 + 10**9 * n // (3 * n), 0)


# ---------------------------------------------------------------- 13


def checked(plan, counts, capacity):
    inside, seen = {}, Counter()
    for length, first, count, sequence, each, offset in sorted(plan.runs):
        assert first == seen[length] and count > 0
        seen[length] += count
        for k in range(count):
            inside.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
    assert seen == Counter({s: n for s, n in counts.items() if n}) and len(inside) == plan.sequences
    for own in inside.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return inside


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=20))
def test_plans_hold_every_piece(counts):
    rule = packing.Packing(capacity=64, small=10, groups=8, each=2)
    inside = checked(packing.plan(counts, rule), counts, 64)
    least = max(math.ceil(sum(s * n for s, n in counts.items()) / 64), sum(n for s, n in counts.items() if s > 32))
    assert len(inside) <= 1.7 * least + 1


def test_plans_are_tight():
    rng = np.random.default_rng(2)
    for lengths, most in ((rng.lognormal(6.2, 0.9, 20_000), 1.002), (rng.integers(700, 1350, 4000), 1.12), (rng.integers(1, 300, 5000), 1.002)):
        counts = Counter(int(min(max(x, 1), 2048)) for x in lengths)
        least = math.ceil(sum(s * n for s, n in counts.items()) / 2048)
        assert len(checked(packing.plan(counts), counts, 2048)) <= most * least + 1
    assert packing.plan({}).sequences == 0 and packing.plan({2048: 5}).sequences == 5
    thirds = packing.plan({1365: 300, 683: 300})
    assert thirds.sequences == 300


def pack_rows():
    rng = random.Random(7)
    texts = [None, "", " ", "a  b\n c", "x<|endoftext|>y", "It's  we'll x 　 end.", "日本語 größe", "word " * 9000, "é" * 5000, " lead", "trail ", "a\tb c", "\n\n x  y"]
    texts += [" ".join(rng.choice(["the", "of", "number", "größe", "q%d" % rng.randrange(999), "a\nb"]) for _ in range(rng.randint(1, 600))) for _ in range(40)]
    return [(k, t, "en", "s") for k, t in enumerate(texts)] + [(3, texts[3], "en", "s"), (None, "x", None, None)]


def test_packing(spark):
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rule = packing.Packing(capacity=128, small=32, groups=12)
    docs = spark.createDataFrame(pack_rows(), SCHEMA).withColumns({"length": F.lit("taken"), "part_no": F.lit("kept"), "n_before": F.lit("kept"), "sequence_id": F.lit("taken")}).repartition(3)
    placed = packing.place(packing.pieces(docs, path, rule), rule)
    assert {"part_no", "n_before"} <= set(placed.columns) and placed.columns.count("length") == placed.columns.count("sequence_id") == 1
    by_doc, inside = {}, {}
    for r in placed.collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
        inside.setdefault(r["sequence_id"], []).append(r)
        assert r["length"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["part_no"] == "kept"
    for d, t, *_ in pack_rows():
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        if d == 3:  # a row twice is two documents
            assert [r["length"] for r in own] == [own[0]["length"]] * 2 and len({(r["sequence_id"], r["offset"]) for r in own}) == 2
            own = own[:1]
        ids = [x for r in own for x in memoryview(r["ids"]).cast("I")]
        assert ids == [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert all(r["length"] == 128 for r in own[1:]) and [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
    total = 0
    for own in inside.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        total += sum(r["length"] for r in own)
    assert len(inside) <= math.ceil(total / 128) * 1.05 + 1
    whole = {r["sequence_id"]: r for r in packing.sequences(placed).collect()}
    assert set(whole) == set(inside) and all(whole[k]["ids"] == b"".join(r["ids"] for r in own) and whole[k]["n_tokens"] * 4 == len(whole[k]["ids"]) for k, own in inside.items())
    none = packing.place(packing.pieces(docs.where("false"), path, rule), rule)
    assert none.count() == 0 and packing.sequences(none).count() == 0


def test_words_and_pieces_have_the_same_tokens():
    public = pytest.importorskip("public_tokenizers")
    own = packing.encoder(public.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(["a", "the", " ", "  ", "\n", "\t", "'s", "12", "é", " ", "　", "\x1c", "\x85", ".", "日"]) for _ in range(rng.randint(0, 40)))
        assert own.encode(t) == own.list.encode(t)


# ---------------------------------------------------------------- names that clash


def clashing(spark):
    """Columns with the names that operators use inside, and of their results."""
    docs = spark.createDataFrame(run_rows()[8:20], SCHEMA)
    names = ["terms", "places", "phrase", "_items", "item_ids", "n_hit", "Contaminated", "row_no", "rare", "_weight", "_known", "rare_weight", "rare_known", "score", "perplexity", "tf", "n", "key"]
    return docs.withColumns({c: F.lit("mine") for c in names}), names


def test_contamination_with_clashing_columns(spark):
    docs, names = clashing(spark)
    items = spark.createDataFrame([("i1", " ".join(run_rows()[9][1].split()[3:17]))], "item_id string, text string")
    plain = decontamination.near_items(decontamination.build(docs.select("doc_id", "text"), items))
    got = decontamination.near_items(decontamination.build(docs, items))
    kept = [c for c in names if c not in ("n_hit", "Contaminated")]
    assert set(kept) <= set(got.columns) and len({c.lower() for c in got.columns}) == len(got.columns)
    assert all(r[c] == "mine" for r in got.collect() for c in kept)
    same = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items"]
    assert sorted(map(tuple, got.select(*same).collect())) == sorted(map(tuple, plain.select(*same).collect())) and plain.where("contaminated").count() >= 1


def test_scores_with_clashing_columns(spark):
    docs, names = clashing(spark)
    model = class_lm.fit(docs.select("doc_id", "text"))
    got = class_lm.score(docs, model)
    kept = [c for c in names if c not in ("score", "perplexity")]
    assert set(kept) <= set(got.columns) and len({c.lower() for c in got.columns}) == len(got.columns)
    assert all(r[c] == "mine" for r in got.collect() for c in kept)
    same = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    assert sorted(map(tuple, got.select(*same).collect())) == sorted(map(tuple, class_lm.score(docs.select("doc_id", "text"), model).select(*same).collect()))
