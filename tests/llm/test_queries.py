"""The registered queries over the driver's smallest tables against brute force by their contracts."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import pytest

from sanilake.llm import queries

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{DATA}/{name}.parquet'").fetchall()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def run(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def documents():
    return dict(table("documents", "doc_id, text"))


def test_op1(spark):
    said = "</s>[INST] ok [/INST]"
    turns = {}
    for conv, turn, role, text in [*table("conversations", "conv_id, turn, role, text"), (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        turns.setdefault(conv, []).append((turn, role or "", text or ""))
    got = {r["conv_id"]: r for r in run(spark, "op1_chat_format")}
    assert set(got) == set(turns)
    for conv, r in got.items():
        own = [x[1:] for x in sorted(turns[conv])]
        learned = "".join(t for role, t in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha("".join(f"{a}\n{t}\n" for a, t in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), sha(learned)) and r["formatted_chars"] >= sum(len(t) for _, t in own)


def test_op3(spark, documents):
    sets = {}
    for d, t in documents.items():
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op3_ngram_jaccard")}
    assert got == {d: (len(s), find(d)) for d, s in sets.items()}


def test_op5(spark, documents):
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = {}
    for d, t in documents.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d] = (len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op5_bpe_transducer")} == want


def test_op6(spark, documents):
    windows = {}
    for item, text in table("benchmark", "item_id, text"):
        w = ALNUM.findall(lower(text))
        for i in range(max(len(w) - 9, 1 if w else 0)):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    got = {r["doc_id"]: r for r in run(spark, "op6_positional_index")}
    assert set(got) == set(documents)
    for d, t in documents.items():
        w, hit, items = ALNUM.findall(lower(t)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit))
        assert r["n_near_items"] >= r["n_items"]


def test_op7(spark, documents):
    out = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in documents}
    counts = Counter(w for d, t in documents.items() if not out[d] for w in [*WORD.findall(lower(t)), None])
    total, kinds = sum(counts.values()), len(counts)
    for r in run(spark, "op7_class_lm"):
        words = [*WORD.findall(lower(documents[r["doc_id"]])), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(words), sum(counts[w] > 0 for w in words), total)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] < 0


def test_op8(spark, documents):
    got = {r["doc_id"]: r for r in run(spark, "op8_fuzzy_lines")}
    assert set(got) == set(documents)
    seen = set()
    for d in sorted(documents):  # an exact copy of a line of an earlier document is never kept
        lines = (documents[d] or "").split("\n")
        plain = [" ".join(w for w in re.split(r"[\W_]+", x.lower()) if w) for x in lines]
        again = {k for k, x in enumerate(plain) if x and x in seen}
        assert again <= set(got[d]["removed"]) and got[d]["n_removed"] == len(got[d]["removed"])
        seen |= {x for x in plain if x}


def test_op9(spark, documents):
    got = {r["doc_id"]: r for r in run(spark, "op9_nearest_toxicity")}
    assert set(got) == set(documents)
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op10(spark, documents):
    for r in run(spark, "op10_compression_bands"):
        t = documents[r["doc_id"]] or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        places = {}
        for i in range(len(words) - 7):
            places.setdefault(tuple(words[i : i + 8]), []).append(i)
        hit = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 20 or 100 * len(hit) > 30 * len(words)) and not (r["base_failed"] and r["kept"])


def runs_by_force(words, least=24, exponent=3):
    """Every start and period, straight from the definition."""
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            part = words[start : start + length]
            if length >= max(least, exponent * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                found.append((start, length, q))
    return sorted(found)


def test_op11(spark, documents):
    got = {r["doc_id"]: r for r in run(spark, "op11_periodic_runs")}
    assert set(got) == set(documents)
    some = 0
    for d, t in documents.items():
        words, h = WORD.findall(t or ""), zlib.crc32(str(d).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_by_force(words)
        gone = {i for start, length, q in runs for i in range(start + q, start + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        r = got[d]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join("%d,%d,%d\n" % x for x in runs))
        assert r["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        some += len(runs)
    assert some > 10


def test_op12(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(queries.ORACLE["op12_source_divergence"]).fetchall()
    got = [tuple(r) for r in run(spark, "op12_source_divergence")]
    assert len(got) > 100 and sorted(got) == sorted(want)


def test_op13(spark, documents):
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got, want, total = run(spark, "op13_bestfit_packing"), {}, 0
    for d, t in documents.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[d, k] = (a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b])))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    inside = {}
    for r in got:
        inside.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in inside.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(inside) <= math.ceil(1.02 * math.ceil(total / 2048))
