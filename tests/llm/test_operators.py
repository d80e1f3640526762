"""The numbered operators against brute force, on small fixtures with every awkward row."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sanilake.llm import bpe, chat, class_lm, components, decontamination, line_dedup, ngram_join, quality, token_counts, toxicity, warc
from sanilake.llm import texts as texts_module
from sanilake.llm.texts import likely_among

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokenizer(name="byte_bpe_50k.json"):
    public = pytest.importorskip("public_tokenizers")
    return public.path(name)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus():
    rng = random.Random(5)
    words = ["the", "of", "And", "größe", "naïve", "x1", "end.", "12", "日本", "a b"] + ["w%d" % k for k in range(150)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).replace(" end. ", " end.\n")
    texts = [None, "", " \n\t ", "one", "One two", "one two three", prose(5000)]
    base = [prose(n) for n in (30, 60, 90, 150, 400)]
    texts += base * 3
    for t in base:
        for edits in (1, 2, 4, 9):
            parts = t.split(" ")
            for _ in range(edits):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            texts.append(" ".join(parts))
    texts += [("repeat this line again and again\n" * 12), "".join(rng.choice("0123456789abcdef") for _ in range(600))]
    rows = [(k, t, "en", "src") for k, t in enumerate(texts)]
    return rows + [rows[7], (None, base[0], "en", "src"), (None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- 1


def test_chat_round_trip(spark):
    template = chat.Template()
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "s", ">", "/", "[", "INST", "]", "\\", "SYS", "\n", " ", "ROLE"]) for _ in range(rng.randint(0, 10)))
        assert not any(c in template.escape(text) for c in template.controls)
        for role in ("user", "assistant", "system", "tool", "", "[ROLE]<"):
            assert template.read("".join(s for s, _ in template.segments(role, text))) == (role, text)


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", said, 1), (1, 1, "assistant", said, 1), (2, 5, "assistant", None, 1), (2, 4, None, "x", 1), (3, 0, "system", "s", 1), (3, 1, "user", "", 1), (3, 2, "assistant", "é", 1), (3, 2, "assistant", "é", 1), (None, None, "user", "n", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(turns)).collect()}
    assert len(got) == 4
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        learned = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(own), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[1]["valid"] and not got[2]["valid"] and got[3]["fault"] == "assistant after assistant" and not got[None]["valid"]
    assert chat.read_back(chat.format_chat(turns.limit(0))).count() == 0


# ---------------------------------------------------------------- 2


def pages(spark):
    big, big2 = "é" * 600, "b" * 1000
    rows = [(1, "http://a/ b", big), (2, "u", big), (3, None, big2), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", big), (9, "u", "b" * 999), (10, "u", "b" * 999), (8, "u", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_warc(spark):
    df, rows = pages(spark)
    manifest = warc.write_warc(warc.plan_records(df.repartition(2)))
    got = sorted((tuple(r) for r in warc.summaries(warc.read_warc(manifest)).collect()), key=repr)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        last = max(p for p, _, h in rows if (h or "") == (html or ""))
        again = len(raw) >= 1000 and page != last
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last if again else None))
    assert got == sorted(want, key=repr)
    assert warc.summaries(warc.read_warc(warc.write_warc(warc.plan_records(df.limit(0))))).count() == 0


def test_warc_reader_checks(tmp_path):
    members = [zlib.compressobj(6, zlib.DEFLATED, 31) for _ in range(2)]
    raw = b"".join(m.compress(warc.record("response", str(k), "u", b"p" * 5000, None)) + m.flush() for k, m in enumerate(members))
    read = lambda data, step: [warc.read_record(p) for p in warc.members(iter([data[i : i + step] for i in range(0, len(data), step)]))]
    for step in (1, 7, 1000):
        assert [len(b) for _, b in read(raw, step)] == [5000 + 73] * 2 or len(read(raw, step)) == 2
    with pytest.raises(warc.WarcError):
        read(raw[:-5], 100)
    bad = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(warc.WarcError):
        read(bad.compress(warc.record("response", "1", "u", b"p" * 50, None).replace(b"pppp", b"qqqq")) + bad.flush(), 100)


# ---------------------------------------------------------------- 3


def roots_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("rule", [ngram_join.Rule(3, 90, 100), ngram_join.Rule(5, 80, 100)])
def test_ngram_join(spark, docs, none, rule):
    sets = {}
    for d, t, *_ in corpus():
        w = WORD.findall(lower(t))
        sets[d] = frozenset(tuple(w[i : i + rule.k]) for i in range(max(1, len(w) - rule.k + 1))) if w else frozenset()
    ids = sorted(d for d in sets if d is not None)
    link = lambda a, b: bool(a and b) and rule.den * len(a & b) >= rule.num * len(a | b)
    roots = roots_of([(a, b) for a in ids for b in ids if a < b and link(sets[a], sets[b])], ids)
    got = ngram_join.groups(docs, rule).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), roots[r["doc_id"]])
    assert ngram_join.groups(none, rule).count() == 0


def test_dealing_leaves_enough_blocks():
    for rule in (ngram_join.Rule(3, 90, 100), ngram_join.Rule(5, 80, 100)):
        for top in ngram_join.class_tops(5000):
            d, blocks = ngram_join.dealing(top, rule)
            assert (not d and not blocks) or blocks > d


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).collect()}
    pairs = [p for p in pairs if p[0] != p[1]]
    assert got == roots_of(pairs, {n for p in pairs for n in p})
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 4, 5


def test_viterbi_against_library():
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(1)
    for _ in range(400):
        vocabulary = list({"".join(rng.choice("▁abc") for _ in range(rng.randint(1, 3))): -float(rng.randint(1, 4)) for _ in range(rng.randint(1, 8))}.items())
        library = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", min(s for _, s in vocabulary)), *vocabulary], unk_id=0))
        library.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
        assert token_counts.CountViterbi(vocabulary).text(text.encode())[0] == len(library.encode(text).ids)


def test_token_counts(docs, none):
    path = tokenizer("piece_bpe_32k.model")
    model = token_counts.CountViterbi(token_counts.piece_scores(path))
    got = token_counts.token_counts(docs, path).collect()
    assert len(got) == len(corpus())
    assert all((r["n_tokens"], r["best_score"]) == model.text((r["text"] or "").encode()) for r in got)
    assert token_counts.token_counts(none, path).count() == 0


def test_bpe_against_library(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer()
    library = tokenizers.Tokenizer.from_file(path)
    own = bpe.load(path)
    rng = random.Random(3)
    texts = [t or "" for _, t, *_ in corpus()] + ["a<|endoftext|>b", "it's  we'll\n\n x", "　a\x85b\x1c c", "'" * 50]
    texts += ["".join(rng.choice(rng.choice(["ab", "-=", "the in er", "éèñ日", "  \n\t", "'sre"])) for _ in range(300)) for _ in range(60)]
    for t in texts:
        ids = own.encode(t)
        want = library.encode(t, add_special_tokens=False).ids
        assert list(memoryview(ids).cast("I")) == want and own.decode(ids) == t == library.decode(want, skip_special_tokens=False)
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))
    assert list(memoryview(own.encode(long)).cast("I")) == library.encode(long).ids
    assert list(own.transduce([long.encode()[i : i + 13] for i in range(0, 20_000, 13)])) == library.encode(long).ids
    got = {(r["doc_id"], r["decoded_sha256"]) for r in bpe.digests(docs, path).collect()}
    assert got == {(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in corpus()}
    assert bpe.digests(none, path).count() == 0


def test_decoder_on_broken_bytes():
    own = bpe.load(tokenizer())
    ids = b"".join(int(own.byte_id[b]).to_bytes(4, "little") for b in b"a\xe6\x97z\xff")
    assert own.decode(ids) == "a�z�"


# ---------------------------------------------------------------- 6


def test_decontamination(spark, docs, none):
    rows = corpus()
    words = ALNUM.findall(lower(rows[11][1]))
    items = [(1, " ".join(words[20:45])), (10, "x1 " + " ".join(words[50:62])), (2, "Größe, of"), (3, ""), (4, None), (5, "日本"), (1, " ".join(words[20:45])), (None, "the")]
    table = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        k = min(10, len(w))
        if i is not None and k:
            for j in range(len(w) - k + 1):
                windows.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    index = decontamination.build(docs, table)
    got = sorted((tuple(r) for r in decontamination.contamination(index).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)
    want = []
    for d, t, *_ in rows:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if who := windows.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    found |= who
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want, key=repr) and sum(x[5] for x in want) > 5
    assert decontamination.proximity(index, 2).count() > 0
    assert decontamination.contamination(decontamination.build(none, table)).count() == 0
    assert decontamination.contamination(decontamination.build(docs, table.limit(0))).where("contaminated").count() == 0


def test_proximity(spark):
    rng = random.Random(6)
    common = ["w%d" % k for k in range(30)]
    items = [(k, " ".join(rng.choice(common) for _ in range(n))) for k, n in enumerate((10, 14, 4, 12, 1))]
    texts = []
    for _, t in items:
        for every in (2, 3, 5, 30):
            w = t.split()
            texts.append(" ".join(x + (" foreign" if k % every == every - 1 else "") for k, x in enumerate(w)))
        texts.append(" ".join(rng.sample(t.split(), len(t.split()))))
    texts += [" ".join(rng.choice(common) for _ in range(40)) for _ in range(5)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = decontamination.build(docs, spark.createDataFrame(items, "item_id long, text string"), slop=5)
    names = {r["row_no"]: r["doc_id"] for r in index.docs.collect()}
    for slop in (0, 2, 5):
        want = set()
        for d, t in enumerate(texts):
            w = (t or "").split()
            for i, item in items:
                terms = item.split()
                size = min(10, len(terms))
                for first in range(len(terms) - size + 1):
                    asked = set(terms[first : first + size])
                    if any(asked <= set(w[j : j + size + slop]) for j in range(len(w))):
                        want.add((d, str(i), first))
        got = {(names[r["row_no"]], r["item_id"], r["ipos"]) for r in decontamination.proximity(index, slop).collect()}
        assert got == want and len(want) > 5
    near = {r["doc_id"]: (r["n_items"], r["n_near_items"]) for r in decontamination.near_items(index).collect()}
    assert len(near) == len(texts) and near[2][0] < near[2][1]


def test_proximity_keeps_postings_near_leading_terms_only(spark):
    """Test terms alone, however many, don't make postings: those of a window that few items have must stand together."""
    common = ["w%d" % k for k in range(12)]
    items = [(k, " ".join([*common[:5], f"rare{k}", *common[5:9], f"odd{k}"])) for k in range(3)]
    texts = [" ".join(common * 20), " ".join([*common, "rare1", *common]), " ".join([*common[:5], "rare2", "foreign", *common[5:9], "odd2"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = decontamination.build(docs, spark.createDataFrame(items, "item_id long, text string"))
    names = {r["row_no"]: r["doc_id"] for r in index.docs.collect()}
    assert 0 not in {names[r["row_no"]] for r in index.near.select("row_no").distinct().collect()}
    near = {r["doc_id"]: r["n_near_items"] for r in decontamination.near_items(index).collect()}
    assert near == {0: 0, 1: 1, 2: 1}


# ---------------------------------------------------------------- 7


def test_class_lm(spark, docs, none):
    import math
    from collections import Counter

    train = docs.where("doc_id % 10 <> 3")
    model = class_lm.fit(train)
    counts = Counter()
    for d, t, *_ in corpus():
        if d is not None and d % 10 != 3:
            counts.update([*WORD.findall(lower(t)), None])
    assert (model.train_tokens, model.vocabulary) == (sum(counts.values()), len(counts))
    assert model.likelihood[-1] > model.likelihood[0]
    total, kinds = sum(counts.values()), len(counts)
    got = class_lm.score(docs, model).collect()
    assert len(got) == len(corpus())
    by_id = {d: t for d, t, *_ in corpus() if d is not None}
    for r in got:
        if r["doc_id"] is not None:
            tokens = [*WORD.findall(lower(by_id[r["doc_id"]])), None]
            base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens)
            assert r["n_tokens"] == len(tokens) and r["n_known"] == sum(counts[w] > 0 for w in tokens)
            assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] < 0
    assert class_lm.score(none, model).count() == 0
    # without training tokens V is 0: the one type there is, the unknown, has probability 1
    assert class_lm.score(docs, class_lm.fit(none)).where("abs(score) < 1e-9 and abs(base_score) < 1e-9").count() == len(corpus())


def test_class_lm_assigns_in_bounded_memory(spark):
    """A batch of words with many neighbours, weighed at once, took more than an executor's memory."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    size = class_lm.CLASSES + 1
    pairs = rng.integers(0, 1000, (size, size)).astype(float)

    class Neighbours:  # what the function inside a task is given
        def groupBy(self, *_):
            return self

        agg = select = groupBy

        def mapInPandas(self, choose, schema):
            return choose

    words = pd.DataFrame({"w": np.arange(4000), "slots": [rng.choice(2 * size, n, replace=False) for n in rng.integers(1, 120, 4000)]})
    words["ns"] = [rng.integers(1, 50, len(x)) for x in words["slots"]]
    choose = class_lm.assign(Neighbours(), pairs)
    tracemalloc.start()
    got = pd.concat(choose([words]))
    taken = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert taken < 100e6 and got["w"].tolist() == list(range(4000))
    alone = [class_lm.assigned(s, n.astype(float), np.array([0]), pairs)[0] for s, n in zip(words["slots"], words["ns"])]
    assert got["class"].tolist() == alone


def test_class_lm_sums_to_one(docs):
    import numpy as np

    model = class_lm.fit(docs.where("doc_id is not null"))
    m = model.parts()
    classes = class_lm.class_ids(model.hot, m["hot"], m["hot_classes"], m["bin_classes"])
    emission = (model.hot_counts + class_lm.ADD) / 10 ** m["room"][classes]
    unseen = np.unique(m["bin_classes"])
    for before in range(0, class_lm.CLASSES, 9):
        moves = 10 ** m["moves"][before]
        assert (emission * moves[classes]).sum() + (class_lm.ADD / 10 ** m["room"][unseen] * moves[unseen]).sum() == pytest.approx(1, abs=1e-6)


def test_class_lm_score_by_hand(spark, monkeypatch):
    """Scores from the model's own classes, counted anew; most words are beyond the hot ones."""
    import math
    from collections import Counter

    import numpy as np

    from sanilake.llm import textvec

    monkeypatch.setattr(class_lm, "HOT", 40)
    monkeypatch.setattr(class_lm, "CORE", 20)
    rng = random.Random(8)
    words = ["w%d%s" % (k, rng.choice(["ing", "ed", "s"])) for k in range(120)]
    texts = [" ".join(words[min(int(rng.expovariate(0.05)), 119)] for _ in range(rng.randint(0, 60))) for _ in range(80)]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = class_lm.fit(train)
    assert len(model.hot) <= 40 and model.vocabulary > 80
    m = model.parts()

    def classes_of(text):
        import pyarrow as pa

        (piece,) = textvec.slices(pa.array([text]))
        return class_lm.class_ids(class_lm.tokens(piece)[0], m["hot"], m["hot_classes"], m["bin_classes"]).tolist()

    counts = Counter(w for t in texts for w in [*t.split(), None])
    of = {w: c for t in texts for w, c in zip([*t.split(), None], classes_of(t), strict=True)}
    pairs, types = np.zeros((class_lm.CLASSES, class_lm.CLASSES)), Counter(of.values())
    for t in texts:
        named = [of[None], *classes_of(t)]
        for a, b in zip(named, named[1:], strict=False):
            pairs[a, b] += 1
    mass = pairs.sum(0)
    room = np.array([mass[c] + class_lm.ADD * (types[c] + (c in m["bin_classes"])) for c in range(class_lm.CLASSES)])
    share = room / room.sum()
    asked = [*texts[:20], "never seeing words", "", None]
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in class_lm.score(rows, model).collect()}
    for k, text in enumerate(asked):
        named, total = [of[None], *classes_of(text or "")], 0.0
        for a, b, w in zip(named, named[1:], [*(text or "").split(), None], strict=False):
            total += math.log10((pairs[a, b] + class_lm.PULL * share[b]) / (pairs[a].sum() + class_lm.PULL)) + math.log10((counts[w] + class_lm.ADD) / room[b])
        assert got[k] == pytest.approx(total, abs=1e-6)


# ---------------------------------------------------------------- 8


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup(spark, docs, none):
    split = re.compile(r"[^\w]+|_")
    norm = lambda line: tuple(w for w in split.split(line.lower()) if w)
    lines = {}
    for d, t, *_ in corpus():
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(norm(line)) >= 1:
                lines.setdefault(d, {})[k] = norm(line)
    kinds = sorted({w for own in lines.values() for w in own.values()})
    similar = [(a, b) for a in kinds for b in kinds if a < b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9]
    true = roots_of(similar, kinds)
    got = line_dedup.groups(docs).collect()
    seen = {}
    for r in got:
        seen.setdefault(r["root"], set()).add(lines[r["doc"]][r["line_no"]])
    assert len({w for g in seen.values() for w in g}) == len(kinds)
    assert all(len({true[w] for w in g}) == 1 for g in seen.values())  # nothing is linked that should not be
    of = {w: root for root, g in seen.items() for w in g}
    rows = line_dedup.lines_of(docs, "doc_id", "text").join(line_dedup.features_of(line_dedup.lines_of(docs, "doc_id", "text")), "node")
    hashes = {lines[r["doc"]][r["line_no"]]: r["simhash"] for r in rows.where("simhash is not null").collect()}
    apart = lambda a, b: ((hashes[a] ^ hashes[b]) % 2**64).bit_count()
    must = [(a, b) for a, b in similar if a in hashes and b in hashes and apart(a, b) <= line_dedup.APART]
    assert len(must) > 2 and all(of[a] == of[b] for a, b in must)
    assert sum(of[a] == of[b] for a, b in similar) >= 0.9 * len(similar)
    firsts = {}
    for r in got:
        firsts.setdefault(r["root"], set()).update({(r["doc"], r["line_no"])} if r["first"] else ())
    assert all(len(f) == 1 for f in firsts.values())
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(corpus())
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.report(none).count() == 0
    plan = line_dedup.report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def grouped(spark, texts):
    """The group of each text, a line of its own."""
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc"]: r["root"] for r in line_dedup.groups(rows).collect()}


def test_line_dedup_recall(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(3, 8)))
    vocabulary = [word() for _ in range(3000)]
    texts, kinds = [], []
    for size, changed in ((10, 1), (20, 1), (20, 4), (60, 3), (60, 12)):
        for _ in range(20):
            line = [rng.choice(vocabulary) for _ in range(size)]
            other = list(line)
            for k in rng.sample(range(size), changed):
                other[k] = "".join(rng.sample(line[k], len(line[k])))  # of the same length
            texts += [" ".join(line), " ".join(other)]
            kinds.append((size, changed))
    root = grouped(spark, texts)
    found = {}
    for n, kind in enumerate(kinds):
        a, b = texts[2 * n], texts[2 * n + 1]
        assert edits(a, b) <= 0.2 * len(a)
        found.setdefault(kind, []).append(root[2 * n] == root[2 * n + 1])
    assert min(sum(x) / len(x) for x in found.values()) >= 0.8 and sum(sum(x) for x in found.values()) >= 0.9 * len(kinds), {k: sum(x) for k, x in found.items()}


def test_line_dedup_corpus_recall(docs):
    split = re.compile(r"[^\w]+|_")
    norm = lambda line: " ".join(w for w in split.split(line.lower()) if w)
    text = {d: t.split("\n") for d, t, *_ in corpus() if t is not None}
    of = {norm(text[r["doc"]][r["line_no"]]): r["root"] for r in line_dedup.groups(docs).collect()}
    kinds = sorted(x for x in of if len(x.split()) >= line_dedup.FUZZY_WORDS and len(x) < 400)
    near = [(a, b) for a in kinds for b in kinds if a < b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and edits(a, b) <= 0.2 * max(len(a), len(b))]
    assert len(near) > 10 and sum(of[a] == of[b] for a, b in near) >= 0.9 * len(near)


def test_line_dedup_crowded_keys(spark):
    """Nodes under a key that are neither its first nor neighbours by SimHash; all share one key here."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(3, 8)))
    texts = []
    for _ in range(60):
        line = [word() for _ in range(rng.choice((12, 14)))]
        other = list(line)
        other[5] = "".join(rng.sample(other[5], len(other[5])))
        texts += [" ".join(line), " ".join(other), " ".join(line[:5] + line[6:])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = line_dedup.lines_of(rows, "doc_id", "text")
    nodes = {r["node"]: r["line"] for r in of.collect()}
    keyed = line_dedup.features_of(of.select("node", "line")).selectExpr("1L as key", "node", "size", "simhash")
    seen = line_dedup.first_look(keyed, 0.8)
    first = {(nodes[r["a"]], nodes[r["b"]]) for r in line_dedup.met_at_first(seen).collect()}
    crowds = line_dedup.divided(seen, line_dedup.met_at_first(seen).selectExpr("a as node", "a as root").where("false"))
    rest = [(nodes[r["a"]], nodes[r["b"]]) for r in line_dedup.met_in_crowds(crowds, line_dedup.marks_of(of), 0.8).collect()]
    size = {r["node"]: r["simhash"] for r in keyed.collect()}
    hashes = {nodes[k]: v for k, v in size.items()}
    near = lambda a, b: ((hashes[a] ^ hashes[b]) % 2**64).bit_count() <= line_dedup.NEAR
    similar = {frozenset((a, b)) for a in hashes for b in hashes if a < b and near(a, b) and edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9}
    assert len(similar) > 100 and not similar <= {frozenset(x) for x in first}
    assert similar <= {frozenset(x) for x in rest} and len(set(map(frozenset, rest))) == len(rest)
    assert len(rest) < 2 * len(similar)  # words in common rule out most others


def test_line_dedup_links_all_that_meet(spark, monkeypatch):
    """Groups are those of every pair under a common key, however many others stand there."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(3, 8)))
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    texts = []
    for _ in range(150):
        line = [word() for _ in range(14)]
        other = list(line)
        for k in rng.sample(range(14), 2):
            other[k] = "".join(rng.sample(other[k], len(other[k])))
        texts += [" ".join(line), " ".join(other)]
    features = line_dedup.features_of
    monkeypatch.setattr(line_dedup, "features_of", lambda lines: features(lines).selectExpr("node", "size", "simhash", "array(7L) as keys"))
    root = grouped(spark, texts)
    hashes = [r["simhash"] for r in features(line_dedup.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").withColumn("node", F.col("doc"))).orderBy("node").collect()]
    close = [(n, n + 1) for n in range(0, 300, 2) if ((hashes[n] ^ hashes[n + 1]) % 2**64).bit_count() <= line_dedup.NEAR and edits(texts[n], texts[n + 1]) <= 0.2 * max(len(texts[n]), len(texts[n + 1]))]
    assert len(close) > 120 and all(root[a] == root[b] for a, b in close)


def test_line_dedup_crowds_of_all_sizes(spark, monkeypatch):
    """Keys with more nodes than a block and with fewer: a key of up to a block isn't dealt into bands."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(3, 8)))
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    monkeypatch.setattr(line_dedup, "NEAR", 64)
    texts = []
    for _ in range(40):
        line = [word() for _ in range(rng.choice((6, 9, 12, 15)))]
        other = list(line)
        other[3] = "".join(rng.sample(other[3], len(other[3])))
        texts += [" ".join(line), " ".join(other), " ".join([*line, word()])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = line_dedup.lines_of(rows, "doc_id", "text")
    nodes = {r["node"]: r["line"] for r in of.collect()}
    key = "if(doc < 90, 1L, if(doc < 105, 2L, 3L)) as key"  # 90 nodes, 15 nodes, 15 nodes
    keyed = line_dedup.features_of(of.select("node", "line")).join(of.selectExpr("node", key), "node").select("key", "node", "size", "simhash")
    crowds = line_dedup.divided(line_dedup.first_look(keyed, 0.8), spark.createDataFrame([], "node long, root long"))
    assert {r["key"]: r["n"] for r in crowds.collect()} == {1: 90, 2: 15, 3: 15}
    met = line_dedup.met_in_crowds(crowds, line_dedup.marks_of(of), 0.8)
    rest = [frozenset((nodes[r["a"]], nodes[r["b"]])) for r in met.collect()]
    keys = {nodes[r["node"]]: r["key"] for r in keyed.collect()}
    similar = {frozenset((a, b)) for a in keys for b in keys if a < b and keys[a] == keys[b] and edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9}
    assert len(similar) > 60 and similar <= set(rest) and len(set(rest)) == len(rest)


def test_line_dedup_stores_no_row_for_each_pair(spark, monkeypatch):
    """150 lines say one passage of half of their words under every key: they are compared, but only links are written."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(3, 8)))
    passage = [word() for _ in range(40)]
    texts = [" ".join(passage + [word() for _ in range(30)]) for _ in range(150)]
    texts += [" ".join([*texts[k].split()[:60], *(word() for _ in range(10))]) for k in range(0, 150, 10)]
    features, stored, made = line_dedup.features_of, line_dedup.stored, []
    monkeypatch.setattr(line_dedup, "features_of", lambda lines: features(lines).selectExpr("node", "size", "simhash", "array(7L, 8L) as keys"))
    monkeypatch.setattr(line_dedup, "NEAR", 64)
    monkeypatch.setattr(line_dedup, "BLOCK", 32)
    monkeypatch.setattr(line_dedup, "stored", lambda df, name, **k: (made.append((name, (t := stored(df, name, **k)).count())), t)[1])
    root = grouped(spark, texts)
    n = len(texts)
    norm = [" ".join(t.split()) for t in texts]
    near = [(a, 150 + a // 10) for a in range(0, 150, 10) if edits(norm[a], norm[150 + a // 10]) <= 0.2 * max(len(norm[a]), len(norm[150 + a // 10]))]
    assert len(near) > 10 and all(root[a] == root[b] for a, b in near) and len(set(root.values())) > 100
    assert made and all(rows <= 4 * n for _, rows in made), made


def test_line_dedup_letters_are_a_bound(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdé 1") for _ in range(rng.randint(8, 14))) for _ in range(60)]
    texts += [t[:3] + "x" + t[4:] for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, line string").select("n", F.length("line").alias("size"), *line_dedup.letters_of("line"))
    allowed = {tuple(r) for r in rows.alias("x").crossJoin(rows.alias("y")).where(line_dedup.letters_allow("x.", "y.", 0.6)).select("x.n", "y.n").collect()}
    near = {(a, b) for a in range(120) for b in range(120) if edits(texts[a], texts[b]) <= 0.4 * max(len(texts[a]), len(texts[b])) + 1e-9}
    assert len(near) > 240 and near <= allowed and len(allowed) < 120 * 120


def test_stored_leaves_no_shuffle_files(spark):
    import time
    from pathlib import Path

    def files():
        return {f.name for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for f in Path(d).rglob("shuffle_*.data")}

    before = files()
    table = texts_module.stored(spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "counts")
    for _ in range(100):  # executors delete them on their own time
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and table.count() == 7  # counting shuffles too
    assert spark.conf.get(texts_module.SHUFFLES_GO, None) != "true"


def test_stored_in_turn(spark):
    """Slices by a hash have all rows once, and one slice's shuffle files are gone before the next slice is written."""
    rows = spark.range(1000).selectExpr("if(id = 7, null, xxhash64(id % 100)) as h", "id")
    parts = texts_module.dealt(rows, "h", 4)
    assert len(parts) == 4 and sorted(r["id"] for p in parts for r in p.collect()) == list(range(1000))
    assert all(p.count() for p in parts)
    got = texts_module.stored_in_turn([p.groupBy("h").count() for p in parts], "parts")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in rows.groupBy("h").count().collect()} and got.count() == 101


def test_line_dedup_short_words_make_no_crowd(spark):
    """Lines that share a run of short words only don't meet under it; copies with another word do, and lines of short words only."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(6, 8)))
    short = "it is of the in to an as at by on so or".split()
    texts = []
    for _ in range(100):
        line = [word() for _ in range(20)]
        line[7:7] = short
        texts += [" ".join(line), " ".join([*line[:25], word(), *line[26:]])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = line_dedup.features_of(line_dedup.lines_of(rows, "doc_id", "text").select("node", "line")).select(F.explode("keys").alias("key"))
    assert keyed.groupBy("key").count().agg(F.max("count")).first()[0] <= 10
    plain = ["we go to it as he is at an ox or so do i", "we go to it as he is at an ox or so do u", "it is up to us if we do go on by no one"]
    root = grouped(spark, [*texts, *plain])
    assert sum(root[n] == root[n + 1] for n in range(0, 200, 2)) >= 95 and root[200] == root[201] != root[202] and len(set(root.values())) >= 102


def test_line_dedup_shuffles_slices(spark, monkeypatch):
    """Features and keys are written slice by slice, and in as many slices lines are grouped alike."""
    made = []
    in_turn = line_dedup.stored_in_turn
    monkeypatch.setattr(line_dedup, "stored_in_turn", lambda parts, name, *a: (made.append((name, len(parts))), in_turn(parts, name, *a))[1])
    lines = ["the first of many lines in a text", "the first of many lines in a texts", "some other line that nothing here is like", "the first of many lines in a text"]
    root = grouped(spark, lines)
    assert root[0] == root[1] == root[3] != root[2] and made == [("features", line_dedup.SLICES), ("seen", line_dedup.SLICES)]


def test_likely_among(spark):
    """All rows that are looked for, few others, and no shuffle of the rows."""
    rows = spark.range(0, 2000).selectExpr("xxhash64(id) as k", "id")
    chosen = rows.where("id % 10 = 0").select("k")
    found = likely_among(rows, "k", chosen)
    ids = {r["id"] for r in found.collect()}
    assert found.columns == ["k", "id"] and ids >= set(range(0, 2000, 10)) and len(ids) < 220
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_line_dedup_copies_and_letters(spark):
    long = "the quick river carried seven yellow barrels toward another harbour"
    typos = long.replace("quick", "quikc").replace("yellow", "yelow").replace("barrels", "barrals")
    chinese = "春天来了花园里的花都开了孩子们在树下唱歌跳舞非常快乐"
    texts = ["Read more", "read  MORE!", chinese, chinese, chinese.replace("花园", "公园"), long, typos, "Chapter one", "Chapter two", "---", "---"]
    root = grouped(spark, texts)
    assert root[0] == root[1] and root[2] == root[3] == root[4] and root[5] == root[6] and root[7] != root[8]
    assert set(root) == set(range(9))  # lines without a word are not compared


# ---------------------------------------------------------------- 9


def test_nearest_is_exact():
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.where(rng.random((300, 20)) < 0.2, rng.random((300, 20)), 0)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    index = toxicity.Index.build(x, np.arange(300), rng.random(300), np.ones(300))
    sims, found = index.nearest(x, 7, without=np.arange(300))
    full = np.round(x @ x.T, 9)
    np.fill_diagonal(full, -1)
    for k in range(300):
        order = sorted((j for j in range(300) if full[k, j] > 0), key=lambda j: (-full[k, j], j))[:7]
        assert list(found[k][found[k] >= 0]) == order and np.allclose(sims[k][: len(order)], full[k][order])


def test_toxicity(spark, none):
    rng = random.Random(8)
    words = ["w%d" % k for k in range(400)]
    rows = []
    for k in range(400):
        toxic = k % 5 == 0
        text = [rng.choice(words) for _ in range(60)]
        if toxic:
            text[rng.randrange(60)] = rng.choice(["scum", "scummy", "idiot!"])
        rows.append((k, " ".join(text), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs = table.select("doc_id", "text").union(spark.createDataFrame([(None, None), (900, ""), (1, rows[1][1])], "doc_id long, text string"))
    labels = table.where("doc_id % 4 <> 2").select("doc_id", "toxic").union(spark.createDataFrame([(0, None)], "doc_id long, toxic int"))
    model = toxicity.fit(docs.where("doc_id % 4 <> 2"), labels, docs)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[k]["score"], y) for k, _, y in rows if k % 4 == 2]
    assert sum((s >= 0.3) == bool(y) for s, y in held) >= 0.95 * len(held)
    assert 0 <= got[None]["score"] <= 1 and got[900]["score"] == got[None]["score"]
    assert all(e in dict((r[0], r) for r in rows) for r in got.values() for e in r["evidence"])
    nothing = toxicity.fit(none.select("doc_id", "text"), labels.limit(0), docs)
    assert toxicity.score(docs, nothing).where("score <> 0").count() == 0


# ---------------------------------------------------------------- 10


def test_quality(spark, docs, none):
    from collections import Counter

    def brute(t):
        w, lines, seen, dup, hit = WORD.findall(t), t.split("\n"), set(), 0, set()
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        for i in range(len(w) - 7):
            if c[tuple(w[i : i + 8])] > 1:
                hit.update(range(i, i + 8))
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)

    got = quality.quality_rules(docs.withColumn("n_words", F.lit("clash"))).collect()
    assert len(got) == len(corpus())
    for r in got:
        n, *rest = brute(r["text"] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 20 or 100 * rest[3] > 30 * n) and not (r["base_failed"] and r["kept"])
        assert (r["ratio"], r["bad_chunks"], r["kept"]) == (pytest.approx(verdict(r["text"] or "")[0]), *verdict(r["text"] or "")[1:])
    assert quality.quality_rules(none).count() == 0


def verdict(text, bands=quality.Bands()):
    """Ratio, bad chunks and whether a text is kept, by the documented rule."""
    import zstandard

    raw, words = text.encode(), WORD.findall(text)
    if not raw:
        return None, 0, False
    squeeze = lambda x: len(zstandard.ZstdCompressor(level=bands.level).compress(x)) / len(x)
    band = lambda n: max((x for x in bands.limits if x[0] <= n))[1:]
    chunks = [raw[k : k + 4096] for k in range(0, len(raw), 4096)]
    bad = [c for c in chunks if not band(len(c))[0] - 0.05 - 1e-12 <= squeeze(c) <= band(len(c))[1] + 0.05 + 1e-12]
    hit = set()
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        hit.update(i + k for i in at if len(at) > 1 for k in range(8))
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    low, high = band(len(raw))
    return squeeze(raw), len(bad), not failed and low <= squeeze(raw) <= high and sum(map(len, bad)) <= 0.34 * len(raw)


def test_chunks_over_every_byte(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlucmf") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))[: n * 4]
    encoded = lambda n: " ".join("".join(chr(rng.randrange(33, 0x2000)) for _ in range(30)) for _ in range(n // 80))
    texts = [prose(1000), prose(1100), prose(3000), prose(800) + " " + encoded(3000), prose(1500) + " " + encoded(7000), "a b c " * 6, "x", prose(25), prose(1024)[:4096] + "!"]
    got = [r for r in quality.quality_rules(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    for r in got:
        assert (r["bad_chunks"], r["kept"]) == verdict(r["text"])[1:]
    of = {r["text"]: r for r in got}
    assert of[texts[2]]["kept"] and of[texts[3]]["bad_chunks"] > 0 and not of[texts[4]]["kept"]


def test_bands():
    import zstandard

    z, bands = zstandard.ZstdCompressor(level=3), quality.Bands()
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshrdlucmf") for _ in range(rng.randint(2, 8))) for _ in range(400)).encode()
    assert quality.judge(memoryview(b"the same again " * 100), z, bands)[2] == "repetitive"
    assert quality.judge(memoryview(bytes(rng.randrange(256) for _ in range(5000))), z, bands)[2] == "incompressible"
    assert quality.judge(memoryview(prose), z, bands)[2] == "ok"
    assert quality.judge(memoryview(b""), z, bands) == (None, 0, "ok")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(d, t, lang, source, len(t or "")) for d, t, lang, source in corpus() if d is not None]
    spark.createDataFrame(rows, SCHEMA + ", n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    item = " ".join(ALNUM.findall(lower(corpus()[10][1]))[5:25])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == corpus_pipeline.DOCUMENTS
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0] < len(rows)
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not any(item in " ".join(ALNUM.findall(lower(t))) for t in left.values())
    final = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(final) == set(left)
    assert all(final[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for d, t in left.items())


def test_pipeline_missing_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(2, 8)))
    prose = lambda: " ".join(word() for _ in range(60))
    a, b, c, d, item = prose(), prose(), prose(), prose(), " ".join(word() for _ in range(12))
    rows = [(None, a), (None, b), (1, c), (1, d), (1, c), (2, prose() + " " + item), (2, prose())]
    table = spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in rows], SCHEMA + ", n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(k, digest(t)) for k, t in (rows[0], rows[1], rows[2], rows[3], rows[6])]
    got = [(r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
