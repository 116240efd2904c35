"""Each operator on small tables with nulls, empty, long and repeated rows, extra columns, against brute force."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from snapgraph.llm import decontaminate, lm_score, mixing, nearest, ngram_join, pieces, pii, prefix_dp, suffix_dedup, token_counts, token_output, toxicity
from snapgraph.llm import common
from snapgraph.llm.common import components

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, block int, keys string"


def texts(seed=1, n=60):
    """Prose of few words with copies, near copies, shared passages; null, empty, short, long and odd texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    out = [prose(rng.randint(1, 120)) for _ in range(n)]
    passage = prose(90)
    for k in range(0, n, 9):
        out[k] = out[k] + " " + passage + " " + prose(5)
    base = out[3] + " " + prose(150)
    out[3] = base
    for k in range(6):
        words = base.split()
        words[10 * k + 20] = "edited"
        out.append(" ".join(words))
    out += [base, base, None, "", " \n\t ", "one", "Two words", "a b C", "A B c", "x" * 900, "x" * 900, "é漢🙂 " * 150, prose(4000)]
    return out


def documents(spark, values=None, parts=3):
    values = texts() if values is None else values
    rows = [(k, t, "en", ["a", "b", None, "c"][k % 4], 7, "k") for k, t in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts), {r[0]: r[1] or "" for r in rows}


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(pattern, text.translate(LOWER))


# ---------------------------------------------------------------- 1


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out[kind].append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans_equal_plain_regexes(spark):
    rng = random.Random(3)
    bits = list("0123456789 -.+()@aé%_\n🙂") + ["192.168.0.1", "a@b.co", "+1 (974) 555-3436", "4539 1488 0343 6467", "256", "0255", "x at y dot com", "bob [at] site [dot] org", "4539148803436468", "a@b.c_d@e.f"]
    values = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(600)] + [None, "", "a." * 3000, "1.1.1.1 " * 2000, "9" * 20000]
    docs, raw = documents(spark, values)
    got = pii.detected(docs.union(docs.where("doc_id = 5"))).collect()
    assert len(got) == len(values) + 1
    for r in got:
        want = base_spans(raw[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in want.values()]
        flat = sum(want.values(), [])
        assert r.base_sha256 == hashlib.sha256(",".join(flat).encode()).hexdigest()
        assert set(flat) <= set(r.spans.split(",")) | {""} and (r.spans == "") == (not flat and not r.n_added)
    assert pii.detected(nothing(spark)).count() == 0


def test_pii_adds_spelled_out_addresses_and_secrets_but_no_plain_numbers(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["house", "river", "at", "paper", "stone", "met", "noon"]) for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 1)) + "7"
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    values = [f"{prose(5)} {word()}{k % 2 * k or ''}@{word()}{k % 3 or ''}.example.com {prose(3)}" for k in range(60)]
    values += [f'{prose(4)} token = "a{hexes(39)}" {prose(3)}' for _ in range(60)]
    values += [f"{prose(3)} {rng.randrange(10**6)} 12 45 678 {prose(2)} call +1 (974) 555-{1000 + k}" for k in range(60)]
    values += [f"{prose(4)} page_{rng.randrange(10, 99)}_of_the_long_manual_{rng.choice('abcdef')} {prose(2)}" for _ in range(60)]
    asked = {"x bob at site dot example dot com y": 1, "x ann [at] mail3 [dot] example [dot] com y": 1, f'key: "b{hexes(39)}"': 1, "paper 4711 12 45 678 stone": 0, "x page_44_of_the_long_manual_c y": 0, "met at noon dot": 0, prose(30): 0}
    docs, _ = documents(spark, [*values, *asked])
    got = {r.doc_id: r for r in pii.detected(docs).collect()}
    assert [got[len(values) + k].n_added for k in range(len(asked))] == list(asked.values())
    assert all(r.n_found == r.n_added + r.n_email + r.n_ip + r.n_card + r.n_phone for r in got.values())
    assert all(got[k].n_added == 1 and got[k].spans.startswith("secret:") for k in range(60, 120)) and not any(got[k].n_added for k in [*range(60), *range(180, 240)])


def test_boosted_trees_learn_counts():
    cells = [((0, d, 0, 0, 0, 0, 0, 0), 90 if d == 6 else 1, 2 if d == 6 else 60) for d in range(9)]
    base, trees = pii.fit_trees(cells)
    score = {c[0][1]: base + sum(pii.value(t, c[0]) for t in trees) for c in cells}
    assert min(score[6] - score[d] for d in range(9) if d != 6) > 2
    assert set(pii.thresholds(cells, base, trees)) == {0}
    assert pii.fit_trees([((0,) * 8, 5, 0)]) == (0.0, [])


# ---------------------------------------------------------------- 2


def contaminated(raw, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text or "")
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(item)
    sizes = {len(k) for k in windows}
    out = {}
    for d, text in raw.items():
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [8_000_000, 300])
def test_decontamination(spark, monkeypatch, block):
    docs, raw = documents(spark)
    long_one = raw[len(raw) - 1].split()
    items = [(1, " ".join(raw[3].split()[5:30])), (2, "one"), (10, None), (11, ""), (12, "never seen words here"), (13, " ".join(long_one[100:150]).upper()), (14, "two words"), (15, "x" * 900)]
    monkeypatch.setattr(decontaminate.test_blocks, "__defaults__", (block,))
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == contaminated(raw, items)
    assert decontaminate.contamination(nothing(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


def test_decontamination_keeps_repeated_and_null_ids_apart_in_several_blocks(spark, monkeypatch):
    rows = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "x y alpha beta z w"), (None, "nothing here"), (None, "gamma delta and more"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "beta gamma")], "item_id long, text string")
    found = lambda: sorted(map(str, decontaminate.contamination(docs, items).collect()))
    whole = found()
    monkeypatch.setattr(decontaminate.test_blocks, "__defaults__", (1,))
    assert found() == whole and len(whole) == len(rows)


def test_proximity(spark):
    docs, _ = documents(spark, ["alpha beta gamma", "alpha x beta gamma", "gamma beta alpha"])
    index, _ = decontaminate.build_index(docs)
    found = lambda slop: {r.doc_id for r in decontaminate.search(index, [(1, "alpha beta gamma")], slop=slop).collect() if r["items"]}
    assert found(0) == {0} and found(1) == {0, 1}


# ---------------------------------------------------------------- 3


def brute_suffix_dedup(values):
    """(n_bytes, n_removed, n_spans, kept_sha256, n_passage_words) of each text."""
    data = [(t or "").encode() for t in values]
    counts = collections.Counter(b[k : k + 400] for b in data for k in range(len(b) - 399))
    spaced = [b.split() for b in data]  # bytes.split: the six ASCII spaces
    runs = lambda ws: {tuple(ws[k : k + 51]) for k in range(len(ws) - 50)}
    texts_with = collections.Counter(r for ws in spaced for r in runs(ws))
    out = []
    for b, ws in zip(data, spaced):
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if counts[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        told = {j for k in range(len(ws) - 50) if texts_with[tuple(ws[k : k + 51])] > 1 for j in range(k, k + 51)}
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), len(told)))
    return out


def test_suffix_dedup(spark):
    assert suffix_dedup.is_cover(suffix_dedup.COVER, suffix_dedup.V) and suffix_dedup.is_cover(suffix_dedup.PASSAGE_COVER, suffix_dedup.PASSAGE_V)
    rng = random.Random(3)
    short = " ".join(rng.choice("ab") for _ in range(55))  # 55 words in 109 bytes
    values = texts() + [short, f"x {short}\n\ny z", f"{short} {short}", " ".join(rng.choice("cd") for _ in range(60)) * 1]
    docs, _ = documents(spark, values)
    want = dict(enumerate(brute_suffix_dedup(values)))
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.removed(docs).collect()} == want
    assert sum(w[1] for w in want.values()) > 3000 and want[len(values) - 4][1:5:3] == (0, 55)
    assert suffix_dedup.removed(nothing(spark)).count() == 0


def test_suffix_dedup_repeated_rows_null_ids_and_clashing_columns(spark):
    text = texts()[3]
    rows = [(5, text, 1), (5, text, 1), (None, text, 2), (None, "w " * 70, 2), (None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int").withColumn("n_bytes", F.lit("k"))
    got = sorted((tuple(r) for r in suffix_dedup.removed(docs).collect()), key=str)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, brute_suffix_dedup([r[1] for r in rows]))), key=str)


def test_suffix_dedup_of_very_long_texts(spark):
    """Texts over the 2 MB of a run and the 4 MB of a segment: one passage in both, one inside a text."""
    rng = np.random.Generator(np.random.PCG64(4))
    word = lambda n: " ".join("%x" % v for v in rng.integers(1 << 20, 1 << 28, n).tolist())
    shared, once = word(120), word(100)
    first = word(330_000) + " " + shared + " " + once + " " + word(10) + " " + once
    second = word(20) + " " + shared + "!"
    third = "y" * 5_000_000
    docs = spark.createDataFrame([(1, first), (2, second), (3, third), (4, third)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.removed(docs).collect()}
    assert got[1].n_bytes == len(first) > 2_500_000
    # A space on each side of the shared passage is equal too.
    assert got[2].n_removed == len(shared) + 1 and got[2].n_passage_words == 119
    assert got[1].n_removed == len(shared) + 1 + 2 * (len(once) + 1) and got[1].n_passage_words == 119
    assert got[3].n_removed == got[4].n_removed == 5_000_000 and got[3].n_spans == 1


# ---------------------------------------------------------------- 4 and 8


def odd_texts(n=1500):
    rng = random.Random(1)
    bits = list("ab Z09.,'!  \n\t\r-é×÷Éñ…\u0301\u00a0\u200b\u2009漢ſ<|>_\x1c\x85") + ["<|endoftext|>", "<|startoftext|>", "'s", "'re", "  ", "😀"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(n)] + texts()


def test_token_counts_equal_the_library(spark):
    docs, raw = documents(spark, odd_texts())
    library = Tokenizer.from_file(WORD_BPE)
    want = {d: len(e.ids) for d, e in zip(raw, library.encode_batch(list(raw.values()), add_special_tokens=False))}
    got = token_counts.budget_table(docs, WORD_BPE).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.n_bytes == len(raw[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.budget_table(nothing(spark), WORD_BPE).count() == 0


def test_prefix_questions_need_no_encoding(spark):
    class Refuses:
        def encode(self, texts):
            raise AssertionError("a text was encoded again")

    rng = random.Random(17)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(400))
    values = ["Hello, wonderful worlds of tokens 12345!", "", "unbelievable", "They'll say it's they're we've 'twas I'm 'reference' x'd !'re", "naïve café Ωmega 漢字かな " + cjk, "a--b...c;;;d 10,000.00 <<>>", "pneumonoultramicroscopicsilicovolcanoconiosis" * 4]
    docs, raw = documents(spark, values)
    library, counter = Tokenizer.from_file(WORD_BPE), prefix_dp.PrefixCounter(WORD_BPE)
    for r in token_counts.prefix_table(docs, WORD_BPE).collect():
        text = raw[r.doc_id]
        table = token_counts.Prefixes(text, np.frombuffer(r["ends"], "<i4"), np.frombuffer(r["counts"], "<i4"), Refuses(), counter)
        want = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        sizes = [len(text[:p].encode()) for p in range(len(text) + 1)]
        assert [table.count_at(b) for b in sizes] == want
        for budget in range(0, want[-1] + 2, max(1, want[-1] // 40)):
            fits = table.longest_prefix(budget)
            assert want[sizes.index(fits)] <= budget


def test_prefix_counts_of_odd_pieces_equal_the_library():
    library, counter = Tokenizer.from_file(WORD_BPE), prefix_dp.PrefixCounter(WORD_BPE)
    rng, told = random.Random(18), 0
    letters = list("etaoinshrdlucmfwypvbgkqjxz") * 4 + list("éßñøç漢字かΩжд'’-.;!?0123456789é̀ÅＡﬁ")
    for _ in range(400):
        piece = "".join(rng.choice(letters) for _ in range(rng.randint(1, 25)))
        got = counter.prefixes(piece)
        if got is not None:
            told += 1
            assert got == [len(library.encode(piece[:k], add_special_tokens=False).ids) for k in range(1, len(piece) + 1)], piece
    assert told > 250 and counter.prefixes("e\u0301a") is None


def test_token_output(spark):
    values = odd_texts(300)
    docs, raw = documents(spark, values)
    docs = docs.union(spark.createDataFrame([(None, "no id", "en", "a", 1, "k"), (5, raw[5], "en", "a", 1, "k")], SCHEMA))
    library = Tokenizer.from_file(BYTE_BPE)
    order = sorted([*raw.items(), (5, raw[5])], key=lambda x: x[0]) + [(None, "no id")]
    start, want = 0, []
    for d, text in order:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted((tuple(r) for r in token_output.token_output(docs, BYTE_BPE).collect()), key=key) == want
    assert token_output.token_output(nothing(spark), BYTE_BPE).count() == 0


def test_wavelet_matrix():
    for top in (2, 7, 50_000):
        ids = np.random.default_rng(0).integers(0, top, 2000)
        w = token_output.WaveletMatrix.load(token_output.WaveletMatrix.build(ids).dump())
        assert (w.decode() == ids).all()
        assert [w.access(k) for k in range(0, 2000, 97)] == ids[::97].tolist()
        token = int(ids[11])
        assert w.occurrences(token) == np.flatnonzero(ids == token).tolist()
        assert w.rank(token, 700) == int((ids[:700] == token).sum()) and w.select(token, 10**6) == -1
    assert token_output.WaveletMatrix.load(token_output.WaveletMatrix.build(np.zeros(0, int)).dump()).decode().tolist() == []


# ---------------------------------------------------------------- 5


def jaccard_components(raw, n, percent):
    sets = {}
    for d, text in raw.items():
        w = words(text, r"[^\x20\x09-\x0D]+")
        sets[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("group_bytes", [6 << 20, 3000])
def test_ngram_join(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(ngram_join, "GROUP_BYTES", group_bytes)
    rng = random.Random(8)
    values = texts()
    chain = ["w%d" % k for k in range(100)]
    for _ in range(14):  # each is near the one before it, the last is far from the first
        k = rng.randrange(100)
        chain = [*chain[:k], "z%d" % rng.randrange(10**6), *chain[k + 1 :]]
        values.append(" ".join(chain))
    docs, raw = documents(spark, values)
    want = jaccard_components(raw, 4, 85)
    assert {r[0]: tuple(r[1:]) for r in ngram_join.joined_components(docs).collect()} == want
    kept = ngram_join.one_of_each(docs, 4, 85)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()}) and kept.columns == docs.columns
    assert ngram_join.joined_components(nothing(spark)).count() == 0


def test_components(spark):
    got = components(spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (7, 7)], "a long, b long"))
    assert dict(map(tuple, got.collect())) == {**{k: 0 for k in range(41)}, 90: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 6


def labelled(spark, n=700):
    rng = random.Random(5)
    bad = ["idiot", "moron", "worthless", "scum"]
    good = ["house", "river", "silent", "garden", "paper", "window", "music", "stone", "idea", "motor", "worth"]
    rows, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        w = [rng.choice(good) for _ in range(rng.randint(3, 30))]
        for _ in range(2 * toxic):
            word = rng.choice(bad)
            word = rng.choice([word, word.upper(), word[:2] + "." + word[2:], word[:3] + "x" + word[3:]])
            w.insert(rng.randrange(len(w)), word)
        rows.append((k, " ".join(w), "en", "a", 1, "k"))
        labels.append((k, 1, int(toxic)))
    rows += [(n, None, "en", "a", 1, "k"), (n + 1, "", None, None, 1, "k"), (None, "you idiot", "en", "a", 1, "k")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_texts(spark):
    docs, labels = labelled(spark)
    got = toxicity.predictions(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 700]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    assert sum((r.doc_id % 4 == 0) == bool(r.predicted) for r in held) >= 0.95 * len(held)
    model = toxicity.fit(docs, labels)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    assert toxicity.predictions(nothing(spark), labels).count() == 0
    assert {r.score for r in toxicity.predictions(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_is_not_fit_in_the_driver(spark, monkeypatch):
    """Its runs of letters took the pipeline's driver over its memory; what comes back is the same model."""
    docs, labels = labelled(spark)
    fold = labels.where(toxicity.fold_of() != 0).join(docs, "doc_id").select("doc_id", "text", "toxic").collect()
    fold.sort(key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["text"]))
    want = toxicity.Model([r["text"] for r in fold], np.array([r["toxic"] for r in fold]))
    here, driver, init = [], os.getpid(), toxicity.Model.__init__
    monkeypatch.setattr(toxicity.Model, "__init__", lambda self, *a: (here.append(1) if os.getpid() == driver else None) or init(self, *a))
    model = toxicity.fit(docs, labels)
    texts = [r["text"] for r in fold[:50]]
    assert model.landmarks.names == want.landmarks.names and np.allclose(model.scores(texts, {}), want.scores(texts, {}))
    assert not here


def test_kernel_counts_gapped_subsequences():
    def brute(s, t, n, decay):
        from itertools import combinations

        total = 0.0
        for a in combinations(range(len(s)), n):
            for b in combinations(range(len(t)), n):
                if all(s[x] == t[y] for x, y in zip(a, b)):
                    total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    pairs = [("idiot", "idxiot"), ("moron", "motor"), ("abc", "cba"), ("aaaa", "aaa")]
    got = toxicity.kernel(toxicity.codes([a for a, _ in pairs]), toxicity.codes([b for _, b in pairs]))
    assert np.allclose(got, [brute(a, b, toxicity.LENGTH, toxicity.DECAY) for a, b in pairs])


# ---------------------------------------------------------------- 7


def test_nearest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 24)).astype(np.float32)
    x[40:340] = x[40]
    rows = [(k, [float(v) for v in x[k]], 0) for k in range(len(x))]
    rows += [(2000, None, 0), (2020, [], 0), (2040, [0.0] * 24, 0), (2060, [float("nan")] * 24, 0), (2080, [None] * 24, 0), (None, rows[0][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = collections.defaultdict(list)
    for r in nearest.neighbours(table, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1200, 20))
    y = x.astype(float)
    hits = 0
    for q, found in got.items():
        found.sort()
        scores = (y * y[q]).sum(1)
        want = sorted((k for k in range(1200) if k != q), key=lambda k: (-scores[k], k))[:20]
        hits += len(set(want) & {v for _, v, _ in found})
        assert all(math.isclose(s, scores[v], rel_tol=1e-12) for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        if 40 <= q < 340:
            assert [v for _, v, _ in found] == want
    assert hits >= 0.9 * 20 * len(got)
    assert nearest.neighbours(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def exact_hits(y, got, queries):
    """How many of the true 20 nearest were found, as a share."""
    hits = total = 0
    for q in queries:
        scores = y @ y[q]
        want = [k for k in np.lexsort((np.arange(len(y)), -scores)) if k != q][:20]
        hits, total = hits + len(set(want) & set(got[q])), total + len(want)
    return hits / total


def found_by(spark, rows):
    got = collections.defaultdict(list)
    for r in nearest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 60 == 0).collect():
        got[r.query_id].append(r.vec_id)
    return got


def test_nearest_counts_repeated_rows_once(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=(600, 16)) / 50 + rng.normal(size=(12, 16))[np.arange(600) % 12]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    got = found_by(spark, [(k, y[k].tolist()) for k in range(600)] * 6)
    assert exact_hits(y, got, range(0, 600, 60)) >= 0.95
    assert all(len(v) == len(set(v)) == 20 for v in got.values())


@pytest.mark.parametrize("kind", ["gaussian", "lognormal", "outlier"])
def test_nearest_recall_on_unequal_norms(spark, kind):
    rng = np.random.default_rng(6)
    y = rng.normal(size=(6000, 64))
    if kind != "gaussian":
        y /= np.linalg.norm(y, axis=1, keepdims=True)
    if kind == "lognormal":
        y *= rng.lognormal(size=(6000, 1))
    if kind == "outlier":
        y[7] *= 1000
    got = found_by(spark, [(k, y[k].tolist()) for k in range(6000)])
    recall = exact_hits(y, got, range(0, 6000, 60))
    print(kind, recall)
    assert recall >= 0.9


def test_nearest_gives_all_of_few_candidates_and_of_far_queries(spark):
    rng = np.random.default_rng(7)
    few = found_by(spark, [(k, rng.normal(size=8).tolist()) for k in range(13)])
    assert sorted(few[0]) == list(range(1, 13))
    near = rng.normal(size=(3000, 128)) * 0.001
    near[:, 0] += 1
    near[0] = -near[0]
    far = found_by(spark, [(k, near[k].tolist()) for k in range(3000)])
    assert len(far[0]) == 20


# ---------------------------------------------------------------- 9


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randint(1, 60), "en", rng.choice(["b", "a", "a", "a", "c", None]), 1, "k") for k in range(3000)]
    rows += [(9000, None, "en", "a", 1, "k"), (9001, "", "en", "empty", 1, "k"), (9002, "  ", "en", "empty", 1, "k")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mixed(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    sizes, source = collections.Counter(), {r[0]: r[3] for r in rows}
    for k, t, _, s, _, _ in rows:
        sizes[s] += len((t or "").split())
    total, names = sum(sizes.values()), sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ones, left = {}, set(names), total
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_ones) for s in open_ones}
        over = {s for s in open_ones if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        open_ones -= over
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s], abs_tol=1e-6) and r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 60 for s in names)
    again = mixing.mixed(docs.repartition(2)).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and collections.Counter(r.doc_id for r in out.collect()) == collections.Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.mixed(nothing(spark)).count() == 0


# ---------------------------------------------------------------- 10


def test_lm_scores(spark):
    docs, raw = documents(spark)
    docs, extra = docs.union(docs.where("doc_id = 4")), raw[4]
    bags = [(d, words(t)) for d, t in raw.items()] + [(4, words(extra))]
    grams = lambda w, n: [tuple(w[k - n + 1 : k + 1]) for k in range(n - 1, len(w))]
    counts = [collections.Counter(g for _, w in bags for g in grams(w, n)) for n in (1, 2, 3)]
    total = sum(len(w) for _, w in bags)

    def score(w):
        own = [collections.Counter(grams(w, n)) for n in (1, 2, 3)]
        c = lambda g: counts[len(g) - 1][g] - own[len(g) - 1][g]
        rest, logs = total - len(w), []
        for k in range(len(w)):
            s = c((w[k],)) / rest if c((w[k],)) else 1 / (rest + 1)
            for n in (2, 3):
                if k >= n - 1:
                    g = tuple(w[k - n + 1 : k + 1])
                    s = c(g) / c(g[:-1]) if c(g) else 0.4 * s
            logs.append(math.log10(s))
        return sum(logs) / len(logs) if logs else None

    want = sorted(((d, len(w), score(w)) for d, w in bags), key=str)
    got = sorted(((r.doc_id, r.n_words, r.score) for r in lm_score.scored(docs).collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and (a[2] is None if b[2] is None else math.isclose(a[2], b[2], rel_tol=1e-9))
    assert lm_score.scored(nothing(spark)).count() == 0


# ---------------------------------------------------------------- rows and names


def test_columns_of_any_name_keep_their_values(spark):
    """Names that an operator may want for itself belong to the user."""
    names = ["_row", "row", "d", "copies", "component_id", "_mix_row", "_mix_copy", "a.b", "block", "size", "rank"]
    values = ["one two three four five", "one two three four five", "six seven eight", None, ""]
    rows = [(k if k != 3 else None, t, "s", *(f"{n}{k}" for n in names)) for k, t in enumerate(values)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    marks = lambda df: collections.Counter(tuple(r[3:]) for r in df.collect())
    own = lambda ks: collections.Counter(tuple(f"{n}{k}" for n in names) for k in ks)
    items = spark.createDataFrame([(1, "six seven eight")], "item_id long, text string")
    for out in (decontaminate.clean(docs, items), ngram_join.one_of_each(docs), mixing.repeated(docs)):
        assert out.columns == docs.columns
    assert marks(decontaminate.clean(docs, items)) == own([0, 1, 3, 4])
    assert marks(ngram_join.one_of_each(docs)) == own([0, 2, 3, 4])
    taken = collections.Counter({r.doc_id: r.copies for r in mixing.mixed(docs).collect()})
    assert marks(mixing.repeated(docs)) == own(d if d is not None else 3 for d in taken.elements())


def test_repeated_rows_and_null_ids(spark):
    text = " ".join("w%d" % k for k in range(30))
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "a"), (None, None, None), (None, "", "a"), (7, "other words here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    count = lambda df, *cols: collections.Counter(tuple(r[c] for c in cols) for r in df.collect())
    assert count(ngram_join.joined_components(docs), "doc_id", "n_shingles", "component_id") == collections.Counter([(1, 27, 1), (1, 27, 1), (None, 27, None), (None, 0, None), (None, 0, None), (7, 1, 7)])
    assert count(token_counts.budget_table(docs, public_tokenizers.path("word_bpe_49k.json")), "doc_id", "n_bytes") == collections.Counter((d, len((t or "").encode())) for d, t, _ in rows)
    scores = lm_score.scored(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words) for r in scores) == collections.Counter([(1, 30), (1, 30), (None, 30), (None, 0), (None, 0), (7, 3)])
    assert len({r.score for r in scores if r.n_words == 30}) == 1
    assert count(mixing.mixed(docs), "doc_id", "size") == collections.Counter([(1, 30), (1, 30), (None, 30), (None, 0), (None, 0), (7, 3)])


# ---------------------------------------------------------------- pipeline


def test_pipeline_of_empty_tables_and_null_ids(spark, tmp_path):
    import corpus_pipeline

    labels, benchmark = "doc_id long, quality int, toxic int", "item_id long, text string"
    for name, docs in (("empty", []), ("nulls", [(None, None, None, None, 1, "k"), (None, "", "en", "a", 1, "k"), (None, "x " * 50, "en", None, 1, "k"), (4, "one two", "en", "a", 1, "k")])):
        at = tmp_path / name
        spark.createDataFrame(docs, SCHEMA).write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([], labels).write.parquet(str(at / "labels.parquet"))
        spark.createDataFrame([], benchmark).write.parquet(str(at / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(at)).collect()
        assert all(r.n_tokens > 0 for r in out) and (len(out) > 0) == (name == "nulls")



def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    docs, labels = labelled(spark, 400)
    prose = lambda k: " ".join("p%d" % rng.randrange(5000) for _ in range(k))
    shared, copy = prose(30), prose(80)
    more = [(1000 + k, prose(40), "en", "b", 1, "k") for k in range(40)] + [(2000 + k, copy, "en", "b", 1, "k") for k in range(5)] + [(3000, prose(9) + " " + shared + " " + prose(9), "en", "a", 1, "k")]
    all_docs = docs.union(spark.createDataFrame(more, SCHEMA))
    all_docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, shared)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept[name] = collections.Counter(r[0] for r in now.select("doc_id").collect())
        if name != "token_output":
            assert now.columns == docs.columns
    assert sum(d % 4 == 0 for d in kept["toxicity"] if d is not None and d < 400) <= 5 and set(range(1000, 1040)) <= set(kept["toxicity"])
    assert 2000 in kept["ngram_join"] and not {2001, 2002, 2003, 2004} & set(kept["ngram_join"]) and 3000 in kept["ngram_join"]
    assert set(kept["decontamination"]) == set(kept["ngram_join"]) - {3000}
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and max(kept["mixing"].values()) <= 3
    assert kept["token_output"] == kept["mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(kept["mixing"].values())


def test_order_of_keys_that_differ_in_low_bits_only():
    rng = np.random.default_rng(4)
    for keys in (rng.integers(0, 9, 300, np.uint64), rng.integers(0, 2**64, 1000, np.uint64)[rng.integers(0, 1000, 5000)], np.uint64(1 << 63) + rng.integers(0, 5, 40, np.uint64), np.zeros(0, np.uint64), np.ones(1, np.uint64)):
        order, found = common.key_order(keys)
        want = np.argsort(keys, kind="stable")
        assert (order == want).all() and (found == keys[want]).all()
        doc, has = np.arange(len(keys)) // 7, np.arange(len(keys)) % 7 > 0
        totals = np.unique(keys[has], return_counts=True)[1] + 3
        total = dict(zip(np.unique(keys[has]).tolist(), totals.tolist()))
        own = collections.Counter(zip(doc[has].tolist(), keys[has].tolist()))
        assert lm_score.others(keys, has, doc, totals).tolist() == [total[k] - own[d, k] if h else 0 for k, h, d in zip(keys.tolist(), has.tolist(), doc.tolist())]
    for base in (common._BASE, common._INVERSE):
        assert common._powers(base, 70_000)[[0, 1, 2, 65_536, 69_999]].tolist() == [pow(base, k, 2**64) for k in (0, 1, 2, 65_536, 69_999)]


def test_new_pieces_reach_the_library_few_at_once(spark, monkeypatch):
    """Each text given to the library leaves an object until its ids are read; a block's at once took the pipeline's executors over their memory."""
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    memo = pieces.PieceMemo(BYTE_BPE, False, token_output.SPECIALS, False)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    sizes, encode = [], memo.encode
    monkeypatch.setattr(memo, "encode", lambda given: sizes.append(len(given)) or encode(given))
    rng = np.random.default_rng(6)
    values = [" ".join("x%d'%d漢" % (a, b) for a, b in rng.integers(0, 10**6, (300, 2)).tolist()) for _ in range(50)]
    got = token_output.ids_of(pa.array(values), memo)
    assert max(sizes) <= 4096 < sum(sizes)
    assert [g.tolist() for g in got] == [e.ids for e in memo.tokenizer.encode_batch(values, add_special_tokens=False)]


def test_pieces_of_one_class_go_to_the_merges():
    memo = pieces.PieceMemo(BYTE_BPE, False, token_output.SPECIALS, False)
    whole = [b"a", b" Walking", "éÿÀñ".encode(), " naïveÖ".encode(), b"0", b" 12345678901", b"!?", b" <|-_~`@[\\]^{}$&(", b"x" * 256]
    others = [b" ", b"\n", b"  a", b"a1", b"'s", b"don't", b"<|endoftext|>", "÷×".encode(), "漢".encode(), "á".encode(), b"a\nb", b"!'", b"x" * 257]
    library = memo.tokenizer.encode_batch([p.decode() for p in whole + others], add_special_tokens=False)
    given, encode = [], memo.encode
    memo.encode = lambda texts: given.extend(texts) or encode(texts)
    begins, lengths, ids = memo.runs((whole + others)[::-1])
    assert given == [p.decode() for p in others[::-1]]
    assert [ids[a : a + n].tolist() for a, n in zip(begins, lengths)][::-1] == [e.ids for e in library]
    assert pieces.PieceMemo(WORD_BPE, True, token_counts.SPECIALS, True).merges is None  # it ends words by a mark of its own


def test_memo_of_pieces(monkeypatch):
    table = pieces.Table(16)
    keys = np.arange(2000, dtype=np.uint64) << np.uint64(12)  # many at one place
    assert (table.find(keys) == -1).all()
    table.add(keys[:3], np.arange(3))
    table.add(keys[3:1000], np.arange(3, 1000))
    assert table.find(keys).tolist() == [*range(1000), *[-1] * 1000] and 2 * table.count <= len(table.keys)

    data = np.frombuffer(bytes(range(1, 101)) * 2, np.uint8)
    spans = [(a, b) for a in range(100) for b in range(a + 1, 101)]
    twice = np.array(spans + [(a + 100, b + 100) for a, b in spans])
    prints = pieces.fingerprints(data, twice[:, 0], twice[:, 1])
    assert (prints[: len(spans)] == prints[len(spans) :]).all() and len(np.unique(prints)) == len(spans)

    monkeypatch.setattr(pieces, "MEMO", 300)  # it starts again, now and then within a text
    memo = pieces.PieceMemo(BYTE_BPE, False, token_output.SPECIALS, False)
    values = odd_texts(400)
    values = [v or "" for v in values]
    for k in range(0, len(values), 50):
        got = token_output.ids_of(pa.array(values[k : k + 50]), memo)
        assert [g.tolist() for g in got] == [e.ids for e in memo.tokenizer.encode_batch(values[k : k + 50], add_special_tokens=False)]


def test_wavelet_matrix_in_runs(monkeypatch):
    """The planes by their definition; places are taken in runs, ids are kept in 16 bits where that is enough."""
    monkeypatch.setattr(token_output, "SPAN", 64)
    for top, kind in ((50_000, np.uint16), (90_000, np.uint32)):
        ids = np.random.default_rng(2).integers(0, top, 1000)
        ids[7] = top - 1
        w = token_output.WaveletMatrix.build(ids)
        now = ids.tolist()
        for k in range(w.bits):
            bits = [v >> (w.bits - 1 - k) & 1 for v in now]
            assert w.plane(k).tolist() == bits
            now = [v for v, b in zip(now, bits) if not b] + [v for v, b in zip(now, bits) if b]
        assert w.decode().dtype == kind and (w.decode() == ids).all()
