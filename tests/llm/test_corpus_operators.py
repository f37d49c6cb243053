"""The corpus operators against brute force, round trips and held-out labels, and on odd inputs."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import uuid
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairwright.llm import bpe, chat, decontaminate, jaccard_join, language_id, quality_rank, quality_rules, registry, sharding, token_counts, toxicity
from pairwright.llm.common import texts, word_hashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, c0 string, label int, prefix string, _text string"


def documents(spark, rows):
    """Documents with null and clashing extra columns."""
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None, None if t is None else len(t), "x", 1, None, "y") for k, (i, t) in enumerate(rows)], DOCS)


def syllables(rng, n, parts=("ba", "co", "di", "fu", "ge", "hi", "jo", "ku")):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "two words"), (6, "A" * 3000), (7, "x " * 20000), (8, "日本語 テスト é İ ß 😀"), (9, "same text of a few words here"), (10, "same text of a few words here"), (10, "same text of a few words here"), (None, "same text of a few words here"), (11, "&lt; <|endoftext|> </s> [INST]"), (12, "12345 !!! ###")]


def test_word_hashes():
    cases = ["a b c", "", "Hello  World\n x", None, "A" * 1_500_000 + " b " + "d" * 1_200_000, " lead", "trail ", "x" * (1 << 20), "w " * 700_000]
    _, n = word_hashes(*texts(pa.array(cases)))
    assert n.tolist() == [len(WORD.findall((c or "").encode())) for c in cases]
    h, _ = word_hashes(*texts(pa.array(["Ab cd", "ab", "cd x", "abc"])), prefixes=(2,))
    assert h[0, 0] == h[2, 0] and h[1, 0] == h[3, 0] and h[0, 1] == h[5, 1] and h[4, 1] == 0


# ---- 1 ----


def shingle_set(text, k):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]) if w else frozenset()


def plain_components(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [(i, s) for i, s in sets if i is not None and s]
    for a in range(len(named)):
        for b in range(a):
            (i, s), (j, t) = named[a], named[b]
            if 100 * len(s & t) >= percent * len(s | t) and top(i) != top(j):
                lo, hi = sorted((top(i), top(j)))
                parent[hi] = lo
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in sets), key=str)


def near_copies(seed):
    rng = random.Random(seed)
    rows, n = [], 100
    passage = syllables(rng, 40)
    for _ in range(25):
        base = syllables(rng, rng.choice([3, 8, 20, 60, 150])).split()
        if rng.random() < 0.3:
            base[2:2] = passage.split()
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = syllables(rng, 1)
            rows.append((n, " ".join(w)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard(spark, k, percent):
    rows = near_copies(k) + ODD
    got = jaccard_join.jaccard_components(documents(spark, rows), jaccard_join.Join(k, percent)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_components(rows, k, percent)


def test_jaccard_large_buckets(spark, monkeypatch):
    """Blocks of a bucket, and members that link with each other but not with the first."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "COMPARE_BYTES", 256)
    rng = random.Random(5)
    base = syllables(rng, 70).split()
    rows = []
    for n in range(40):
        w = list(base)
        for _ in range(4 if n == 0 else 1 + n % 3):
            w[rng.randrange(len(w))] = syllables(rng, 1)
        rows.append((n, " ".join(w)))
    got = jaccard_join.jaccard_components(documents(spark, rows), jaccard_join.Join(3, 85)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_components(rows, 3, 85)


def test_jaccard_sends_pairs_once(spark, monkeypatch, tmp_path):
    """Near copies that don't quite link share many buckets, of which one sends a pair; buckets of the same members are one."""
    compare = jaccard_join.compare

    def noted(t, join, nearest):
        for batch in compare(t, join, nearest):
            (tmp_path / uuid.uuid4().hex).write_text("".join(f"{nearest} {a} {b}\n" for a, b in zip(*(c.to_pylist() for c in batch.columns))))
            yield batch

    monkeypatch.setattr(jaccard_join, "compare", noted)
    rng = random.Random(8)
    base, places = syllables(rng, 160).split(), iter(range(2, 160, 4))
    rows = []
    for n in range(12):  # sets of two differ by 36 shingles; linked ones by 35 at most
        w = list(base)
        for _ in range(3):
            w[next(places)] = f"other{n}"
        rows.append((n, " ".join(w)))
    got = jaccard_join.jaccard_components(documents(spark, rows), jaccard_join.Join(3, 80)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_components(rows, 3, 80)
    sent = [line for f in tmp_path.iterdir() for line in f.read_text().splitlines()]
    assert len(sent) > 15 and len(sent) == len(set(sent))


def test_jaccard_leads(spark):
    keyed = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (2, 11, 6), (2, 10, 5), (3, 10, 5), (3, 12, 6), (4, 10, 5), (5, 10, 5), (5, 11, 6), (5, 12, 6)], "key long, id long, n int")
    assert sorted(map(tuple, jaccard_join.leads(keyed).collect())) == [(1, 10, 5, 2), (3, 10, 5, 2), (5, 10, 5, 3)]


def test_jaccard_schemes_agree(spark):
    """The light scheme, the heavy one, and a boundary between them reach all linked pairs."""
    rows = [(i, t) for i, t in near_copies(9)]
    join = jaccard_join.Join(3, 80)
    docs = documents(spark, rows).select("doc_id", "text")
    distinct = jaccard_join.describe(docs, join, jaccard_join.frequency_levels(docs, join)).where("n > 0")
    sets = {i: shingle_set(t, 3) for i, t in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a] != sets[b]}
    for light in (0, 20, 10_000):
        keys = collections.defaultdict(set)
        for r in jaccard_join.entries(distinct, join, light).collect():
            keys[r.key].add(r.id)
        met = {(a, b) for s in keys.values() for a in s for b in s if a < b}
        assert linked <= met


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in jaccard_join.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert jaccard_join.components(links.limit(0)).collect() == []


def test_keep_one(spark):
    kept = jaccard_join.keep_one(documents(spark, ODD), jaccard_join.Join(5, 80))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == documents(spark, []).columns and 10 not in ids and ids.count(9) == 1 and None in ids


# ---- 2, 9 ----


def labelled(spark, seed=1, n=240):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        t = syllables(rng, rng.randrange(20, 80))
        bad, toxic = i % 4 == 0, i % 3 == 0
        if toxic:
            w = t.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["scum,", "Vermin", "dolt."]))
            t = " ".join(w)
        if bad:
            t = " ".join(w + "***" for w in t.split())
        rows.append((i, t))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return documents(spark, rows + [(1000 + k, t) for k, (_, t) in enumerate(ODD)]), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), {i: (q, x) for i, q, x in labels}


@pytest.mark.parametrize("which", [0, 1])
def test_classifiers(spark, which):
    docs, labels, truth = labelled(spark)
    module, label = ((quality_rank, "quality"), (toxicity, "toxic"))[which]
    clashing = labels.withColumn("text", F.lit("scum")).withColumn("label", F.lit(7)).withColumn("prefix", F.lit(None))
    got = module.score_documents(docs, module.train(docs, clashing, label)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id][which] for r in out) >= 0.9 * len(out)
    assert all(r.predicted == int(r.score >= (0.5, 0.7)[which]) for r in got)
    for empty_labels in (labels.limit(0), labels.where(f"{label} = 1")):
        assert module.score_documents(docs, module.train(docs, empty_labels, label)).count() == docs.count()
    assert module.score_documents(docs.limit(0), module.train(docs.limit(0), labels, label)).count() == 0


def test_keep_clean(spark):
    docs, labels, truth = labelled(spark)
    kept = toxicity.keep_clean(docs, toxicity.train(docs, labels))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and sum(i in ids for i, (_, x) in truth.items() if x == 0) >= 150 and sum(i in ids for i, (_, x) in truth.items() if x) <= 10


def test_threshold_between_ties():
    """Equal logits fall on one side, whatever the order of their labels."""
    for y in ([1, 0, 0, 0, 1], [0, 0, 0, 1, 1]):
        assert 0 < toxicity._cut(np.array([0.0, 0, 0, 0, 2]), np.array(y)) < 2


def test_ranking_gradient():
    """Preference pairs order the scores; the threshold is the quantile of the low share."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] + 0.1 * rng.normal(size=300) > -0.5).astype(int)
    r = quality_rank.fit(x, y, float((y == 0).mean()))
    s = r.score(x)
    assert s[y == 1].mean() > s[y == 0].mean() and abs((s < 0.5).mean() - (y == 0).mean()) < 0.03


def plain_features(text):
    """The numbers of operator 2, counted one by one."""
    raw = text.encode()
    kind = lambda b: 128 if b >= 128 else ord("A") if chr(b).isupper() else ord("a") if chr(b).islower() else ord("0") if chr(b).isdigit() else b
    kinds = sorted({kind(b) for b in range(256)})
    every, words = collections.Counter(map(kind, raw)), WORD.findall(raw)
    ends, size = collections.Counter(kind(w[-1]) for w in words), collections.Counter(next(k for k, e in enumerate(quality_rank._EDGES) if len(w) <= e) for w in words)
    low = [w.translate(LOWER) for w in words]
    out = [math.sqrt(every[k] / len(raw)) if raw else 0.0 for k in kinds] + [math.sqrt(ends[k] / len(words)) if words else 0.0 for k in kinds]
    out += [size[k] / len(words) if words else 0.0 for k in range(len(quality_rank._EDGES))]
    return out + ([1 - len(set(low)) / len(low), sum(a == b for a, b in zip(low, low[1:], strict=False)) / len(low), math.log1p(len(raw)) / 10] if words else [0.0] * 3)


def test_ranking_against_plain_loss(spark):
    """Features and scores by plain counting; the loss over all preference pairs is close to the least there is."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    ranker = quality_rank.train(docs, labels)
    got = {r.doc_id: r for r in registry.QUERIES["op2_pairwise_quality"](spark, sf).collect()}
    assert set(got) == set(text)
    for i, t in text.items():
        z = (np.clip((np.array(plain_features(t)) - ranker.mean) / ranker.spread, -8, 8) * ranker.weights).sum()
        score = 1 / (1 + math.exp(-max(-30, min(30, ranker.scale * (z - ranker.threshold)))))
        assert got[i].score == pytest.approx(score, abs=1e-6) and got[i].predicted == int(got[i].score >= 0.5)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 4))
    y = (x @ [1.0, -0.5, 0.2, 0.0] + rng.normal(size=120) > 0).astype(int)
    r = quality_rank.fit(x, y, float((y == 0).mean()))
    z = np.clip((x - r.mean) / r.spread, -8, 8)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 4)
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 5e-4 * w @ w
    best = np.zeros(4)
    for _ in range(3000):
        best -= 0.5 * (-(d / (1 + np.exp(d @ best))[:, None]).mean(0) + 1e-3 * best)
    assert loss(best) - 1e-9 <= loss(r.weights) <= loss(best) * 1.02


def test_convolution_against_loops(spark, monkeypatch):
    """Logits window by window, also where a text spans blocks; the query's scores are those."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, labels)
    one = lambda t: toxicity.buckets(*texts(pa.array([t])))

    def plain(t):
        words = re.findall(r"[A-Za-z0-9'\u0080-\U0010ffff]+", t)
        x = [m.embedding[one(w)[0][0]].sum(0, dtype=np.float64) for w in words]
        z = m.out_bias
        for k, f in enumerate(m.filters):
            for q in range(toxicity.FILTERS):
                values = [sum(x[i + j] @ f[j, :, q] for j in range(len(f)) if i + j < len(x)) for i in range(len(x))] + [0.0] * toxicity.TOP
                for n, v in enumerate(sorted(values)[-toxicity.TOP :]):
                    c = k * toxicity.FILTERS + q
                    z += max(0.0, v + m.bias[n, c]) * m.out[n, c]
        return z

    text = {r.doc_id: r.text for r in docs.collect()}
    some = sorted((i for i, t in text.items() if len(t) < 2500))[:25]
    got = {r.doc_id: r for r in registry.QUERIES["op9_convolutional_toxicity"](spark, sf).collect()}
    assert set(got) == set(text)
    for size in (toxicity.BLOCK_WORDS, 7):
        monkeypatch.setattr(toxicity, "BLOCK_WORDS", size)
        assert m.logit(*toxicity.buckets(*texts(pa.array([text[i] for i in some])))) == pytest.approx([plain(text[i]) for i in some], abs=1e-3)
    for i in some:
        z = plain(text[i]) - m.threshold[m.languages.of(*one(text[i]))[0]] + math.log(0.7 / 0.3)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-3)


def test_ties_leave_a_document_out():
    docs = [np.array([[5, 9]], np.int32), np.array([[5, 7]], np.int32), np.array([[7, 0]], np.int32), np.array([[8, 9]], np.int32)]
    y = np.array([1, 1, 0, 0])
    every, zero, one = toxicity.ties(docs, y)
    odds = lambda a, b: math.log((a + 2) / (b + 2))  # noqa: E731  half of the documents have label 1
    assert [every[k] for k in (5, 7, 8, 9)] == pytest.approx([odds(2, 0), odds(1, 1), odds(0, 1), odds(1, 1)]) and every[0] == 0
    assert [every[k] + one[k] for k in (5, 7, 9)] == pytest.approx([odds(1, 0), odds(0, 1), odds(0, 1)])
    assert [every[k] + zero[k] for k in (7, 8, 9)] == pytest.approx([odds(1, 0), odds(0, 0), odds(1, 0)])


# ---- 3 ----


def edit(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_myers():
    rng = random.Random(3)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 90)))
        assert decontaminate.semi_global(p, t, 200)[0] == edit(p, t)


@pytest.mark.parametrize("block", [100, 4_000_000])
def test_decontamination(spark, block):
    rng = random.Random(4)
    budget = decontaminate.Budget(0.06, 24, block)
    items = [(k, syllables(rng, 12)) for k in range(8)] + [(None, "nothing here at all to be found"), (9, None), (20, "short"), (21, "Same text!"), (22, "wo"), (23, "?!"), (3, "")]
    items.append((0, items[0][1]))
    rows = list(ODD)
    for n in range(60):
        w = list(syllables(rng, 40))
        if n % 2:
            piece = list(items[n % 8][1].upper().replace(" ", "  "))
            for _ in range(n % 7):
                piece[rng.randrange(len(piece))] = rng.choice("abcdefgh")
            at = rng.randrange(len(w))
            w[at:at] = [" ", *piece, "."]
        rows.append((200 + n, "".join(w)))
    rows += [(300, "in short"), (301, "shorter, shortest"), (302, "Short."), (303, "wo")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, h.item_id): h.distance for r in decontaminate.find_contamination(documents(spark, rows), bench, budget).collect() for h in r._hits}
    want = {}
    for i, t in rows:
        for k, x in items:
            if k is not None and x and (p := decontaminate.normalise(x)):
                plain = decontaminate.normalise(t or "")
                d = edit(p, plain) if len(p) >= 24 else 0 if f" {p} " in f" {plain} " else 99
                if d <= budget.of(len(p)):
                    want[i, k] = d
    assert got == want and len(want) > 15
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # batches with hits and without in one task
    try:
        assert {(r.doc_id, h.item_id): h.distance for r in decontaminate.find_contamination(documents(spark, rows), bench, budget).collect() for h in r._hits} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = decontaminate.drop_contaminated(documents(spark, rows), bench, budget)
    assert kept.columns == documents(spark, []).columns and kept.count() == sum(i not in {k for k, _ in want} for i, _ in rows)
    assert decontaminate.find_contamination(documents(spark, rows), bench.limit(0)).where("size(_hits) > 0").count() == 0


# ---- 4, 7 ----


def odd_texts(seed, n=600):
    rng = random.Random(seed)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x800), rng.randrange(0x300, 0x370), rng.randrange(0x800, 0xD7FF), rng.randrange(9, 33), rng.randrange(0x10000, 0x1FFFF)]))
    return ["".join(pick() for _ in range(rng.randrange(30))) for _ in range(n)] + ["aaaa" * 50, "<|endoftext|>x <|endoftext|>  y", "it's we'll  ", "ΑΣ ΟΔΟΣ", "<|startoftext|>"]


def test_bpe(spark):
    rows = ODD + [(500 + i, t) for i, t in enumerate(odd_texts(1))]
    path = public_tokenizers.path(bpe.VOCABULARY)
    tok = Tokenizer.from_file(path)
    got = sorted((tuple(r) for r in bpe.encode_documents(documents(spark, rows), path).collect()), key=str)
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), ",".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    digests = bpe.encode_documents(documents(spark, ODD), path, digests=True, keep=["doc_id", "c0"])
    assert digests.columns == ["doc_id", "c0", "n_tokens", "ids_sha256", "decoded_sha256"]
    with pytest.raises(ValueError):
        bpe.ByteBPE(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.decoded_sha256 for r in digests.where("doc_id = 4").collect()} == {hashlib.sha256(b"one").hexdigest()}


def test_token_counts(spark, tmp_path):
    rows = ODD + [(500 + i, t) for i, t in enumerate(odd_texts(2))]
    path, cache = public_tokenizers.path(token_counts.VOCABULARY), "file://" + str(tmp_path / "cache")
    tok = Tokenizer.from_file(path)
    want = sorted(((i, len((t or "").encode()), n, n > 2048) for i, t in rows for n in [len(tok.encode(t or "", add_special_tokens=False).ids)]), key=str)
    for _ in range(2):
        got = token_counts.count_tokens(documents(spark, rows), path, cache)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("content_digest").distinct().count()
    assert token_counts.count_tokens(documents(spark, []), path, "file://" + str(tmp_path / "none")).count() == 0


# ---- 5 ----


def test_quality_rules(spark):
    rng = random.Random(6)
    clean = lambda: " ".join(rng.choice(["the", "of", "and", "to", "in", "Vale", "stone", "river,", "went", "bright."]) + (rng.choice(["s", "", "x", "y"]) if rng.random() < 0.5 else "") for _ in range(150))
    rows = ODD + [(100 + i, clean() + "\n" + clean()) for i in range(40)] + [(200 + i, " ".join(w + "%%%" for w in clean().split())) for i in range(4)] + [(300, "again and again " * 60), (301, "line one here\n\n \nline one here\nline one here"), (302, clean().upper())]
    got = {(r.doc_id, r.n_words): r for r in quality_rules.quality_report(documents(spark, rows)).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        r = got[i, len(w)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert all(r.kept for (i, _), r in got.items() if i and 100 <= i < 140) and not any(r.kept for (i, _), r in got.items() if i and i >= 200)
    kept = quality_rules.keep_good(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns and kept.count() == 40
    assert quality_rules.quality_report(documents(spark, [])).count() == 0


@pytest.mark.parametrize("few", [15, 3])
def test_quality_rules_keep_small_languages(spark, few):
    rng = random.Random(7)
    text = lambda common, other: " ".join(w + rng.choice(["", "s", "x", "y"]) for w in rng.choices(common * 2 + other, k=120)) + " " + " ".join(rng.choices(common, k=80))
    en = [(i, text(["the", "of", "and", "to", "in", "was"], ["Vale", "stone", "river"]), "en") for i in range(few * 300)]
    ru = [(100_000 + i, " ".join(rng.choice(["дом", "река", "Камень", "светлый", "шёл", "город,", "поле."]) + rng.choice(["а", "у", "ом", "ы"]) for _ in range(200)), "ru") for i in range(few)]
    junk = [(200_000, " ".join(w + "%%%" for w in en[0][1].split()), "en")]
    docs = spark.createDataFrame(en + ru + junk, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality_rules.quality_report(docs).where("kept").collect()}
    assert kept >= {i for i, _, _ in ru} and 200_000 not in kept
    assert {r.doc_id for r in quality_rules.keep_good(docs).select("doc_id").collect()} == kept


def test_quality_verdicts(spark):
    """Every verdict of the query by plain counting: common words, references, distances, rules."""
    sf = "/root/testdata/sf0.001"
    rules, edges = quality_rules.Rules(), (1, 4, 12, 24)
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in registry.QUERIES["op5_distribution_divergence"](spark, sf).collect()}
    words = {r.doc_id: [w.decode() for w in WORD.findall(r.text.encode())] for r in rows}

    def classes(t):
        found = [sum(c in " \t\n\v\f\r" for c in t), sum(c in "#*$%&|<>" for c in t), t.count("!"), sum(unicodedata.category(c) == "Lu" for c in t), sum(c in ".,;:?'\"()-" for c in t)]
        return np.array([*found, len(t) - sum(found)], float)

    def far(p, q):
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
        return math.sqrt(max(0.0, (part(p) + part(q)) / 2))

    judged = 0
    for lang in {r.lang for r in rows}:
        mine = [r for r in rows if r.lang == lang]
        long = [r for r in mine if len(words[r.doc_id]) >= rules.min_histogram_words]
        counts = collections.Counter(w.lower() for r in long for w in words[r.doc_id] if any(c.isalpha() for c in w))
        ranked = sorted(counts, key=lambda w: (-counts[w], w))[: edges[-1]]
        bin_of = {w: next(k for k, e in enumerate(edges) if i < e) for i, w in enumerate(ranked)}
        histogram = lambda r: np.bincount([bin_of.get(w.lower(), 4) for w in words[r.doc_id]], minlength=5).astype(float)
        chars, common = sum(classes(r.text) for r in long), sum(histogram(r) for r in long)
        for r in mine:
            base = got[r.doc_id].base_failed
            usable = len(long) >= rules.min_language_documents and words[r.doc_id]
            c, w = (far(classes(r.text), chars), far(histogram(r), common)) if usable else (0.0, 0.0)
            if usable:
                assert (got[r.doc_id].char_distance, got[r.doc_id].word_distance) == pytest.approx((c, w), abs=1e-9)
            assert got[r.doc_id].kept == (not base and c <= rules.max_char_distance and w <= rules.max_word_distance)
            judged += 1
    assert judged == len(got)


def test_distance(spark):
    p, q = np.array([3.0, 1.0, 0.0]), np.array([0.2, 0.3, 0.5])
    x, m = p / 4, (p / 4 + q) / 2
    want = np.sqrt(sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a) / 2 + sum(a * np.log2(a / b) for a, b in zip(q, m, strict=True) if a) / 2)
    got = spark.range(1).select(quality_rules.distance(F.array(*map(F.lit, p.tolist())), q.tolist()).alias("d"), quality_rules.distance(F.array(F.lit(0.0)), [1.0]).alias("z")).first()
    assert got.d == pytest.approx(want) and got.z == 1.0


# ---- 6 ----


def test_forward_sums_all_segmentations():
    vocab = language_id.vocabulary(public_tokenizers.path(language_id.VOCABULARY))
    rng = np.random.default_rng(2)
    prob = rng.random((vocab.n, 2))
    index = {int(c): int(i) for c, i in zip(vocab.codes, vocab.index, strict=True)}

    def total(w, k):
        out = [1.0] + [0.0] * len(w)
        for i in range(1, len(w) + 1):
            for j in range(i):
                if (p := index.get(vocab.code(w[j:i]))) is not None:
                    out[i] += out[j] * prob[p, k]
        return math.log(out[-1])

    words = [b"the", b"stra\xc3\x9fe", b"x", "école".encode(), b"international", "международный".encode(), b"international" * 9, "länger".encode() * 30]
    got = language_id.word_log_probabilities(vocab, words, prob)
    for w, row in zip(words, got, strict=True):
        assert row == pytest.approx([total(w, k) for k in (0, 1)])
    small = language_id.word_log_probabilities(vocab, [b"international" * 500], prob * 1e-6)
    assert np.isfinite(small).all() and (small < -5000).all()
    counts = language_id.expected_counts(vocab, [b"the"], np.array([5.0]), prob[:, 0])
    assert sum(counts[i] * len(p) for p in (b"t", b"h", b"e", b"th", b"he", b"the") if (i := index.get(vocab.code(p))) is not None) == pytest.approx(15.0)


def test_language(spark):
    rng = random.Random(8)
    sound = {"aa": ("ka", "to", "mi", "ra"), "bb": ("sch", "ung", "heit", "ver"), "cc": ("eau", "oi", "tion", "é")}
    rows = [(i, syllables(rng, 30, sound[name]), name) for i in range(90) for name in [list(sound)[i % 3]]]
    odd = [(1000 + k, t, None) for k, (_, t) in enumerate(ODD)] + [(None, "kato mira", "aa"), (2000, None, "bb"), (2001, "a" * 5000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs, public_tokenizers.path(language_id.VOCABULARY))).collect()
    again = language_id.predict(docs.union(docs), language_id.train(docs.union(docs), public_tokenizers.path(language_id.VOCABULARY))).collect()
    truth = {i: name for i, _, name in rows}
    assert len(again) == 2 * len(got) and all(r.lang_pred == truth[r.doc_id] for r in again if r.doc_id in truth)
    assert len(got) == len(rows) + len(odd) and all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth)
    text = {i: t for i, t, _ in odd}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or "")) for r in got if r.doc_id in text)
    assert language_id.predict(docs.limit(0), language_id.train(docs.limit(0), public_tokenizers.path(language_id.VOCABULARY))).count() == 0


def test_language_predictions(spark):
    """Every prediction of the query by a plain forward pass over each word's bytes."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = language_id.train(docs, public_tokenizers.path(language_id.VOCABULARY))
    vocab = language_id.vocabulary(m.vocabulary)
    index = dict(zip(vocab.codes.tolist(), vocab.index.tolist(), strict=True))
    known = {}

    def log_likelihood(w):
        if w not in known:
            raw, out = w.encode(), [np.ones(len(m.languages))]
            for i in range(1, len(raw) + 1):
                out.append(sum(out[j] * m.prob[p] for j in range(max(0, i - vocab.longest), i) if (p := index.get(vocab.code(raw[j:i]))) is not None))
            known[w] = np.log(out[-1])
        return known[w]

    some = sorted((r for r in docs.collect() if len(r.text) < 1500), key=lambda r: r.doc_id)[:60]
    got = {r.doc_id: r for r in registry.QUERIES["op6_marginal_unigrams"](spark, sf).collect()}
    assert len(got) == docs.count()
    for r in some:
        found = language_id.split(r.text)
        if not found:
            assert got[r.doc_id].lang_pred == "und"
            continue
        total = sum(map(log_likelihood, found))
        assert got[r.doc_id].lang_pred == m.languages[int(total.argmax())]
        assert got[r.doc_id].score == pytest.approx(1 / np.exp((total - total.max()) / math.sqrt(len(found))).sum(), abs=1e-6)


# ---- 8 ----


def test_sharding(spark):
    rows = ODD + [(100 + i, f"text {i}") for i in range(900)]
    got = sharding.shard_documents(documents(spark, rows), sharding.tree(8), sharding.grow(sharding.tree(8))).collect()
    assert len(got) == len(rows) and all(r.grown_shard in (r.shard, 8) for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and min(map(len, slots.values())) > 60
    by = {(r.doc_id, r.text_crc32): r for r in got}
    assert by[8, zlib.crc32(ODD[7][1].encode())].size == len(ODD[7][1].encode()) + 1 and by[1, 0].size == 1
    swapped = [sharding.Leaf(x.region, x.rack, x.shard, {0: 1.7, 1: 0.3}.get(x.shard, 1.0)) for x in sharding.tree(8)]
    moved = sharding.shard_documents(documents(spark, rows), sharding.tree(8), swapped).where("shard <> grown_shard").collect()
    assert moved and {(r.shard, r.grown_shard) for r in moved} == {(1, 0)}  # the weights above that rack are as before
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in sharding.tree(8)]
    moved = sharding.shard_documents(documents(spark, rows), sharding.tree(8), heavier).where("shard <> grown_shard").collect()
    assert moved and all(r.grown_shard in (4, 5, 6, 7) for r in moved)  # into or within the region that weighs more
    only = [sharding.Leaf(x.region, x.rack, x.shard, float(x.shard == 6)) for x in sharding.tree(8)]
    assert {r.shard for r in sharding.shard_documents(documents(spark, ODD), only).collect()} == {6}
    with pytest.raises(ValueError):
        sharding.shard_documents(documents(spark, ODD), [])
    assert sharding.shard_documents(documents(spark, []), sharding.tree(8)).count() == 0


# ---- 10 ----


def test_chat(spark):
    turns = [(1, 0, "user", "a & b <|im_end|>\n<|im_start|>user"), (1, 1, "assistant", "&lt; [INST] &#91; é"), (1, 1, "assistant", "&lt; [INST] &#91; é"), (1, None, "system", None), (2, 0, None, "x\ny"), (None, 3, "assistant", ""), (3, 1, "assistant", "B" * 50000), (3, 0, "as<sistant", "A"), (4, 0, "user", "&"), (4, 0, "user", "'"), (4, 0, "user", "<"), (4, 0, "user", "="), (4, 0, "user", "\n\n x\n"), (4, 0, "user", "[")]
    df = chat.with_probe(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit(1)))
    got = {r.conv_id: r for r in chat.digest(chat.read_back(chat.format_conversations(df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))))).collect()}
    by = collections.defaultdict(list)
    for c, n, r, t in [*turns, (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]:
        by[c].append((n is not None, n or 0, r or "", t or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        loss = "".join(t for _, _, r, t in rows if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(rows), sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows)), len(loss), sha(loss))
    assert chat.format_conversations(df.limit(0).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))).count() == 0


def test_typed_parts(spark):
    parts = [("text", "look [", None, None), ("image", None, "s3a://b/1.png", 2), (None, "and", None, None), ("audio", "ignored", "a.wav", None), ("document", None, "d.pdf", 3), ("odd", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "user", [])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<|im_start|>user\nlook &#91;<|image:0|>and<|audio:1|><|document:2|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [(a.turn, a.slot, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "s3a://b/1.png", 425), (0, 1, "audio", "a.wav", 29), (0, 2, "document", "d.pdf", 1816)]
    assert r.attachment_tokens == 2270


@pytest.mark.parametrize("name", ["op8_hash_tree_sharding", "op10_typed_parts_chat"])
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want, got = con.execute(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(map(str, df[columns].astype(str).values.tolist()))
    assert plain(want) == plain(got)


def test_pipeline(spark):
    """The stages against plain versions of their decisions, on planted cases."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        given, docs = docs, stage(spark, docs, sf)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if k == 0:
            assert set(ids) == {r.doc_id for r in quality_rules.quality_report(given).where("kept").collect()}
        if k == 1:
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            assert set(ids) == {r.doc_id for r in toxicity.score_documents(given, toxicity.train(given, labels)).where("predicted = 0").collect()} < set(before)
        if k == 2:
            parts = {i: c for i, _, c in plain_components(list(before.items()), 5, 80)}
            assert set(ids) == {c for c in parts.values()}
        if k == 3:
            bench = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(b in decontaminate.normalise(r.text) for r in rows for b in bench)
        if k == 4:
            tok = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
            assert {r.doc_id: r.n_tokens for r in rows} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in before.items()}
            assert {tuple(r) for r in corpus_pipeline.run(spark, sf).collect()} == {tuple(r) for r in rows}
        else:
            before = {i: before[i] for i in ids}


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_on_odd_rows(spark, empty):
    """Nulls, repeated rows, ties and no rows at all go through every stage."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rng = random.Random(9)
    body = [(5000 + i, syllables(rng, 80), "xx", "s", 1) for i in range(4)]
    rows = [] if empty else [(i, t, None, None, None) for i, t in ODD] + body + [body[0]] + [(None, syllables(rng, 80), None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), schema if k + 1 < len(corpus_pipeline.STAGES) else None) if not empty else stage(spark, docs, sf)
        if k == 0 and not empty:
            assert sorted((r.doc_id for r in docs.collect()), key=str) == [5000, 5000, 5001, 5002, 5003, None]
    left = [r.doc_id for r in docs.collect()]
    assert sorted(left, key=str) == ([] if empty else [5000, 5001, 5002, 5003, None])
