"""Divergence audit, language model and importance resampling against brute force and cases at the edges."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("cadenza.llm")
from cadenza.llm import divergence, hidden_markov, importance, lm_scoring  # noqa: E402
from cadenza.llm.hidden_markov import Batch, Counts, Model  # noqa: E402

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FEATURES = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(pattern, text):
    return pattern.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(5)
    vocabulary = ["the", "The", "of", "É", "ß", "don't", "x1", "漢字", "a-b", "42", "ﬁ"] + [f"w{chr(97 + i % 26)}{i}" for i in range(200)]
    rows = []
    for i in range(90):
        lang, source = draw.choice(["en", "en", "de", None]), draw.choice(["s0", "s0", "s1", "s2", None, ""])
        n = draw.choice([0, 3, 25, 60, 200])
        rows.append((i, " ".join(draw.choice(vocabulary[: draw.choice([20, 211])]) for _ in range(n)), lang, source))
    rows += [(200, None, "en", "s1"), (201, "", "fr", "only"), (202, " \t\n\x0b", "it", "a"), (203, "12 34 5", "it", "b"), (None, "a b c " * 10, "en", "s0"), (None, None, None, None)]
    rows += [(204, "the of " * 40_000, "en", "s0"), (205, "y" * 200_000 + " " + "z" * 70, "en", "s3")] + [(206, "the of and of", "en", "s1")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("term", F.lit("t")).withColumn("row", F.lit(1)).withColumn("part", F.lit(2)).withColumn("n", F.lit(3)).withColumn("rank", F.lit(4)).repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]


def brute_audit(plain, least, most_rank):
    counts, spread, groups = {}, {}, set()
    for _, text, lang, source in plain:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = words_of(TERMS, text)
        for w, n in Counter(words).items():
            counts[lang, source, w] = counts.get((lang, source, w), 0) + n
            spread[lang, w] = spread.get((lang, w), 0) + 1
    out = set()
    for lang in {g for g, _ in groups}:
        kept = [w for (g, w), d in spread.items() if g == lang and d >= least]
        sources = sorted(s for g, s in groups if g == lang)
        own = {s: {w: counts.get((lang, s, w), 0) for w in kept} for s in sources}
        whole = {w: sum(own[s][w] for s in sources) for w in kept}
        p = lambda c: {w: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for w, n in c.items()}
        shares, q = {s: p(own[s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(sum(abs(shares[s][w] - shares[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(shares[s][w] - q[w], w) for w in kept if own[s][w] and shares[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, most_rank)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered, 1)}
    return out


@pytest.mark.parametrize("least,most_rank,cells", [(5, 50, 1 << 20), (2, 3, 8), (1000, 50, 8)])
def test_divergence_audit(docs, plain, least, most_rank, cells, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    monkeypatch.setattr(divergence, "HELD_TERMS", cells * 4)
    monkeypatch.setattr(divergence, "PART_BYTES", 50)
    out = divergence.audit(docs, least, most_rank)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(plain, least, most_rank)


def test_divergence_of_an_empty_table(docs):
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_beyond_64_bits():
    n = np.array([0, 10**11, 10**12])
    assert divergence._shares(n, 10**12, 3, 5).tolist() == [1 + 10**9 * (int(x) + 5) // (10**12 + 15) for x in n]


def test_run_bounds_against_cells():
    draw = np.random.default_rng(1)
    counts, lengths = np.sort(draw.integers(0, 4, (60, 5)), axis=0), draw.integers(1, 9, 60)
    totals = (counts * lengths[:, None]).sum(axis=0).tolist()
    shares = np.stack([divergence._shares(counts[:, s], totals[s], int(lengths.sum()), 5) for s in range(5)], axis=1)
    got = divergence.pair_sums(counts, lengths, totals, int(lengths.sum()))
    for a, b in itertools.combinations(range(5), 2):
        assert got[a, b] == (np.abs(shares[:, a] - shares[:, b]) * lengths).sum()


def random_model(k, symbols, seed):
    draw = np.random.default_rng(seed)
    return Model(draw.dirichlet(np.ones(k)), draw.dirichlet(np.ones(k), k), draw.dirichlet(np.ones(symbols), k).T)


def plain_counts(model, sequence):
    """Forward and backward without scaling, step by step."""
    a = [model.start * model.emits[sequence[0]]]
    for s in sequence[1:]:
        a.append(a[-1] @ model.moves * model.emits[s])
    b = [np.ones(len(model.start))]
    for s in sequence[:0:-1]:
        b.append(model.moves @ (model.emits[s] * b[-1]))
    b = b[::-1]
    total = a[-1].sum()
    out = Counts(a[0] * b[0] / total, np.zeros_like(model.moves), np.zeros_like(model.emits), math.log(total))
    for t, s in enumerate(sequence):
        out.emits[s] += a[t] * b[t] / total
        if t:
            out.moves += np.outer(a[t - 1], model.emits[s] * b[t]) * model.moves / total
    return out


@pytest.mark.parametrize("segment,group", [(2048, 500_000), (7, 40), (1, 3)])
def test_recursions_against_plain_ones(segment, group, monkeypatch):
    monkeypatch.setattr(hidden_markov, "SEGMENT", segment)
    monkeypatch.setattr(hidden_markov, "GROUP", group)
    model, draw = random_model(3, 6, 0), np.random.default_rng(2)
    sequences = [draw.integers(0, 6, n).astype(np.int32) for n in (1, 2, 7, 8, 40, 1, 90, 14)]
    want = [plain_counts(model, s) for s in sequences]
    total, logs = Counts(np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))), []
    for run in hidden_markov.batches(iter(sequences)):
        Batch(model, run, True).count(total)
        logs += Batch(model, run, False).logs().tolist()
    assert np.allclose(logs, [w.log for w in want])
    for name in ("start", "moves", "emits", "log"):
        assert np.allclose(getattr(total, name), sum(getattr(w, name) for w in want)), name


def test_likelihoods_of_all_sequences_sum_to_one():
    model = random_model(4, 3, 3)
    every = [np.array(s, np.int32) for s in itertools.product(range(3), repeat=4)]
    assert np.isclose(np.exp(Batch(model, every, False).logs()).sum(), 1)


def test_baum_welch_never_loses_likelihood_and_finds_states():
    draw, logs = np.random.default_rng(4), []
    texts = [draw.integers(0, 10, 60) + 10 * (n % 2) for n in range(60)]
    model = lm_scoring.first_model(np.full(20, 0.05), 2)
    for _ in range(12):
        total = Counts(np.zeros(2), np.zeros((2, 2)), np.zeros((20, 2)))
        Batch(model, texts, True).count(total)
        logs.append(total.log)
        model = Model(total.start / total.start.sum(), total.moves / total.moves.sum(axis=1, keepdims=True), total.emits / total.emits.sum(axis=0))
    assert (np.diff(logs) > -1e-6).all() and logs[-1] / 3600 > -2.35  # ln 10 = 2.303 a token, where one state gives ln 20 = 2.996


def brute_base(plain):
    tokens = [[*words_of(SPACED, t), "\n"] for _, t, *_ in plain]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in plain]
    counts = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (str(i), h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 5)) for (i, *_), t, h in zip(plain, tokens, held)
    ), counts, held


@pytest.mark.parametrize("most", [10_000, 30, 1])
def test_scores_of_texts(docs, plain, most, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HELD_WORDS", 50)
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 1000)
    want, counts, held = brute_base(plain)
    assert any(held)
    out = lm_scoring.score_texts(docs, states=2, rounds=2, most_symbols=most).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out) == want
    assert all(r["score"] < 0 for r in out)


@pytest.mark.parametrize("most", [10_000, 30])
def test_one_state_is_the_common_distribution(docs, plain, most):
    """With one state the score of a text is that of its tokens' smoothed shares, by which all tokens and the unknown one sum to 1."""
    _, counts, _ = brute_base(plain)
    words, own = lm_scoring.frequent(lm_scoring.word_counts(docs.filter(~lm_scoring.held_out(F.col("doc_id")))), most)
    symbols = {w.decode(): int(n) for w, n in zip(words, own)}
    assert len(symbols) <= most + 1 and all(counts[w] == n for w, n in symbols.items()) and words[0] == b"\n"
    n, once, rest = sum(counts.values()), sum(c == 1 for c in counts.values()), [c for w, c in counts.items() if w not in symbols]
    share = lambda c, more: 0.95 * c / (n + once) + 0.05 * (c + more) / (n + once + 0.5)
    last, below = share(sum(rest) + once, 0.5), sum(c + 0.5 for c in rest) + once + 0.5
    p = {w: share(c, 0) if w in symbols else last * (c + 0.5) / below for w, c in counts.items()}
    unknown = last * (once + 0.5) / below
    assert abs(sum(p.values()) + unknown - 1) < 1e-9
    want = sorted((str(i), round(sum(math.log10(p.get(w, unknown)) for w in [*words_of(SPACED, t), "\n"]), 2)) for i, t, *_ in plain)
    got = sorted((str(r["doc_id"]), r["score"]) for r in lm_scoring.score_texts(docs, states=1, rounds=1, most_symbols=most).collect())
    assert all(a == b and abs(x - y) <= 0.006 + 1e-5 * abs(x) for (a, x), (b, y) in zip(want, got))


def test_language_model_beats_the_base_on_held_out_texts(spark, sf_dir):
    out = lm_scoring.score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("held_out and n_tokens > 20").toPandas()
    assert (out["score"] > out["base_score"]).mean() > 0.9 and (out["score"] <= 0).all()


def test_scores_without_training_rows(docs):
    assert lm_scoring.score_texts(docs.limit(0)).count() == 0
    out = lm_scoring.score_texts(docs.filter(lm_scoring.held_out(F.col("doc_id")))).collect()
    assert out and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] == 0 for r in out)


def brute_resample(plain, target, most_run, percent):
    def buckets(text):
        w = words_of(FEATURES, text)
        return [zlib.crc32(" ".join(w[a : a + n]).encode()) % 10000 for n in range(1, most_run + 1) for a in range(len(w) - n + 1)], len(w)

    own, aim = Counter(), Counter()
    for _, text, *_ in plain:
        own.update(buckets(text)[0])
    for text in target:
        aim.update(buckets(text)[0])
    s, t = sum(own.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000))))
    rows = []
    for i, text, *_ in plain:
        found, n = buckets(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("most_run,percent", [(1, 10), (3, 60)])
def test_importance_resampling(spark, docs, plain, most_run, percent, monkeypatch):
    monkeypatch.setattr(importance, "SCAN_BYTES", 300)
    aims = ["the of X1", None, "É ß 漢字 the, of", "never seen elsewhere"]
    target = spark.createDataFrame([(t, 1) for t in aims], "text string, n int")
    got = importance.resample(docs, target, most_run, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got, want = sorted((tuple(r) for r in got.collect()), key=str), brute_resample(plain, aims, most_run, percent)
    # Of rows alike any may be drawn.
    assert [r[:4] for r in got] == [r[:4] for r in want] and Counter(r[4] for r in got) == Counter(r[4] for r in want)
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0)).filter("weight is null or n_features is null").count() == 0


def test_dictionary_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(importance, "MOST_KNOWN", 1500)
    monkeypatch.setattr(importance, "MOST_FRESH", 4000)
    own, draw = importance.Dictionary(), random.Random(1)
    for n in range(40):
        words = [draw.choice(["the", "of", f"w{draw.randrange(n * 100, n * 100 + 3000)}"]) for _ in range(3000)] + ["q" * 60]
        got = own.scan(" " + " ".join(words) + " ")
        assert got.tolist() == [zlib.crc32(w.encode()) << 31 | len(w) for w in words]
        assert len(own.words) <= 1500
    assert len(own.words) > 500


def test_checksums_compose():
    draw = np.random.default_rng(0)
    pairs = [(draw.bytes(int(a)), draw.bytes(int(b))) for a, b in draw.integers(0, 200, (60, 2))]
    first, then = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    assert importance.combine(first, then, np.array([len(b) for _, b in pairs])).tolist() == [zlib.crc32(a + b) for a, b in pairs]
