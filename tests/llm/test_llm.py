"""The training-data operators against brute force, round trips and cases at the edges."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("cadenza.llm")
import corpus_pipeline  # noqa: E402
from cadenza.llm import bpe, components, exact_dedup, exchange, fm_index, html_text, kernels, licenses, mixing, mpeg_audio, near_dedup, queries, substring_dedup, token_files, toxicity  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def make_texts(n=60, seed=3):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß", "don't", "x1", "漢字"]
    base = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 120))) for _ in range(n // 3)]
    out = list(base)
    for t in base:
        w = t.split()
        w[draw.randrange(len(w))] = "changed"
        out.append(" ".join(w))
        out.append("Intro " + t.upper() if draw.random() < 0.5 else " \n".join(t.split()))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = make_texts()
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, t, "src%d" % (i % 4)) for i, t in enumerate(texts)]
    rows += [(100, f"a b {passage} c", "src0"), (101, f"{passage} tail", None), (102, passage, "src1"), (102, passage, "src1"), (103, passage.upper(), "src1")]
    rows += [(None, texts[0], "src0"), (None, None, None), (104, None, "src2"), (105, "", "src2"), (106, " \t\n", "src2"), (107, "one two", "z"), (108, "One two", "z"), (109, "word " * 30_000, "z"), (110, "you idiot moron scum", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # Further columns with names that operators use within.
    return df.withColumn("sender", F.lit("s")).withColumn("kept", F.lit(1)).withColumn("size", F.lit(2)).withColumn("component_id", F.lit(3)).repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words_of(text):
    return WORDS.findall(text or "")


def test_rice_codes_round_trip():
    for n, universe in ((0, 100), (1, 1), (1, 1 << 40), (500, 1000), (500, 1 << 48)):
        values = np.array(sorted(random.Random(n).sample(range(universe), n)) if universe < 1 << 20 else sorted({random.Random(i).randrange(universe) for i in range(n)}), np.uint64)
        k, code = exchange.rice_encode(values, universe)
        assert (exchange.rice_decode(len(values), k, code) == values).all()


def test_exact_duplicates(docs, plain, empty):
    norm = lambda t: (t or "").translate(LOWER)
    groups = {}
    for i, t, _ in plain:
        groups.setdefault(norm(t), []).append(i)
    out = exact_dedup.exact_duplicates(docs).collect()
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(out) == len(plain)
    for r in out:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in out) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def brute_components(plain):
    sets, parent = {}, {}
    for i, t, _ in plain:
        w = words_of((t or "").translate(LOWER))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(s)
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [1_000_000, 200])
def test_near_duplicates(docs, plain, empty, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", max(2, block // 1000))
    want = brute_components(plain)
    out = near_dedup.near_duplicates(docs).collect()
    assert len(out) == len(plain)
    for r in out:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    if block == 200:
        assert near_dedup.near_duplicates(empty).count() == 0


def test_chain_in_one_bucket(spark):
    """A member that is unlike the bucket's smallest but like another one is linked by the block comparison."""
    words = [f"v{i}" for i in range(400)]
    rows = [(n, " ".join(words[n * 30 : n * 30 + 200])) for n in range(4)]
    want = brute_components([(i, t, None) for i, t in rows])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_recall_near_the_threshold(spark):
    """Pairs with a similarity of 0.75 to 0.80, all of which must be found, and of 0.70 to 0.75, none of which may be."""
    draw, rows, linked = random.Random(5), [], 0
    for n in range(400):
        words = [f"a{draw.randrange(10**6)}" for _ in range(draw.randint(60, 300))]
        other = list(words)
        at, size = draw.randrange(len(words) - 50), 0
        sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, other)]
        goal = draw.choice([0.71, 0.735, 0.752, 0.76, 0.78])
        while len(sets[0] & sets[1]) / len(sets[0] | sets[1]) > goal + 0.015 or not size:
            other[(at + 3 * size) % len(other)] = f"b{draw.randrange(10**6)}"
            size += 1
            sets[1] = {tuple(other[k : k + 5]) for k in range(len(other) - 4)}
        link = 100 * len(sets[0] & sets[1]) >= 75 * len(sets[0] | sets[1])
        linked += link
        rows += [(2 * n, " ".join(words), 2 * n), (2 * n + 1, " ".join(other), 2 * n + (not link))]
    out = near_dedup.near_duplicates(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert linked > 100 and {r["doc_id"]: r["component_id"] for r in out} == {i: c for i, _, c in rows}


def test_word_hashes_do_not_depend_on_the_slice(monkeypatch):
    text = ("one two  three " + "x" * 700 + " four five " + "yz" * 400).encode()
    raw, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, ends, _ = kernels.find_words(raw, offsets)
    want = kernels.hash_words(raw, starts, ends, lower=True)
    assert len(set(want.tolist())) == 7
    for size in (1000, 200, 16):
        monkeypatch.setattr(kernels, "SLICE_BYTES", size)
        assert (kernels.hash_words(raw, starts, ends, lower=True) == want).all()


def test_superminhash_estimates_similarity():
    a = np.unique(kernels.mix(np.arange(1000, dtype=np.uint64)))
    b = np.unique(kernels.mix(np.arange(250, 1250, dtype=np.uint64)))
    small = np.unique(kernels.mix(np.arange(3, dtype=np.uint64)))
    sig = near_dedup.superminhash([a, b, small, small[:1]])
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15 and (near_dedup.superminhash([a])[0] == sig[0]).all()
    # Every place has its own step for a set of one.
    assert sorted((sig[3] >> np.uint64(56)).tolist()) == list(range(128))


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(n, n + 1) for n in range(100, 130)]
    parent = {x: x for e in edges for x in e}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def brute_repeats(plain):
    first, out = {}, []
    for i, t, _ in plain:
        w = words_of(t)
        for k in range(len(w) - 12) if i is not None else ():
            q = tuple(w[k : k + 13])
            first[q] = min(first.get(q, i), i)
    for i, t, _ in plain:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out.append((str(i), len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [5000, 0])
def test_repeats(docs, plain, empty, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    if hot == 0:  # several chunks and shards, too
        monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", 300)
        monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 2_000)
    out = [(str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(out) == brute_repeats(plain)
    if hot == 0:
        assert substring_dedup.remove_repeats(empty).count() == 0


def test_fm_index():
    draw = np.random.default_rng(0)
    text = np.append(draw.integers(1, 4, 300), 0)
    suffixes = fm_index.sorted_suffixes(text, 5)
    index = fm_index.FMIndex(text, suffixes, 4, 5)
    assert (index.wavelet.access(np.arange(len(text))) == text[suffixes - 1]).all()
    stream = draw.integers(1, 4, 80)
    ends = np.arange(4, 80)
    length, low, high = index.matches(stream, ends)
    at = lambda p: [k for k in range(len(text) - len(p) + 1) if (text[k : k + len(p)] == p).all()]
    for e, n, a, b in zip(ends, length, low, high):
        # The longest match with two suffixes, and all suffixes that have it.
        assert n == max(m for m in range(6) if m == 0 or len(at(stream[e - m + 1 : e + 1])) > 1)
        assert sorted(suffixes[a:b].tolist()) == at(stream[e - n + 1 : e + 1])


def test_token_files(spark, docs, plain, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    full = Tokenizer.from_file(path)
    got = sorted(token_files.token_files(docs, path).collect(), key=lambda r: r["start"])
    at, ids_order = 0, []
    left = {}
    for i, t, _ in plain:
        ids = np.array(full.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        left.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in left[r["doc_id"]]
        left[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        at += r["n_tokens"]
        ids_order.append(-1 if r["doc_id"] is None else r["doc_id"])
    assert ids_order == sorted(ids_order) and not any(left.values())
    assert token_files.token_files(empty, path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_bpe_like_the_library(spark, docs, plain, empty, name):
    from tokenizers import Tokenizer

    path = queries.tokenizer(name)
    full = Tokenizer.from_file(path)
    odd = ["it's I'LL don't a<|endoftext|>b <|startoftext|>", "İstanbul ΑΣ Σ ́x 漢字 \x1f a\x1cb \x85 c", "😀😀 a1b22c३ ...!!", "ﬁ Å ​ x　y 'veabc"]
    own = bpe.encoder(path)
    for text in odd + [t or "" for _, t, _ in plain]:
        ids = full.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert next(own.digests([text])) == (len(ids), " ".join(map(str, ids)), full.decode(ids, skip_special_tokens=False))
    out = bpe.bpe_digests(docs, path)
    assert out.count() == len(plain) and bpe.bpe_digests(empty, path).count() == 0
    back = bpe.encode_texts(docs.filter("doc_id = 107"), path).select(bpe.decode_ids(F.col("ids"), path).alias("t")).first()["t"]
    assert back == full.decode(full.encode("one two", add_special_tokens=False).ids, skip_special_tokens=False)


def test_cuts_are_forced():
    own = bpe.encoder(queries.tokenizer("word_bpe_49k.json"))
    pieces = ["jqzjqx", "hello"]
    assert own.encode_pieces(pieces) == [own.last.encode(p, add_special_tokens=False).ids for p in pieces]
    assert not own.inside[:, 0x20].any() and not own.inside[0x20].any()


def test_mixing(docs, plain, empty):
    out = mixing.mix_sources(docs).collect()
    sizes = {}
    for _, t, s in plain:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    target = {s: sum(sizes.values()) * weight[s] / sum(weight.values()) for s in order}
    while any(target[s] > 3 * sizes[s] + 1e-6 for s in order):
        excess = sum(max(0, target[s] - 3 * sizes[s]) for s in order)
        full = {s for s in order if target[s] >= 3 * sizes[s] - 1e-9}
        target = {s: min(target[s], 3 * sizes[s]) for s in order}
        rest = sum(weight[s] for s in order if s not in full)
        target = {s: t if s in full else t + excess * weight[s] / rest for s, t in target.items()}
    taken = {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    largest = {s: max(len(words_of(t)) for _, t, x in plain if x == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, mixing.mix_sources(docs.repartition(5)).collect()))
    assert mixing.mix_sources(empty).count() == 0


def test_flight_keeps_totals():
    draw = np.random.default_rng(5)
    pi, size = np.full(500, 0.37), np.sort(draw.integers(1, 900, 500))[::-1].astype(float)
    x = mixing._fly(pi, size, draw)
    assert ((x > 0) & (x < 1)).sum() <= 2 and abs(x.sum() - pi.sum()) < 3 and (x * size).sum() == pytest.approx((pi * size).sum())
    for size in (np.full(9, 7.0), np.zeros(9), np.array([50.0] + [1.0] * 8)):
        x = mixing._land(mixing._fly(np.full(9, 0.37), size, draw), size, draw)
        assert set(x) <= {0.0, 1.0}


def test_every_document_keeps_its_probability():
    size = np.array([900, 700, 300, 200, 150, 100, 90, 50, 20, 10], float)
    pi = np.array([0.37] * 5 + [0.6] * 5)
    taken = np.array([mixing._land(mixing._fly(pi, size, rng), size, rng) for rng in map(np.random.default_rng, range(3000))])
    assert np.abs(taken.mean(axis=0) - pi).max() < 0.035  # four standard deviations
    # With more documents the words taken are far nearer to their total than by draws of each alone.
    size = np.sort(np.random.default_rng(1).integers(5, 2000, 60))[::-1].astype(float)
    pi = np.full(60, 0.37)
    taken = np.array([mixing._land(mixing._fly(pi, size, rng), size, rng) for rng in map(np.random.default_rng, range(300))])
    alone = np.random.default_rng(0).random((300, 60)) < pi
    miss = lambda t: np.abs((t * size).sum(axis=1) - (pi * size).sum()).mean()
    assert miss(taken) < 0.1 * miss(alone)


def test_mix_of_alike_rows(spark):
    rows = [(1, "a b c", "s")] * 7 + [(k, "w " * (k % 5 + 1), "s" if k % 2 else None) for k in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("m_id", "m_copies", "m_turn", "row", "copies", "turn", "alike")}).repartition(3)
    mixed = mixing.mix_sources(df)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    count = lambda d, c: {tuple(r)[:2]: r["n"] for r in d.groupBy("doc_id", "source").agg(c.alias("n")).collect() if r["n"]}
    assert count(out, F.count("*")) == count(mixed, F.sum("copies"))


@pytest.mark.parametrize("stage", ["exact", "near", "toxic"])
def test_columns_that_clash(spark, docs, stage):
    clash = docs.withColumns({c: F.lit("x") for c in ("__id", "k_id", "k_sha", "id", "own_id", "own_sha", "row", "t_id", "a.b", "score", "norm", "l_id", "label")})
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0)], "doc_id long, toxic int").withColumn("text", F.lit("y"))
    drop = {"exact": exact_dedup.drop_exact_duplicates, "near": near_dedup.drop_near_duplicates, "toxic": lambda d: toxicity.drop_toxic(d, labels)}[stage]
    out = drop(clash)
    assert out.columns == clash.columns and out.count() == drop(docs).count()


def test_mixing_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 20)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    out = mixing.mix_sources(df)
    r = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert sum(x["n"] for x in r) == 400 and all(abs(x["taken"] - x["target"]) < 0.02 * x["target"] for x in r)


def test_media_round_trip(docs, plain, empty):
    out = mpeg_audio.media_digests(docs).collect()
    assert len(out) == len(plain)
    want = {}
    for i, t, _ in plain:
        p = (t or "").encode()
        p = p + b"\0" * (-len(p) % 64 if p else 64)
        want.setdefault(i, set()).add((len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    for r in out:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]] and "crc=0/" not in r["feature"] and "skipped=0" in r["feature"]
    assert mpeg_audio.media_digests(empty).count() == 0


def test_audio_parser(spark):
    stream = mpeg_audio.write(mpeg_audio.pad(b"abc" * 1000))
    begin = stream.index(b"\xff\xfb")
    audio = mpeg_audio.parse(stream)
    assert audio.seconds == pytest.approx(4 * 1152 / 48000) and audio.table == "Xing" and audio.table_frames == 4 and audio.failed == 0 and audio.tags == {"TSSE": "cadenza"}
    cut = begin + 192 + 960
    noisy = mpeg_audio.parse(b"junk\xff\xe0" + stream[begin:cut] + b"garbage!" + stream[cut:])
    assert len(noisy.offsets) == 4 and noisy.skipped == 14
    broken = bytearray(stream)
    broken[begin + 192 + 10] ^= 1
    assert mpeg_audio.parse(bytes(broken)).failed == 1
    old = mpeg_audio.parse(stream[begin:] + b"TAG" + b"Song".ljust(30, b"\0") + bytes(95))
    assert old.tags == {"TIT2": "Song"} and len(old.offsets) == 4
    rows = spark.createDataFrame([(1, bytearray(stream)), (2, None), (3, bytearray(b"none"))], "id long, media binary")
    got = {r["id"]: r for r in mpeg_audio.audio_columns(rows, "id", "media").collect()}
    assert got[1]["n_frames"] == 4 and got[1]["bitrate_mode"] == "vbr" and got[2]["n_frames"] == got[3]["n_frames"] == 0 and got[2]["seconds"] == 0


def test_html_text(spark):
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><p>Site header.</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies.</p></div><div id="sidebar"><p>Links of the side.</p></div>
    <main><article><h1>Head &amp; line</h1><p>First  paragraph,<br>with <b>bold</b> text.<p>Of.</p><ul><li>An item, listed.</li></ul><form><input><p>Sign up.</p></form>
    <div class="comments"><p>I disagree, said the reader at some length, for many good reasons.</p></div></article></main><footer>&copy; 2025</footer>"""
    assert html_text.main_text(page) == "Head & line\nFirst paragraph, with bold text.\nOf.\nAn item, listed."
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>Only text, here.")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract_text(rows).collect()}
    assert got[2]["text"] == got[3]["text"] == "" and got[None]["text"] == "Only text, here." and got[1]["n_chars"] == len(got[1]["text"])


def test_licenses(spark):
    rows = [(1, "Some text.\nReleased under the MIT License.\nmore"), (2, "Licensed under the\nApache License, Version 2.0."), (3, None), (4, ""), (5, "word"), (6, "licensed under CC BY-NC 4.0")]
    got = {r["doc_id"]: [(m["passage"], m["license"]) for m in r["matches"]] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(2, "MIT")], 2: [(0, "Apache-2.0")], 3: [], 4: [], 5: [], 6: [(1, "CC-BY-NC-4.0")]}
    low, high = licenses.size_bounds(10, 85)
    assert all((2 * min(n, 10) * 100 >= 85 * (n + 10)) == (low <= n <= high) for n in range(1, 40))


def test_toxicity(spark, sf_dir, docs, empty):
    table, labels = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    out = toxicity.toxicity(table, labels)
    known = out.join(labels, "doc_id").filter("held_out").toPandas()
    assert ((known.predicted == known.toxic).mean()) > 0.9 and (known[known.toxic == 0].predicted.mean()) < 0.1
    machine = toxicity.learn(table, labels)
    scored = {r["doc_id"]: r for r in docs.select("doc_id", toxicity.score(F.col("text"), machine).alias("s")).collect()}
    assert scored[110]["s"] > 0.3 > scored[105]["s"] and all(0 <= r["s"] <= 1 for r in scored.values())
    # Against the same fit without factors: no worse, and far above what "never toxic" or chance would give.
    table, labels = (spark.read.parquet(f"{sf_dir}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    machine, plain_ = toxicity.learn(table, labels), toxicity.learn(table, labels, factors=0)
    rows = table.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).select("text", "toxic").toPandas()
    sets = [toxicity.term_buckets(*_buffers(t))[0] for t in rows["text"]]
    with_, without = (m.scores(sets) for m in (machine, plain_))
    y = rows["toxic"].to_numpy()
    assert ((with_ >= 0.3)[y == 1]).mean() >= max(0.7, ((without >= 0.3)[y == 1]).mean()) and auc(y, with_) >= max(0.95, auc(y, without) - 0.005)
    twice = labels.withColumn("toxic", F.lit(0)).union(labels)  # of several labels 1 counts
    assert (toxicity.learn(table, twice).scores(sets) == with_).all()
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(docs, labels.limit(0)).select("score").distinct().count() == 1


def _buffers(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def auc(y, score):
    ranks = pd.Series(score).rank().to_numpy()
    return (ranks[y == 1].mean() - (y.sum() + 1) / 2) / (y == 0).sum()


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_factors_learn_what_weights_cannot(seed):
    """The label is the exclusive or of two terms, neither of which says anything alone."""
    draw = np.random.default_rng(seed)
    def make(n):
        sets, y = [], []
        for _ in range(n):
            a, b = draw.random(2) < 0.5
            sets.append(np.unique(np.array([10] * bool(a) + [20] * bool(b) + [30] + draw.integers(100, 500, 8).tolist(), np.int32)))
            y.append(int(a != b))
        return sets, np.array(y)
    (sets, y), (other, want) = make(1200), make(400)
    with_, without = toxicity.fit(sets, y), toxicity.fit(sets, y, factors=0)
    assert auc(want, with_.scores(other)) > 0.99 and auc(want, without.scores(other)) < 0.7
    assert {10, 20} <= set(with_.buckets.tolist())


def test_machine_learns_pairs():
    """Two terms that say nothing alone and 1 together."""
    draw = np.random.default_rng(0)
    sets, y = [], []
    for _ in range(600):
        a, b = draw.random(2) < 0.5
        sets.append(np.array(sorted([10] * bool(a) + [20] * bool(b) + [30]), np.int32))
        y.append(int(a and b))
    machine = toxicity.fit(sets, np.array(y))
    both, one = machine.scores([np.array([10, 20, 30], np.int32), np.array([10, 30], np.int32)])
    assert both > 0.6 > 0.4 > one


def test_pipeline_of_odd_documents(spark, sf_dir, docs, plain, empty):
    """Nulls in any column, empty and long texts, repeated rows: every stage answers, with all columns, and so does an empty table."""
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, sf_dir)
        assert out.columns == docs.columns, name
        left = out.cache()
        assert left.count() > 0
        assert stage(spark, empty, sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, left, sf_dir).count() == left.count()
    texts = [r["text"] for r in left.collect()]
    assert sum(t is not None and t.startswith("word word") for t in texts) <= 3 and sum(not t for t in texts) <= 3


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = out.cache()
    assert 0 < corpus_pipeline.run(spark, sf_dir).count() == docs.count()
