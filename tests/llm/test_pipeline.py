"""The pipeline's rows against each stage done by brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("cadenza.llm")
import corpus_pipeline  # noqa: E402
from cadenza.llm import toxicity  # noqa: E402
from cadenza.llm.queries import tokenizer  # noqa: E402

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall(text.translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def first_of_components(rows):
    """Of each group of near duplicates the smallest doc_id, by comparing all pairs."""
    ids = sorted(rows)
    sets, parent = {i: shingles(rows[i]) for i in ids}, {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i for i in ids if find(i) == i}


def targets(sizes):
    """Words of each source in the mix: shares by weight, none above three times its size, the rest shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    total, out, free = float(sum(sizes.values())), {}, list(names)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 3.0 * sizes[s] for s in full}
        free = [s for s in free if s not in full]
    return out


def test_pipeline_against_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: (r["text"] or "", r["source"]) for r in docs.collect()}
    machine = toxicity.learn(docs, labels)
    raw = {i: np.frombuffer(t.encode(), np.uint8) for i, (t, _) in rows.items()}
    clean = {i for i in rows if machine.scores([toxicity.term_buckets(raw[i], np.array([0, len(raw[i])]))[0]])[0] < toxicity.THRESHOLD}
    last = {}
    for i in sorted(clean):
        last[rows[i][0].translate(LOWER)] = i
    left = first_of_components({i: rows[i][0] for i in last.values()})
    assert 0 < len(left) < len(last) <= len(clean) < len(rows)

    size = {i: len(WORDS.findall(rows[i][0])) for i in left}
    sizes = Counter()
    for i in left:
        sizes[rows[i][1]] += size[i]
    own = corpus_pipeline.run(spark, sf_dir).collect()
    taken = Counter(r["doc_id"] for r in own)
    assert set(taken) <= left and max(taken.values()) <= 3
    for source, target in targets(sizes).items():
        largest = max(size[i] for i in left if rows[i][1] == source)
        assert abs(sum(n * size[i] for i, n in taken.items() if rows[i][1] == source) - target) <= largest, source

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    for r in own:
        ids = library.encode(rows[r["doc_id"]][0], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_scores_by_all_pairs_of_terms(spark, sf_dir):
    """The scores that Spark gives are those of the machine's formula, pair by pair, over whole texts."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.learn(docs, labels)
    place = {int(b): k for k, b in enumerate(machine.buckets)}
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    rows = docs.limit(60).collect()
    for r in rows:
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        own = [place[int(b)] for b in toxicity.term_buckets(raw, np.array([0, len(raw)]))[0] if int(b) in place]
        odds = machine.bias + sum(machine.weights[k] for k in own)
        odds += sum(float(machine.vectors[a] @ machine.vectors[b]) for n, a in enumerate(own) for b in own[:n])
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-9)
