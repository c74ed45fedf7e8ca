"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so a text may be cut
there; the fragments are encoded independently and their ids concatenated. White space occurs inside no token
of a vocabulary with word ends, which gives the first cuts; inside words the table of byte pairs gives more.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common

#: Words of a generation of a worker's memory, which has two; this bounds its memory, not its results.
CACHE_WORDS = 100_000
#: Bytes of text encoded at once; a longer text is encoded alone, whole.
CHUNK_BYTES = 1 << 20
#: Pre-tokens handed to the library at once.
PIECES = 4_000


def byte_letters() -> dict[str, int]:
    """The byte that each letter of the byte-level alphabet stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def chunks(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    """The texts in runs of about `most` bytes."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def batched(tokenizer, pieces: list[str]) -> Iterator[list[int]]:
    """Ids of each of many pieces, few of the library's results being held at a time."""
    for a in range(0, len(pieces), PIECES):
        for found in tokenizer.encode_batch_fast(pieces[a : a + PIECES], add_special_tokens=False):
            yield found.ids


class ForcedBoundaryBPE:
    """Encodes as the tokenizers library does with the file `path`, unused truncation and padding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.letters = byte_letters()
        #: inside[a, b]: bytes a, b stand next to each other in some token.
        self.inside = np.zeros((256, 256), bool)
        for token in vocab:
            if token in special:
                continue
            plain = token.removesuffix(self.suffix) if self.suffix else token
            codes = [self.letters[c] for c in plain if c in self.letters]
            self.inside[codes[:-1], codes[1:]] = True
        self.to_bytes = {ord(c): b for c, b in self.letters.items()}
        self.to_letters = {b: c for c, b in self.letters.items()}
        # Of a word's fragments only the last has the end of the word.
        self.middle = Tokenizer(BPE(vocab=vocab, merges=merges))
        self.last = Tokenizer(self.full.model) if self.suffix else self.middle
        self.names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        # The short cut below holds for the pattern of vocabularies with word ends, lower-cased.
        self.plain_words = _PATTERN in json.dumps(spec["pre_tokenizer"]) and "Lowercase" in json.dumps(spec["normalizer"])
        self.has_decoder = spec["decoder"] is not None
        self.young: dict[bytes, str] = {}
        self.old: dict[bytes, str] = {}

    def pieces(self, part: str) -> list[str]:
        """Pre-tokens of a text without white space around it, in the byte-level alphabet."""
        if self.plain_words and _WESTERN(part):
            found = _PIECES(part.lower())
            return found if part.isascii() else [p.encode().decode("latin-1").translate(self.to_letters) for p in found]
        norm = self.full.normalizer.normalize_str(part) if self.full.normalizer else part
        return [p for p, _ in self.full.pre_tokenizer.pre_tokenize_str(norm)]

    def cuts(self, pieces: list[str]) -> dict[int, list[int]]:
        """Where forced boundaries are, by the number of the piece: pairs that no token has inside."""
        raw = np.frombuffer("".join(pieces).translate(self.to_bytes).encode("latin-1"), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        forced = ~self.inside[raw[:-1], raw[1:]]
        forced[ends[:-1] - 1] = False
        at = np.flatnonzero(forced) + 1
        number = np.searchsorted(ends, at, "right")
        out: dict[int, list[int]] = {}
        for k, x in zip(number.tolist(), (at - (ends - [len(p) for p in pieces])[number]).tolist()):
            out.setdefault(k, []).append(x)
        return out

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of distinct pre-tokens: the fragments between forced boundaries, encoded independently and concatenated."""
        if not pieces:
            return []
        cuts = self.cuts(pieces)
        front: dict[str, list[int]] = {}
        fragments, ends = {}, list(pieces)
        for k, at in cuts.items():
            piece = pieces[k]
            parts = [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)])]
            fragments[k], ends[k] = parts[:-1], parts[-1]
            front.update(dict.fromkeys(parts[:-1]))
        for text, ids in zip(front, batched(self.middle, list(front))):
            front[text] = ids
        out = list(batched(self.last, ends))
        for k, parts in fragments.items():
            out[k] = [i for p in parts for i in front[p]] + out[k]
        return out

    def learn(self, words: set[bytes]) -> None:
        """Remembers of each word the ids as text, a line feed, which no word has, and the decoded text; nothing of a word without ids."""
        plan: dict[bytes, list[str | int]] = {}
        for key in words:
            word = key.decode()
            if "<|" in word and self.special:
                parts = self.special.split(word)
                plan[key] = [x for n, p in enumerate(parts) for x in ([self.full.token_to_id(p)] if n % 2 else self.pieces(p) if p else [])]
            else:
                plan[key] = self.pieces(word)
        distinct = list({p for parts in plan.values() for p in parts if isinstance(p, str)})
        ids_of = dict(zip(distinct, self.encode_pieces(distinct)))
        for word, parts in plan.items():
            ids = [i for p in parts for i in (ids_of[p] if isinstance(p, str) else [p])]
            text = self.full.decode(ids, skip_special_tokens=False) if self.has_decoder else " ".join([self.names[i] for i in ids])
            self.young[word] = " ".join(map(str, ids)) + "\n" + text if ids else ""

    def words(self, texts: list[bytes]) -> list[list[str]]:
        """What is remembered of every word of each text in UTF-8, in order.

        A word met again moves to the young generation; when that is full it becomes the old one, which forgets the rest."""
        split = [t.split() for t in texts]  # of bytes: at ASCII white space alone
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        get = self.young.get
        found = [list(map(get, words)) for words in split]
        open_texts = [n for n, x in enumerate(found) if None in x]
        missing = {w for n in open_texts for w, x in zip(split[n], found[n]) if x is None}
        for w in missing & self.old.keys():
            self.young[w] = self.old[w]
        self.learn(missing - self.young.keys())
        for n in open_texts:
            found[n] = list(map(get, split[n]))
        return found

    def parts(self, texts: list[str]) -> Iterator[list[str]]:
        """Of each text the ids of a word as text and its decoded text by turns, without the words that have no ids."""
        for run in chunks([t.encode() for t in texts], CHUNK_BYTES):
            for found in self.words(run):
                if "" in found:
                    found = [x for x in found if x]
                yield "\n".join(found).split("\n") if found else []

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return [int(i) for w in next(self.parts([text]))[::2] for i in w.split()]

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, their text, the decoded text) of each text."""
        join = ("" if self.has_decoder else " ").join
        for parts in self.parts(texts):
            ids = " ".join(parts[::2])
            yield ids.count(" ") + 1 if ids else 0, ids, join(parts[1::2])


#: Words of printable ASCII and western letters, on which the fixed pre-token pattern and lower-casing need no Unicode tables.
_WESTERN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
#: Fixed value: how such a vocabulary's file states its pattern.
_PATTERN = json.dumps("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
#: The vocabulary's fixed pre-token pattern for such words.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z\xdf-\xf6\xf8-\xff0-9]+").findall
_encoders: dict[str, ForcedBoundaryBPE] = {}


def encoder(path: str) -> ForcedBoundaryBPE:
    """The worker's own encoder for `path`; its memory of words lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = ForcedBoundaryBPE(path)
    return _encoders[path]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """`docs` (doc_id, text) with ids (array of int) of every whole text; null is empty and has no ids."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode_ids(ids: Column, path: str) -> Column:
    """The text of a column of ids, as the library's decode(ids, skip_special_tokens=False); null ids give null."""

    @F.pandas_udf("string")
    def run(column):
        own = encoder(path)
        return column.map(lambda x: None if x is None else own.full.decode([int(i) for i in x], skip_special_tokens=False))

    return run(ids)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string): doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null, empty and blank texts have no ids and decode to the empty text. Rows that repeat a doc_id are separate.
    An empty table gives an empty result. Other columns are not read.
    """
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            n, ids, texts = [], [], []
            for count, numbers, decoded in own.digests([t or "" for t in batch.column(1).to_pylist()]):
                n.append(count)
                ids.append(hashlib.sha256(numbers.encode()).hexdigest())
                texts.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
