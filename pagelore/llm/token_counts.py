"""Token counts by a Viterbi pass that keeps counts alone.

An Aho-Corasick automaton enumerates, for every position of a text, the vocabulary pieces that end there,
longest first. Dynamic programming carries the best score and the number of its pieces, and no back
pointers: of equal scores the piece that starts first wins, as in the SentencePiece library, which replaces
a best path only by a greater score. A character that no piece covers alone may be unknown, at the least
score less ten; it then counts as its UTF-8 bytes.

No piece of the vocabulary goes on into a word mark after another character, so a text falls into chunks
(word marks and what follows them) whose best paths are independent; a chunk seen before is looked
up. Scores are added exactly in double precision from the chunk's start. The library adds them in single
precision from the text's start, so on texts whose scores pass 2^24 its sums are rounded.

The public files hold no unigram model: the pieces and scores of the SentencePiece file are read as one, as the
library does when the file's model type is set to unigram. Its placeholder scores (-1e9, for pieces that no merge
makes) are raised to the least real score less one: single precision can't add them to anything.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import positional, shipped_model, trimmed
from pagelore.llm.ngrams import Remembered
from pagelore.runtime import table

MARK = "▁"
#: Fixed values of the model format: piece types, and what an unknown piece scores below the least.
NORMAL, USER_DEFINED, UNKNOWN_PENALTY = 1, 4, 10.0
PLACEHOLDER = -1e8
CACHE_CHUNKS, CACHED_CHARS = 100_000, 64


def _fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message; bytes for nested ones."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = raw[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + n]
            at += n


class Unigram:
    def __init__(self, raw: bytes):
        import ahocorasick

        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, NORMAL)))
            elif number in (2, 3):
                (trainer if number == 2 else normalizer).update(_fields(value))
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24) or not trainer.get(35):
            raise ValueError("a model of identity normalisation with byte fallback is needed")
        self.prefix = bool(normalizer.get(3, 1))
        floor = min(s for _, s, t in pieces if t == NORMAL and s > PLACEHOLDER) - 1
        pieces = [(p, s if s > PLACEHOLDER else floor, t) for p, s, t in pieces]
        normal = [s for _, s, t in pieces if t == NORMAL]
        self.unknown = min(normal) - UNKNOWN_PENALTY
        self.ac = ahocorasick.Automaton()
        self.longest = 0
        whole = False
        for text, score, kind in pieces:
            if kind in (NORMAL, USER_DEFINED):
                s = score if kind == NORMAL else len(text.encode()) * max(normal) - 0.1
                self.ac.add_word(text, (len(text), s))
                self.longest = max(self.longest, len(text))
                whole |= MARK in text.lstrip(MARK)
        self.ac.make_automaton()
        self.chunks = (lambda t: [t]) if whole else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.known = Remembered(CACHE_CHUNKS)

    def count_chunk(self, text: str) -> int:
        n, unknown = len(text), self.unknown
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        end, top, of, alone = 1, None, 0, False

        def close(end, top, of, alone):
            """The unknown character starts last, so it must be better."""
            if not alone and (top is None or best[end - 1] + unknown > top):
                top, of = best[end - 1] + unknown, count[end - 1] + len(text[end - 1].encode())
            best[end], count[end] = top, of

        for last, (k, score) in self.ac.iter(text):
            while end <= last:
                close(end, top, of, alone)
                end, top, of, alone = end + 1, None, 0, False
            at = last + 1 - k
            if top is None or best[at] + score > top:
                top, of = best[at] + score, count[at] + 1
            if k == 1:
                alone = True
        while end <= n:
            close(end, top, of, alone)
            end, top, of, alone = end + 1, None, 0, False
        return count[n]

    def _new(self, chunk: str) -> int:
        n = self.known.recall(chunk)
        if n is None:
            n = self.count_chunk(chunk)
            if len(chunk) <= CACHED_CHARS:
                self.known.put(chunk, n)
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        known, new = self.known, self._new
        return sum([known.get(c) or new(c) for c in self.chunks(text)])


def load(path: str) -> Unigram:
    with open(path, "rb") as f:
        return Unigram(f.read())


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row; a null or empty text has none. Texts are counted whole, however long; of
    equally good segmentations the library's counts. Repeated rows give repeated rows, an empty table none. Ids are
    whole numbers: others fail. Only the two columns are read, whatever the names of the others."""
    unigram = shipped_model(docs.sparkSession, path, Unigram)

    def run(batches):
        model = unigram()
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([model.count(t) for t in b.column(1).to_pylist()], pa.int64())], names=["id", "n_tokens"])

    i, t = (F.col(f"_c{docs.columns.index(c)}") for c in (id_col, text_col))
    return positional(docs).select(i.cast("bigint").alias("id"), t.alias("text")).mapInArrow(trimmed(run), "id bigint, n_tokens bigint")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, default_path()).withColumnRenamed("id", "doc_id")
