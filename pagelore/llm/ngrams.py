"""Hashed character n-grams of words, vectorised over many words at once, and the words of a text."""

from __future__ import annotations

import re

import numpy as np

from pagelore.llm.common import held_model

_WORD = re.compile(r"[^\W\d_]+").findall
#: Fixed mixing constants of the hash: odd 64-bit numbers.
_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD(text.lower()) if text else []


def ngram_buckets(words: list[str], sizes: range, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each n-gram of <word>, the markers < and > included; sorted by word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = "<" + "><".join(words) + ">"
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(c))  # characters to the word's end
    at, bucket = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, sizes.stop):
        h = h[: len(c) - n + 1] * _STEP + c[n - 1 :] + np.uint64(1)
        if n >= sizes.start:
            fits = np.flatnonzero(left[: len(h)] >= n)
            at.append(owner[fits])
            x = (h[fits] + np.uint64(n)) * _MIX
            bucket.append(((x ^ (x >> np.uint64(29))) * _MIX >> np.uint64(64 - bits)).astype(np.int64))
    at, bucket = np.concatenate(at), np.concatenate(bucket)
    order = np.argsort(at, kind="stable")
    return at[order], bucket[order]


def per_word_sums(at: np.ndarray, values: np.ndarray, n_words: int) -> np.ndarray:
    """Sum of the values' rows by word number; at is sorted and has every word at least once."""
    if not n_words:
        return np.zeros((0, *values.shape[1:]), values.dtype)
    return np.add.reduceat(values, np.searchsorted(at, np.arange(n_words)), axis=0)


class WordRows:
    """word -> number, with what ``make`` gives for the words in an array of one row each. Bounded:
    when a batch of texts would not fit, all is forgotten first."""

    @classmethod
    def of_model(cls, uid: str, make, width: int) -> WordRows:
        """The rows of a model, kept from task to task."""
        return held_model(uid, lambda: cls(make, width))

    def __init__(self, make, width: int, cap: int = 150_000):
        self.make, self.cap = make, cap
        self.rows, self.number = np.zeros((1024, width)), {}

    def of(self, words: list[str]) -> np.ndarray:
        """The rows of the words, one after the other."""
        at = self.numbers(words)
        return self.rows[at]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The row of each word; rows hold until the next call."""
        number = self.number
        new = [w for w in dict.fromkeys(words) if w not in number]
        if new:
            if len(number) + len(new) > self.cap and number:
                number.clear()
                new = list(dict.fromkeys(words))
            first = len(number)
            while len(self.rows) < first + len(new):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                self.rows[first + at : first + at + len(part)] = self.make(part)
            number.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def in_groups(texts, words: int = 100_000, split=words_of):
    """(number of words of each text, all their words): texts in turn, in groups of about so many words;
    a text is never split."""
    sizes, flat = [], []
    for t in texts:
        w = split(t)
        sizes.append(len(w))
        flat += w
        if len(flat) >= words:
            yield sizes, flat
            sizes, flat = [], []
    if sizes:
        yield sizes, flat


class Remembered:
    """A bounded memory of computed values: two generations of ``cap`` entries; a full one becomes the
    old one, so that what recurs stays."""

    def __init__(self, cap: int):
        self.cap, self.new, self.old = cap, {}, {}
        self.get = self.new.get

    def recall(self, key):
        """The value of a key of the old generation, kept on in the new; None if there is none."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.cap:
            self.old, self.new = self.new, {}
            self.get = self.new.get
        self.new[key] = value
