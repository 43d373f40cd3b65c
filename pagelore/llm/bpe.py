"""Byte-level BPE by backtracking, and decoding by an offset table.

The encoder does not replay merges. An Aho-Corasick automaton over the vocabulary gives, for every
position of a piece, the longest token that starts there; tokens are laid from left to right, each
checked against the one before with a pair-compatibility rule (would BPE have merged across the border
sooner?), and the encoder steps back to a shorter token where the rule fails. A bit per position makes
each position fail at most once, so time is linear in the piece. Tokens that BPE itself can never
produce are left out of the automaton. Decoding gathers bytes through a table of token offsets.
"""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelore.llm.common import named, positional, shipped_model, trimmed
from pagelore.llm.ngrams import Remembered
from pagelore.runtime import table

#: Fixed values of the public format: the pattern that splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges to which Unicode 16.0, the version of the tokenizers library, added letters and numbers.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105FF), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4),
    (0x11380, 0x113FF), (0x116D0, 0x116FF), (0x11BC0, 0x11BFF), (0x13460, 0x143FF), (0x16100, 0x1613F), (0x16D40, 0x16D7F),
    (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FF),
)
#: A worker remembers up to twice this many pieces, of at most this many characters, and so many token pairs.
CACHE_PIECES, CACHED_CHARS, CACHE_PAIRS = 100_000, 32, 100_000


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, spec: dict):
        import regex

        if spec["model"]["type"] != "BPE" or spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a plain byte-level BPE file is needed")
        chars = byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in what surrounds them are not known here")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = vocab
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[int, int] = {i: -1 for t, i in vocab.items() if len(t) == 1}
        self.split: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        reachable = set(self.rank)
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (vocab[raw(x)] for x in (m if isinstance(m, list) else m.split(" ")))
            new = vocab[self.bytes_of[a] + self.bytes_of[b]]
            self.pair.setdefault((a, b), r)
            if new in self.rank:
                continue
            self.rank[new], self.split[new] = r, (a, b)
            if a in reachable and b in reachable and self.compatible(a, b, r):
                reachable.add(new)
        self.reachable = reachable
        self._automaton(reachable)
        self._tables()
        self.find = regex.compile(PATTERN).findall
        self.cut_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.known = Remembered(CACHE_PIECES)
        self.fits: dict[int, bool] = {}
        self.size = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)]
        self.newer = regex.compile("[\u0558-\U0010ffff]").search
        self.stand_in: dict[int, str] | None = None

    def _automaton(self, reachable):
        import ahocorasick

        self.ac = ahocorasick.Automaton()
        for i in reachable:
            self.ac.add_word(self.bytes_of[i].decode("latin-1"), (len(self.bytes_of[i]) - 1, i))
        self.ac.make_automaton()
        # The longest proper prefix of a token that is a token too.
        self.shorter: dict[int, int] = {}
        for i in reachable:
            t = self.bytes_of[i]
            for n in range(len(t) - 1, 0, -1):
                if (p := self.vocab.get(t[:n])) is not None and p in reachable:
                    self.shorter[i] = p
                    break

    def _tables(self):
        n = max(self.bytes_of) + 1
        lens = np.zeros(n, np.int64)
        for i, t in self.bytes_of.items():
            lens[i] = len(t)
        self.lens, self.offsets = lens, np.cumsum(lens) - lens
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(n)), np.uint8)

    def compatible(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether BPE on the bytes of a and b keeps their border. Of the merges that built a and b
        the latest is undone first; a merge across the border that comes before it would have won.
        A merge of equal rank to the left comes first, one to the right later."""
        rank, split, pair = self.rank, self.split, self.pair
        while True:
            across = pair.get((a, b))
            if across is not None and across < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, split[a][1]
            else:
                limit, b = rb + 1, split[b][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [0] * n
        for end, (k, i) in self.ac.iter(piece.decode("latin-1")):
            longest[end - k] = i  # ends ascend, so the last match of a start is its longest
        out: list[int] = []
        ok = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        shorter, size, compatible, fits = self.shorter, self.size, self.compatible, self.fits
        while at < n:
            end = at + size[token]
            if ok[end]:
                good = True
                if out and (good := fits.get(pair := out[-1] << 32 | token)) is None:
                    if len(fits) >= CACHE_PAIRS:
                        fits.clear()
                    good = fits[pair] = compatible(out[-1], token)
                if good:
                    out.append(token)
                    at = end
                    if at < n:
                        token = longest[at]
                    continue
            while True:
                if token in shorter:
                    token = shorter[token]
                    break
                ok[at] = 0
                token = out.pop()
                at -= size[token]
        return out

    def _piece(self, piece: str) -> bytes:
        ids = self.known.recall(piece)
        if ids is None:
            found = self.encode_piece(piece.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(piece) <= CACHED_CHARS:
                self.known.put(piece, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers; special tokens in the text are recognised."""
        out: list[bytes] = []
        special = self.special
        parts = self.cut_special(text) if self.cut_special and any(s in text for s in special) else (text,)
        for part in parts:
            if part in special:
                out.append(special[part].to_bytes(4, "little"))
                continue
            known, piece = self.known, self._piece
            out += [known.get(p) or piece(p) for p in self.pieces(part)]
        return b"".join(out)

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches by the Unicode version of the tokenizers library. The regex module's is
        newer: characters that it alone knows are matched as an unassigned one."""
        if text.isascii() or not self.newer(text):
            return self.find(text)
        if self.stand_in is None:
            import unicodedata

            import regex

            known = regex.compile(r"[\p{L}\p{N}]").match
            self.stand_in = {c: "\u0378" for c in range(0x558, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and known(chr(c)) and not any(a <= c <= b for a, b in UNICODE_16)}
        swapped = text.translate(self.stand_in)
        found, at = [], 0
        for p in self.find(swapped):
            found.append(text[at : at + len(p)])
            at += len(p)
        return found

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD. Ids without a token give nothing."""
        out = bytearray()
        all_ids = np.frombuffer(ids, "<u4").astype(np.int64)
        for at in range(0, len(all_ids), 1 << 18):
            x = all_ids[at : at + (1 << 18)]
            x = x[x < len(self.lens)]
            n = self.lens[x]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out += self.blob[np.arange(total) + np.repeat(self.offsets[x] - ends + n, n)].tobytes()
        return out.decode("utf-8", errors="replace")


def from_bytes(raw: bytes) -> Bpe:
    return Bpe(json.loads(raw))


def load(path: str) -> Bpe:
    """The tokenizer in a file of the tokenizers library."""
    with open(path, "rb") as f:
        return from_bytes(f.read())


def _with(docs: DataFrame, path: str, text_col: str, added: dict[str, str], each) -> DataFrame:
    """docs + columns that each(tokenizer, text) makes of the text; columns of the same names are replaced."""
    src, at = positional(docs), docs.columns.index(text_col)
    tokenizer = shipped_model(docs.sparkSession, path, from_bytes)
    schema = StructType([*src.schema.fields, *StructType.fromDDL(", ".join(f"`_a{i}` {t}" for i, t in enumerate(added.values()))).fields])

    def run(batches):
        tok = tokenizer()
        for b in batches:
            rows = [each(tok, t) for t in b.column(at).to_pylist()]
            cols = [pa.array([r[k] for r in rows], {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for k, t in enumerate(added.values())]
            yield pa.record_batch([*b.columns, *cols], schema=pa.schema([*b.schema, *[(f"_a{i}", c.type) for i, c in enumerate(cols)]]))

    return named(src.mapInArrow(trimmed(run), schema), docs.columns, {c: F.col(f"_a{i}") for i, c in enumerate(added)})


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs + ids (binary, little-endian unsigned 32-bit) and n_tokens; columns of these names are replaced. Null
    is encoded as the empty text, which has no token; a text is encoded whole, however long; every row stays, repeated
    ones as often as they are there. An empty table gives an empty one."""

    def each(tok, t):
        ids = tok.encode(t or "")
        return ids, len(ids) // 4

    return _with(docs, path, text_col, {"ids": "binary", "n_tokens": "bigint"}, each)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded + decoded: the text of the ids; null ids give the empty text."""
    return _with(encoded, path, ids_col, {"decoded": "string"}, lambda tok, ids: (tok.decode(ids or b""),))


def encode_checked(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """encode + round_trip: whether the ids decode to the text again (null: to the empty one). One worker does
    both; rows and columns as for encode."""

    def each(tok, t):
        ids = tok.encode(t or "")
        return ids, len(ids) // 4, tok.decode(ids) == (t or "")

    return _with(docs, path, text_col, {"ids": "binary", "n_tokens": "bigint", "round_trip": "boolean"}, each)


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """encode and decode of each row, digested in the same pass: docs + n_tokens, ids_sha256, decoded_sha256. Null and
    the empty text have no tokens and the digests of nothing; rows and columns as for encode."""

    def each(tok, t):
        ids = tok.encode(t or "")
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(tok.decode(ids).encode()).hexdigest()

    return _with(docs, path, text_col, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, each)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, default_path()).drop("text")
