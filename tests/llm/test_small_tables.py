"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import collections
import hashlib
import json
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagelore.llm import bpe, chat, exact_dedup, language_id, line_dedup, mixing, nearest, simhash, token_counts, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _len int, keep string, fp string, ids string, _text string"
LONG = "word and Word\nline of text\n" * 20_000


def docs(spark, rows):
    """Rows (id, text, lang, source) with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "k", "f", "i", "t") for r in rows], DOCS)


ROWS = [
    (5, "Same Text", "en", "a"), (1, "same text", None, "a"), (9, "SAME TEXT", "en", None), (9, "SAME TEXT", "en", None), (None, "same text", "en", ""),
    (2, None, None, "b"), (3, "", "fr", "b"), (4, " \t\n ", "fr", "b"), (6, "É é \U0001f600 ß", "de", "b"), (7, LONG, "en", "c"), (8, LONG + "x", "en", "c"), (10, "a\nb\na\n\nc", "es", "c"), (10, "b\nb", "es", "c"),
]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


@pytest.mark.parametrize("filter_words", [1 << 20, 1])
def test_exact_dedup(spark, filter_words):
    """One word: the filters are full, rows that are alone reach the full hash and come out alone."""
    got = exact_dedup.exact_dedup(docs(spark, ROWS), carry=("text", "_len"), filter_words=filter_words).collect()
    assert len(got) == len(ROWS)
    groups = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        groups[lower(t)].append(i)
    for r in got:
        g = groups[lower(r.text)]
        keep = max((i for i in g if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept, r._len) == (keep, len(g), r.doc_id == keep, 1)
        assert (r.full_hash is None) or r.full_hash == hashlib.sha256(lower(r.text).encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs(spark, ROWS).limit(0)).count() == 0


def test_exact_dedup_same_length_and_prefix(spark):
    rows = [(i, "p" * 200 + c, "en", "s") for i, c in enumerate("aabbc")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 2: (3, 2), 3: (3, 2), 4: (4, 1)}


def brute_lines(rows, min_docs, min_chars, keep_first):
    seen = collections.defaultdict(set)
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_order(r[1])))
    first, out = set(), {}
    for i, t in order:
        kept, lines = [], (t or "").split("\n")
        for x in lines:
            k = key(x)
            drop = len(k) >= min_chars and len(seen[k]) >= min_docs
            if drop and keep_first and k not in first:
                first.add(k)
                drop = False
            if not drop:
                kept.append(x)
        out[i, t] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def text_order(t):
    """Rows of one id are ordered by XXH64 of their text, as a signed number."""
    h = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return h - 2**64 if h >= 2**63 else h


@pytest.mark.parametrize("rule", [dict(min_docs=2, min_chars=1, keep_first=False), dict(min_docs=3, min_chars=2, keep_first=False), dict(min_docs=2, min_chars=1, keep_first=True)])
def test_line_dedup(spark, rule):
    rng = random.Random(3)
    lines = ["Alpha", " alpha", "beta ", "", "  ", "Gamma\x0b", "é", "É", "hot"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 6)))) for i in range(60)] + [(None, "hot\nbeta"), (None, None), (100, LONG), (101, "line of text\nown")]
    want = brute_lines(rows, **rule)
    d = docs(spark, [(i, t, "en", "s") for i, t in rows]).repartition(7)
    for hot_partitions in (1, 23):
        spark.conf.set("spark.sql.shuffle.partitions", hot_partitions)  # the hot line crosses partition borders
        try:
            got = line_dedup.with_bitmaps(d, line_dedup.keep_bitmaps(d, **rule)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        have = collections.Counter((r.doc_id, r._n_lines, r._n_dropped, r._kept) for r in got)
        assert have == collections.Counter((i, *want[i, t]) for i, t in rows)


def test_line_dedup_keeps_columns_and_copies(spark):
    d = docs(spark, ROWS)
    out = line_dedup.dedup_lines(d, min_docs=2, keep_first=True, most=0.5)
    assert out.columns == d.columns and out.count() == len(ROWS)
    assert out.where("doc_id = 2").first().text is None
    assert out.where("doc_id = 8").first().text == LONG + "x"  # it would lose nearly all its lines
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def brute_target(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {s: 0.0 for s in names}
    while open_:
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if part[s] > cap * sizes[s]}
        if not full:
            target.update(part)
            break
        for s in full:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), "en", rng.choice(["a", "a", "a", "b", "c", "é", None, "", "Z"])) for i in range(900)] + [(7, "x y", "en", "a"), (None, None, None, "b"), (None, "p q r", None, None)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_target(sizes)
    by_size = {(round(r.target, 6), r.source_size) for r in got}
    assert by_size == {(round(t, 6), sizes[s]) for s, t in want.items()}
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[round(r.target, 6), r.source_size] += r.taken
    for (t, _), n in taken.items():
        assert abs(n - t) <= 15.5  # half the largest document
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs(spark, rows)).collect()), key=str)
    d = docs(spark, rows)
    out = mixing.mixed(d)
    assert out.columns == d.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(d.limit(0)).count() == 0


def test_mixing_threshold_is_that_of_a_sort(spark):
    rows = [(i, " ".join(["w"] * (i % 9)), "en", "s" if i % 3 else "t") for i in range(3000)]
    got = {r.doc_id: r for r in mixing.mix(docs(spark, rows), weights=(1, 2), share=0.2).collect()}
    for s in ("s", "t"):
        own = sorted((int(hashlib.md5(f"{i}\n{t}".encode()).hexdigest()[:15], 16), i, len(t.split())) for i, t, _, x in rows if x == s)
        budget, run = got[own[0][1]].target, 0
        for _, i, n in own:
            assert got[i].copies == (1 if 2 * run + n <= 2 * budget else 0)
            run += n


def test_mixing_of_rows_that_share_an_id(spark):
    """Two thirds of a source have the null id: they are no block, the target is met within half a document."""
    rows = [(None if i % 3 else i, f"own{i} " + "w " * (i % 20), "en", "a" if i % 4 else "b") for i in range(90)]
    got = mixing.mix(docs(spark, rows)).collect()
    for size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10.5


def link_classes(ids, prints, radius):
    """Smallest id reachable, by comparing all pairs."""
    u = list(dict.fromkeys(prints))
    root = {p: p for p in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for i, p in zip(ids, prints, strict=True):
        r = find(p)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return [least[find(p)] for p in prints]


def plain_fingerprint(text, words=3):
    """The contract's fingerprint, bit by bit."""
    w = [x for x in re.split("[\x20\x09-\x0d]+", lower(text)) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(300)] for _ in range(6)]
    rows = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(300)] = "edit"
        rows.append((i, rng.choice([" ", "\t", "\n"]).join(w).upper() if i % 2 else " ".join(w), "en", "s"))
    rows += [(i, t, "en", "s") for i, t in [(200, ""), (201, None), (202, " \n"), (203, "one"), (204, "ONE"), (205, "one two"), (None, "one"), (206, LONG)]]
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    assert prints == [simhash.fingerprint(t, 3) for _, t, *_ in rows]
    assert prints[120:123] == [0, 0, 0] and prints[123] == prints[124]
    want = collections.Counter(zip([r[0] for r in rows], link_classes([r[0] for r in rows], prints, 2), strict=True))
    for cap in (4096, 2):  # 2: nearly every bucket goes through the second index
        got = simhash.near_duplicates(docs(spark, rows), bucket_cap=cap).collect()
        assert collections.Counter((r.id, r.component) for r in got) == want
    assert len({c for _, c in want}) < len(rows) - 5
    assert simhash.near_duplicates(docs(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize(("radius", "cap"), [(0, 4096), (1, 4096), (2, 4096), (2, 3), (3, 4096), (3, 4), (5, 4096), (5, 8), (7, 4096)])
def test_links_at_every_radius(spark, radius, cap):
    rng = np.random.default_rng(radius)
    centre = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for c in centre for _ in range(60)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    want = link_classes(signed, list(fps), radius)
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), radius, cap)
    from pagelore.llm.components import components

    root = {r.node: r.root for r in components(links).collect()}
    assert {s: root.get(s, s) for s in signed} == dict(zip(signed, want, strict=True))


def test_bpe_against_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    lib = Tokenizer.from_file(path)
    texts = [t for _, t, *_ in ROWS] + ["<|endoftext|>a<|endoftext|>", "  x　y\r\n\tz  ", "it's WE'LL 123 \U0001f600‍", "՘ � \x00"]
    d = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(d.select("doc_id", "text"), path), path).collect()}
    digests = {r.doc_id: r for r in bpe.round_trip(d, path).collect()}
    for i, t in enumerate(texts):
        e = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == e and got[i].n_tokens == len(e)
        assert got[i].decoded == lib.decode(e, skip_special_tokens=False)
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
    assert bpe.encode(d.limit(0), path).count() == 0
    assert bpe.load(path).decode(np.array([10, 200, 999_999], "<u4").tobytes()) == bpe.load(path).decode(np.array([10, 200], "<u4").tobytes())


def test_bpe_equals_merging(tmp_path):
    """On a small vocabulary with merges that get in each other's way, against merges by rank."""
    chars = {v: k for k, v in bpe.byte_chars().items()}
    rng = random.Random(4)
    vocab, merges = {chars[b]: b for b in range(256)}, []
    parts = [chars[ord(c)] for c in "abc"]
    while len(merges) < 60:
        a, b = rng.choice(parts), rng.choice(parts)
        if a + b not in vocab and len(a + b) < 9:
            vocab[a + b] = len(vocab)
            merges.append([a, b])
            parts.append(a + b)
    tok = bpe.Bpe({"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "added_tokens": []})
    rank = {(a, b): i for i, (a, b) in enumerate(merges)}
    for _ in range(3000):
        s = [rng.choice("abc") for _ in range(rng.randrange(1, 14))]
        want = list(s)
        while True:
            at = min(range(len(want) - 1), key=lambda i: (rank.get((want[i], want[i + 1]), 10**9), i), default=None)
            if at is None or (want[at], want[at + 1]) not in rank:
                break
            want[at : at + 2] = [want[at] + want[at + 1]]
        assert tok.encode_piece("".join(s).encode()) == [vocab[x] for x in want]


def test_token_counts_against_the_library(spark):
    import sentencepiece

    raw = open(token_counts.default_path(), "rb").read()
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(raw)
    m.trainer_spec.model_type = 1  # unigram
    floor = min(p.score for p in m.pieces if p.type == 1 and p.score > -1e8) - 1
    for p in m.pieces:
        if p.type == 1:
            p.score = max(p.score, floor)
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = [t for _, t, *_ in ROWS] + ["  two  marks ", "▁▁x", "日本語 と \x00", "\n\n"]
    got = {r.id: r.n_tokens for r in token_counts.count_tokens(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), token_counts.default_path()).collect()}
    assert got == {i: len(lib.encode(t or "")) for i, t in enumerate(texts)}
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    counts = {r.id: r.n_tokens for r in token_counts.count_tokens(real, token_counts.default_path()).collect()}
    assert counts == {r.doc_id: len(lib.encode(r.text or "")) for r in real.collect()}
    assert token_counts.count_tokens(real.limit(0), token_counts.default_path()).count() == 0


def test_viterbi_against_all_segmentations():
    u = token_counts.load(token_counts.default_path())
    score = {}
    for end, (k, s) in [x for w in ("▁abab", "▁the", "▁aaaa") for x in u.ac.iter(w)]:
        score.setdefault(k, s)
    pieces = {p: v[1] for p, v in u.ac.items()}
    rng = random.Random(1)

    def best(s):
        if not s:
            return (0.0, 0)
        options = []
        for k in range(len(s), 0, -1):
            if (v := pieces.get(s[-k:])) is not None:
                a, n = best(s[:-k])
                options.append((a + v, n + 1))
        if s[-1] not in pieces:
            a, n = best(s[:-1])
            options.append((a + u.unknown, n + len(s[-1].encode())))
        top = max(o[0] for o in options)
        return next(o for o in options if o[0] == top)

    for _ in range(300):
        s = "▁" + "".join(rng.choice("thea\U0001f600n") for _ in range(rng.randrange(1, 8)))
        assert u.count_chunk(s) == best(s)[1]


def test_chats(spark):
    t = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "bot", "other"), (4, 0, "user", "hi"), (4, 1, "bot", "other"),
         (5, 0, "user", "x<|im_end|>"), (5, 0, "user", "x<|im_end|>"), (6, None, None, None), (None, 0, "user", "hi"), (None, 1, "bot", "yo"), (None, 2, "user", "null id")]
    d = spark.createDataFrame([(*r, 1, "p") for r in t], "conv_id bigint, turn bigint, role string, text string, k int, p1 string")
    got = {r.conv_id: r for r in chat.format_chats(d).collect()}
    assert set(got) == {2, 3, 5, 6, None}
    assert got[3].copies == 2 and got[2].n_turns == 3 and got[5].n_turns == 1
    assert got[2].chat == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert got[5].chat == "<|im_start|>user\nx<| im_end|><|im_end|>\n" and got[6].chat == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat.format_chats(d.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 8)).astype(np.float32)
    v[100:400] = v[0]  # a hot vector
    v[500] = 2 * v[1]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(9000, None), (9001, [0.0] * 8), (9002, [1.0, None] + [0.0] * 6), (9003, [float("nan")] * 8), (9004, []), (None, [1.0] * 8), (3, [float(x) for x in v[3]]), (9005, [1.0, 2.0])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("shard", F.lit("clash"))
    x = v.astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    q = d.where("vec_id % 20 = 0")
    got = collections.defaultdict(list)
    for r in nearest.nearest(d, q, k=5, shard_rows=90).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 700, 20))
    for i, found in got.items():
        s = np.round(unit @ unit[i], 12)
        want = sorted((-s[j], j) for j in range(700) if j != i)[:5]
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert np.allclose([f[2] for f in found], [-w[0] for w in want])
        assert [f[1] for f in found] == [w[1] for w in want]
    few = nearest.nearest(d.where("vec_id < 3"), d.where("vec_id = 0"), k=5)
    assert few.count() == 2 and nearest.nearest(d.limit(0), q).count() == 0


def test_relaxed_search_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 12)) + rng.normal(size=(8, 12))[rng.integers(0, 8, 4000)] * 2
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, tree = x[::40], nearest.VpTree(x)
    true = np.argsort(-(q @ x.T), axis=1)[:, :6]
    work, recall = {}, {}
    for relax in (1.0, 1.5):
        tree.visited = 0
        found, _ = tree.search(q, 10, 6, relax)
        work[relax] = tree.visited
        recall[relax] = np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(found.tolist(), true.tolist(), strict=True)])
    assert recall[1.0] == 1.0 and recall[1.5] >= 0.9 and work[1.5] < work[1.0] < len(q) * len(x)


def words(rng, stems, n):
    return " ".join(rng.choice(stems) + rng.choice(["a", "en", "ist", "ung", "o"]) for _ in range(n))


def test_toxicity_learns_parts_of_words(spark):
    rng = random.Random(6)
    clean, bad = ["bal", "dor", "fim", "gul", "hep", "kor", "lum"], ["zrax", "qwov"]
    rows, labels = [], []
    for i in range(700):
        w = words(rng, clean, rng.randrange(20, 120)).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad) + "".join(rng.choice("abcdef") for _ in range(3))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(toxic)))
    d = docs(spark, rows)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (99_999, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(d, lab.where("doc_id % 5 <> 0 or doc_id is null"))
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    held = [i for i in range(0, 700, 5)]
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in held]) > 0.95
    junk = docs(spark, [(1, "balen " * 5000, None, None), (2, None, None, None), (3, "", None, None), (4, LONG, None, None), (5, "  12 !", None, None)])
    assert all(0 <= r.score < 0.5 for r in toxicity.score(junk, model).where("doc_id <> 4").collect())
    out = toxicity.score(d, model)
    assert out.columns == [*d.columns, "score"]
    none = toxicity.fit(d, lab.limit(0))
    assert {r.score for r in toxicity.score(d.limit(3), none).collect()} == {0.0}


def test_language_id(spark):
    rng = random.Random(7)
    stems = {"xx": ["the", "of", "wher"], "yy": ["quar", "uña", "llo"], "zz": ["sch", "ünd", "keit"]}
    rows = [(i, words(rng, stems[lang], rng.randrange(5, 60)), lang, "s") for i in range(400) for lang in [["xx", "yy", "zz"][i % 3]]]
    rows += [(900, None, "xx", "s"), (901, "", "xx", "s"), (902, "12 34 ! \u00bd \u2167", "yy", "s"), (903, "the of", None, "s"), (904, LONG, None, "s")]
    d = docs(spark, rows)
    m = language_id.fit(d.where("doc_id % 5 <> 0"))
    got = {r.id: r for r in language_id.identify(d, m).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in rows[:400] if i % 5 == 0]) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(d.limit(3), language_id.fit(d.limit(0))).collect()} == {"und"}


def test_document_frequencies_count_all_rows(spark):
    texts = ["ab cd", "ab", "", None, "cd cd cd"]
    df, n = language_id.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = np.zeros(1 << language_id.BITS, int)
    for t in texts:
        if t:
            want[np.unique(language_id.ngram_buckets(t.split(), language_id.SIZES, language_id.BITS)[1])] += 1
    assert n == 5 and (df == want).all()


def test_spec_of_other_tokenizers_is_refused():
    with pytest.raises(ValueError):
        bpe.Bpe(json.loads('{"model":{"type":"BPE"},"normalizer":{"type":"NFC"},"pre_tokenizer":{"type":"ByteLevel","add_prefix_space":false}}'))
