"""Spelling variants, token alignment and the n-gram join against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from armature.llm import alignment, jaccard, spelling, tokens
from armature.llm.common import shared_folder
from tests.llm.test_operators import _docs, _empty, DOCS

A, B = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- 11 --------------------------------------------------------------------------------------------

def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(rows):
    seen = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run
            if len(word) >= 7:
                seen[word] += 1
    n = {w: c for w, c in seen.items() if c >= 2}
    near = {w: sorted((-n[v], v) for v in n if _near(w, v)) for w in n}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 10 * n[w] else None for w in n}
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def test_variants_equal_brute_force(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(7, 11))) for _ in range(25)] + ["aaaaaaaaa", "abababab", "Größenwahn"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(12):
            w = base[min(int(r.expovariate(0.25)), len(base) - 1)]
            if r.random() < 0.25:
                at = r.randrange(len(w))
                w = r.choice((w[:at] + w[at + 1:], w[:at] + r.choice("abcÉ") + w[at + 1:], w[:at] + "b" + w[at:]))
            words.append(w)
        rows.append((i % 390, ", ".join(words), "s", "clash", i))
    rows += [(None, "aaaaaaaa aaaaaaaa", None, None, None), (None, None, None, None, None), (1, "", "s", "k", 1)]
    long = "".join(r.choice("xyz") for _ in range(30_000))
    short = long[:20_000] + long[20_001:]
    whole = [i for i in range(900, 1900) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in (long, short))]
    rows += [(i, t, "s", "k", 1) for i, t in zip(whole, (long, long + " " + long, short, short))]
    got = {x.word: tuple(x) for x in spelling.variants(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    small = [(d, t) for d, t, *_ in rows if t is None or len(t) < 1000]
    want = _variants(small)
    assert {w: v for w, v in got.items() if len(w) < 1000} == want
    assert sum(v[1] is not None for v in want.values()) > 20 and any(v[2] != v[1] for v in want.values() if v[1])
    assert {w: v[3:5] for w, v in got.items() if len(w) > 1000} == {long: (3, 1), short: (2, 1)}


def test_variants_count_a_near_word_once(spark):
    """A beginning and another word's reversed beginning once shared a node: such pairs were met twice, n_near was too great."""
    words = ["bccaccab", "bccacca", "aaaaaaaa", "aaaaaaa", "baaaaaaa", "aaaaaab", "baaaaab", "aaaabaaab", "aaaaaaab"]
    rows = [(i, " ".join(words), "s", "k", i) for i in range(6)]
    got = {x.word: tuple(x) for x in spelling.variants(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == _variants([r[:2] for r in rows])


def test_variants_of_nothing(spark):
    assert spelling.variants(_empty(spark)).count() == 0
    assert spelling.variants(_docs(spark).select("doc_id", F.lit("short").alias("text"))).count() == 0


# -- 12 --------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def _brute_groups(aligner, text):
    """Groups of ids, from the tokenizers' own outputs."""
    a, b = aligner.a.lib.encode(" " + text, add_special_tokens=False).ids, aligner.b.lib.encode(text)
    ta, tb = [aligner.a.bytes[i] for i in a], [aligner.b.bytes[i] for i in b]
    if not text or b"".join(ta) != b"".join(tb) or b"".join(ta) != b" " + text.encode():
        return None
    ends_a, ends_b = np.cumsum(list(map(len, ta))).tolist(), np.cumsum(list(map(len, tb))).tolist()
    cuts = sorted(set(ends_a) & set(ends_b))
    return [([i for i, e in zip(a, ends_a) if lo < e <= hi], [i for i, e in zip(b, ends_b) if lo < e <= hi])
            for lo, hi in zip([0] + cuts, cuts)]


def test_groups_equal_brute_force(aligner):
    r = random.Random(5)
    signs = "abcXYZéÉßÿ÷×ªàÖİıſµ¼́ \n\t.,'sS09<|>$%  \x1c\x85\xa0²日🙂“”–…€—▁"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["<|endoftext|> <s> don't we'll  ", "a" * 700, "<0x41>", "   x", "x   ", "\n\n a", "", "the cat sat " * 300]
    hit = 0
    for t in texts:
        want, got = _brute_groups(aligner, t), aligner(t)
        if want is None:
            assert got is None
            continue
        hit += 1
        ids_a, ids_b, size_a, size_b = got
        assert [len(x) for x, _ in want] == size_a.tolist() and [len(y) for _, y in want] == size_b.tolist()
        assert ids_a.tolist() == [i for x, _ in want for i in x] and ids_b.tolist() == [i for _, y in want for i in y]
        linked = collections.Counter((x << 32) | y for xs, ys in want for x in xs for y in ys)
        assert dict(zip(*(v.tolist() for v in alignment.links(*got)))) == linked
        assert aligner.spell(*got).decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want)
    assert hit > 500


def test_long_stretches_and_huge_groups(monkeypatch):
    ends = np.arange(1, 5001)
    cut = np.delete(ends, [100, 101, 3000])
    size_a, size_b = alignment.groups(ends, cut)
    assert size_a.sum() == 5000 and size_b.tolist() == [1] * 4997 and sorted(size_a.tolist())[-2:] == [2, 3]
    monkeypatch.setattr(alignment, "_BLOCK_LINKS", 50)
    r = np.random.default_rng(1)
    a, b = r.integers(0, 9, 60), r.integers(0, 9, 50)
    size_a, size_b = np.array([1, 40, 2, 17]), np.array([3, 40, 2, 5])
    want = collections.Counter()
    i = j = 0
    for x, y in zip(size_a, size_b):
        want.update((int(p) << 32) | int(q) for p in a[i:i + x] for q in b[j:j + y])
        i, j = i + x, j + y
    assert dict(zip(*(v.tolist() for v in alignment.links(a, b, size_a, size_b)))) == want


@pytest.mark.parametrize("common", [5, 1_000_000])
def test_alignment_report(spark, aligner, common):
    docs = _docs(spark)
    held = [(x.doc_id, _brute_groups(aligner, x.text or "")) for x in docs.collect()]
    links = [None if g is None else collections.Counter((x, y) for xs, ys in g for x in xs for y in ys) for _, g in held]
    count = collections.Counter(p for c in links if c for p in c)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    want = []
    for (doc_id, g), c in zip(held, links):
        if g is None:
            want.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        want.append((doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()),
                     sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()),
                     hashlib.sha256(text.encode()).hexdigest()))
    got = list(map(tuple, alignment.report(docs, A, B, common=common).collect()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert alignment.report(_empty(spark), A, B).count() == 0


# -- 13 --------------------------------------------------------------------------------------------

def _shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def _components(rows, size, percent):
    sets = [_shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        key = -(1 << 63) if d is None else d
        least[find(i)] = min(least.get(find(i), key), key)
    back = lambda k: None if k == -(1 << 63) else k
    return sorted(((d, len(s), back(least[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def _edited(r, words, edits, vocabulary):
    w = list(words)
    for _ in range(edits):
        at = r.randrange(len(w))
        kind = r.randrange(3)
        w[at:at + 1] = [] if kind == 0 else [r.choice(vocabulary)] if kind == 1 else [w[at], r.choice(vocabulary)]
    return w


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join_equals_brute_force(spark, seed):
    """Near copies about the threshold around a few bases, templates that many share, copies, and odd rows."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for size in (12, 40, 90):
        base = [r.choice(vocabulary) for _ in range(size)]
        rows += [(len(rows) + i, " ".join(_edited(r, base, r.randint(0, max(1, size // 30)), vocabulary))) for i in range(70)]
    template = [r.choice(vocabulary) for _ in range(60)]
    rows += [(1000 + i, " ".join(template + [r.choice(vocabulary) for _ in range(r.randint(1, 6))])) for i in range(60)]
    rows += [(2000 + i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 6)))) for i in range(40)]
    rows += [(r.randrange(3000), t) for _, t in r.sample(rows, 20)] + [(None, rows[0][1]), (None, None), (5000, " \t\n"), (5001, "A b"), (5002, "a\nB")]
    docs = spark.createDataFrame([(d, t, "s", "clash", 1) for d, t in rows], DOCS).repartition(3)
    got = sorted(map(tuple, jaccard.join(docs, 4, 0.85).collect()), key=str)
    assert got == _components(rows, 4, 85)
    assert len({c for _, _, c in got}) < len(rows) - 60


def test_jaccard_join_default_and_empty(spark):
    docs = _docs(spark)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    assert sorted(map(tuple, jaccard.join(docs).collect()), key=str) == _components(rows, 5, 80)
    assert jaccard.join(_empty(spark)).count() == 0
