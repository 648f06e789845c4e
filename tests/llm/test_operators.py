"""Each training-data operator against brute force, the library it must equal, or an exact round trip."""

import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from armature.llm import (bpe, graph, hilbert, kdtree, line_runs, minmax, packing, substrings, suffixes, token_files,
                          tokens, tool_calls, toxicity)
from armature.llm.common import NULL_ID, shared_folder

DOCS = "doc_id long, text string, source string, k string, n long"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.tokenizer_path())


def _texts(n=60, seed=3):
    """Invented texts with copies, edited copies, shared passages and odd signs."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 6))) for _ in range(300)]
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and out:
            out.append(r.choice(out))
        elif kind == 2 and out:
            w = r.choice(out).split(" ")
            for _ in range(max(1, len(w) // 20)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
        else:
            t = " ".join(r.choice(words) for _ in range(r.randint(1, 120)))
            out.append(t + ("\n  A shared line of some length \n" if kind == 3 else "") + ("\nx\nx" if kind == 4 else ""))
    return out


def _docs(spark, extra=True):
    """Documents with nulls, empty texts, repeated rows, repeated ids and columns with clashing names."""
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "clash", i) for i, t in enumerate(_texts())]
    if extra:
        rows += [(None, None, None, None, None), (None, "lone text without an id", "s0", None, None), (100, "", "s0", "", 0),
                 (101, None, "s1", "", 0), (102, rows[0][1], "s1", "", 0), (102, rows[0][1], "s1", "", 0),
                 (103, "same id", "s1", "", 0), (103, "other text of the id", "s1", "", 0), (104, " \t\n", "s2", "", 0),
                 (105, "long " * 3000 + "<|endoftext|> İ \x00 日本 🙂 don't", "s2", "", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def _empty(spark):
    return spark.createDataFrame([], DOCS)


def _key(i):
    return NULL_ID if i is None else i


# -- tokens, 5, 6, 7 -------------------------------------------------------------------------------

def test_trie_and_plain_path_equal_the_library(lib):
    r = random.Random(5)
    signs = "abcXYZéÉßÿ÷×ªàÖİıſµ¼́ \n\t.,'sS09<|>$%  \x1c日🙂"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 80))) for _ in range(800)]
    texts += ["<|startoftext|>a<|endoftext|>", "don't we'll", "a" * 500, "", " ", "hahaha" * 50]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for engine in (tokens.TrieBpe, tokens.LibraryBpe):
        e = tokens.TextEncoder(engine(tokens.tokenizer_path()), cache_bytes=9_000)
        assert [a.tolist() for a in e.encode_batch([t.encode() for t in texts])] == want


def test_a_long_unbroken_word_takes_linear_time(lib):
    word = "".join(random.Random(2).choice("abcdefghij") for _ in range(1_000_000))
    got = tokens.TextEncoder(tokens.TrieBpe(tokens.tokenizer_path())).encode_batch([word.encode()])
    assert got[0].tolist() == lib.encode(word, add_special_tokens=False).ids


def test_encode_decode(spark, lib):
    docs = _docs(spark)
    got = sorted(map(tuple, bpe.digests(bpe.encode_decode(docs, tokens.tokenizer_path())).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_decode(_empty(spark), tokens.tokenizer_path()).count() == 0


def test_elias_fano_round_trip():
    r = random.Random(1)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        for top in (1, 10, 1 << 40):
            v = sorted(r.randrange(top) for _ in range(n))
            e, _ = token_files.EliasFano.from_buffer(token_files.EliasFano.of(v).to_bytes(), 0)
            assert e.values().tolist() == v
            assert [e.get(i) for i in range(n)] == v
    size = len(token_files.EliasFano.of(np.arange(0, 4_000_000, 400)).to_bytes())
    assert size < 10_000 * 12 / 8 + 1000                          # about 2 + log2(400) bits a value


def test_token_files(spark, lib):
    docs = _docs(spark)
    folder = shared_folder(spark)
    manifest = token_files.write(docs, folder, tokens.tokenizer_path(), 2, file_bytes=4000)
    assert manifest.count() > 3
    got = [(r.doc_id, r.start, struct.unpack(f"<{len(r.ids) // 4}I", r.ids))
           for r in token_files.read(spark, folder, manifest).orderBy("start").collect()]
    rows = sorted(docs.collect(), key=lambda r: (_key(r.doc_id), (r.text or "").encode()))
    at, want = 0, []
    for r in rows:
        ids = (*lib.encode(r.text or "", add_special_tokens=False).ids, 2)
        want.append((r.doc_id, at, ids))
        at += len(ids)
    assert got == want
    assert token_files.write_and_read(_empty(spark), tokens.tokenizer_path(), 2).count() == 0


def _check_pieces(pieces, docs, lib, window):
    by_doc, stream = {}, {}
    for p in pieces:
        ids = struct.unpack(f"<{len(p.ids) // 4}I", p.ids)
        by_doc.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
        stream.setdefault(p.sequence_id, []).append((p.offset, len(ids)))
    want = {}
    for d in docs:
        want.setdefault(d.doc_id, []).append((*lib.encode(d.text or "", add_special_tokens=False).ids, 1))
    assert by_doc.keys() == want.keys()
    for i, texts in want.items():
        if len(texts) == 1:
            assert sum((ids for _, ids, _ in sorted(by_doc[i])), ()) == texts[0]
            assert {n for *_, n in by_doc[i]} == {len(texts[0])}
        assert sum(len(ids) for _, ids, _ in by_doc[i]) == sum(map(len, texts))
    assert sorted(stream) == list(range(len(stream)))
    for s, parts in stream.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == window or s == len(stream) - 1


@pytest.mark.parametrize("weights", [None, {"s0": 0.7, None: 0.1}])
def test_packing(spark, lib, weights):
    docs = _docs(spark)
    pieces = packing.pack(docs, tokens.tokenizer_path(), 1, window=128, burst=32, lane_tokens=1000, weights=weights).collect()
    _check_pieces(pieces, docs.collect(), lib, 128)
    first = [p for p in pieces if p.sequence_id < 8 and p.source == "s0"]
    if weights:
        assert abs(sum(len(p.ids) // 4 for p in first) / (8 * 128) - 0.7 / (0.7 + 0.1)) < 0.1     # others weigh next to nothing
    assert packing.pack(_empty(spark), tokens.tokenizer_path(), 1).count() == 0


def test_windows_keep_the_mixture():
    out = packing.serve([[50] * 200, [5] * 1000, [1000] * 5], 0, 256, 16)
    x, seen = 0, [0, 0, 0]
    for q, _, _, size in out:
        seen[q] += size
        x += size
        assert all(abs(seen[i] - x * n / 20000) <= 48 for i, n in enumerate((10000, 5000, 5000)))


# -- 1, 2, 9 ---------------------------------------------------------------------------------------

def _sets(rows, size):
    out = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        out.append({tuple(w[i:i + min(size, len(w))]) for i in range(len(w) - min(size, len(w)) + 1)} if w else set())
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    docs = _docs(spark)
    rows = docs.collect()
    sets = _sets(rows, size)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 62), _key(r.doc_id))
    want = sorted((_key(r.doc_id), len(sets[i]), least[find(i)]) for i, r in enumerate(rows))
    got = minmax.groups(docs, size).collect()
    assert sorted((r.k, r.n, r.component) for r in got) == want
    kept = minmax.dedup(docs, size)
    assert kept.columns == docs.columns
    assert {_key(r.doc_id) for r in kept.collect()} == {k for k, _, c in want if k == c}
    assert minmax.report(_empty(spark)).count() == 0


def test_far_copies_of_a_big_group(spark):
    """Copies of one text with 0 to 30 % of the words changed: links only among the near ones."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(120):
        w = list(base)
        for _ in range(i // 4):
            w[r.randrange(150)] = r.choice(["the", "of", f"x{r.randrange(30)}"])
        texts.append(" ".join(w))
    order = list(range(120))
    r.shuffle(order)
    docs = spark.createDataFrame([(n, texts[i], "s", "", 0) for n, i in enumerate(order)], DOCS)
    sets = _sets(docs.orderBy("doc_id").collect(), 2)
    edges = [(i, j) for i in range(120) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = list(range(120))
    for _ in range(120):
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    assert 1 < len(set(root)) < 100
    assert [x.component for x in minmax.groups(docs, 2).orderBy("k").collect()] == root


def test_parts_of_one_source_form_few_pairs(spark, monkeypatch):
    """Documents that share half of one source are in one bucket but unlinked: few pairs are formed, the links are all found."""
    r = random.Random(6)
    source = [" ".join(f"s{i}w{j}" for j in range(10)) for i in range(40)]
    texts = [" ".join(source[i] for i in sorted(r.sample(range(40), 28))) for _ in range(150)]
    for i in range(0, 12, 2):                       # pairs with a similarity of about 0.85, far from all others
        w = texts[i].split()
        for at in r.sample(range(len(w)), 10):
            w[at] = f"other{i}x{at}"
        texts[i + 1] = " ".join(w)
    docs = spark.createDataFrame([(n, t, "s", "", 0) for n, t in enumerate(texts)], DOCS)
    sets = _sets(docs.orderBy("doc_id").collect(), 2)
    root = list(range(150))
    edges = [(i, j) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in range(150):
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    assert len(edges) >= 6
    staged, plain = {}, minmax.stage

    def counted(df, folder, name):
        out = plain(df, folder, name)
        staged[name] = out.count()
        return out
    monkeypatch.setattr(minmax, "stage", counted)
    assert [x.component for x in minmax.groups(docs, 2).orderBy("k").collect()] == root
    assert staged["further"] <= 300


def test_a_big_group_is_not_looked_up_by_bucket(spark, monkeypatch):
    """Near copies of one text and a few texts just too far from it: rows (bucket, node) are formed for the few only, links are all found."""
    r = random.Random(9)
    source = [f"w{i}" for i in range(60)]

    def copy(edits, tag):
        w = list(source)
        for at in r.sample(range(60), edits):
            w[at] = f"{tag}x{at}"
        return " ".join(w)
    texts = [" ".join(source)] + [copy(1, f"near{i}") for i in range(80)] + [copy(6, f"far{i}") for i in range(6)]
    docs = spark.createDataFrame([(n, t, "s", "", 0) for n, t in enumerate(texts)], DOCS)
    sets = _sets(docs.orderBy("doc_id").collect(), 2)
    root = list(range(len(texts)))
    edges = [(i, j) for i in root for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    assert root[:81] == [0] * 81 and any(root[81:])
    by_bucket, plain = [], minmax.stage

    def counted(df, folder, name):
        out = plain(df, folder, name)
        if "b" in out.columns:
            by_bucket.append(out.groupBy([c for c in out.columns if c.endswith("root")]).count().agg({"count": "max"}).first()[0] or 0)
        return out
    monkeypatch.setattr(minmax, "stage", counted)
    assert [x.component for x in minmax.groups(docs, 2).orderBy("k").collect()] == root
    assert by_bucket and max(by_bucket) <= minmax.FINE_BANDS       # at most the buckets of one far text


def test_parity_never_exceeds_the_difference():
    import numpy as np
    r = np.random.default_rng(8)
    for n in (0, 1, 5, 300, 5000):
        a, b = (np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate((b[:n // 4], a[n // 4:])))
        bits = sum(((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() for x, y in zip(minmax._parity(a), minmax._parity(b)))
        assert bits <= len(np.setxor1d(a, b)) and (len(minmax._parity(a)), bits % 2) == (16, len(np.setxor1d(a, b)) % 2)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}
    for _ in range(500):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long"), shared_folder(spark), "t").collect()))
    assert got == {x: y for x, y in root.items() if x != y}


def _removed(rows):
    """Brute force: kept bytes per (id, text), documents in order of (id, hash of the text)."""
    seen, out = {}, {}
    for key, text in rows:
        gone = np.zeros(len(text), bool)
        for a in range(len(text) - 99):
            if text[a:a + 100] in seen:
                gone[a:a + 100] = True
            seen.setdefault(text[a:a + 100], key)
        out[key] = (bytes(np.frombuffer(text, np.uint8)[~gone]), len(text) - int(gone.sum()))
    return out


@pytest.mark.parametrize("split", [20_000, 1])
def test_repeated_substrings(spark, monkeypatch, split):
    monkeypatch.setattr(substrings, "SPLIT", split)
    docs = _docs(spark)
    more = docs.unionByName(spark.createDataFrame(
        [(200, "a" * 400 + "b" * 150, "s", "", 0), (201, "b" * 120 + "a" * 350 + "ab" * 200, "s", "", 0)], DOCS))
    hashed = more.withColumn("r", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))).select("doc_id", "r", "text").distinct()
    rows = sorted(((_key(x.doc_id), x.r), (x.text or "").encode()) for x in hashed.collect())
    want = _removed(rows)
    got = substrings.dedup(more).collect()
    assert len(got) == more.count()
    by_id = {}
    for (k, _), text in rows:
        by_id.setdefault(k, set()).add(want[(k, _)][0])
    assert all(bytes(x.kept) in by_id[_key(x.doc.doc_id)] for x in got)
    assert sorted(hashlib.sha256(bytes(x.kept)).hexdigest() for x in {(_key(y.doc.doc_id), bytes(y.kept)): y for y in got}.values()) \
        == sorted(hashlib.sha256(v).hexdigest() for v in {(k[0], v[0]): v[0] for k, v in want.items()}.values())
    assert substrings.dedup(_empty(spark)).count() == 0


@pytest.mark.parametrize("partitions", [1, 2])
def test_repeated_rows_keep_their_text(spark, partitions):
    """Rows equal in id and text are one document, in one slice or in two."""
    r = random.Random(11)
    alone = "".join(r.choice("abcdefgh ") for _ in range(700))
    twice = "".join(r.choice("ijklmnop ") for _ in range(300))
    rows = [(1, alone, "s", "", 0), (2, twice + alone[:50] + twice, "s", "", 0)] * 2
    got = substrings.dedup(spark.createDataFrame(rows, DOCS).repartition(partitions)).collect()
    kept = sorted((x.doc.doc_id, bytes(x.kept).decode()) for x in got)
    assert kept == [(1, alone)] * 2 + [(2, twice + alone[:50])] * 2


def test_a_line_with_different_text_around_it(spark, monkeypatch):
    """A line of 62 to 99 bytes puts all its holders in one group; no task sorts more than SPLIT rows of a group."""
    r = random.Random(12)
    some = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line, ends = some(84), [some(30) for _ in range(12)]
    rows = [(i, some(150) + line + ends[i % 12] + some(150), "s", "", 0) for i in range(90)]
    rows += rows[:3]
    whole = substrings._sort_blocks

    def bounded(batches):
        sizes = {}

        def watched():
            for batch in batches:
                for g in batch.column(batch.schema.get_field_index("g")).to_pylist():
                    sizes[g] = sizes.get(g, 0) + 1
                assert max(sizes.values(), default=0) <= 20
                yield batch
        yield from whole(watched())

    monkeypatch.setattr(substrings, "SPLIT", 20)
    monkeypatch.setattr(substrings, "_sort_blocks", bounded)
    got = substrings.dedup(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    want = _removed([(x[0], x[1].encode()) for x in rows[:90]])
    assert sorted((x.doc.doc_id, bytes(x.kept)) for x in got) == sorted((x[0], want[x[0]][0]) for x in rows)
    assert sum(len(x[1]) for x in rows) > sum(len(x.kept) for x in got)


def test_meeting_does_not_depend_on_batches():
    import pyarrow as pa
    r = random.Random(13)
    rows = sorted((r.randrange(6), r.randrange(4), r.randrange(3), 0, r.randrange(3)) for _ in range(80))

    def run(size):
        out = []
        for at in range(0, len(rows), size):
            cols = list(zip(*rows[at:at + size]))
            out.append(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array([False] * len(cols[0]))],
                                                  names=["seed", "span", "k", "r", "place", "settled"]))
        return sorted((tuple(x.values()) for b in substrings._meet(iter(out)) for x in b.to_pylist()), key=repr)

    spans = {s: {x[1] for x in rows if x[0] == s} for s in range(6)}
    assert sum(x[0] is not None for x in run(80)) == sum(len(v) for v in spans.values() if len(v) > 1)
    assert all(run(n) == run(80) for n in (1, 2, 3, 7))


def test_suffix_sort_orders_like_bytes():
    r = random.Random(9)
    rows = [(g, bytes(r.choice(b"ab") for _ in range(r.randint(1, 60)))) for g in range(5) for _ in range(r.randint(1, 40))]
    right = np.array([list(t.ljust(100, b"\0")) for _, t in rows], np.uint8)
    b = suffixes.Block(np.array([g for g, _ in rows]), np.zeros((len(rows), 76), np.uint8), right,
                       np.zeros(len(rows), np.int64), np.array([len(t) for _, t in rows]))
    assert [rows[i] for i in b.order()] == sorted(rows)


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup(spark, batches):
    docs = _docs(spark)
    clean = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_runs.UPPER, line_runs.LOWER))
    rows = docs.collect()
    holders = {}
    for r in rows:
        for x in (r.text or "").split("\n"):
            holders.setdefault(clean(x), set()).add(_key(r.doc_id))
    want = []
    for r in rows:
        lines = (r.text or "").split("\n")
        keep = [x for x in lines if len(clean(x)) < 10 or min(holders[clean(x)]) == _key(r.doc_id)]
        want.append((r.doc_id, len(lines), len(lines) - len(keep), "\n".join(keep), r.k))
    got = [(x.doc.doc_id, x.n_lines, x.n_dropped, x.text, x.doc.k) for x in line_runs.dedup(docs, batches=batches, fanout=2).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert line_runs.dedup(_empty(spark)).count() == 0


# -- 4, 8 ------------------------------------------------------------------------------------------

def _vectors(spark, n=400, width=8):
    g = np.random.default_rng(1)
    x = g.standard_normal((n, width)).round(2)
    rows = [(i, x[i].tolist(), "e") for i in range(n)]
    rows += [(1000, None, "e"), (1050, [1.0, None], "e"), (1100, [float("nan")] * width, "e"), (1150, [float("inf")] * width, "e"),
             (1200, [0.0] * width, "e"), (1250, [1.0, 2.0], "e"), (1300, x[0].tolist(), "e"), (1300, x[0].tolist(), "e"), (None, x[1].tolist(), "e")]
    table = {i: np.pad(np.array(v), (0, width - len(v))) for i, v, _ in rows
             if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string"), table


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 60)
    monkeypatch.setattr(kdtree, "BLOCK_ROWS", 4)
    monkeypatch.setattr(kdtree, "LEAF", 8)
    table, vectors = _vectors(spark)
    ints = {i: np.floor(256 * v).astype(int) for i, v in vectors.items()}
    want = []
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, kdtree.top_k(table).collect())) == sorted(want)
    assert kdtree.top_k(table.where("vec_id IS NULL")).count() == 0


def test_approximate_neighbours(spark):
    table, vectors = _vectors(spark)
    vectors = {i: v for i, v in vectors.items() if v.any()}
    found, hits, total = hilbert.search(table, k=20, every=20).collect(), 0, 0
    got = {}
    for r in found:
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i in vectors if i % 20 == 0}
    for q, hit in got.items():
        best = sorted((-float(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:20]
        total += 20
        hits += len({i for _, i in best} & {i for i, _ in hit.values()})
        assert sorted(hit) == list(range(1, 21))
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-9 for i, s in hit.values())
        assert [x for _, x in sorted(hit.items())] == sorted(hit.values(), key=lambda x: (-x[1], x[0]))
    assert hits / total >= 0.9
    assert hilbert.search(table.where("vec_id IS NULL")).count() == 0


def test_hilbert_neighbours_differ_by_one_step():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    keys = hilbert.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# -- 3, 10 -----------------------------------------------------------------------------------------

EVENTS = "conv_id long, turn long, kind string, call_id string, name string, role string, arguments string, content string"


def test_tool_calls(spark):
    rows = [(1, 0, "message", None, None, "user", None, "hi"),
            (1, 1, "call", "a", "add", "assistant", '{"y":2, "x":{"$result":"b"}}', None),
            (1, 2, "call", "b", "add", "assistant", '{"x":1,"y":"q","z":0}', None),
            (1, 3, "result", "b", None, "tool", None, "3"), (1, 4, "result", "a", None, "tool", None, "5"),
            (1, 5, "result", "zz", None, "tool", None, None),
            (2, 0, "call", "p", "add", "assistant", '{"x":{"$result":"q"},"y":1}', None),
            (2, 1, "call", "q", "nope", "assistant", '{"x":{"$result":"p"}}', None),
            (3, 600, "message", None, None, "user", None, "late"), (3, 1, "message", None, None, "user", None, "early"),
            (None, None, "call", None, "add", None, None, None)]
    tools = tool_calls.schemas(spark, {"add": [("x", "integer", True), ("y", "integer", True)]})
    got = {(r.conv_id, r.part): r for r in tool_calls.transcripts(spark.createDataFrame(rows, EVENTS), tools).collect()}
    assert got[(1, 0)].chat == (
        '[{"content":"hi","role":"user"},'
        '{"arguments":{"x":1,"y":"q","z":0},"errors":["type:y","unknown:z"],"id":"b","name":"add","role":"assistant","state":"linked"},'
        '{"arguments":{"x":{"$result":"b"},"y":2},"id":"a","name":"add","role":"assistant","state":"linked"},'
        '{"content":"3","id":"b","role":"tool","state":"linked"},{"content":"5","id":"a","role":"tool","state":"linked"},'
        '{"content":"","id":"zz","role":"tool","state":"orphan"}]')
    assert (got[(1, 0)].n_linked, got[(1, 0)].n_invalid) == (2, 1)
    assert got[(2, 0)].chat.count('"cyclic":true') == 2 and '"errors":["tool"]' in got[(2, 0)].chat
    assert (3, 0) in got and (3, 1) in got
    assert '"errors":["arguments"]' in got[(None, 0)].chat
    assert tool_calls.transcripts(spark.createDataFrame([], EVENTS), tools).count() == 0


def test_automaton_equals_edit_distance():
    r = random.Random(6)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            new = [i + 1]
            for j, d in enumerate(b):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(40)]
    trie = toxicity.Trie(words)
    for _ in range(400):
        w = "".join(r.choice("abc") for _ in range(r.randint(0, 8)))
        for k in (1, 2):
            found = trie.near(w, k)
            assert (found is not None) == any(distance(w, x) <= k for x in words)
            assert found is None or distance(w, found) <= k
            assert found is None or len(found) <= k or toxicity.Pieces([found], k).may_match(w)


def test_toxicity(spark):
    r = random.Random(8)
    plain = ["".join(r.choice("aeioumnrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows, marks = [], []
    for i in range(500):
        w = [r.choice(plain) for _ in range(r.randint(5, 60))]
        toxic = int(i % 5 == 0)
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(["zblockhead", "qvermin!", "Jackwxyz"]))
        rows.append((i, " ".join(w), "s", "", 0))
        marks.append((i, toxic))
    rows += [(1000, "you zblockhaed of a qvermn", "s", "", 0), (1001, 'she said "zblockhead" and left', "s", "", 0), (1002, None, "s", "", 0), (None, "", "s", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame(marks + [(0, None), (None, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.report(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, toxic in marks:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == toxic
    assert got[1000].predicted == 1 and got[1001].predicted == 0
    assert got[1002].predicted == 0 and got[None].predicted == 0 and 0 <= got[1002].score <= 1
    flipped = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in marks], "doc_id long, toxic int")
    assert {x.doc_id: x.score for x in toxicity.report(docs, flipped).collect()} == {i: x.score for i, x in got.items()}
    none = toxicity.report(docs, labels.limit(0)).collect()
    assert {x.predicted for x in none} == {0} and len({x.score for x in none}) == 1
    assert toxicity.clean(docs, labels).columns == docs.columns


# -- pipeline and registered queries ------------------------------------------------------------------

@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver test data missing")
def test_pipeline_stages(spark, lib):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    folder, now = shared_folder(spark), docs
    for name, step in P.STAGES:
        after = step(spark, now, SMALL)
        if name != "packing":
            assert after.columns == docs.columns and [t for _, t in after.dtypes] == [t for _, t in docs.dtypes]
        after.write.parquet(f"{folder}/{name}")
        after, before = spark.read.parquet(f"{folder}/{name}"), now.orderBy("doc_id").collect()
        if name == "toxicity":
            good = {r.doc_id for r in toxicity.report(now, labels).collect() if not r.predicted}
            assert {r.doc_id for r in after.collect()} == good
        elif name == "line_dedup":
            want = {r.doc.doc_id: r.text for r in line_runs.dedup(now, batches=1).collect()}
            assert {r.doc_id: r.text for r in after.collect()} == want
        elif name == "near_dedup":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in minmax.report(now, 5).collect() if r.kept}
        elif name == "passage_dedup":
            want = _removed([(r.doc_id, r.text.encode()) for r in before])
            assert {r.doc_id: r.text for r in after.collect()} == {k: v[0].decode("utf-8", "ignore") for k, v in want.items()}
            assert all(r.n_chars == len(r.text) for r in after.collect())
        else:
            sizes = {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}
            got = after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
            assert {r.doc_id: r.n for r in got} == sizes
        now = after
    assert P.run(spark, SMALL).count() == now.count()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver test data missing")
def test_queries_match_their_sql(spark):
    import duckdb
    from armature.llm.queries import REGISTRY
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    for name, (query, sql) in REGISTRY.items():
        if sql:
            got = query(spark, SMALL)
            rel = con.sql(sql)
            order = [rel.columns.index(c) for c in got.columns]
            assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str), name
