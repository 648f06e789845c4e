"""Cross-tokenizer alignment (operator 12).

Method: diagonal run skipping.  Two tokenizations of one text are two increasing arrays of
token ends.  At the present shift between the arrays, exponential probing compares ever longer
blocks of both and a binary search finds where they stop being equal: every token of such a stretch is aligned one
to one, and the whole stretch is jumped.  What follows is one irregular group, resolved token by token up to the
next common end, where the shift is updated.

Tokenizer A is a byte-level BPE file of the tokenizers library, B a sentencepiece model with byte fallback.  Both end
tokens at single spaces, so a worker keeps the groups of recently used chunks in a bounded cache and
aligns the new chunks of many texts as one text (``Aligner``).  Signs beyond Latin-1 and common punctuation go to A's library whole.

Scale: one pass over the texts, which leaves per document its distinct linked id pairs with their numbers of links.
A pair's count is a map-side aggregate over these rows.  The ``COMMON_PAIRS`` pairs with the greatest counts are
broadcast, so the pairs that many documents hold never move; the rest join by a shuffle on the pair.

Defined results: texts that are null, empty or that a tokenizer does not give back (``space + text``) have no tokens,
so zeros and an empty digest; rows that repeat an id are separate documents, and repeated rows count again in a pair's
documents; a null id stays null.  Texts of any length are taken whole; their links are counted in blocks.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armature.llm import tokens as K
from armature.llm.common import discard, id_key, id_value, release, shared_folder, stage

ALIGNED = ("row long, k long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, times array<long>")
#: The most id pairs that are broadcast; fixed-width rows.
COMMON_PAIRS = 1_000_000
_BLOCK_LINKS = 1 << 20
#: Bytes of one of the two generations of a worker's chunk cache, what an entry takes beside its bytes, and the longest
#: chunk that is cached (a text with a longer one is aligned as a whole).
_CACHE_BYTES = 96 << 20
_ENTRY_BYTES = 330
_LONG_CHUNK = 2000
#: The byte-level splitting pattern on Latin-1, general punctuation and the euro sign.
_SPACE, _LETTER, _DIGIT = r"\t-\r \x85\xa0", r"A-Za-zªµºÀ-ÖØ-öø-ÿ", r"0-9²³¹¼-¾"
_KNOWN = re.compile(r"[\x00-\xff‐-‧‰-⁞€]*").fullmatch
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+"
                     rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
_CHUNKS = re.compile(r"(?<=\S) (?=\S)").split
_BLANKS = frozenset(c for c in map(chr, range(0x3001)) if c.isspace())
_UNSIGN = {chr(v): b for b, v in K._SIGNS.items()}


class ByteTokens:
    """Tokenizer A: ids of ``space + text`` and the bytes of its ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.lib.encode_special_tokens = True
        self.merge = self.lib.model.tokenize
        n = self.lib.get_vocab_size()
        self.signs = [i.to_bytes(4, "little") for i in range(n)]
        self.bytes = [bytes(_UNSIGN.get(c, ord(c) & 255) for c in self.lib.id_to_token(i)) for i in range(n)]
        self.cache = K.TextEncoder(self, cache_bytes=8 << 20)

    def chunk_bytes(self, piece: str) -> bytes:
        text = piece.encode("utf-8").decode("latin-1").translate(K._SIGNS)
        return b"".join([self.signs[t.id] for t in self.merge(text)])

    def ids(self, text: str) -> np.ndarray:
        if not _KNOWN(text):
            return np.array(self.lib.encode(" " + text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(self.cache.join(_PIECES(" " + text)), "<u4")


class PieceTokens:
    """Tokenizer B: a sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.lib.is_byte(i) else p.replace("▁", " ").encode("utf-8")
                      for i, p in enumerate(pieces)]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, num_threads=1), "<u4")


def _stretch(a: bytes, b: bytes, i: int, j: int) -> int:
    """How many entries of 8 bytes are equal from ``i`` and ``j`` on: blocks of doubled size, then a binary search."""
    most, same, size = min(len(a) // 8 - i, len(b) // 8 - j), 0, 4
    while same < most:
        size = min(size, most - same)
        p, q = 8 * (i + same), 8 * (j + same)
        if a[p:p + 8 * size] == b[q:q + 8 * size]:
            same += size
            size *= 2
            continue
        while size > 1:                             # the first unequal entry is within the block
            half = size // 2
            p, q = 8 * (i + same), 8 * (j + same)
            if a[p:p + 8 * half] == b[q:q + 8 * half]:
                same += half
                size -= half
            else:
                size = half
        break
    return same


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes in A tokens and in B tokens of the groups between common ends; both arrays increase to the same last end."""
    a, b = (np.ascontiguousarray(e, "<i8").tobytes() for e in (ends_a, ends_b))
    la, lb = [*ends_a.tolist(), -1], [*ends_b.tolist(), -2]     # the last entries are never equal
    size, i, j, done = len(la) - 1, 0, 0, 0
    place: list[int] = []                           # of an irregular group among all
    in_a: list[int] = []
    in_b: list[int] = []
    while i < size:
        x, y = la[i], lb[j]
        if x == y:
            same = 1
            while same < 4 and la[i + same] == lb[j + same]:
                same += 1
            if same == 4:
                same += _stretch(a, b, i + 4, j + 4)
            i, j, done = i + same, j + same, done + same
            continue
        at_a, at_b = i, j
        while x != y:
            if x < y:
                i += 1
                x = la[i]
            else:
                j += 1
                y = lb[j]
        i, j = i + 1, j + 1
        place.append(done)
        in_a.append(i - at_a)
        in_b.append(j - at_b)
        done += 1
    size_a, size_b = np.ones(done, np.int64), np.ones(done, np.int64)
    size_a[place], size_b[place] = in_a, in_b
    return size_a, size_b


def links(ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked (A id << 32 | B id) and their numbers of links."""
    each, from_a, from_b = size_a * size_b, np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    keys, times = [], []

    def add(k, t):
        keys.append(k)
        times.append(t)
        if sum(map(len, keys)) > 4 * _BLOCK_LINKS:
            merge()

    def merge():
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        t = np.zeros(len(k), np.int64)
        np.add.at(t, at, np.concatenate(times))
        keys[:], times[:] = [k], [t]

    a, b = ids_a.astype(np.int64), ids_b.astype(np.int64)
    for g in np.flatnonzero(each > _BLOCK_LINKS):   # one huge group: its distinct ids by their numbers
        ua, na = np.unique(a[from_a[g]:from_a[g] + size_a[g]], return_counts=True)
        ub, nb = np.unique(b[from_b[g]:from_b[g] + size_b[g]], return_counts=True)
        rows = max(1, _BLOCK_LINKS // len(ub))
        for at in range(0, len(ua), rows):
            add((ua[at:at + rows, None] << 32 | ub).ravel(), (na[at:at + rows, None] * nb).ravel())
    rest = np.flatnonzero(each <= _BLOCK_LINKS)
    block = (np.cumsum(each[rest]) - 1) // _BLOCK_LINKS
    for some in np.split(rest, np.flatnonzero(np.diff(block)) + 1):
        n = each[some]
        g = np.repeat(some, n)
        t = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
        add(*np.unique(a[from_a[g] + t // size_b[g]] << 32 | b[from_b[g] + t % size_b[g]], return_counts=True))
    if len(keys) > 1:
        merge()
    return keys[0], times[0]


class Speller:
    """The groups as ``a1,a2|b1;a3|b2,b3``: every id is written with the sign that follows it."""

    def __init__(self, n_a: int, n_b: int):
        self.shift = 2 * n_a
        self.words = [b"%d%c" % (i, c) for n, signs in ((n_a, b",|"), (n_b, b",;")) for i in range(n) for c in signs]

    def signs(self, ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> list[bytes]:
        upto_a, upto_b = np.cumsum(size_a), np.cumsum(size_b)
        a, b = 2 * ids_a.astype(np.int64), 2 * ids_b.astype(np.int64) + self.shift
        a[upto_a - 1] += 1
        b[upto_b - 1] += 1
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(upto_b - size_b, size_a)] = a
        order[np.arange(len(b)) + np.repeat(upto_a, size_b)] = b
        return list(map(self.words.__getitem__, order.tolist()))

    def __call__(self, *found) -> bytes:
        return b"".join(self.signs(*found))[:-1]


class Aligner:
    """Alignment of whole texts, and of the chunks between single spaces through a cache.

    A single space between two other signs ends a token of both tokenizers: A's pattern starts a piece there, and no
    piece of B has a space after another sign (checked on loading).  So a text's groups are those of its
    chunks, and new chunks of many texts are aligned together as one text.
    """

    def __init__(self, path_a: str, path_b: str, cache_bytes: int = _CACHE_BYTES):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.spell = Speller(len(self.a.bytes), len(self.b.bytes))
        self.len_a, self.len_b = (np.array(list(map(len, t.bytes)), np.int64) for t in (self.a, self.b))
        self.chunked = not any(b" " in piece.lstrip(b" ") for piece in self.b.bytes)
        self.limit, self.size = cache_bytes, 0
        self.young: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def __call__(self, text: str):
        """(ids A, ids B, group sizes A, group sizes B) or None where there are no tokens."""
        if not text:
            return None
        whole = b" " + text.encode("utf-8")
        ids_b = self.b.ids(text)
        if b"".join(map(self.b.bytes.__getitem__, ids_b.tolist())) != whole:
            return None
        ids_a = self.a.ids(text)
        if b"".join(map(self.a.bytes.__getitem__, ids_a.tolist())) != whole:
            return None
        return ids_a, ids_b, *groups(np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b]))

    def _add(self, chunk: str, value: tuple | None) -> None:
        self.young[chunk] = value
        self.size += len(chunk) + (len(value[1]) + len(value[2]) if value else 0) + _ENTRY_BYTES

    def _together(self, chunks: list[str]) -> None:
        """Align new chunks as one text and keep each one's (packed counts, groups, links)."""
        found = self(" ".join(chunks)) if len(chunks) > 1 else None
        if found is None:                           # one chunk, or one of them does not come back
            for c in chunks:
                one = self(c)
                self._add(c, None if one is None else self._split(one, [len(c.encode("utf-8")) + 1])[0])
            return
        for c, value in zip(chunks, self._split(found, [len(c.encode("utf-8")) + 1 for c in chunks])):
            self._add(c, value)

    def _split(self, found, sizes: list[int]) -> list[tuple]:
        ids_a, ids_b, size_a, size_b = found
        upto_a, upto_b, each = np.cumsum(size_a), np.cumsum(size_b), size_a * size_b
        group = np.searchsorted(np.cumsum(self.len_a[ids_a])[upto_a - 1], np.cumsum(sizes)) + 1      # groups up to a chunk's end
        n_a, n_b = upto_a[group - 1], upto_b[group - 1]
        links = np.cumsum(each)[group - 1] * 8
        g = np.repeat(np.arange(len(each)), each)
        t = np.arange(len(g)) - np.repeat(np.cumsum(each) - each, each)
        down, across = np.divmod(t, size_b[g])
        pairs = (ids_a.astype(np.int64)[(upto_a - size_a)[g] + down] << 32
                 | ids_b.astype(np.int64)[(upto_b - size_b)[g] + across]).tobytes()
        signs = self.spell.signs(*found)
        out, was = [], (0, 0, 0, 0)
        for now in zip(n_a.tolist(), n_b.tolist(), group.tolist(), links.tolist()):
            counts = now[0] - was[0] | now[1] - was[1] << 40 | now[2] - was[2] << 80
            out.append((counts, b"".join(signs[was[0] + was[1]:now[0] + now[1]]), pairs[was[3]:now[3]]))
            was = now
        return out

    def texts(self, texts: list[str]) -> list[tuple | None]:
        """Per text (n_a, n_b, n_groups, n_links, groups, distinct pairs, their links), or None without tokens."""
        cut = [_CHUNKS(t) if self.chunked else [t] for t in texts]
        batches: dict[bool, set[str]] = {True: set(), False: set()}
        whole: set[int] = set()                     # texts with a chunk that is not cached
        for i, chunks in enumerate(cut):
            for c in set(chunks).difference(self.young):
                if c in self.before:
                    self._add(c, self.before[c])
                elif len(c) > _LONG_CHUNK:
                    whole.add(i)
                elif c and (c[0] in _BLANKS or c[-1] in _BLANKS):
                    self._together([c])
                elif c:
                    batches[_KNOWN(c) is not None].add(c)
        for some in batches.values():
            some = sorted(some)
            for at in range(0, len(some), 20_000):
                self._together(some[at:at + 20_000])
        out = [self._text(t, None if i in whole else chunks) for i, (t, chunks) in enumerate(zip(texts, cut))]
        if self.size > self.limit:
            self.before, self.young, self.size = self.young, {}, 0
        return out

    def _text(self, text: str, chunks: list[str] | None):
        if not text or (self.chunked and "▁" in text):          # B reads that sign as a space
            return None
        if chunks is None:
            found = self(text)
            return found and (len(found[0]), len(found[1]), len(found[2]), int((found[2] * found[3]).sum()), self.spell(*found), *links(*found))
        values = list(map(self.young.__getitem__, chunks))
        if None in values:
            return None
        counts, spelt, pairs = zip(*values)
        counts, pairs = sum(counts), np.frombuffer(b"".join(pairs), np.int64)
        low = (1 << 40) - 1
        return counts & low, counts >> 40 & low, counts >> 80, len(pairs), b"".join(spelt)[:-1], *np.unique(pairs, return_counts=True)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``ALIGNED``: a number per row, its counts, the digest of its groups, its distinct linked pairs and their links."""

    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 40
        aligner = Aligner(path_a, path_b)
        for part in K.row_slices(batches, 1 << 20):
            counts, digests, pairs, times = [], [], [], []
            for found in aligner.texts(part.column(1).to_pylist()):
                if found is None:
                    counts.append((0, 0, 0, 0))
                    digests.append("")
                    continue
                counts.append(found[:4])
                digests.append(hashlib.sha256(found[4]).hexdigest())
                pairs.append(found[5])
                times.append(found[6])
            each = iter(map(len, pairs))
            ends = np.cumsum([0] + [next(each) if c[0] else 0 for c in counts]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (pairs, times)]
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), part.column(0), *[pa.array(c, pa.int64()) for c in zip(*counts)],
                 pa.array(digests, pa.string()), *lists],
                names=["row", "k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
            row += n

    rows = docs.select(id_key().alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold a pair linked, and whether no pair of its A id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def report(docs: DataFrame, path_a: str, path_b: str, common: int = COMMON_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    aligned = stage(align(docs, path_a, path_b), folder, "aligned")
    counts = stage(pair_counts(aligned), folder, "pairs")
    release(spark)
    held = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times") \
        .withColumnRenamed("pairs", "pair")
    if counts.limit(common + 1).count() <= common:
        counted = held.join(F.broadcast(counts), "pair")
    else:
        frequent = stage(counts.orderBy(F.col("count").desc(), "pair").limit(common), folder, "common")
        rare = counts.join(F.broadcast(frequent.select("pair")), "pair", "left_anti")
        counted = held.join(F.broadcast(frequent), "pair").unionByName(
            held.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(rare, "pair"))
    sums = stage(counted.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"),
                                            F.sum(F.col("times") * F.col("count")).alias("count_sum")), folder, "sums")
    discard(spark, folder, "pairs", "common")
    zero = F.lit(0).cast("long")
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        id_value("k").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
