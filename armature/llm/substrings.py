"""Removal of long repeated byte strings (operator 2).

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a
smaller document, or earlier in the same one) is removed; strings are judged on
the input, overlaps count, and no string crosses a document.

Method: a sparse suffix array.  Suffixes start at anchors: for every window of
``LENGTH`` bytes, the ``SEED``-byte string in it with the least hash (leftmost on
ties).  Equal windows have their anchor at the same place, so equal windows are found
among equal anchors, and only about 2.6 % of all positions are anchors.

1. Each document's anchors carry the hash of their seed and the hash of their
   span: all windows that share this anchor.  Spans repeated inside a slice of a task are
   settled there, so a passage that many documents share is reduced
   before it is shuffled.
2. Anchors meet by seed.  All but the first of equal spans repeat it
   entirely.  Seeds with a single span are done.
3. Seeds with several spans (edges of passages, edited copies): the first holder of
   each span fetches its bytes, and per seed the suffixes at the anchors are sorted by the
   hash-compared merge sort of ``suffixes``; neighbours with a long common extension and
   equal left sides repeat each other, and bytes are compared before they count.
   A seed with more than ``SPLIT`` spans is dealt by the hash of the bytes beside the anchor: a
   window has ``HALF`` bytes on one side at least, and its offset says on which.  A group that still has
   more than ``SPLIT`` rows is grouped by the bytes of each of its windows instead.
4. The repeated stretches go back to their documents.

Defined results: null text is empty; a null id is the smallest; rows that share an id are
separate documents in the order of a hash of their texts; rows equal in id and text are
one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armature.llm import tokens as K
from armature.llm.common import discard, id_key, release, shared_folder, shuffle_partitions, small_ids, stage, text_bytes
from armature.llm.suffixes import BASE, LETTERS, U, Block, powers

LENGTH = 100
SEED = 24
REACH = LENGTH - SEED            # most bytes of a window before its anchor
HALF = REACH // 2
SPLIT = 20_000
SLICE_BYTES = 1 << 20
SORT_ROWS = 30_000
INVERSE = U(pow(int(BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


class Anchors:
    """Anchors of a batch of texts, on one concatenated byte array."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, texts: list[bytes]):
        """Arrays: text number, first window, windows less one, offset of the first, seed hash, span hash."""
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(data)
        if n < LENGTH:
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
        if len(self.up) <= n:
            self.up, self.down = powers(n + 1), powers(n + 1, INVERSE)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(LETTERS[data] * self.up[:n], out=sums[1:])
        seeds = _mix((sums[SEED:] - sums[:-SEED]) * self.down[:n - SEED + 1])
        # least of REACH + 1 successive seeds; the low bits hold the place, so ties go left
        key = (seeds >> U(24) << U(24)) | np.arange(len(seeds), dtype=np.uint64)
        span, low = 1, key
        while 2 * span <= REACH + 1:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        rest = REACH + 1 - span
        low = np.minimum(low[:len(low) - rest], low[rest:]) if rest else low
        anchor = (low & U((1 << 24) - 1)).astype(np.int64)      # by start of the window
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)[:len(anchor)]
        inside = np.arange(len(anchor)) + LENGTH <= ends[owner]
        change = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])]
        first = np.flatnonzero(change)
        last = np.r_[first[1:], len(anchor)] - 1
        keep = inside[first]
        first, last = first[keep], last[keep]
        at = anchor[first]
        spans = _mix((sums[last + LENGTH] - sums[first]) * self.down[first] + ((at - first) * 128 + last - first).astype(np.uint64))
        text = owner[first]
        return text, first - (ends - sizes)[text], last - first, at - first, seeds[at], spans


def _heads(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(seed, span, k, r, at, windows, lead, settled): a settled row repeats another of its slice."""

    def run(batches):
        anchors = Anchors()
        for part in K.row_slices(batches, SLICE_BYTES):
            ks = np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64)
            rs = np.asarray(part.column(1).to_numpy(zero_copy_only=False), np.int64)
            texts = part.column(2).to_pylist()
            step = 1 << 23                       # one long text may exceed the slice; places need 24 bits
            if sum(map(len, texts)) >= 1 << 24:
                texts_at = [(i, a) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - LENGTH + 1), step)]
                cuts = [([texts[i][a:a + step + LENGTH - 1]], i, a) for i, a in texts_at]
            else:
                cuts = [(texts, None, 0)]
            for some, i, a in cuts:
                text, first, windows, lead, seed, span = anchors(some)
                if i is not None:
                    text, first = text + i, first + a
                k, r = ks[text], rs[text]
                by = np.lexsort((first, r, k, span, seed))
                text, first, windows, lead, seed, span, k, r = (x[by] for x in (text, first, windows, lead, seed, span, k, r))
                head = _heads(seed, span)
                eldest = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
                # a repeated row holds the eldest's own place again: the same document, not a repeat of it
                keep = head | (k != k[eldest]) | (r != r[eldest]) | (first != first[eldest])
                again, seed, span, k, r = (x[keep] for x in (~head, seed, span, k, r))
                place = (first << 16 | windows << 8 | lead)[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed.view(np.int64)), pa.array(span.view(np.int64)), pa.array(k), pa.array(r),
                     pa.array(place), pa.array(again)],
                    names=["seed", "span", "k", "r", "place", "settled"])

    rows = docs.select(id_key().alias("k"), F.xxhash64(text_bytes()).alias("r"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "seed long, span long, k long, r long, place long, settled boolean")


def _meet(batches):
    """Rows sorted by seed, span and age -> stretches (seed null) and first holders of seeds with several spans."""
    names = ("seed", "span", "k", "r", "place")
    held = [np.zeros(0, np.int64) for _ in names]

    def out(seed, k, r, place, stretch):
        return pa.RecordBatch.from_arrays(
            [pa.array(seed, mask=stretch), pa.array(k), pa.array(r), pa.array(place)], names=["seed", "k", "r", "place"])

    several = False                  # whether the held span's seed had another span before it

    def holders(c):
        return out(c[0], c[2], c[3], c[4], np.zeros(len(c[0]), bool))

    for batch in batches:
        new = [np.asarray(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False), np.int64) for c in names]
        settled = np.asarray(batch.column(batch.schema.get_field_index("settled")).to_numpy(zero_copy_only=False), bool)
        if settled.any():
            yield out(*(new[i][settled] for i in (0, 2, 3, 4)), np.ones(int(settled.sum()), bool))
        rows = [np.concatenate((h, x[~settled])) for h, x in zip(held, new)]
        if not len(rows[0]):
            continue
        head = _heads(rows[0], rows[1])
        eldest = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
        again = ~head & ~((rows[2] == rows[2][eldest]) & (rows[3] == rows[3][eldest]) & (rows[4] == rows[4][eldest]))
        if again.any():
            yield out(*(rows[i][again] for i in (0, 2, 3, 4)), np.ones(int(again.sum()), bool))
        firsts = [x[head] for x in rows]
        starts = np.flatnonzero(_heads(firsts[0]))
        size = np.diff(np.r_[starts, len(firsts[0])])
        size[0] += several
        many = np.repeat(size > 1, np.diff(np.r_[starts, len(firsts[0])]))
        # the last span may go on in the next batch; of its seed nothing else is held
        several, many[-1] = bool(many[-1]), False
        yield holders([x[many] for x in firsts])
        held = [x[-1:] for x in firsts]
    if several:
        yield holders(held)


def _fetch(batches):
    """(k, r, text, holders) -> one row per holder with the bytes of its span."""
    import xxhash
    for part in K.row_slices(batches, 2 << 20):
        rows = []
        for k, r, text, holders in zip(*(part.column(i).to_pylist() for i in range(4))):
            for h in holders:
                first, windows, lead = h["place"] >> 16, h["place"] >> 8 & 255, h["place"] & 255
                at = first + lead                       # offsets: first window `lead`, last `lead - windows`
                low, high = lead - windows, lead
                left, right = text[at - high:at], text[at:at - low + LENGTH]
                if not h["hot"]:
                    rows.append((h["seed"], k, r, at, low, high, left, right))
                    continue
                if low <= HALF:
                    key = xxhash.xxh3_64_intdigest(right[SEED:SEED + HALF], h["seed"] & (1 << 63) - 1) >> 1
                    rows.append((key, k, r, at, low, min(high, HALF), left[max(0, high - HALF):], right))
                if high > HALF:
                    key = -(xxhash.xxh3_64_intdigest(left[-HALF:], h["seed"] & (1 << 63) - 1) >> 1) - 1
                    rows.append((key, k, r, at, max(low, HALF + 1), high, left, right[:LENGTH - max(low, HALF + 1)]))
        for i in range(0, len(rows), 20_000):
            cols = list(zip(*rows[i:i + 20_000]))
            kinds = [pa.int64()] * 6 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             names=["g", "k", "r", "at", "low", "high", "left", "right"])


def _matrix(values: list[bytes], width: int, from_right: bool) -> np.ndarray:
    data = b"".join(v.rjust(width, b"\0") if from_right else v.ljust(width, b"\0") for v in values)
    return np.frombuffer(data, np.uint8).reshape(len(values), width)


def _sort_blocks(batches):
    """Holders sorted by group -> stretches (k, r, begin, end) that repeat an older holder."""

    def block(rows):
        g, k, r, at, low, high = (np.array([x[i] for x in rows], np.int64) for i in range(6))
        right_size = LENGTH - low
        b = Block(g, _matrix([x[6] for x in rows], REACH, True), _matrix([x[7] for x in rows], LENGTH, False), high, right_size)
        by = np.lexsort((at, r, k))
        age = np.empty(len(rows), np.int64)        # equal for rows that are the same document
        age[by] = np.cumsum(_heads(k[by], r[by], at[by]))
        least, most = b.repeats(low, high, age)
        hit = most >= least
        return pa.RecordBatch.from_arrays(
            [pa.array(k[hit]), pa.array(r[hit]), pa.array((at - most)[hit]), pa.array((at - least + LENGTH)[hit])],
            names=["k", "r", "begin", "end"])

    held: list[tuple] = []
    for batch in batches:
        rows = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                          for c in ("g", "k", "r", "at", "low", "high", "left", "right"))))
        held += rows
        while len(held) >= SORT_ROWS and held[0][0] != held[-1][0]:
            cut = min(len(held), SORT_ROWS) - 1
            while cut and held[cut - 1][0] == held[cut][0]:
                cut -= 1
            if not cut:
                cut = next(i for i, x in enumerate(held) if x[0] != held[0][0])
            yield block(held[:cut])
            held = held[cut:]
    if held:
        yield block(held)


def _windows(batches):
    """Holders with their bytes -> (k, r, at, begin, bytes) of each of their windows."""
    for part in K.row_slices(batches, SLICE_BYTES >> 5):            # a holder has up to 77 windows
        rows = []
        for k, r, at, low, high, left, right in zip(*(part.column(i).to_pylist() for i in range(7))):
            text, anchor = left + right, len(left)
            rows += [(k, r, at, at - o, text[anchor - o:anchor - o + LENGTH]) for o in range(low, high + 1)]
        kinds = [pa.int64()] * 4 + [pa.binary()]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["k", "r", "at", "begin", "bytes"])


def _by_window(holders: DataFrame, folder: str) -> DataFrame:
    """Stretches of holders whose group is too large for one task; grouped by the bytes of each window.

    A first aggregate over hashes, partial before the shuffle, drops the windows that occur once; the eldest
    of the others is found by the bytes themselves.  Equal windows share their group, so nothing else can repeat them.
    """
    windows = holders.select("k", "r", "at", "low", "high", "left", "right").mapInArrow(
        _windows, "k long, r long, at long, begin long, bytes binary").withColumn("hash", F.xxhash64("bytes"))
    place = F.struct("k", "r", "begin")
    shared = stage(windows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), folder, "shared")
    found = stage(windows.join(small_ids(shared), "hash", "left_semi").drop("hash"), folder, "windows")
    eldest = found.groupBy("bytes").agg(F.min(place).alias("eldest"))
    again = found.join(eldest, "bytes").where(place != F.col("eldest"))
    return (again.groupBy("k", "r", "at").agg(F.min("begin").alias("begin"), (F.max("begin") + LENGTH).alias("end"))
            .select("k", "r", "begin", "end"))


def stretches(docs: DataFrame, folder: str) -> DataFrame:
    """(k, r, begin, end): byte stretches to remove, overlapping, by document."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    found = _anchor_rows(docs)
    met = (found.repartition(parts, F.when(F.col("settled"), F.col("k")).otherwise(F.col("seed")))
           .sortWithinPartitions("seed", "span", "k", "r", "place")
           .mapInArrow(_meet, "seed long, k long, r long, place long"))
    met = stage(met, folder, "met")
    release(spark)
    first = F.shiftright("place", 16)
    whole = (met.where("seed IS NULL")
             .select("k", "r", first.alias("begin"),
                     (first + F.shiftright("place", 8).bitwiseAND(F.lit(255)) + LENGTH).alias("end")))
    holders = met.where("seed IS NOT NULL")
    hot = holders.groupBy("seed").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SPLIT).select("seed", F.lit(True).alias("hot"))
    hot = stage(hot, folder, "hot")
    dealt = holders.join(small_ids(hot), "seed", "left")
    lists = (dealt.groupBy("k", "r").agg(F.collect_list(F.struct("seed", "place", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("holders")))
    texts = docs.select(id_key().alias("k"), F.xxhash64(text_bytes()).alias("r"), text_bytes().alias("text"))

    # repeated rows fetch once; the join has put them side by side
    fetched = (texts.join(lists, ["k", "r"]).dropDuplicates(["k", "r"]).select("k", "r", "text", "holders")
               .mapInArrow(_fetch, "g long, k long, r long, at long, low long, high long, left binary, right binary"))
    windowed = None
    if not hot.isEmpty():
        # bytes are fetched once and staged, so that groups that are still too large can go window by window
        fetched = stage(fetched, folder, "fetched")
        release(spark)
        large = stage(fetched.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SPLIT).select("g"), folder, "large")
        if not large.isEmpty():
            large = small_ids(large)
            windowed = _by_window(fetched.join(large, "g", "left_semi"), folder)
            fetched = fetched.join(large, "g", "left_anti")
    sorted_ = (fetched.repartition(parts, "g").sortWithinPartitions("g")
               .mapInArrow(_sort_blocks, "k long, r long, begin long, end long"))
    if windowed is not None:
        sorted_ = sorted_.unionByName(windowed)
    edges = stage(sorted_, folder, "edges")
    release(spark)
    return whole.unionByName(edges)


def _cut(batches, as_text: bool):
    """(doc, text, marks) -> text without the marked stretches, and the merged stretches."""
    for part in K.row_slices(batches):
        texts, marks = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("text", "marks"))
        kept, spans = [], []
        for text, mark in zip(texts, marks):
            merged: list[list[int]] = []
            for m in sorted((m["begin"], m["end"]) for m in mark or ()):
                if merged and m[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], m[1])
                else:
                    merged.append(list(m))
            pieces, at = [], 0
            for a, z in merged:
                pieces.append(text[at:a])
                at = z
            kept.append(b"".join(pieces) + text[at:])
            spans.append([{"begin": a, "end": z} for a, z in merged])
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index("doc")), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
             pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
            names=["doc", "n_bytes", "kept", "spans"])


def dedup(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """(doc, n_bytes, kept, spans): ``doc`` holds the columns but ``text``, ``kept`` the remaining bytes.

    ``as_text``: ``kept`` is a string without characters that a cut left incomplete.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    marks = (stretches(docs, folder).groupBy("k", "r")
             .agg(F.collect_list(F.struct("begin", "end")).alias("marks")))
    marks = stage(marks, folder, "marks")
    discard(spark, folder, "met", "hot", "fetched", "large", "shared", "windows", "edges")
    release(spark)
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(doc.alias("doc"), id_key().alias("k"), F.xxhash64(text_bytes()).alias("r"), text_bytes().alias("text"))
    joined = rows.join(marks, ["k", "r"], "left").select("doc", "text", "marks")
    kind = joined.schema["doc"].dataType.simpleString()
    return joined.mapInArrow(lambda batches: _cut(batches, as_text),
                             f"doc {kind}, n_bytes long, kept {'string' if as_text else 'binary'}, "
                             "spans array<struct<begin:bigint,end:bigint>>")


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(
        F.col("doc.doc_id").alias("doc_id"), "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


#: The same result in one statement.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce("text", ''))) AS x FROM documents),
b AS (SELECT doc_id, x, unnest(range(0, length(x) // 2)) AS i FROM d),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS c, CASE WHEN 2 * i + 200 <= length(x) THEN substr(x, 2 * i + 1, 200) END AS s FROM b),
f AS (SELECT doc_id, i, c, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM w),
g AS (SELECT doc_id, i, c, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS 99 PRECEDING) AS gone FROM f),
h AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS head FROM g),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone = 1) AS n_removed, count(*) FILTER (WHERE head) AS n_spans,
             string_agg(c, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
