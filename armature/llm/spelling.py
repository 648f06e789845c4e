"""Spelling variants of a corpus's words (operator 11).

Method: relational trie frontier.  The words form a trie, kept as a distributed edge table
(node, sign, label, child); chains without a branch are one edge, so a word of any length has few levels.  States
(node, word, rest) say that a word's beginning has been followed to a node with the allowed edit
already made, and that ``rest`` is still to be read.  Level by level the frontier joins the edge
table; states that have read everything at the end of a word are neighbours.

* Two near words part at a branch of the trie, so edits are made only at the branches on a word's
  own path: one sign replaced (the frontier joins the branch's other edges) or one sign left out.
  An inserted sign is the other word's deletion, and of two words that differ in one sign the smaller finds
  the greater; pairs are then mirrored.
* An edit lies in the second half of a word or of its reversal.  Both directions go through the
  same tables, and only nodes in the lower half of a word are kept: the crowded top of the trie is never joined.
* Nodes are 63-bit hashes of their paths and a bit for the direction.  A collision could only add edges; every
  pair is confirmed by its edit distance.

Scale: every step is a shuffle join or a map-side aggregate; joins on a crowded node are split by
adaptive execution, as the edge side has at most one row per sign.  The number of levels is the greatest number of
branches below a word's middle.

Defined results: null or empty text has no words; a null id is written as an empty text before the colon; rows that
repeat an id are separate documents, repeated rows count again; without words there are no rows. Words of any length
are taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armature.llm import tokens as K
from armature.llm.common import discard, release, shared_folder, stage

#: The letters of a run, and what happens to one run in ``MISSPELT``.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MISSPELT = 31

GROWN = "kind int, node long, sign int, label string, child long, word string, n long, rest string"
_EDGE, _REPLACE, _DELETE, _END = range(4)


def occurrences(docs: DataFrame, least: int = 7) -> DataFrame:
    """(word): every run of at least ``least`` letters in A-Z lower case, one in ``MISSPELT`` without one of its letters."""
    run = F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")) \
        .select("id", run.alias("run"))
    # a run of ASCII letters alone is lower-cased as a whole, which gives the same and costs less than sign by sign
    runs = runs.withColumn("run", F.when(F.octet_length("run") == F.length("run"), F.lower("run"))
                           .otherwise(F.translate("run", UPPER, LOWER)))
    h = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    cut = F.expr("concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2))")
    return h.select(F.when(F.col("h") % MISSPELT == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def words(docs: DataFrame, least: int = 7, seen: int = 2) -> DataFrame:
    """(word, n): distinct words with at least ``seen`` occurrences."""
    return occurrences(docs, least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= seen)


def _hashes(codes: np.ndarray, side: int) -> np.ndarray:
    """Hashes of the beginnings (0 to all signs) of words of one length, a row of code points each.

    The lowest bit is the direction, so that the two directions never share a node and no pair is met in both.
    """
    m, size = codes.shape
    out = np.empty((m, size + 1), np.uint64)
    h = np.full(m, 0x9E3779B97F4A7C15, np.uint64)
    out[:, 0] = h
    for d in range(size):
        h = (h ^ codes[:, d].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out[:, d + 1] = h
    return out << np.uint64(1) | np.uint64(side)


def _beginnings(batches):
    """(w, side, d, node, sign): the nodes in the lower half of each word, with the next sign (0 at the end)."""
    for part in K.row_slices(batches, 1 << 20):
        ids, texts = part.column(0).to_numpy(), part.column(1).to_pylist()
        by_size: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            by_size.setdefault(len(t), []).append(i)
        for size, rows in by_size.items():
            codes = np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le"), "<u4").reshape(-1, size)
            half, w = size // 2, np.repeat(ids[rows], size - size // 2 + 1)
            for side in (0, 1):
                c = codes if side == 0 else codes[:, ::-1]
                nodes = _hashes(c, side)[:, half:]
                signs = np.concatenate((c[:, half:], np.zeros((len(rows), 1), c.dtype)), axis=1)
                n = nodes.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w, pa.int64()), pa.array(np.full(n, side, np.int32)),
                     pa.array(np.tile(np.arange(half, size + 1, dtype=np.int32), len(rows))),
                     pa.array(nodes.ravel().view(np.int64)), pa.array(signs.ravel().astype(np.int32))],
                    names=["w", "side", "d", "node", "sign"])


def _grow(batches):
    """Edges, ends and first states (``GROWN``) of words with their branches (word, n, side, path)."""
    names = ["kind", "node", "sign", "label", "child", "word", "n", "rest"]
    types = dict(zip(names, (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())))

    def rows(kind, m, **columns):
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)) if c == "kind" else pa.array(columns[c], types[c])
                                           if c in columns else pa.nulls(m, types[c]) for c in names], names=names)

    for part in K.row_slices(batches, 1 << 20):
        words, n, side = part.column(0).to_pylist(), part.column(1).to_numpy(), part.column(2).to_numpy()
        texts = [w[::-1] if r else w for w, r in zip(words, side.tolist())]
        sizes = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(sizes) - sizes
        codes = np.append(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64), 0)
        begins = np.append(True, codes[1:] != codes[:-1])
        begins[base] = True
        run = np.maximum.accumulate(np.where(begins, np.arange(len(codes)), 0))    # where a stretch of one sign begins
        steps = part.column(3)
        own_row = np.repeat(np.arange(len(texts)), np.diff(steps.offsets.to_numpy()))
        d, node, a, z = (f.to_numpy() for f in steps.flatten().flatten())
        order = np.lexsort((d, own_row))
        own_row, d, node, a, z = own_row[order], d[order].astype(np.int64), node[order], a[order], z[order]
        last = np.append(own_row[1:] != own_row[:-1], True)
        ends = own_row[last].tolist()
        yield rows(_END, len(ends), node=node[last], sign=np.zeros(len(ends), np.int32), word=[words[i] for i in ends], n=n[ends])
        at = np.flatnonzero(~last)
        e, child, i, d, node, a, z = d[at + 1], node[at + 1], own_row[at], d[at], node[at], a[at], z[at]
        own, after = codes[base[i] + d], np.where(d + 1 < sizes[i], codes[base[i] + d + 1], 0)
        yield rows(_EDGE, len(i), node=node, sign=own.astype(np.int32), child=child,
                   label=[texts[j][x:y] for j, x, y in zip(i.tolist(), d.tolist(), e.tolist())])
        # a pair is found where its words part in reading order if that is past the middle, else in reverse;
        # a and z are the branch's least and greatest sign, so other states have no edge to go on
        forth, half = side[i] == 0, sizes[i] // 2
        other = (own < z) & (forth | (sizes[i] - 1 - d < half))
        left_out = (after != own) & (a <= after) & (after <= z) & (forth | (sizes[i] - 1 - (run[base[i] + d] - base[i]) < half))
        for kind, signs, these in ((_REPLACE, own, other), (_DELETE, np.zeros_like(own), left_out)):
            j, x = i[these].tolist(), d[these].tolist()
            yield rows(kind, len(j), node=node[these], sign=signs[these].astype(np.int32), word=[words[k] for k in j], n=n[j],
                       rest=[texts[k][y + 1:] for k, y in zip(j, x)])


def near_pairs(words: DataFrame, folder: str) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of ``words`` (w, word, n) that are one edit apart; w: a number per row."""
    found = words.select("w", "word").mapInArrow(_beginnings, "w long, side int, d int, node long, sign int")
    branches = (found.groupBy("node").agg(F.min("sign").alias("a"), F.max("sign").alias("z"))
                .where("a = 0 OR a < z"))
    paths = (found.select("w", "side", "d", "node").join(branches, "node").groupBy("w", "side")
             .agg(F.collect_list(F.struct("d", "node", "a", "z")).alias("path")))
    grown = stage(paths.join(words, "w").select("word", "n", "side", "path").mapInArrow(_grow, GROWN), folder, "grown")
    edges = stage(grown.where(F.col("kind") == _EDGE).select("node", "sign", "label", "child").distinct(), folder, "edges")
    release(words.sparkSession)

    def after(states: DataFrame, eaten: Column) -> DataFrame:
        return states.select(F.col("child").alias("node"), "word", "n", F.expr("rest").substr(eaten, F.length("rest")).alias("rest"))

    other = grown.where(F.col("kind") == _REPLACE).select("node", F.col("sign").alias("own"), "word", "n", "rest")
    replaced = after(other.join(edges, "node").where("sign > own AND startswith(rest, substring(label, 2))"), F.length("label"))
    frontier = stage(grown.where(F.col("kind") == _DELETE).select("node", "word", "n", "rest").unionByName(replaced), folder, "level-0")
    level, met = 0, frontier.where("rest = ''").select("node", "word", "n")
    while True:
        going = frontier.where("rest <> ''")
        if going.isEmpty():
            break
        level += 1
        frontier = stage(after(going.withColumn("sign", F.ascii("rest")).join(edges, ["node", "sign"])
                               .where("startswith(rest, label)"), F.length("label") + 1), folder, f"level-{level}")
        met = met.unionByName(frontier.where("rest = ''").select("node", "word", "n"))
    ends = grown.where(F.col("kind") == _END).select("node", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = met.join(ends, "node").where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")
    pairs = met.unionByName(met.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"),
                                       F.col("n").alias("near_n")))
    return stage(pairs, folder, "pairs")


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) of the words that have a form, by pointer doubling over (word, form)."""
    now, step = stage(forms.select("word", F.col("form").alias("root")), folder, "roots-0"), 0
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step += 1
        moved = stage(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                               F.col("next").isNotNull().alias("moved")), folder, f"roots-{step}")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def variants(docs: DataFrame, least: int = 7, seen: int = 2, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its most frequent near word, if ``factor`` times as frequent."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    known = stage(words(docs, least, seen).withColumn("w", F.monotonically_increasing_id()), folder, "words")
    release(spark)
    pairs = near_pairs(known, folder)
    release(spark)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= factor * F.col("n")
    formed = stage(known.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), folder, "formed")
    ends = roots(formed.where("form IS NOT NULL"), folder)
    discard(spark, folder, "words", "grown", "edges", "pairs")
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: ``variants`` in one statement: CRC-32 by its table, near words by equal texts with one letter left out.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
x AS (SELECT doc_id, unnest(regexp_extract_all("text", '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
r AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM x WHERE length(raw) >= 7 GROUP BY ALL),
b AS (SELECT run, times, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
        lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 + (unicode(ch) >> 6)::BIGINT, 128 + (unicode(ch) & 63)::BIGINT] END)) AS bytes FROM r),
h AS (SELECT run, times, xor(list_reduce(bytes, lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) AS h FROM b, t),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM h),
w AS (SELECT word, sum(times)::BIGINT AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.rest = w.word),
f AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM p GROUP BY word),
v AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN f ON w.word = f.word),
c AS (SELECT word, word AS root, form AS further FROM v UNION ALL SELECT c.word, v.word, v.form FROM c JOIN v ON c.further = v.word)
SELECT v.word, v.form, c.root, v.n, v.n_near, v.form_n FROM v JOIN c ON v.word = c.word AND c.further IS NULL
"""
