"""Toxicity scores from a learned lexicon (operator 10).

Method: the lexicon holds the words and word beginnings that labelled toxic
documents hold far more often than clean ones.  Its words form a trie; a word
of a text that is not in it is matched by intersecting the word's Levenshtein
automaton with the trie (one edit from 5 letters on, two from 9), which catches
misspellings.  A term that has such a neighbour among the words of the clean
labelled documents is matched exactly only.  A window of ``WINDOW`` words around each match separates quotation
(marks around the match, or a reporting word and a mark before it) from abuse; quoted matches never
raise a score.  A logistic
regression over the summed weights of abusive and quoted matches (a misspelling counts
``NEAR`` of its term), the strongest match and their share of the text gives the score.

Learning uses at most ``TRAIN_ROWS`` labelled rows (those with the least hash of their
id, so the choice does not depend on partitions; edited copies of one another mostly count
once), never rows whose ``crc32(doc_id) mod 5`` is 0; their words are counted by Spark, and at most
``TERMS`` terms and one row of features per labelled row reach the driver.
Scoring is row by row over whole texts, without a shuffle.

Defined results: null text counts as empty and gets the score of a text without
matches; a null id is held out; without usable labels every score is the same, below 0.5.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armature.llm import tokens as K
from armature.llm.common import shared_folder, stage, text_bytes
from armature.shipping import ship

TRAIN_ROWS = 20_000
TERMS = 4_000
SUPPORT = 0.02          # least share of the toxic documents that hold a term
WINDOW = 5
NEAR = 0.7
FEATURES = 4
_CACHE = 200_000
#: Marks that open or close a quotation, and words that report speech.
QUOTES = "\"“”„«»‹›‘’"
REPORTING = {
    "said", "says", "called", "quoted", "quote", "wrote", "word", "term", "slur",
    "dit", "écrit", "mot", "sagte", "schrieb", "wort", "dijo", "escribió", "palabra",
}
PREFIXES = (4, 5, 6)


def _word(chunk: str) -> str:
    """The chunk in lower case without signs at its ends."""
    w = chunk.lower()
    a, z = 0, len(w)
    while a < z and not w[a].isalpha():
        a += 1
    while z > a and not w[z - 1].isalpha():
        z -= 1
    return w[a:z]


class Trie:
    """Words as nested dictionaries; the empty key marks an end."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str, edits: int) -> str | None:
        """A word of the trie within ``edits`` edits: the automaton of ``word`` runs along the trie.

        State ``e`` of the automaton is a bit set: bit i says that i letters of ``word`` are matched
        with e edits.
        """
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        goal = 1 << len(word)
        start = [(1 << e + 1) - 1 for e in range(edits + 1)]
        stack = [(self.root, start)]
        while stack:
            node, states = stack.pop()
            for c, child in node.items():
                if not c:
                    if any(s & goal for s in states):
                        return child
                    continue
                mask = masks.get(c, 0)
                after = [(states[0] & mask) << 1]
                for e in range(1, edits + 1):
                    after.append((states[e] & mask) << 1 | states[e - 1] | states[e - 1] << 1 | after[-1] << 1)
                if any(after):
                    stack.append((child, after))
        return None


class Pieces:
    """Quick exclusion before the automaton: of k + 1 pieces of a term, k edits leave one whole."""

    def __init__(self, words, edits: int):
        self.edits = edits
        first, middle, last = set(), set(), set()
        for w in words:
            cut = [len(w) * i // (edits + 1) for i in range(edits + 2)]
            parts = [w[a:z] for a, z in zip(cut, cut[1:])]
            first.add(parts[0])
            last.add(parts[-1])
            middle.update(parts[1:-1])
        self.first, self.middle, self.last = first, middle, last
        self.first_sizes, self.middle_sizes, self.last_sizes = ({len(p) for p in s} for s in (first, middle, last))

    def may_match(self, word: str) -> bool:
        return (any(word[:n] in self.first for n in self.first_sizes) or any(word[-n:] in self.last for n in self.last_sizes)
                or any(word[i:i + n] in self.middle for n in self.middle_sizes for i in range(len(word) - n + 1)))


class Lexicon:
    """Weights of terms (``word`` or ``beginning*``); words in ``exact`` are not matched misspelled."""

    def __init__(self, weights: dict[str, float], exact=()):
        self.words = {t: w for t, w in weights.items() if not t.endswith("*")}
        self.starts = {t[:-1]: w for t, w in weights.items() if t.endswith("*")}
        loose = self.words.keys() - set(exact)
        self.trie = Trie(w for w in loose if len(w) >= 5)
        self.long = Trie(w for w in loose if len(w) >= 9)
        self.one, self.two = Pieces((w for w in loose if len(w) >= 5), 1), Pieces((w for w in loose if len(w) >= 9), 2)

    def neighbour(self, word: str) -> str | None:
        """A word of the lexicon of which ``word`` may be a misspelling."""
        if len(word) < 4 or len(word) > 60:
            return None
        found = self.trie.near(word, 1) if self.one.may_match(word) else None
        if not found and len(word) >= 7 and self.two.may_match(word):
            found = self.long.near(word, 2)
        return found

    def match(self, word: str) -> float:
        weight = self.words.get(word, 0.0)
        for n in PREFIXES:
            if len(word) >= n:
                weight = max(weight, self.starts.get(word[:n], 0.0))
        if not weight and (found := self.neighbour(word)):
            weight = NEAR * self.words[found]
        return weight


class Scorer:
    """Features of whole texts; matches of recently used chunks are kept."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.cache = lexicon, {}

    def _match(self, chunk: bytes):
        if len(self.cache) > _CACHE:
            self.cache.clear()
        value = self.cache[chunk] = self.lexicon.match(_word(chunk.decode("utf-8")))
        return value

    @staticmethod
    def _quoted(chunks: list[bytes], i: int) -> bool:
        before = [c.decode("utf-8") for c in chunks[max(0, i - WINDOW):i + 1]]
        after = [c.decode("utf-8") for c in chunks[i:i + WINDOW + 1]]
        opened = any(c.lstrip("([{")[:1] in QUOTES and c.lstrip("([{") for c in before)
        closed = any(c.rstrip(".,;:!?)]}")[-1:] in QUOTES and c.rstrip(".,;:!?)]}") for c in after)
        return opened and (closed or any(_word(c) in REPORTING for c in before[-4:-1]))

    def features(self, text: bytes) -> list[float]:
        chunks = text.split()
        found = list(map(self.cache.get, chunks))
        if None in found:
            cache, match = self.cache, self._match
            for i, f in enumerate(found):
                if f is None:
                    c = chunks[i]
                    known = cache.get(c)
                    found[i] = match(c) if known is None else known
        abuse = quoted = top = 0.0
        if any(found):
            for i, weight in enumerate(found):
                if weight:
                    if self._quoted(chunks, i):
                        quoted += weight
                    else:
                        abuse += weight
                        top = max(top, weight)
        return [math.log1p(abuse), math.log1p(quoted), top, math.log1p(100 * abuse / (len(chunks) + 20))]


def held_out(col: str = "doc_id"):
    text = F.coalesce(F.col(col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(5)) == 0


def _outlines(batches):
    """(label, text) -> (label, text, outline): the least hash of three words in a row, mostly equal for edited copies."""
    import xxhash
    for part in K.row_slices(batches, 1 << 20):
        least = []
        for text in part.column(1).to_pylist():
            w = text.split()
            least.append(min((xxhash.xxh3_64_intdigest(b" ".join(w[i:i + 3])) >> 1 for i in range(max(1, len(w) - 2))), default=0))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(least, pa.int64())],
                                         names=["label", "text", "outline"])


def _count_terms(batches):
    """(label, text) -> (term, toxic, clean): documents of either label that hold a term."""
    for part in K.row_slices(batches, 1 << 20):
        counts = (Counter(), Counter())
        for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            words = {_word(c.decode("utf-8")) for c in set(text.split())}
            terms = {w for w in words if 3 <= len(w) <= 40}
            terms |= {w[:n] + "*" for w in terms for n in PREFIXES if len(w) > n}
            counts[label].update(terms)
        terms = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(terms), 50_000):
            some = terms[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.string()), pa.array([counts[1][t] for t in some], pa.int64()),
                 pa.array([counts[0][t] for t in some], pa.int64())], names=["term", "toxic", "clean"])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients, the last one constant (iterated weighted least squares); weights of matches stay positive."""
    scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(x.shape[1])
    z = np.hstack((x / scale, np.ones((len(x), 1))))
    beta = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge * max(1, len(x)) / 100)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        w = p * (1 - p) + 1e-6
        step = np.linalg.solve((z * w[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    beta[:-1] /= scale
    beta[1] = min(beta[1], 0.0)         # a quotation is no abuse, however the labelled rows fell
    return beta


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and coefficients from labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_folder(spark)
    usable = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
              .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)     # the stated bound of the sample
    chosen = stage(chosen.select(F.col("doc_id").alias("id"), (F.col("label") > 0).cast("int").alias("label")), folder, "chosen")
    rows = (docs.select(F.col("doc_id").alias("id"), text_bytes().alias("text"))
            .join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("label", "text"))
    rows = rows.mapInArrow(_outlines, "label int, text binary, outline long").dropDuplicates(["label", "outline"])
    rows = stage(rows.select("label", "text"), folder, "rows")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = (rows.mapInArrow(_count_terms, "term string, toxic long, clean long")
              .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    counts = stage(counts, folder, "counts")
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    strong = (counts.where(F.col("toxic") >= max(3, math.ceil(SUPPORT * toxic))).withColumn("weight", odds)
              .where("weight >= 2.5").orderBy(F.desc("weight"), "term").limit(TERMS))
    weights = {r["term"]: r["weight"] for r in strong.collect()}
    draft = Lexicon(weights)

    def neighbours(batches):
        for batch in batches:
            found = {draft.neighbour(t) for t in batch.column(0).to_pylist() if not draft.words.get(t)} - {None}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["term"])

    # terms of the lexicon, at most TERMS
    exact = [r["term"] for r in counts.where("clean > 0 AND NOT endswith(term, '*')").select("term")
             .mapInArrow(neighbours, "term string").distinct().collect()]
    lexicon = Lexicon(weights, exact)

    def measure(batches):
        scorer = Scorer(lexicon)
        for part in K.row_slices(batches):
            x = [scorer.features(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    seen = rows.mapInArrow(measure, "label int, x array<double>").collect()
    x = np.array([r["x"] for r in seen]).reshape(len(seen), FEATURES)
    y = np.array([r["label"] for r in seen], float)
    if not toxic or not clean:
        return lexicon, np.array([0.0] * FEATURES + [-2.0])
    return lexicon, fit_logistic(x, y)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, score): ``doc`` holds the input columns."""
    lexicon, beta = learn(docs, labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_bytes().alias("text"))

    def run(batches):
        scorer = Scorer(lexicon)
        for part in K.row_slices(batches):
            x = np.array([scorer.features(t) for t in part.column(1).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], names=["doc", "score"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; only id and text are read."""
    scored = score(docs.select("doc_id", "text"), labels).select(F.col("doc.doc_id").alias("doc_id"), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5."""
    return score(docs, labels).where("score < 0.5").select("doc.*")
