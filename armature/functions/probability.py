"""Answer probabilities from token log-probabilities (A1-A3), as array expressions.

Everything is a higher-order SQL expression (``transform``/``filter``/
``aggregate``) evaluated per row in the JVM; the answer-variant registry is an
array literal, so marginalising over spellings needs no join and no explode.

Token positions are ``array<array<struct<token string, logprob double>>>`` -
the shape of a batch response's ``logprobs.content[].top_logprobs``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armature.sources.registry import VARIANTS


def _sq(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _dq(s: str) -> str:
    """DuckDB string literal."""
    return "'" + s.replace("'", "''") + "'"


def tokenize_variant(v: str) -> list[str]:
    """Tokens of a spelling where no tokenizer's own sequence is given: a blank belongs to the word after it."""
    return re.findall(r" ?[^ ]+| ", v)


def chain_prob_sql(positions: str, tokens: list[str]) -> str:
    """A2 (Spark SQL): exp(sum_i logprob(tokens[i] at position i)); 0 when the variant is longer
    than the response or any token is outside that position's top list (last entry wins)."""
    n = len(tokens)
    arr = "array(" + ", ".join(_sq(t) for t in tokens) + ")"
    lps = (f"zip_with({arr}, slice({positions}, 1, {n}), "
           f"(vt, m) -> try_element_at(filter(m, x -> x.token = vt), -1).logprob)")
    return (f"(CASE WHEN size({positions}) < {n} THEN 0D "
            f"ELSE coalesce(exp(aggregate({lps}, 0D, (a, x) -> a + x)), 0D) END)")


def chain_prob_duck(positions: str, tokens: list[str]) -> str:
    """A2 (DuckDB twin)."""
    n = len(tokens)
    lst = "[" + ", ".join(_dq(t) for t in tokens) + "]"
    lps = (f"list_transform(range(1, {n + 1}), lambda j: "
           f"list_filter({positions}[j], lambda x: x.token = {lst}[j])[-1].logprob)")
    return (f"(CASE WHEN len({positions}) < {n} THEN 0.0 "
            f"WHEN len(list_filter({lps}, lambda x: x IS NOT NULL)) < {n} THEN 0.0 "
            f"ELSE exp(list_sum({lps})) END)")


def marginal_duck(positions: str, label: str, seqs: list[list[str]] | None = None) -> str:
    """A1 (DuckDB): sum of A2 over every spelling of ``label``."""
    return " + ".join(chain_prob_duck(positions, t) for t in seqs or map(tokenize_variant, VARIANTS[label]))


def chain_prob(positions: str, answer: str) -> Column:
    """A2 as a Column: probability that the response starts with ``answer``."""
    return F.expr(chain_prob_sql(positions, tokenize_variant(answer)))


def whitespace_positions_sql(text: str, first: int | None = None) -> str:
    """Top-logprob positions derived from a text: one position per word with the blank before it,
    entries (token, lower, upper) with data-derived log-probabilities (Spark SQL); only the ``first`` ones if given."""
    lp = "CAST(length(tok) % 7 AS DOUBLE) / CAST(-10 AS DOUBLE)"
    words = f"filter(transform(split({text}, ' '), (w, i) -> concat(if(i = 0, '', ' '), w)), w -> w <> '')"
    if first is not None:
        words = f"slice({words}, 1, {first})"
    return (f"transform({words}, tok -> array(named_struct('token', tok, 'logprob', {lp}), "
            f"named_struct('token', lower(tok), 'logprob', {lp} - CAST(1 AS DOUBLE)), "
            f"named_struct('token', upper(tok), 'logprob', {lp} - CAST(2 AS DOUBLE))))")


def whitespace_positions_duck(text: str) -> str:
    lp = "CAST(length(tok) % 7 AS DOUBLE) / CAST(-10 AS DOUBLE)"
    words = (f"list_filter(list_transform(string_split({text}, ' '), "
             f"lambda w, i: CASE WHEN i = 1 THEN w ELSE ' ' || w END), lambda w: w <> '')")
    return (f"list_transform({words}, lambda tok: [{{'token': tok, 'logprob': {lp}}}, "
            f"{{'token': lower(tok), 'logprob': {lp} - CAST(1 AS DOUBLE)}}, "
            f"{{'token': upper(tok), 'logprob': {lp} - CAST(2 AS DOUBLE)}}])")


# ---------------------------------------------------------------------------
# A3: full-vocabulary logits -> probability of a picked token id (stable softmax)
# ---------------------------------------------------------------------------

def softmax_logprob_sql(logits: str, idx: str) -> str:
    """log softmax(logits)[idx] with idx 1-based; stable at large logits, without masked (-inf) and null ones."""
    live = f"filter(transform({logits}, v -> CAST(v AS DOUBLE)), v -> v > CAST('-Infinity' AS DOUBLE) AND NOT isnan(v))"
    # one pass: the running maximum m and the sum s of exp(v - m)
    step = ("(a, v) -> if(v > a.m, named_struct('m', v, 's', a.s * exp(a.m - v) + 1D), "
            "named_struct('m', a.m, 's', a.s + exp(v - a.m)))")
    lse = f"aggregate({live}, named_struct('m', CAST('-Infinity' AS DOUBLE), 's', 0D), {step}, a -> a.m + ln(a.s))"
    return f"(CAST(try_element_at({logits}, {idx}) AS DOUBLE) - {lse})"


def softmax_logprob_duck(logits: str, idx: str) -> str:
    m = f"list_max(list_transform({logits}, lambda v: CAST(v AS DOUBLE)))"
    lse = f"({m} + ln(list_sum(list_transform({logits}, lambda v: exp(CAST(v AS DOUBLE) - {m})))))"
    return f"(CAST({logits}[{idx}] AS DOUBLE) - {lse})"


def log_sum_exp(logits: str) -> tuple[str, str]:
    """SQL of a chunk's mergeable (m, s): its greatest logit and the sum of exp(v - m).

    Null and NaN logits are left out, masked (-inf) ones add nothing; an empty chunk has m null.
    """
    live = f"filter(transform({logits}, v -> CAST(v AS DOUBLE)), v -> v > CAST('-Infinity' AS DOUBLE) AND NOT isnan(v))"
    return f"array_max({live})", f"(transform(array({live}), l -> aggregate(l, 0D, (a, v) -> a + exp(v - array_max(l))))[0])"


def logit_positions(chunks: DataFrame, by: list[str], wanted: list[list[str]], pos: str = "pos", offset: str = "offset",
                    logits: str = "logits") -> DataFrame:
    """A3: (by..., positions) from full-vocabulary logits in chunks, one row per (by, pos, chunk).

    ``pos`` counts from 1 and ``offset`` is the id of a chunk's first logit.  Each chunk gives its (maximum,
    scaled sum) and the logits of the ``wanted`` ids at its position (id strings per position); merging the
    pairs normalises them, so no row ever holds a whole vocabulary and the work is linear in its width.
    The result has the shape of a batch response's positions, for ``answer_probs`` on id sequences.
    """
    ids = "array(" + ", ".join("CAST(array(" + ", ".join(w) + ") AS array<long>)" for w in wanted) + ")"
    inside = f"filter(try_element_at({ids}, CAST({pos} AS INT)), i -> i >= {offset} AND i < {offset} + size({logits}))"
    m, s = log_sum_exp(logits)
    live = chunks.select(*by, pos, F.expr(f"size({logits})").alias("_n"), F.expr(logits).alias("_v"), F.expr(inside).alias("_i"), F.col(offset).alias("_o"))
    live = live.select(
        *by, pos, F.expr(log_sum_exp("_v")[0]).alias("_m"), F.expr(log_sum_exp("_v")[1]).alias("_s"),
        F.expr("transform(_i, i -> named_struct('token', CAST(i AS STRING), 'logit', CAST(_v[CAST(i - _o AS INT)] AS DOUBLE)))").alias("_p"))
    merged = live.groupBy(*by, pos).agg(F.collect_list(F.struct("_m", "_s")).alias("_c"), F.flatten(F.collect_list("_p")).alias("_p"))
    merged = merged.withColumn("_m", F.expr("array_max(transform(_c, c -> c._m))"))
    merged = merged.withColumn("_l", F.expr("_m + ln(aggregate(_c, 0D, (a, c) -> a + coalesce(c._s * exp(c._m - _m), 0D)))"))
    picked = merged.select(*by, pos, F.expr(
        "transform(filter(_p, x -> x.logit > CAST('-Infinity' AS DOUBLE) AND NOT isnan(x.logit)), "
        "x -> named_struct('token', x.token, 'logprob', x.logit - _l))").alias("_p"))
    whole = picked.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col(pos).cast("int").alias("k"), "_p"))).alias("_m"))
    return whole.select(*by, F.transform(F.sequence(F.lit(1), F.lit(max(len(wanted), 1))), lambda i: F.try_element_at("_m", i)).alias("positions"))


# ---------------------------------------------------------------------------
# All spellings at once: their token sequences form a prefix trie, level by level, and one fold over
# the first positions carries the log-probability of every trie node.  A prefix shared by many
# spellings is looked up and summed once, and below a node that a position lacks nothing is looked up.
# ---------------------------------------------------------------------------

class VariantTrie:
    """Token sequences by label as trie levels of (index of the parent in the level above, token)."""

    def __init__(self, seqs: dict[str, list[list[str]]]):
        self.levels: list[list[tuple[int, str]]] = []
        self.ends: dict[str, list[int]] = {lab: [] for lab in seqs}     # places among all nodes, root first
        place = {(): 0}
        seqs = {lab: [tuple(s) for s in v] for lab, v in seqs.items()}
        depth = max((len(s) for v in seqs.values() for s in v), default=0)
        total, above = 1, {(): 0}
        for d in range(1, depth + 1):
            level = {p: i for i, p in enumerate(dict.fromkeys(s[:d] for v in seqs.values() for s in v if len(s) >= d))}
            self.levels.append([(above[p[:-1]], p[-1]) for p in level])
            place.update((p, total + i) for p, i in level.items())
            total += len(level)
            above = level
        for lab, v in seqs.items():
            self.ends[lab] = [place[s] for s in v]

    @property
    def depth(self) -> int:
        return len(self.levels)

    def tokens(self) -> list[list[str]]:
        """The distinct tokens at each position."""
        return [sorted({t for _, t in level}) for level in self.levels]

    def walk_sql(self, positions: str) -> str:
        """Log-probability of every node (null where a position lacks its token), in order of ``ends``."""
        if not self.levels:
            return "array(0D)"
        levels = "array(" + ", ".join(
            "array(" + ", ".join(f"named_struct('u', {u}, 't', {_sq(t)})" for u, t in level) + ")" for level in self.levels) + ")"
        root = "slice(array(0D, CAST(NULL AS DOUBLE)), 1, 1)"           # of a type that may hold nulls
        # of several entries of a token the last one counts
        step = ("transform(x.l, n -> if(a.live[n.u] IS NULL, NULL, a.live[n.u] + "
                "try_element_at(filter(x.p, e -> e.token = n.t), -1).logprob))")
        return (f"aggregate(zip_with({levels}, slice({positions}, 1, {self.depth}), (l, p) -> named_struct('l', l, 'p', p)), "
                f"named_struct('live', {root}, 'all', {root}), "
                f"(a, x) -> transform(array({step}), v -> named_struct('live', v, 'all', concat(a.all, v)))[0], a -> a.all)")

    def prob_sql(self, walk: str, label: str) -> str:
        """Sum of the probabilities of a label's sequences."""
        ends = ", ".join(map(str, self.ends[label]))
        return f"aggregate(array({ends}), 0D, (s, i) -> s + coalesce(exp({walk}[i]), 0D))" if ends else "0D"


def token_seqs(labels: list[str], variants=None) -> dict[str, list[list[str]]]:
    """Token sequences of every spelling by label.

    ``variants``: a registry table (label, token_seq) with the model tokenizer's own sequences;
    without it, ``tokenize_variant`` of the registry's spellings.
    """
    if variants is None:
        return {lab: [tokenize_variant(v) for v in VARIANTS[lab]] for lab in labels}
    rows = variants.where(F.col("label").isin(labels)).select("label", "token_seq").collect()     # one per spelling
    return {lab: [list(r["token_seq"]) for r in rows if r["label"] == lab] for lab in labels}


def tries(labels: list[str], variants=None) -> dict[str | None, VariantTrie]:
    """One trie per model of ``variants`` (column model_id), or one under None if it names no models."""
    if variants is None or "model_id" not in variants.columns:
        return {None: VariantTrie(token_seqs(labels, variants))}
    models = [r["model_id"] for r in variants.select("model_id").distinct().collect()]            # the model registry
    return {m: VariantTrie(token_seqs(labels, variants.where(F.col("model_id") == m))) for m in models}


def answer_probs(df: DataFrame, positions: str, labels: list[str], suffix: str = "_prob", variants=None) -> DataFrame:
    """A1 for several labels: adds ``<label lower><suffix>`` columns; 0 where ``positions`` is null.

    ``variants``: see ``token_seqs``; with a column model_id each row is scored by its own model's sequences,
    and a model without sequences gets 0.
    """
    out = df
    for i, (model, trie) in enumerate(tries(labels, variants).items()):
        walk = f"_walk{i}"
        expr = F.expr(trie.walk_sql(positions))
        out = out.withColumn(walk, expr if model is None else F.when(F.col("model_id") == model, expr))
        for lab in labels:
            prob, name = F.expr(trie.prob_sql(walk, lab)), f"{lab.lower()}{suffix}"
            if model is not None:
                prob = F.when(F.col("model_id") == model, prob).otherwise(F.col(name) if i else F.lit(0.0))
            out = out.withColumn(name, prob)
        out = out.drop(walk)
    return out
