"""The registered queries of this subpackage: (query, SQL or None) by name.

Every query applies one operator to its whole table and derives the columns
of its contract from the operator's own results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from armature.llm import (alignment, bpe, hilbert, jaccard, kdtree, line_runs, minmax, packing, spelling, substrings,
                          token_files, tokens, tool_calls, toxicity)
from armature.llm.common import documents
from pyspark.sql import functions as F


def op1_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.report(documents(spark, sf_dir), words=2, threshold=0.8)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.dedup(documents(spark, sf_dir)))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tool_calls.conversation_events(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return tool_calls.transcripts(events, tool_calls.schemas(spark, tool_calls.DIALOGUE_TOOLS))


def op4_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20)


def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(documents(spark, sf_dir), tokens.tokenizer_path(), end_id=1))


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(documents(spark, sf_dir), tokens.tokenizer_path()))


def op7_elias_fano_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.write_and_read(documents(spark, sf_dir), tokens.tokenizer_path(), end_id=2)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").cast("long").alias("ids_crc32"))


def op8_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digests(line_runs.dedup(documents(spark, sf_dir)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(documents(spark, sf_dir), tokens.tokenizer_path("byte_bpe_50k.json"),
                            tokens.tokenizer_path("piece_bpe_32k.model"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir), words=4, threshold=0.85)


REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_minmax_dedup": (op1_minmax_dedup, minmax.ORACLE),
    "op2_suffix_dedup": (op2_suffix_dedup, substrings.ORACLE),
    "op3_tool_calls": (op3_tool_calls, tool_calls.ORACLE),
    "op4_hilbert_ann": (op4_hilbert_ann, None),
    "op5_mixture_packing": (op5_mixture_packing, None),
    "op6_trie_bpe": (op6_trie_bpe, None),
    "op7_elias_fano_files": (op7_elias_fano_files, None),
    "op8_kdtree_topk": (op8_kdtree_topk, kdtree.ORACLE),
    "op9_line_runs": (op9_line_runs, line_runs.ORACLE),
    "op10_toxicity": (op10_toxicity, None),
    "op11_spelling_variants": (op11_spelling_variants, spelling.ORACLE),
    "op12_token_alignment": (op12_token_alignment, None),
    "op13_jaccard_join": (op13_jaccard_join, jaccard.ORACLE),
}
