"""BPE encoding and decoding of whole texts (operator 6).

Method: prefix-sharing trie traversal (``tokens.TrieBpe``).  Each Python worker
inserts the distinct words of the texts it reads into a trie and encodes them
in one depth-first walk that carries the last token of every prefix; the texts'
ids are the concatenated ids of their chunks.  Rows never move between
partitions, so the plan has no shuffle, and state per worker is a cache of
bounded size.

Defined results: null text counts as empty and gives no ids and an empty
decoded text; null ids stay null; repeated rows give repeated results.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armature.llm import tokens as K
from armature.llm.common import text_bytes
from armature.shipping import ship


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): little-endian unsigned 32-bit ids of each text, and those ids decoded again."""
    ship(docs.sparkSession)

    def run(batches):
        encoder = K.encoder(K.TrieBpe, tokenizer)
        for part in K.row_slices(batches, encodes=True):
            arrays = encoder.encode_batch(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0),
                 pa.array([a.tobytes() for a in arrays], pa.binary()),
                 pa.array([encoder.engine.decode(a.tolist()) for a in arrays], pa.string())],
                names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and hashes of ``encode_decode``'s output."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
