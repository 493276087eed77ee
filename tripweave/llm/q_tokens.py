"""Query of the SentencePiece operator; merges over a vocabulary are not expressible in SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import pieces
from .common import table
from .registry import query


def model_path() -> str:
    """The public vocabulary file: TRIPWEAVE_PIECES, or the installed one."""
    import public_tokenizers

    return os.environ.get("TRIPWEAVE_PIECES") or public_tokenizers.path("piece_bpe_32k.model")


@query("op12_sentencepiece")
def op12_sentencepiece(spark, sf_dir):
    model = pieces.model_bytes(model_path())
    found = pieces.encode(table(spark, sf_dir, "documents"), model, decoded=True)
    tiled = F.concat(F.array(F.lit(0)), "ends") == F.concat("begins", F.array(F.col("n_bytes").cast("int")))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), tiled.alias("spans_tile_text"))
