"""The tokenizer artifact: one JSON text with specials, offsets, pieces and sizes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.sequences import EVENT_OFFSET, SPECIALS, TEXT_OFFSET

VERSION = 1
MAX_PIECES = 1 << 20


def payload(vocabulary: DataFrame, config: dict | None = None) -> dict:
    """The artifact of a vocabulary (token_id from 0 without gaps, piece); more than
    ``MAX_PIECES`` pieces are an error, since it is one text on the driver."""
    pieces = [(r["token_id"], r["piece"]) for r in vocabulary.select("token_id", "piece").orderBy("token_id").limit(MAX_PIECES + 1).collect()]
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"a vocabulary has at most {MAX_PIECES} pieces")
    if [k for k, _ in pieces] != list(range(len(pieces))):
        raise ValueError("token ids are not dense from 0")
    return {
        "version": VERSION,
        "special_tokens": list(SPECIALS),
        "config": config or {},
        "text": {"kind": "byte", "vocab_size": EVENT_OFFSET - TEXT_OFFSET},
        "midi": {"pieces": [p for _, p in pieces]},
        "offsets": {"special": 0, "text": TEXT_OFFSET, "midi": EVENT_OFFSET},
        "vocab_size": EVENT_OFFSET + len(pieces),
    }


def save(spark: SparkSession, path: str, content: dict) -> None:
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(payload, vocabulary); an error where version, offsets or size do not fit."""
    content = json.loads(spark.read.text(path).first()["value"])
    if content.get("version") != VERSION:
        raise ValueError(f"artifact version {content.get('version')!r}, not {VERSION}: build it again")
    if (content.get("offsets") or {}).get("text") != TEXT_OFFSET or content["offsets"].get("midi") != EVENT_OFFSET:
        raise ValueError("the artifact's offsets do not fit")
    pieces = (content.get("midi") or {}).get("pieces") or []
    if content.get("vocab_size") != EVENT_OFFSET + len(pieces):
        raise ValueError("the artifact's vocab_size does not fit its pieces")
    return content, spark.createDataFrame(list(enumerate(pieces)), "token_id long, piece string")
