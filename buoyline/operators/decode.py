"""Payload decoding (text -> VARIANT) for both message dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _payload_text(df: DataFrame, payload: str, lenient: bool) -> Column:
    c = F.col(payload)
    if isinstance(df.schema[payload].dataType, T.BinaryType):
        c = c.cast("string")
    if lenient:
        # Bad bytes become U+FFFD, surrounding white space is dropped.
        return F.regexp_replace(F.make_valid_utf8(c), r"^\s+|\s+$", "")
    return F.try_validate_utf8(c)


def decode(raw: DataFrame, payload: str = "payload", lenient: bool = False) -> DataFrame:
    """Add ``text`` (valid UTF-8 or NULL) and ``json`` (VARIANT or NULL).

    Strict mode (live gateway): bytes that are not UTF-8 and text that is not
    JSON both give ``json`` NULL, to be rejected as ``invalid_json``.
    Lenient mode (legacy hub): bad bytes are replaced and the text stripped;
    text that is not JSON stays available in ``text`` as a plain string.
    The parse runs once per message; everything downstream reads the VARIANT.
    """
    text = _payload_text(raw, payload, lenient)
    return raw.withColumn("text", text).withColumn("json", F.try_parse_json(F.col("text")))
