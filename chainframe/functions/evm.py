"""EVM byte-level helpers: word slicing, addresses from topics, PUSH4 selector extraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: public ERC standard selectors and event topics -----------------------
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
TRANSFER_SINGLE_TOPIC = "0xc3d58168c5ae7397731d063d5bbf3d657854427343f4c083240f7aacaa2d0f62"
TRANSFER_BATCH_TOPIC = "0x4a39dc06d4c0dbc64b70af90fd698a233a518aa5d07e595d983b8c0526c8f7fb"
ERC20_SELECTORS = ("0x18160ddd", "0x70a08231", "0xa9059cbb", "0x23b872dd", "0x095ea7b3", "0xdd62ed3e")
ERC721_SELECTORS = ("0x70a08231", "0x6352211e", "0x42842e0e", "0xb88d4fde", "0x23b872dd", "0x095ea7b3",
                    "0xa22cb465", "0x081812fc", "0xe985e9c5")
# ------------------------------------------------------------------------------------------


def strip0x(c: Column) -> Column:
    return F.when(c.startswith("0x") | c.startswith("0X"), F.substr(c, F.lit(3))).otherwise(c)


def packed(c: Column) -> Column:
    """Text as bytes, one to one: 0x and lower-case hex as 1 and the bytes it stands for, any other
    text as 0 and its own bytes."""
    hexed = c.startswith("0x") & (F.length(c) % 2 == 0) & (F.lower(c) == c)
    raw = F.when(hexed, F.unhex(F.substring(c, 3, 2 ** 31 - 1)))  # NULL where a digit is none
    return F.coalesce(F.concat(F.unhex(F.lit("01")), raw), F.concat(F.unhex(F.lit("00")), c.cast("binary")))


def unpacked(c: Column) -> Column:
    """The text of ``packed`` bytes."""
    rest = F.substring(c, 2, 2 ** 31 - 1)
    return F.when(F.substring(c, 1, 1) == F.unhex(F.lit("01")), F.concat(F.lit("0x"), F.lower(F.hex(rest)))).otherwise(rest.cast("string"))


def word(hexdata: Column, i: int) -> Column:
    """32-byte word ``i`` (0-based) of a hex payload without 0x, as 64 hex chars."""
    return F.substring(hexdata, i * 64 + 1, 64)


def word_at(hexdata: Column, i: Column) -> Column:
    """Word at a computed index (0-based)."""
    return F.substr(hexdata, (i * 64 + 1).cast("int"), F.lit(64))


def topic_address(topic: Column) -> Column:
    """Address held in a 32-byte topic/word: ``0x`` + last 40 hex chars, lower case."""
    return F.concat(F.lit("0x"), F.lower(F.substring(topic, -40, 40)))


def split_topics(topics: Column) -> Column:
    """``'[t0,t1,…]'`` text → ARRAY<STRING> (brackets stripped, split on commas, no trimming)."""
    plain = topics.startswith("[") & topics.endswith("]")
    body = F.when(plain, F.substr(topics, F.lit(2), F.length(topics) - 2)) \
        .otherwise(F.regexp_replace(F.regexp_replace(topics, r"^\[", ""), r"\]$", ""))
    empty = topics.isin("", "[", "]", "[]")
    return F.when(topics.isNull(), None).when(empty, F.array().cast("array<string>")).otherwise(F.split(body, ","))


def push4_selectors_py(code: str | None) -> list[str] | None:
    """Walk EVM opcodes and return the operands of every PUSH4 (0x63), in code order.

    Bytes inside PUSH data are skipped, so a 0x63 inside a constant is not a selector."""
    if code is None:
        return None
    h = code[2:] if code[:2] in ("0x", "0X") else code
    try:
        b = bytes.fromhex(h)
    except ValueError:
        return None
    out, i, n = [], 0, len(b)
    while i < n:
        op = b[i]
        if 0x60 <= op <= 0x7F:
            size = op - 0x5F
            if op == 0x63 and i + 5 <= n:
                out.append("0x" + b[i + 1:i + 5].hex())
            i += 1 + size
        else:
            i += 1
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def push4_selectors(code: pd.Series) -> pd.Series:
    """Arrow-batched opcode walk (per distinct bytecode; see ``derive.classify_contracts``)."""
    return code.map(push4_selectors_py)
