"""Scalar functions as column expressions: encodings, ages, hashes, text of metrics, decoding of ids and small messages."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of buckets, as numbers.
BANKROLL = {"low": 0, "medium": 1, "high": 2}
STAKES = {"micro": 0, "low": 1, "medium": 2, "high": 3}


def ordinal(value: Column, order: dict[str, int]) -> Column:
    """The number of a bucket's name in any case; 0 for a null or an unknown one."""
    table = F.create_map(*[F.lit(x) for p in order.items() for x in p])
    return F.coalesce(table[F.lower(value)], F.lit(0))


def age_days(at: Column, since: Column) -> Column:
    """Days from since to at, 0 at least and for nulls, rounded half-even to nine digits."""
    micros = F.unix_micros(at.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return F.coalesce(F.bround(F.greatest(micros, F.lit(0)) / F.lit(86_400e6), 9), F.lit(0.0))


def hash_fraction(value: Column) -> Column:
    """The first 32 bits of the sha256 of a text, over 2^32 - 1; 0 for null."""
    return F.coalesce(F.conv(F.substring(F.sha2(value.cast("string"), 256), 1, 8), 16, 10).cast("double") / float(2**32 - 1), F.lit(0.0))


def one_hot(value: Column, known: list[str], prefix: str) -> list[Column]:
    """A 0/1 column for each known category and one for all others, nulls among them."""
    return [(value.eqNullSafe(F.lit(k))).cast("double").alias(f"{prefix}={k}") for k in known] + [F.coalesce(~value.isin(*known), F.lit(True)).cast("double").alias(f"{prefix}=<other>")]


def filled(value: Column, fill: float) -> Column:
    """The value, or fill where it is null, not a number or infinite."""
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(fill)).otherwise(v)


def rounded(value: Column, digits: int) -> Column:
    """A double rounded as C and DuckDB do, half away from zero of its product with the power of ten. F.round goes by the shortest decimal text, which is another number where the text ends in a five."""
    y = F.abs(value) * F.lit(10.0**digits)
    whole = F.floor(y).cast("double")
    return F.signum(value) * (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**digits)


def metric_line(name: str, labels: dict[str, Column], value: Column) -> Column:
    """A line of a metrics page: name{label="value",...} value. Quotes, backslashes and line feeds in labels are escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    inside = F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), escape(v), F.lit('"')) for k, v in labels.items()])
    return F.concat(F.lit(name + "{"), inside, F.lit("} "), value.cast("string"))


def scenario_family(pair_id: Column, families: list[str]) -> Column:
    """The family that an id's trailing number stands for, in turn; null if it has no number."""
    n = F.regexp_extract(pair_id, r"(\d+)$", 1)
    return F.when(n != "", F.get(F.array(*map(F.lit, families)), F.pmod(n.cast("long"), F.lit(len(families))).cast("int")))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a wire-format message: varints, 64-bit, delimited and 32-bit ones."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 1:
            yield tag >> 3, struct.unpack_from("<q", data, at)[0]
            at += 8
        elif tag & 7 == 2:
            n = varint()
            if at + n > len(data):
                raise ValueError("cut off")
            yield tag >> 3, data[at : at + n]
            at += n
        elif tag & 7 == 5:
            yield tag >> 3, struct.unpack_from("<i", data, at)[0]
            at += 4
        else:
            raise ValueError("unknown wire type")


# The fields of the message by number, as (name, kind); money is in millionths.
_ACTION = {1: ("sequence_no", "int"), 2: ("player_id", "text"), 3: ("street", "text"), 4: ("action_type", "text"), 5: ("amount", "money")}
_PLAYER = {1: ("player_id", "text"), 2: ("name", "text"), 3: ("position", "text"), 4: ("stack_start", "money"), 5: ("hole_cards", "words"), 6: ("won_amount", "money")}
_HAND = {
    1: ("hand_id", "text"), 2: ("game_type", "text"), 3: ("table_id", "text"), 4: ("played_at_ms", "int"), 5: ("dataset_split", "text"), 6: ("generator", "text"), 7: ("small_blind", "money"), 8: ("big_blind", "money"),
    9: ("num_players", "int"), 10: ("pot_size", "money"), 11: ("board", "list"), 12: ("actions", _ACTION), 13: ("players", _PLAYER),
}
_TYPES = {"text": "string", "int": "long", "money": "double", "words": "string", "list": "array<string>"}
_struct = lambda fields: ", ".join(f"{n}: {_TYPES[k] if isinstance(k, str) else f'array<struct<{_struct(k)}>>'}" for n, k in fields.values())
HAND = f"struct<{_struct(_HAND)}, error: string>"


def decode_hand(message: Column) -> Column:
    """A binary hand message in Arrow batches: the hand with its actions and players, played_at_ms in milliseconds, money in units.

    Absent texts are empty, absent numbers 0, as in the format. Unknown fields are passed over. What does not parse or has no hand_id has an error and nulls; so has null.
    """
    return F.pandas_udf(_decode, HAND)(message)


def _message(data: bytes, fields: dict) -> dict:
    empty = {"text": "", "int": 0, "money": 0.0}
    out = {n: empty[k] if isinstance(k, str) and k in empty else [] for n, k in fields.values()}
    for number, value in _fields(data):
        if number not in fields:
            continue
        name, kind = fields[number]
        if isinstance(kind, dict):
            out[name].append(_message(value, kind))
        elif kind in ("list", "words"):
            out[name].append(value.decode())
        elif kind == "text":
            out[name] = value.decode()
        else:
            signed = value - (1 << 64) if value >= 1 << 63 else value
            out[name] = signed / 1e6 if kind == "money" else signed
    return out | {n: " ".join(out[n]) for n, k in fields.values() if k == "words"}


def _decode(messages: pd.Series) -> pd.DataFrame:
    names = [n for n, _ in _HAND.values()]
    rows = []
    for m in messages:
        try:
            hand = _message(m or b"", _HAND)
            if not hand["hand_id"]:
                raise ValueError("no hand")
            rows.append((*(hand[n] for n in names), None))
        except (ValueError, IndexError, AttributeError, TypeError, struct.error) as e:
            rows.append((*[None] * len(names), str(e) or type(e).__name__))
    return pd.DataFrame(rows, columns=[*names, "error"])


def identifier(name: Column) -> Column:
    """Whether a text is a plain SQL identifier: a letter or underscore, then letters, digits and underscores."""
    return F.coalesce(name.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), F.lit(False))
