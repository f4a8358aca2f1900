"""Change records of an outbox table: unwrapped, checked and decoded, each with the first reason to reject it or null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROW = "id string, tenant_id string, game_type string, aggregate_id string, codec_version string, payload string, payload_sha256 string, dataset_split string, occurred_at timestamp"
_CHANGE = f"op string, before struct<{_ROW.replace(' string', ': string').replace(' timestamp', ': timestamp')}>, after struct<{_ROW.replace(' string', ': string').replace(' timestamp', ': timestamp')}>, source struct<db: string, `schema`: string, `table`: string, txId: long, snapshot: string>"
_FIELDS = _CHANGE.replace("op string", "op: string").replace("before struct", "before: struct").replace("after struct", "after: struct").replace("source struct", "source: struct")
SCHEMA = f"{_CHANGE}, `schema` string, payload struct<{_FIELDS}>"
SPLITS = ("train", "validation", "test", "challenge")
#: What a decoded payload has to say of itself.
HAND = "hand_id string, dataset_split string, played_at timestamp"


def adapt(records: DataFrame, codecs: tuple[str, ...], table: str, value: str = "value", *, schema: str | None = None, database: str | None = None, tenants: tuple[str, ...] = (), games: tuple[str, ...] = (), split: str | None = None, identity: bool = False) -> DataFrame:
    """id, codec_version, payload (text) and reject of each record; records may be wrapped as {"schema": ..., "payload": ...}.

    Reasons in order: tombstone, operation (only inserts and snapshot reads are taken), before_image, after_image, snapshot (a read without
    a snapshot's mark), missing_tx (of an insert), source, tenant, game_type, base64, checksum, codec, split. With identity, the payload is JSON
    with hand_id, dataset_split and played_at, and has to agree with the row: aggregate (aggregate_id), split (`split`, if given) and
    event_time (occurred_at). Empty lists allow all. Decoding and hashing are expressions; nothing leaves the JVM.
    """
    parsed = F.from_json(value, SCHEMA)
    wrapped = F.get_json_object(value, "$.payload").isNotNull() & F.get_json_object(value, "$.op").isNull()
    r = records.withColumn("w", parsed).withColumn("r", F.when(wrapped, F.col("w.payload")).otherwise(F.struct("w.op", "w.before", "w.after", "w.source")))
    a, s = "r.after", "r.source"
    raw = F.try_to_binary(F.col(f"{a}.payload"), F.lit("base64"))
    hand = F.from_json(raw.cast("string"), HAND)
    none = F.col("w").isNull() | F.col("r").isNull() | (F.col("r.op").isNull() & F.col(a).isNull())
    among = lambda c, allowed: F.coalesce(F.col(c), F.lit("")).isin(*allowed)
    other = lambda c, want: ~F.col(c).eqNullSafe(F.lit(want)) if want is not None else F.lit(False)
    snapshot = F.lower(F.coalesce(F.col(f"{s}.snapshot"), F.lit("false")))
    reject = (
        F.when(F.col(value).isNull() | none, "tombstone").when(~among("r.op", ("c", "r")), "operation").when(F.col("r.before").isNotNull(), "before_image").when(F.col(a).isNull(), "after_image")
        .when((F.col("r.op") == "r") & (snapshot == "false"), "snapshot").when((F.col("r.op") == "c") & F.col(f"{s}.txId").isNull(), "missing_tx")
        .when(other(f"{s}.table", table) | other(f"{s}.schema", schema) | other(f"{s}.db", database), "source")
        .when(~among(f"{a}.tenant_id", tenants) if tenants else F.lit(False), "tenant").when(~among(f"{a}.game_type", games) if games else F.lit(False), "game_type")
        .when(raw.isNull(), "base64").when(~F.sha2(raw, 256).eqNullSafe(F.col(f"{a}.payload_sha256")), "checksum").when(~among(f"{a}.codec_version", codecs), "codec")
    )
    if identity:
        reject = reject.when(~hand["hand_id"].eqNullSafe(F.col(f"{a}.aggregate_id")), "aggregate").when(~hand["dataset_split"].eqNullSafe(F.lit(split)) if split else ~hand["dataset_split"].isin(*SPLITS), "split")
        reject = reject.when(~hand["played_at"].eqNullSafe(F.col(f"{a}.occurred_at")), "event_time")
    else:
        reject = reject.when(~among(f"{a}.dataset_split", SPLITS), "split")
    return r.select(F.col(f"{a}.id").alias("id"), F.col(f"{a}.codec_version").alias("codec_version"), raw.cast("string").alias("payload"), reject.alias("reject"))


def route_outbox(rows: DataFrame, allowed: DataFrame, column: str = "dataset_id") -> DataFrame:
    """Rows whose dataset is on the allow-list."""
    return rows.join(allowed.select(column).distinct(), column, "left_semi")
