"""Reading: filtered scans, JSON lines, merged event files, event envelopes, content hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Fields that must not reach a model's input.
FORBIDDEN = ("is_suspicious", "collusion_pair_id", "is_collusive", "label", "labels", "hidden_state", "scenario_family")


def in_list(df: DataFrame, column: str, values: list, strict: bool = False) -> DataFrame:
    """Rows whose column is one of the values; an empty list gives no row and reads nothing, or with strict is an error. Long lists become a semi join."""
    if not values:
        if strict:
            raise ValueError(f"no values of {column} are asked for")
        return df.limit(0)
    if len(values) <= 1000:
        return df.where(F.col(column).isin(values))
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], df.select(column).schema)
    return df.join(wanted.distinct(), column, "left_semi")


def page(df: DataFrame, filters: dict[str, list], order: list[Column], most: int) -> DataFrame:
    """Rows that pass all filters (column: values; empty lists do not filter), in order, `most` of them, from 1 to 1000: a bounded report."""
    for column, values in filters.items():
        df = in_list(df, column, values) if values else df
    return df.orderBy(*order).limit(max(1, min(1000, most)))


def scoped(events: DataFrame, tenants: list[str], kinds: dict[str, int], prefix: str = "sim-", tenant: str = "tenant_id", kind: str = "event_type", version: str = "schema_version", dataset: str = "dataset_id") -> DataFrame:
    """Add scope: null for events that are let in, else the first reason: tenant, event_type, schema_version or dataset (its prefix). Nulls are not let in."""
    known = F.create_map(*[F.lit(x) for p in kinds.items() for x in p])
    ok = lambda c: F.coalesce(c, F.lit(False))
    reason = F.when(~ok(F.col(tenant).isin(tenants)), "tenant").when(~ok(F.col(kind).isin(list(kinds))), "event_type").when(~ok(known[F.col(kind)] == F.col(version)), "schema_version")
    return events.withColumn("scope", reason.when(~ok(F.col(dataset).startswith(prefix)), "dataset"))


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, lines that do not parse have nulls and their text in _corrupt."""
    return spark.read.schema(schema.add("_corrupt", "string")).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def merged(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows in one order: a range-partitioned sort, whatever the order of the parts."""
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(*order)


def forbidden_fields(kind: DataType, path: str = "", names: tuple[str, ...] = FORBIDDEN) -> list[str]:
    """Paths of forbidden fields anywhere in a schema: a check at plan time instead of one a row."""
    found: list[str] = []
    if isinstance(kind, StructType):
        for f in kind.fields:
            here = f"{path}.{f.name}" if path else f.name
            found += [here] * (f.name in names) + forbidden_fields(f.dataType, here, names)
    elif isinstance(kind, ArrayType):
        found += forbidden_fields(kind.elementType, f"{path}[]", names)
    elif isinstance(kind, MapType):
        found += forbidden_fields(kind.valueType, f"{path}{{}}", names)
    return found


def flatten(df: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Fields of nested groups as columns with a prefix: {"current_hand": "current_"}. Other columns stay."""
    rest = [c for c in df.columns if c not in groups]
    return df.select(*rest, *[F.col(g)[f].alias(f"{p}{f}") for g, p in groups.items() for f in df.schema[g].dataType.names])


def hand_tables(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hands, actions and players of nested hand events; missing numbers are 0."""
    head = [c for c in events.columns if c not in ("actions", "players")]
    actions = events.select("hand_id", F.inline("actions")).fillna(0)
    return events.select(*head), actions, events.select("hand_id", F.inline("players")).fillna(0)


def without_labels(events: DataFrame, labels: tuple[str, ...] = ("is_suspicious", "collusion_pair_id")) -> tuple[DataFrame, DataFrame]:
    """Events whose players lack the label fields, and the labels as a table of their own."""
    public = events.withColumn("players", F.transform("players", lambda p: p.dropFields(*labels)))
    private = events.select("hand_id", F.explode("players").alias("p")).select("hand_id", "p.player_id", *[f"p.{x}" for x in labels])
    return public, private


def population_hash(member: Column) -> Column:
    """sha256 of the sorted distinct members, joined by line feeds."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(member)), "\n"), 256)


def ordered_hash(order: Column, member: Column) -> Column:
    """sha256 of the members in the given order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), member.cast("string").alias("m")))), lambda x: x["m"]), "\n"), 256)


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """The columns as JSON with sorted keys and nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID, version 5, of a name in a namespace given as hexadecimal digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("string"), 10, 16))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
