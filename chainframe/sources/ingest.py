"""Ingest helpers: defaults, constraint audit, block JSON normalising, metric samples."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainframe.sources import schemas as S


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """Add declared column defaults only where the column is absent; an explicit NULL stays NULL."""
    for col, val in S.DEFAULTS.get(table, {}).items():
        if col not in df.columns:
            df = df.withColumn(col, F.lit(val))
    return df


def to_sentinel(df: DataFrame, col: str = "decimals", sentinel=-1) -> DataFrame:
    """Export form: NULL → sentinel (columnar stores with NOT NULL columns)."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(sentinel)))


def from_sentinel(df: DataFrame, col: str = "decimals", sentinel=-1) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col) == F.lit(sentinel), None).otherwise(F.col(col)))


def constraint_report(df: DataFrame, required: list[str], key: list[str]) -> DataFrame:
    """One row per check: NULL count per required column and duplicate-key count.

    One aggregation pass for all NULL counts; the duplicate check is a grouped count on the
    key (partial aggregation before the shuffle)."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    stack = ", ".join(f"'{c}', `{c}`" for c in required)
    null_rows = nulls.selectExpr(f"stack({len(required)}, {stack}) AS (check_name, violations)")
    dups = (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("violations"))
            .select(F.lit("duplicate_key").alias("check_name"), "violations"))
    return null_rows.select("check_name", F.col("violations").cast("long")).unionByName(dups)


def hex_to_long(c: Column) -> Column:
    """'0x…' quantity (≤ 64 bits) → BIGINT."""
    return F.conv(F.regexp_replace(c, r"^0[xX]", ""), 16, 10).cast("long")


BLOCK_JSON = T.StructType([
    T.StructField("result", T.StructType([
        T.StructField("number", T.StringType()), T.StructField("timestamp", T.StringType()),
        T.StructField("hash", T.StringType()), T.StructField("parentHash", T.StringType()),
        T.StructField("miner", T.StringType()),
    ])),
])


def normalize_block_json(df: DataFrame, col: str = "json") -> DataFrame:
    """JSON-RPC ``eth_getBlockByNumber`` replies → (blknum, block_timestamp, hashes).

    Hex ``number``/``timestamp`` become BIGINT and a UTC timestamp; a null ``result`` gives
    (0, epoch 0) like the reference fetcher.
    """
    p = F.from_json(F.col(col), BLOCK_JSON)
    r = p["result"]
    num = F.when(r.isNull(), F.lit(0).cast("long")).otherwise(hex_to_long(r["number"]))
    sec = F.when(r.isNull(), F.lit(0).cast("long")).otherwise(hex_to_long(r["timestamp"]))
    return df.select(
        *[c for c in df.columns if c != col],
        num.alias("blknum"), sec.alias("timestamp"),
        F.timestamp_seconds(sec).cast(T.TimestampNTZType()).alias("block_timestamp"),
        r["hash"].alias("blkhash"), r["parentHash"].alias("parent_hash"), r["miner"].alias("miner"),
    )


def series_key(name: Column, labels: Column) -> Column:
    """Stable identity of a series: name + labels sorted by key."""
    sorted_entries = F.array_sort(F.map_entries(labels))
    return F.concat(name, F.lit("{"), F.array_join(
        F.transform(sorted_entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), F.lit("}"))


def metrics_frame(df: DataFrame, name: str | Column, label_cols: list[str], ts: str, value: str,
                  static_labels: dict | None = None) -> DataFrame:
    """Long metric samples (name, labels map, series_key, ts, value) from any table.

    ``static_labels`` are target labels added to every sample (scrape config)."""
    n = F.lit(name) if isinstance(name, str) else name
    pairs = []
    for k, v in (static_labels or {}).items():
        pairs += [F.lit(k), F.lit(v)]
    for c in label_cols:
        pairs += [F.lit(c), F.col(c).cast("string")]
    labels = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    out = df.select(n.alias("name"), labels.alias("labels"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    return out.select("name", "labels", series_key(F.col("name"), F.col("labels")).alias("series_key"), "ts", "value")


def relabel(df: DataFrame, target: str, *, source_labels: list[str] | None = None, separator: str = ";",
            replacement: str | None = None) -> DataFrame:
    """Copy ``source_labels`` (joined by ``separator``) or a constant ``replacement`` into
    ``target``; the rest of the label set is kept."""
    if replacement is not None:
        val = F.lit(replacement)
    else:
        val = F.concat_ws(separator, *[F.coalesce(F.col("labels")[s], F.lit("")) for s in source_labels])
    kept = F.map_filter(F.col("labels"), lambda k, v: k != F.lit(target))
    labels = F.map_concat(kept, F.create_map(F.lit(target), val))
    return df.withColumn("labels", labels).withColumn("series_key", series_key(F.col("name"), F.col("labels")))


def add_external_labels(df: DataFrame, external: dict, honor_labels: bool = True) -> DataFrame:
    """External labels fill in labels a series lacks; with ``honor_labels=False`` a clashing
    series label is renamed ``exported_<k>`` and the target value wins."""
    ext = F.create_map(*[x for k, v in external.items() for x in (F.lit(k), F.lit(v))])
    lab = F.col("labels")
    if honor_labels:
        labels = F.map_concat(F.map_filter(ext, lambda k, v: ~F.array_contains(F.map_keys(lab), k)), lab)
    else:
        clash = F.map_filter(lab, lambda k, v: F.array_contains(F.map_keys(ext), k))
        renamed = F.transform_keys(clash, lambda k, v: F.concat(F.lit("exported_"), k))
        rest = F.map_filter(lab, lambda k, v: ~F.array_contains(F.map_keys(ext), k))
        labels = F.map_concat(rest, renamed, ext)
    return df.withColumn("labels", labels).withColumn("series_key", series_key(F.col("name"), F.col("labels")))


def and_all(conds: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conds)
