"""Differences between two copies of a table, by hierarchical checksums.

Keys are placed on a ring of 64-bit tokens (a hash of the key, so that hot key
prefixes spread evenly). A range of the ring is a token prefix. Both sides are reduced
to a checksum and row count per coarse range, which combine before the shuffle; only ranges whose
checksums differ are bisected further, down to leaves of a few rows. Rows are shuffled by key in
mismatched leaves only, where superseded versions fall away: first their digests, which tell rows on
one side from changed rows, then, for changed rows, the fields themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import materialize

ONLY_LEFT, ONLY_RIGHT = "only_in_left", "only_in_right"


def canonical_json(column: Column, ignore: list[str] = ()) -> Column:
    """Text that is equal for two JSON objects iff they have the same keys and values.

    Key order, spacing and escapes do not count, nor do the top-level keys in ``ignore``.
    Other JSON values are normalised too; text that is no JSON stays as it is.
    """
    fields = F.from_json(column, "map<string,variant>")
    if ignore:
        fields = F.map_filter(fields, lambda k, _: ~k.isin(list(ignore)))
    entries = F.array_sort(F.map_entries(F.transform_values(fields, lambda _, v: F.to_json(v))))
    return F.coalesce(F.when(column.rlike(r"^\s*\{"), F.to_json(entries)), F.to_json(F.try_parse_json(column)), column)


def _digest(columns: list[Column]) -> Column:
    """64-bit digest in which null differs from every value and position counts."""
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])
    return F.xxhash64(nulls, *columns)


def _prefix(token: Column, bits: int) -> Column:
    return F.shiftrightunsigned(token, 64 - bits) if bits else F.lit(0).cast("long")


def _differs() -> Column:
    return (F.col("rows_l") != F.col("rows_r")) | (F.col("sum_l") != F.col("sum_r")) | (F.col("xor_l") != F.col("xor_r"))


def diff(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: list[str],
    left_version: str | None = None,
    right_version: str | None = None,
    json_fields: dict[str, list[str]] | None = None,
    leaf_rows: int = 2,
    bits_per_level: int = 12,
    names: tuple[str, str] = (ONLY_LEFT, ONLY_RIGHT),
) -> DataFrame:
    """One row ``(key, difference)`` for each key on one side only and each differing field.

    ``difference`` is ``names[0]``, ``names[1]`` or a field's name. Null equals only null.
    ``json_fields`` maps a field that holds a JSON object to the top-level keys to ignore.
    With a version column only the row with the greatest version of a key counts; without
    one, and among equal versions, the row with the greatest digest. A null version is
    older than any. Rows with a null key match rows with a null key and the same values, one for one; each that is left over is
    reported under a null key. Extra columns are ignored; an empty side yields every key of the other. ``leaf_rows``: the expected
    number of rows in a leaf range.
    """
    json_fields = json_fields or {}

    def side(df: DataFrame, version: str | None) -> DataFrame:
        value = [canonical_json(df[f], json_fields[f]) if f in json_fields else df[f] for f in fields]
        order = df[version] if version else F.lit(None).cast("timestamp")
        return df.select(
            df[key].cast("string").alias("k"), order.cast("timestamp").alias("v"), _digest(value).alias("d"),
            *[x.alias(f"f{i}") for i, x in enumerate(value)],
        )

    sides = {"l": side(left, left_version), "r": side(right, right_version)}
    rows = None
    for name, df in sides.items():
        one = df.select("k", F.lit(name).alias("side"), "v", "d", F.xxhash64("k").alias("token"))
        rows = one if rows is None else rows.unionByName(one)
    rows = materialize(rows, "diff-rows")

    def of(side: str, column: Column) -> Column:
        return F.when(F.col("side") == side, column)

    nameless = rows.where("k is null").groupBy("d").agg((F.count(of("l", F.col("d"))) - F.count(of("r", F.col("d")))).alias("n"))
    nameless = nameless.where("n <> 0").select(F.lit(None).cast("string").alias(key), F.explode(F.array_repeat(F.when(F.col("n") > 0, F.lit(names[0])).otherwise(F.lit(names[1])), F.abs("n").cast("int"))).alias("difference"))

    suspects = rows.where("k is not null")
    count = max(*(r[1] for r in rows.groupBy("side").count().collect()), 1) if not rows.isEmpty() else 1
    depth = min(48, max(0, math.ceil(math.log2(count / leaf_rows)))) if count > leaf_rows else 0
    # Equal row counts and checksums of all rows, superseded ones too, mean equal rows: nothing has to be matched by key to rule a range out.
    both = F.xxhash64("k", "d", "v") if left_version and right_version else F.xxhash64("k", "d")
    for bits in [*range(bits_per_level, depth, bits_per_level), depth]:
        node = _prefix(F.col("token"), bits)
        nodes = suspects.groupBy(node.alias("node")).agg(
            F.count(of("l", both)).alias("rows_l"), F.count(of("r", both)).alias("rows_r"),
            F.coalesce(F.sum(of("l", F.shiftright(both, 32))), F.lit(0)).alias("sum_l"), F.coalesce(F.sum(of("r", F.shiftright(both, 32))), F.lit(0)).alias("sum_r"),
            F.coalesce(F.bit_xor(of("l", both)), F.lit(0)).alias("xor_l"), F.coalesce(F.bit_xor(of("r", both)), F.lit(0)).alias("xor_r"),
        )
        bad = nodes.where(_differs()).select("node")
        # At most 2 ** bits nodes: the coarse level is small whatever the tables hold.
        suspects = suspects.withColumn("node", node).join(F.broadcast(bad) if bits <= 12 else bad, "node", "left_semi").drop("node")

    latest = lambda s: F.max(of(s, F.struct("v", "d")))["d"]
    pairs = suspects.groupBy("k").agg(latest("l").alias("dl"), latest("r").alias("dr"))
    pairs = materialize(pairs.where(~F.col("dl").eqNullSafe(F.col("dr"))), "diff-pairs")
    lone = pairs.where(F.col("dl").isNull() | F.col("dr").isNull()).select(
        F.col("k").alias(key), F.when(F.col("dr").isNull(), F.lit(names[0])).otherwise(F.lit(names[1])).alias("difference")
    )

    changed = pairs.where(F.col("dl").isNotNull() & F.col("dr").isNotNull())
    value = F.struct(*[f"f{i}" for i in range(len(fields))])
    found = None
    for name, df in sides.items():
        wanted = changed.select("k", F.col(f"d{name}").alias("d"))
        got = df.join(wanted, ["k", "d"], "left_semi").select("k", F.lit(name).alias("side"), value.alias("x"))
        got = got.groupBy("k", "side").agg(F.first("x").alias("x"))
        found = got if found is None else found.unionByName(got)
    lr = found.groupBy("k").agg(F.first(of("l", F.col("x")), ignorenulls=True).alias("l"), F.first(of("r", F.col("x")), ignorenulls=True).alias("r"))
    different = F.array(
        *[F.when(~F.col(f"l.f{i}").eqNullSafe(F.col(f"r.f{i}")), F.lit(f)) for i, f in enumerate(fields)]
    )
    inner = lr.select(F.col("k").alias(key), F.explode(F.array_compact(different)).alias("difference"))
    return lone.unionByName(inner).unionByName(nameless)
