"""Row-level table changes as snapshot -> snapshot transforms.

Tables are immutable files; an update produces the next snapshot.  Every
operator is a join / aggregate, so it runs at any size; ``max_by`` keeps the
newest version per key with partial aggregation (a hot key is reduced inside
each task before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_latest(base: DataFrame, changes: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """M1: per key the stored row, unless a change overwrites it.

    A change always wins over the stored row, whatever its date.  Of several
    changes (or stored rows) of a key the newest by ``order_cols`` wins; rows
    that are equal there are told apart by all other columns, so the winner
    doesn't depend on the order of rows."""
    others = [c for c in base.columns if c != key]
    ranked = base.withColumn("_rank", F.lit(0)).unionByName(changes.withColumn("_rank", F.lit(1)))
    order = F.struct("_rank", *order_cols, *[F.col(c).cast("string") for c in others])
    g = ranked.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r"))
    return g.select(key, "_r.*")


def with_defaults(keys: DataFrame, latest: DataFrame, key: str, defaults: dict) -> DataFrame:
    """M1 read side: every key gets its stored values or the defaults."""
    marked = latest.withColumn("_stored", F.lit(True))
    j = keys.select(key).distinct().join(marked, key, "left")
    out = [F.col(key)]
    for c in latest.columns:
        if c == key:
            continue
        out.append(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c))
    out.append(F.col("_stored").isNull().alias("is_default"))
    return j.select(*out)


def delete_where(df: DataFrame, predicate) -> DataFrame:
    """M2: drop rows matching ``predicate``; a NULL predicate keeps the row."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], deleted_keys: DataFrame,
                   key: str = "id") -> dict[str, DataFrame]:
    """M3: remove the deleted keys from each table (``tables[name] = (df, fk)``)
    with anti joins; returns the surviving tables."""
    k = deleted_keys.select(F.col(key).alias("_del")).distinct()
    return {name: df.join(k, df[fk] == k["_del"], "left_anti") for name, (df, fk) in tables.items()}


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str = "id") -> DataFrame:
    """M3 report: child rows whose foreign key has no parent row."""
    p = parent.select(F.col(pk).alias("_pk"))
    return child.join(p, child[fk] == p["_pk"], "left_anti")


def update_by_key(df: DataFrame, changes: DataFrame, key: str, columns: list[str],
                  order_cols: list[str] | None = None) -> DataFrame:
    """M4: overwrite ``columns`` from ``changes`` where the key matches, NULLs
    included; unmatched rows keep their values.  Of several changes of a key the
    last by ``order_cols`` (then by ``columns``) counts, so no row is multiplied."""
    order = F.struct(*(order_cols or []), *columns)
    ch = (changes.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*columns), order).alias("_new"))
          .withColumn("_matched", F.lit(True)))
    j = df.join(ch, df[key] == ch["_k"], "left")
    out = [F.when(F.col("_matched"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
           for c in df.columns]
    return j.select(*out)
