"""Mutations as pure functions of a table, its changes, the clock and the actor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FOREIGN_KEYS, ForeignKey
from ..sources.tables import written


def stamped(rows: DataFrame, now: Column, actor: Column) -> DataFrame:
    """New rows with their audit block: created and updated now, by the actor; updated_by stays null."""
    kind = actor_type(rows, actor)
    return rows.withColumns({"is_deleted": F.lit(False), "created_at": now, "created_by": actor, "updated_at": now, "updated_by": F.lit(None).cast(kind), "deleted_at": F.lit(None).cast("timestamp"), "deleted_by": F.lit(None).cast(kind)})


def actor_type(rows: DataFrame, actor: Column) -> str:
    return rows.select(actor.alias("a")).schema["a"].dataType.simpleString()


def add(table: DataFrame, rows: DataFrame, now: Column, actor: Column) -> DataFrame:
    """Append rows with audit stamps."""
    return table.unionByName(stamped(rows, now, actor))


def collisions(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Keys that ``rows`` can't take: in the table already, or twice among them."""
    twice = rows.groupBy(key).count().filter("count > 1").select(key)
    return rows.select(key).join(table.select(key), key, "left_semi").unionByName(twice).distinct()


def add_new(table: DataFrame, rows: DataFrame, now: Column, actor: Column, key: str = "id") -> DataFrame:
    """As add(), but rows whose key is there already are left out: a retry changes nothing."""
    return add(table, rows.dropDuplicates([key]).join(table.select(key), key, "left_anti"), now, actor)


def update(table: DataFrame, rows: DataFrame, now: Column, actor: Column, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(the table with whole rows replaced by key and stamped, the keys that matched nothing).

    Of ``rows`` with one key, which collisions() names, the greatest counts, compared column by column.
    """
    rows = rows.groupBy(F.col(key).alias("__key")).agg(F.max(F.struct(*rows.columns)).alias("row")).select("row.*")
    fresh = rows.join(table.select(key), key, "left_semi").withColumns({"updated_at": now, "updated_by": actor})
    unmatched = rows.join(table.select(key), key, "left_anti").select(key)
    return table.join(rows.select(key), key, "left_anti").unionByName(fresh), unmatched


def soft_delete(table: DataFrame, ids: DataFrame, now: Column, actor: Column, *, single: bool = False, key: str = "id") -> DataFrame:
    """Stamp the rows among ``ids`` as deleted; deleted ones are stamped again, unknown ids don't matter.

    ``single`` also sets updated_at, as removing one row does; removing many leaves it.
    """
    named = ids.select(F.col(key)).distinct().withColumn("__hit", F.lit(True))
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    stamps = {"is_deleted": F.col("is_deleted") | hit, "deleted_at": F.when(hit, now).otherwise(F.col("deleted_at")), "deleted_by": F.when(hit, actor).otherwise(F.col("deleted_by"))}
    if single:
        stamps["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    return table.join(named, key, "left").withColumns(stamps).drop("__hit")


def hard_delete(table: DataFrame, condition: Column) -> DataFrame:
    """Rows that don't meet the condition; those for which it is null stay."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def matched_count(table: DataFrame, condition: Column) -> DataFrame:
    """``matched, any``: how many rows hard_delete() takes, and whether it takes any."""
    n = F.count_if(F.coalesce(condition, F.lit(False)))
    return table.agg(n.alias("matched"), (n > 0).alias("any"))


def hard_delete_rows(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def cascade(tables: dict[str, DataFrame], roots: dict[str, DataFrame], key: str = "id", keys: list[ForeignKey] = FOREIGN_KEYS) -> DataFrame:
    """``table, id`` of all rows that go when ``roots`` (table: ids) go, over the cascading foreign keys."""
    doomed = doomed_by_table(tables, roots, key, keys)
    return reduce(DataFrame.unionByName, [ids.select(F.lit(name).alias("table"), F.col(key).alias("id")) for name, ids in sorted(doomed.items())])


def delete_order(names: set[str], keys: list[ForeignKey]) -> list[list[str]]:
    """``names`` in groups, parents before children over the cascading keys; tables that refer to each other are one group."""
    below = {n: {n} for n in names}
    for _ in names:
        for fk in keys:
            if fk.rule == "cascade" and fk.child in names and fk.parent in names:
                for found in below.values():
                    if fk.parent in found:
                        found.add(fk.child)
    above = {n: sum(n in found for found in below.values()) for n in names}
    groups = {frozenset(m for m in names if m in below[n] and n in below[m]) for n in names}
    # what stands above a table stands above its children too, and these themselves
    return [sorted(g) for g in sorted(groups, key=lambda g: (above[min(g)], min(g)))]


def doomed_by_table(tables: dict[str, DataFrame], roots: dict[str, DataFrame], key: str = "id", keys: list[ForeignKey] = FOREIGN_KEYS) -> dict[str, DataFrame]:
    """Ids to delete, by table, over any graph of foreign keys.

    Tables come in the order of delete_order(), so each is searched once for each of its keys. Tables that refer to
    themselves or each other are searched again from what the last search found, until it finds nothing new. Whatever is
    found is written, so that nothing further down finds it again.
    """

    def children(fk: ForeignKey, parents: DataFrame) -> DataFrame:
        return tables[fk.child].join(parents.select(F.col(key).alias(fk.column)), fk.column, "left_semi").select(key)

    def together(parts: list[DataFrame]) -> DataFrame:
        return written(reduce(DataFrame.unionByName, parts).distinct() if len(parts) > 1 else parts[0], "doomed")

    given = {name: ids.select(key).distinct() for name, ids in roots.items()}
    usable = [fk for fk in keys if fk.rule == "cascade" and fk.child in tables]
    out: dict[str, DataFrame] = {}
    for group in delete_order({*tables, *roots}, keys):
        parts = {name: [given[name]] if name in given else [] for name in group}
        for fk in usable:
            if fk.child in group and fk.parent not in group and fk.parent in out:
                parts[fk.child].append(children(fk, out[fk.parent]))
        front = {name: together(found) for name, found in parts.items() if found}
        out |= front
        inner = [fk for fk in usable if fk.child in group and fk.parent in group]
        while inner and front:
            fresh: dict[str, list[DataFrame]] = {}
            for fk in inner:
                if fk.parent in front:
                    found = children(fk, front[fk.parent])
                    fresh.setdefault(fk.child, []).append(found.join(out[fk.child], key, "left_anti") if fk.child in out else found)
            front = {name: new for name, found in fresh.items() if not (new := written(reduce(DataFrame.unionByName, found).distinct(), "doomed")).isEmpty()}
            for name, new in front.items():
                out[name] = out[name].unionByName(new) if name in out else new
    return out


def restricted(tables: dict[str, DataFrame], roots: dict[str, DataFrame], key: str = "id", keys: list[ForeignKey] = FOREIGN_KEYS) -> DataFrame:
    """``table, id, column`` of rows that forbid the delete: they refer to a doomed row and aren't doomed themselves."""
    doomed, parts = doomed_by_table(tables, roots, key, keys), []
    for fk in keys:
        if fk.rule == "restrict" and fk.parent in doomed and fk.child in tables:
            held = tables[fk.child].join(doomed[fk.parent].select(F.col(key).alias(fk.column)), fk.column, "left_semi")
            if fk.child in doomed:
                held = held.join(doomed[fk.child], key, "left_anti")
            parts.append(held.select(F.lit(fk.child).alias("table"), F.col(key).alias("id"), F.lit(fk.column).alias("column")))
    return reduce(DataFrame.unionByName, parts)
