"""References (name, oid, symref, peeled), reflogs and identity aliases as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquill.functions import people
from strataquill.functions import refs as R
from strataquill.functions.globs import wildmatch
from strataquill.plans.closure import closure


def branches(refs: DataFrame, pattern: str | None = None) -> DataFrame:
    """(branch, oid) of refs/heads/, filtered by a glob."""
    out = refs.where(F.col("name").startswith(R.HEADS)).select(R.extract_branch_name(F.col("name")).alias("branch"), "oid")
    return out if pattern is None else out.where(F.col("branch").rlike(wildmatch(pattern, paths=False)))


def for_each_ref(refs: DataFrame, objects: DataFrame, pattern: str | None = None) -> DataFrame:
    """(oid, type, name) of refs that a glob of segments matches, with their objects' types."""
    out = refs if pattern is None else refs.where(R.matches_segments(F.col("name"), pattern))
    return out.join(objects.select("oid", "type"), "oid", "left").select("oid", "type", "name")


def show_ref(refs: DataFrame, patterns: list[str] | None = None, heads: bool = False, tags: bool = False, dereference: bool = False) -> DataFrame:
    """(oid, name) by namespace and by patterns that match whole segments at a name's end; peeled tags as further rows name^{}."""
    out = refs
    if heads or tags:
        out = out.where(R.under_any(F.col("name"), [R.HEADS] * heads + [R.TAGS] * tags))
    if patterns:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | (F.col("name") == p) | F.col("name").endswith("/" + p)
        out = out.where(hit)
    rows = out.select("oid", "name")
    if dereference:
        rows = rows.unionByName(out.where("peeled is not null").select(F.col("peeled").alias("oid"), F.concat("name", F.lit("^{}")).alias("name")))
    return rows


def resolve(refs: DataFrame) -> DataFrame:
    """(name, oid): names with symbolic references followed; loops and dangling ones are left out."""
    edges = refs.where("symref is not null").select(F.col("name").alias("src"), F.col("symref").alias("dst"))
    reach = closure(edges, refs.select(F.col("name").alias("key"), F.col("name").alias("node")), keys=("key",))
    ends = refs.where("oid is not null and symref is null").select(F.col("name").alias("node"), "oid")
    return reach.join(ends, "node").select(F.col("key").alias("name"), "oid")


def lookup(refs: DataFrame, spec: str) -> DataFrame:
    """The one ref that an abbreviated name means, by the order of candidates."""
    rank = {n: i for i, n in enumerate(R.candidates(spec))}
    ranked = refs.where(F.col("name").isin(list(rank))).withColumn("rank", F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("name")])
    return ranked.orderBy("rank").limit(1).drop("rank")


def newest_wins(tables: DataFrame) -> DataFrame:
    """Stacked ref tables (name, update_index, oid, deleted) merged: of each name the row of the highest index, deletions hidden."""
    best = tables.groupBy("name").agg(F.max_by(F.struct("oid", "deleted", "update_index"), "update_index").alias("x"))
    return best.where("not x.deleted").select("name", "x.oid", "x.update_index")


def import_refs(current: DataFrame, incoming: DataFrame, base: str, prune: bool = False) -> DataFrame:
    """``current`` (name, oid) after setting base/name of every incoming ref; with ``prune`` other names under base go."""
    new = incoming.select(F.concat(F.lit(base + "/"), F.col("name")).alias("name"), F.col("oid"))
    rest = current.select("name", "oid").join(new.select("name"), "name", "left_anti")
    if prune:
        rest = rest.where(~F.col("name").startswith(base + "/"))
    return rest.unionByName(new)


def compare_and_set(current: DataFrame, updates: DataFrame) -> DataFrame:
    """(name, oid, applied) after conditional updates (name, expected, new): applied where the present id is ``expected`` (null: absent); a null ``new`` deletes."""
    j = current.select("name", "oid").join(updates, "name", "full_outer")
    asked = F.col("expected").isNotNull() | F.col("new").isNotNull()
    ok = asked & F.col("oid").eqNullSafe(F.col("expected"))
    out = j.select("name", F.when(ok, F.col("new")).otherwise(F.col("oid")).alias("oid"), ok.alias("applied"))
    return out.where("oid is not null")


def pack_refs(loose: DataFrame, packed: DataFrame) -> DataFrame:
    """Loose refs over packed ones."""
    return loose.select("name", "oid").unionByName(packed.select("name", "oid").join(loose.select("name"), "name", "left_anti"))


def wanted(remote: DataFrame, objects: DataFrame) -> DataFrame:
    """(oid): targets of remote refs that are not present, without peeled rows."""
    return remote.where(~F.col("name").endswith("^{}")).select("oid").distinct().join(objects.select("oid"), "oid", "left_anti")


# Reflogs ---------------------------------------------------------------------------------------------------


def at_index(reflog: DataFrame, n: int) -> DataFrame:
    """The n-th newest row of each ref (ref, seq, old, new, ts)."""
    return reflog.withColumn("n", F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("seq"))) - 1).where(F.col("n") == n).drop("n")


def at_time(reflog: DataFrame, probes: DataFrame) -> DataFrame:
    """(ref, at, oid): each ref's value at the times of ``probes`` (ref, at): the newest row not later, in one window over both.

    Before the first row it is that row's old value.
    """
    rows = reflog.select("ref", F.col("ts").alias("t"), F.col("seq"), F.col("new").alias("oid"), F.lit(0).alias("kind"), F.col("old"))
    asks = probes.select("ref", F.col("at").alias("t"), F.lit(None).cast(dict(reflog.dtypes)["seq"]).alias("seq"), F.lit(None).cast(dict(reflog.dtypes)["new"]).alias("oid"), F.lit(1).alias("kind"), F.lit(None).cast(dict(reflog.dtypes)["old"]).alias("old"))
    order = Window.partitionBy("ref").orderBy("t", "kind", "seq")
    both = rows.unionByName(asks).withColumn("last", F.last("oid", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.first("old", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    return both.where("kind = 1").select("ref", F.col("t").alias("at"), F.coalesce("last", "next").alias("oid"))


def drop_entry(reflog: DataFrame, index: int, rewrite: bool = False) -> DataFrame:
    """Rows without each ref's ``index``-th newest; with ``rewrite`` the row after it continues from the row before it.

    Dropping the newest row changes no other.
    """
    order = Window.partitionBy("ref").orderBy(F.desc("seq"))
    rest = reflog.withColumn("n", F.row_number().over(order) - 1).where(F.col("n") != index)
    if rewrite and index > 0:
        rest = rest.withColumn("old", F.when(F.col("n") == index - 1, F.coalesce(F.lead("new").over(order), F.lit("0" * 40).cast(dict(reflog.dtypes)["old"]))).otherwise(F.col("old")))
    return rest.drop("n")


def expire(reflog: DataFrame, before: int, unreachable_before: int | None = None, reachable: DataFrame | None = None) -> DataFrame:
    """Rows that stay: reachable ones not older than ``before``, unreachable ones not older than their own bound."""
    if unreachable_before is None or reachable is None:
        return reflog.where(F.col("ts") >= before)
    hit = reachable.select(F.col("node").alias("new"), F.lit(True).alias("hit")).distinct()
    bound = F.when(F.col("hit"), F.lit(before)).otherwise(F.lit(unreachable_before))
    return reflog.join(hit, "new", "left").where(F.col("ts") >= bound).select(*reflog.columns)


def stash_list(reflog: DataFrame) -> DataFrame:
    """(position, oid, message) of stashes, newest first."""
    own = reflog.where("ref = 'refs/stash'")
    return own.select((F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("seq"))) - 1).alias("position"), F.col("new").alias("oid"), "message")


# Identities ------------------------------------------------------------------------------------------------


def alias_rows(lines: DataFrame) -> DataFrame:
    """(no, name, email, from_name, from_email) of an alias file's lines (no, line).

    A line without a source identity holds for its own name with any address and its own address with any name.
    """
    text = F.trim(F.regexp_replace("line", "(^|\\s)#.*$", ""))
    two = text.rlike(r">.*<")
    one = people.parse_identity(F.when(two, F.regexp_extract(text, r"^([^>]*>)", 1)).otherwise(text))
    other = F.when(two, people.parse_identity(F.regexp_extract(text, r"^[^>]*>\s*(.*)$", 1)))
    rows = lines.where(text != "").select("no", one.alias("to"), other.alias("of"))
    full = rows.where("of is not null").select("no", "to.name", "to.email", F.col("of.name").alias("from_name"), F.col("of.email").alias("from_email"))
    none = F.lit(None).cast("string")
    bare = rows.where("of is null")
    by_name = bare.where("to.name is not null").select("no", "to.name", "to.email", F.col("to.name").alias("from_name"), none.alias("from_email"))
    by_mail = bare.where("to.email is not null").select("no", "to.name", "to.email", none.alias("from_name"), F.col("to.email").alias("from_email"))
    return full.unionByName(by_name).unionByName(by_mail)


def canonical(people_: DataFrame, aliases: DataFrame) -> DataFrame:
    """``people_`` (name, email, …) with to_name and to_email: an alias by name and address, else by address, else by name; the last line wins."""
    def by(*keys: str) -> DataFrame:
        own = aliases
        for k in ("from_name", "from_email"):
            own = own.where(F.col(k).isNotNull() if k in keys else F.col(k).isNull())
        return own.groupBy(*keys).agg(F.max_by(F.struct("name", "email"), "no").alias("hit"))

    out = people_
    for i, keys in enumerate((("from_name", "from_email"), ("from_email",), ("from_name",))):
        rule = by(*keys).select(*[F.col(k).alias(f"sq_{k}") for k in keys], F.col("hit").alias(f"sq_hit{i}"))
        on = [out[k.removeprefix("from_")] == rule[f"sq_{k}"] for k in keys]
        out = out.join(rule, on, "left").drop(*[f"sq_{k}" for k in keys])
    hit = F.coalesce("sq_hit0", "sq_hit1", "sq_hit2")
    return out.withColumns({"to_name": F.coalesce(hit["name"], F.col("name")), "to_email": F.coalesce(hit["email"], F.col("email"))}).drop("sq_hit0", "sq_hit1", "sq_hit2")
