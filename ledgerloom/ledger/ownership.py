"""Row ownership and authorization as relations: who may act for whom, grants, collectives, transfers, sealed values.

Tables (all DataFrames): members (collective, member, role, state, joined_tx, left_tx), collectives (collective, insert_role, update_role, delete_role),
grants (grant_id, tbl, grantor, grantee, row_key, op_insert, op_update, op_delete, columns, created_tx, revoked_tx),
offers (offer_id, tbl, row_key, from_owner, to_owner, scope_digest, state).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.folds import line_digests

# Roles of a collective in ascending order.
ROLES = ("reader", "member", "admin")


def apart(side: DataFrame) -> DataFrame:
    """A join's side that is dealt out by key and sorted, never broadcast: what explodes is estimated at the size of the files below it."""
    return side.hint("merge")


def role_rank(role: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, r in enumerate(ROLES):
        out = F.when(role == r, i).otherwise(out)
    return out


def actor_owners(actors: DataFrame, members: DataFrame, collectives: DataFrame) -> DataFrame:
    """(actor, owner, op) of the owners each actor may act for: itself, and collectives whose required role its own reaches."""
    own = actors.select(F.col("actor"), F.col("actor").alias("owner"), F.explode(F.array(*(F.lit(o) for o in ("insert", "update", "delete")))).alias("op"))
    active = members.where((F.col("state") == "active") & F.col("left_tx").isNull())
    joined = active.join(collectives, "collective").join(apart(actors), F.col("member") == F.col("actor"))
    needs = F.explode(F.array(*(F.struct(F.lit(o).alias("op"), F.col(f"{o}_role").alias("needed")) for o in ("insert", "update", "delete"))))
    allowed = joined.select("actor", F.col("collective").alias("owner"), "role", needs.alias("n")).where(role_rank(F.col("role")) >= role_rank(F.col("n.needed")))
    return own.unionByName(allowed.select("actor", "owner", "n.op"))


def live_grants(grants: DataFrame, at_tx: int | None = None) -> DataFrame:
    """Grants made and not revoked (at a transaction, or now)."""
    if at_tx is None:
        return grants.where(F.col("revoked_tx").isNull())
    return grants.where((F.col("created_tx") <= at_tx) & (F.col("revoked_tx").isNull() | (F.col("revoked_tx") > at_tx)))


def check_writes(writes: DataFrame, owners: DataFrame, grants: DataFrame, tbl: str, *, seeding: bool = False) -> DataFrame:
    """``writes`` with ``allowed``.

    ``writes``: tx_id, actor, op, owner, row_key, changed (array of column names), new_owner (null unless the owner changes).  A write
    is allowed for an owner that the actor acts for, else by a live grant of that owner on the row or the whole table whose
    columns, if it names any, hold all changed ones.  A change of owner is never allowed here; that takes a transfer.  While the
    ``seeding`` window is open inserts are allowed for any owner.
    """
    names = ("actor", "owner", "op", "row_key", "changed")
    rows = writes.select("*", *(F.col(c).alias(f"__{c}") for c in names))
    ask = {c: F.col(f"__{c}").outer() for c in names}  # under names that no subquery has, even in what it doesn't select
    own = apart(owners).where((F.col("actor") == ask["actor"]) & (F.col("owner") == ask["owner"]) & (F.col("op") == ask["op"])).exists()
    may = F.when(ask["op"] == "insert", F.col("op_insert")).when(ask["op"] == "update", F.col("op_update")).otherwise(F.col("op_delete"))
    on_row = F.col("g_key").isNull() | (F.col("g_key") == ask["row_key"])
    fits = F.col("caps").isNull() | (F.size(F.array_except(ask["changed"], F.col("caps"))) == 0)
    g = apart(grants.where(F.col("tbl") == tbl).select("grantor", "grantee", F.col("row_key").alias("g_key"), "op_insert", "op_update", "op_delete", F.col("columns").alias("caps")))
    granted = g.where((F.col("grantor") == ask["owner"]) & (F.col("grantee") == ask["actor"]) & on_row & F.coalesce(may, F.lit(False)) & fits).exists()
    stays = F.col("new_owner").isNull() | (F.col("new_owner") == F.col("owner"))
    seed = (F.col("op") == "insert") & F.lit(seeding)
    out = rows.withColumn("__own", own).withColumn("__grant", granted).withColumn("allowed", (F.col("__own") | F.col("__grant") | seed) & stays)
    return out.drop("__own", "__grant", *(f"__{c}" for c in names))


def check_replaces(writes: DataFrame, owners: DataFrame, grants: DataFrame, tbl: str) -> DataFrame:
    """``writes`` that replace rows, with ``allowed``: the delete of the row of ``old_owner`` (null: there is none) and the insert for ``owner`` must both be."""
    parts = F.array(F.struct(F.lit("insert").alias("op"), F.col("owner")), F.struct(F.lit("delete").alias("op"), F.col("old_owner").alias("owner")))
    both = writes.select("tx_id", "actor", "row_key", "changed", F.explode(parts).alias("p")).select("tx_id", "actor", "row_key", "changed", "p.op", "p.owner", F.lit(None).cast("string").alias("new_owner")).where("owner IS NOT NULL")
    per = check_writes(both, owners, grants, tbl).groupBy("tx_id", "row_key").agg(F.bool_and("allowed").alias("allowed"))
    return writes.join(apart(per), ["tx_id", "row_key"])


def statement_outcomes(checked: DataFrame, tbl: str) -> DataFrame:
    """(tx_id, outcome, rejection_code): one violation aborts the whole statement."""
    per = checked.groupBy("tx_id").agg(F.bool_and("allowed").alias("ok"), F.min(F.when(~F.col("allowed"), F.col("op"))).alias("op"))
    return per.select("tx_id", F.when(F.col("ok"), "accepted").otherwise("rejected").alias("outcome"), F.when(~F.col("ok"), F.concat(F.lit(f"policy:{tbl}:"), F.col("op"))).alias("rejection_code"))


def changed_columns(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key and the names of columns that differ, of rows in both."""
    rest = [c for c in before.columns if c not in key]
    both = before.alias("b").join(after.alias("a"), list(key))
    names = F.filter(F.array(*(F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), F.lit(c)) for c in rest)), lambda c: c.isNotNull())
    return both.select(*key, names.alias("changed"))


def revoke(grants: DataFrame, revocations: DataFrame) -> DataFrame:
    """Grants after revocations (grant_id, actor, tx): only the grantor's count, the first one stays."""
    first = revocations.join(grants.select("grant_id", F.col("grantor").alias("actor")), ["grant_id", "actor"], "left_semi").groupBy("grant_id").agg(F.min("tx").alias("__tx"))
    return grants.join(first, "grant_id", "left").withColumn("revoked_tx", F.coalesce("revoked_tx", "__tx")).drop("__tx").select(*grants.columns)


def membership_state(changes: DataFrame) -> DataFrame:
    """(collective, member, role, state) after changes (collective, member, action, role, tx): the latest of each member.

    Actions: accept, set, leave.
    """
    last = changes.groupBy("collective", "member").agg(F.max_by(F.struct("action", "role"), "tx").alias("l"))
    return last.select("collective", "member", "l.role", F.when(F.col("l.action") == "leave", "left").otherwise("active").alias("state"))


def without_admin(state: DataFrame) -> DataFrame:
    """Collectives that have members but no active admin: changes that lead here are refused."""
    per = state.groupBy("collective").agg(F.count(F.when(F.col("state") == "active", 1)).alias("active"), F.count(F.when((F.col("state") == "active") & (F.col("role") == "admin"), 1)).alias("admins"))
    return per.where("admins = 0").select("collective")


def scope_digest(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """(offer_id, digest) of the rows (tbl, row_key, content) in each offer's scope (offer_id, tbl, row_key), in byte order of table and key."""
    found = scope.join(rows, ["tbl", "row_key"], "left")
    line = F.concat_ws("|", "tbl", "row_key", F.coalesce("content", F.lit("-")))
    return line_digests(found, "offer_id", [F.col("tbl"), F.col("row_key"), F.coalesce("content", F.lit("-"))], line)


def accept_transfers(offers: DataFrame, digests: DataFrame, accepts: DataFrame) -> DataFrame:
    """(offer_id, outcome) of acceptances (offer_id, actor): the addressee's, of an open offer whose scope still has its digest."""
    joined = accepts.join(offers, "offer_id", "left").join(digests, "offer_id", "left")
    code = (
        F.when(F.col("state").isNull(), "platform:unknown_offer").when(F.col("state") != "open", "platform:offer_closed")
        .when(F.col("to_owner") != F.col("actor"), "platform:not_addressee").when(~F.col("scope_digest").eqNullSafe(F.col("digest")), "platform:offer_stale").otherwise("accepted")
    )
    return joined.select("offer_id", code.alias("outcome"))


def apply_transfers(rows: DataFrame, scope: DataFrame, accepted: DataFrame, offers: DataFrame) -> DataFrame:
    """Rows (tbl, row_key, owner, ...) after accepted offers: all rows of their scopes change owner, and nothing else."""
    new = scope.join(accepted.where("outcome = 'accepted'").select("offer_id"), "offer_id").join(offers.select("offer_id", "to_owner"), "offer_id").groupBy("tbl", "row_key").agg(F.max_by("to_owner", "offer_id").alias("__to"))
    return rows.join(new, ["tbl", "row_key"], "left").withColumn("owner", F.coalesce("__to", "owner")).drop("__to").select(*rows.columns)


def incomplete_transfers(scope: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows (offer_id, tbl, row_key) of an expected closure that a scope lacks."""
    return expected.join(scope, ["offer_id", "tbl", "row_key"], "left_anti")


def invalidate(grants: DataFrame, offers: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grants, offers) after changes (tbl, row_key, kind, tx) of kind delete, rekey or owner: grants on such rows are revoked, open offers cancelled."""
    hit = changes.where(F.col("kind").isin("delete", "rekey", "owner")).groupBy("tbl", "row_key").agg(F.min("tx").alias("__tx"))
    g = grants.join(hit, ["tbl", "row_key"], "left").withColumn("revoked_tx", F.coalesce("revoked_tx", "__tx")).select(*grants.columns)
    o = offers.join(hit, ["tbl", "row_key"], "left").withColumn("state", F.when((F.col("state") == "open") & F.col("__tx").isNotNull(), "cancelled").otherwise(F.col("state"))).select(*offers.columns)
    return g, o


def principal_ids(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Known principals (key, id) and new ones: unseen keys get the next ids in the order of their first use (key, idx)."""
    from ledgerloom.operators.writes import with_row_ids

    new = seen.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.min("idx").alias("first"))
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).head().top
    return known.select("key", "id").unionByName(with_row_ids(new, ["first", "key"], int(top), "id").select("key", "id"))


def policy_updates(policies: DataFrame, changes: DataFrame) -> DataFrame:
    """(policy, outcome, version): a change (policy, expected, tx) counts if it is the first that names the current version."""
    w = Window.partitionBy("policy").orderBy("tx")
    # Each success raises the version by one, so the n-th success names version + n - 1: the runs of matching changes follow from ranks of distinct expectations.
    first = changes.groupBy("policy", "expected").agg(F.min("tx").alias("tx"))
    step = first.join(policies, "policy").where(F.col("expected") >= F.col("version"))
    place = step.withColumn("n", F.row_number().over(Window.partitionBy("policy").orderBy("expected"))).withColumn("before", F.lag("tx", 1, -1).over(Window.partitionBy("policy").orderBy("expected")))
    fine = place.withColumn("broken", F.sum(F.when((F.col("expected") != F.col("version") + F.col("n") - 1) | (F.col("tx") < F.col("before")), 1).otherwise(0)).over(Window.partitionBy("policy").orderBy("expected")))
    good = fine.where("broken = 0").groupBy("policy").agg(F.count("*").alias("applied"))
    return policies.join(good, "policy", "left").select("policy", (F.col("version") + F.coalesce("applied", F.lit(0))).alias("version"))


def sealed_puts(puts: DataFrame, policies: DataFrame) -> DataFrame:
    """(put_id, outcome) of sealed writes: the recipients must be exactly the policy's readers, at its current version; no cryptography."""
    joined = puts.join(policies, "policy", "left")
    code = (
        F.when(F.col("version").isNull(), "platform:unknown_policy").when(F.col("policy_version") != F.col("version"), "platform:stale_policy")
        .when(F.size(F.array_distinct("recipients")) != F.size("recipients"), "platform:repeated_recipient")
        .when(F.array_sort("recipients") != F.array_sort("readers"), "platform:recipients").otherwise("accepted")
    )
    return joined.select("put_id", code.alias("outcome"))


def reconcile(catalog: DataFrame, registry: DataFrame) -> DataFrame:
    """(tbl, problem) of tables (tbl, has_key) in the catalog or in the registry (tbl) that don't fit."""
    both = catalog.withColumn("c", F.lit(True)).join(registry.select("tbl").withColumn("r", F.lit(True)), "tbl", "full_outer")
    problem = F.when(F.col("c").isNull(), "missing_table").when(F.col("r").isNull(), "schema_unregistered").when(~F.col("has_key"), "no_primary_key")
    return both.select("tbl", problem.alias("problem")).where("problem IS NOT NULL")


# What a foreign key may do when its parent's owner is a part of it.
FOREIGN_KEY_ACTIONS = ("no action", "restrict", "cascade")


def foreign_key_problems(keys: Sequence[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(child, problem) of foreign keys (child, on_update, on_delete) with actions that would change rows behind the checks."""
    return [(child, f"{when} {action}") for child, update, delete in keys for when, action in (("on update", update), ("on delete", delete)) if action.lower() not in FOREIGN_KEY_ACTIONS]


def seeding_window(outcomes: DataFrame, seed_operation: str = "close-seeding") -> DataFrame:
    """(idx, open) of transactions (idx, operation, outcome): the window is open up to the first accepted transaction that closes it, which itself still may seed."""
    closed = outcomes.where((F.col("operation") == seed_operation) & (F.col("outcome") == "accepted")).agg(F.min("idx").alias("closed"))
    return outcomes.crossJoin(F.broadcast(closed)).select("idx", F.coalesce(F.col("idx") <= F.col("closed"), F.lit(True)).alias("open"))  # one row
