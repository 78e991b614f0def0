"""Edits of resolved entities as functions from tables to tables; nothing is stored unless the caller writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import CHECKPOINTS

PATCH_KEYS = ("entity_type", "canonical_value", "person_gender", "enabled", "mode", "replacement_value")


def update(groups: DataFrame, group_id: str, patch: dict) -> DataFrame:
    """M8: the patch's keys in their fixed order. A value set by hand stays until the mode changes; a new mode clears it."""
    unknown = set(patch) - set(PATCH_KEYS)
    if unknown:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    at = F.col("group_id") == group_id
    out = groups if "value_user_set" in groups.columns else groups.withColumn("value_user_set", F.lit(False))
    for key in PATCH_KEYS:
        if key not in patch:
            continue
        new = F.lit(patch[key])
        if key == "person_gender" and patch[key] == "neutral":
            new = F.lit(None).cast("string")
        if key == "mode":
            out = out.withColumn("value_user_set", F.when(at & (F.col("mode") != new), False).otherwise(F.col("value_user_set")))
        if key == "replacement_value":
            out = out.withColumn("value_user_set", F.when(at, True).otherwise(F.col("value_user_set")))
        if key == "entity_type":
            # M9: the group comes last in its new type
            last = groups.filter(F.col("entity_type") == patch[key]).groupBy("doc_id").agg(F.max("index_in_type").alias("__last"))
            out = out.join(last, "doc_id", "left").withColumn("index_in_type", F.when(at & (F.col("entity_type") != new), F.coalesce("__last", F.lit(0)) + 1).otherwise(F.col("index_in_type"))).drop("__last")
        out = out.withColumn(key, F.when(at, new).otherwise(F.col(key)))
    return out


def merge(groups: DataFrame, members: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """plan(survivor, absorbed): members move, numbers of members add up, the smallest ordinal stays. Pairs of
    one id, repeats and pairs of different types are left out."""
    kind = groups.select("group_id", "entity_type")
    ok = plan.filter("survivor <> absorbed").dropDuplicates(["absorbed"]).join(kind.select(F.col("group_id").alias("survivor"), F.col("entity_type").alias("a")), "survivor").join(kind.select(F.col("group_id").alias("absorbed"), F.col("entity_type").alias("b")), "absorbed").filter("a = b").select(F.col("absorbed").alias("group_id"), "survivor")
    moved = members.join(ok, "group_id", "left").withColumn("group_id", F.coalesce("survivor", "group_id")).drop("survivor")
    keyed = groups.join(ok, "group_id", "left").withColumn("__to", F.coalesce("survivor", "group_id"))
    sums = keyed.groupBy(F.col("__to").alias("group_id")).agg(F.sum("n_members").alias("n_members"), F.min("index_in_type").alias("index_in_type"))
    return groups.drop("n_members", "index_in_type").join(sums, "group_id"), moved


def split(members: DataFrame, group_id: str, moved: DataFrame, new_id: str) -> DataFrame:
    """The members named by moved(seq) get the new id; they must be some of the group's and not all. Bookkeeping is
    rebuilt from the members afterwards (exact_groups)."""
    own = members.filter(F.col("group_id") == group_id)
    n, k = own.count(), own.join(moved, "seq", "left_semi").count()
    if not 0 < k < n:
        raise ValueError("a split takes some members and leaves some")
    flag = moved.select("seq", F.lit(True).alias("__moved")).distinct()
    return members.join(flag, "seq", "left").withColumn("group_id", F.when((F.col("group_id") == group_id) & F.col("__moved"), new_id).otherwise(F.col("group_id"))).drop("__moved")


def drop_occurrences(occurrences: DataFrame, source: str | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Without those of a source, on given pages, or both at once; one of the two must be given."""
    if source is None and pages is None:
        raise ValueError("a source or pages must be given")
    gone = occurrences if source is None else occurrences.filter(F.col("source") == source)
    if pages is None:
        return occurrences.filter(~F.col("source").eqNullSafe(source))
    gone = gone.join(pages, ["doc_id", "page_index"], "left_semi").select("doc_id", "seq")
    return occurrences.join(gone, ["doc_id", "seq"], "left_anti")


def diff(before: DataFrame, after: DataFrame, key: str = "group_id") -> DataFrame:
    """(key, op, changed): groups removed, created, or changed, with the names of the columns that differ."""
    names = [c for c in before.columns if c != key and c in after.columns]
    a = before.select(F.col(key), F.struct(*names).alias("a"))
    b = after.select(F.col(key), F.struct(*names).alias("b"))
    j = a.join(b, key, "full")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in names)))
    op = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "created").when(F.size(changed) > 0, "updated")
    return j.select(key, op.alias("op"), F.when(op == "updated", changed).alias("changed")).filter("op IS NOT NULL")


def recomputed_by_rules(groups: DataFrame, old_mode: Column, new_mode: Column) -> DataFrame:
    """Groups whose effective mode differs; their hand-set values go."""
    return groups.filter(~old_mode.eqNullSafe(new_mode)).withColumn("value_user_set", F.lit(False))


def default_candidate(conflicts: DataFrame) -> DataFrame:
    """conflicts(conflict_id, candidates) with the type of the most confident candidate, on ties the pattern's."""
    c = F.col("candidates")
    ranked = F.array_sort(F.transform(c, lambda x, i: F.struct((-x["confidence"]).alias("c"), F.when(x["source"] == "regex", 0).otherwise(1).alias("s"), i.alias("i"), x["entity_type"].alias("t"))))
    return conflicts.withColumn("default_type", ranked[0]["t"])


def candidate_types(conflicts: DataFrame) -> DataFrame:
    """The distinct types by confidence, the pattern's first, and the distinct spellings as first seen."""
    c = F.col("candidates")
    ranked = F.array_sort(F.transform(c, lambda x, i: F.struct((-x["confidence"]).alias("c"), F.when(x["source"] == "regex", 0).otherwise(1).alias("s"), i.alias("i"), x["entity_type"].alias("t"))))
    return conflicts.select("conflict_id", F.array_distinct(F.transform(ranked, lambda x: x["t"])).alias("types"), F.array_distinct(F.transform(c, lambda x: x["value"])).alias("spellings"))


def resolve(conflicts: DataFrame, conflict_id: str, kind: str | None = None) -> DataFrame:
    """The conflict is settled by the given type or its default."""
    out = default_candidate(conflicts)
    at = F.col("conflict_id") == conflict_id
    return out.withColumn("resolved", F.col("resolved") | at).withColumn("resolved_type", F.when(at, F.coalesce(F.lit(kind), F.col("default_type"))).otherwise(F.col("resolved_type"))).drop("default_type")


def pending_manual(conflicts: DataFrame) -> DataFrame:
    """Per group the unresolved conflicts that hold a manual occurrence."""
    return conflicts.filter("NOT resolved AND held_manual").groupBy("group_id").agg(F.count("*").alias("n_pending"))


def unreadable_pages(pages: DataFrame, members: DataFrame, unchecked: DataFrame | None = None) -> DataFrame:
    """Pages with ink that nobody could read and no entity, less those that a person unchecked."""
    out = pages.filter("unreadable").join(members.select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_anti")
    return out if unchecked is None else out.join(unchecked, ["doc_id", "page_index"], "left_anti")


def to_toggle(groups: DataFrame, on: bool) -> DataFrame:
    """Only groups whose state changes."""
    return groups.filter(F.col("enabled") != on)


def type_modes(groups: DataFrame) -> DataFrame:
    """Per type the one mode, or mixed."""
    return groups.groupBy("doc_id", "entity_type").agg(F.when(F.min("mode") == F.max("mode"), F.min("mode")).otherwise("mixed").alias("mode"))


def sweep(rules: DataFrame, scope: str, entity_type: str | None = None) -> DataFrame:
    """A mode set for a document removes the rules of types and groups; one set for a type, those of its groups."""
    if scope == "global":
        return rules.filter("scope = 'global'")
    return rules.filter(~((F.col("scope") == "group") & (F.col("target_type") == entity_type)) | F.col("target_type").isNull())


def overrides(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """Per document the enabled rules of types and of groups, and the groups that one of them reaches."""
    live = rules.filter("enabled")
    n = live.groupBy("doc_id").agg(F.count_if(F.col("scope") == "type").alias("n_type_rules"), F.count_if(F.col("scope") == "group").alias("n_group_rules"))
    own = groups.join(live.filter("scope = 'group'").select(F.col("target_group_id").alias("group_id")), "group_id", "left_semi").select("doc_id", "group_id")
    kind = groups.join(live.filter("scope = 'type'").select("doc_id", F.col("target_type").alias("entity_type")), ["doc_id", "entity_type"], "left_semi").select("doc_id", "group_id")
    reached = own.union(kind).distinct().groupBy("doc_id").agg(F.count("*").alias("n_groups_reached"))
    return n.join(reached, "doc_id", "left").na.fill(0, ["n_groups_reached"])


def merge_targets(groups: DataFrame) -> DataFrame:
    """For each group the others of its type, in order. All pairs of a type within a document: a list for one
    document's panel, not for a corpus."""
    a, b = groups.select("doc_id", "entity_type", "group_id"), groups.select("doc_id", "entity_type", F.col("group_id").alias("target"), F.col("index_in_type").alias("ordinal"))
    return a.join(b, ["doc_id", "entity_type"]).filter("group_id <> target").withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy("ordinal", "target")))


def degraded_pages(fitted: DataFrame) -> DataFrame:
    """The pages on which a group's token is illegible."""
    return fitted.filter("degraded").groupBy("group_id").agg(F.array_sort(F.collect_set("page_index")).alias("pages"))


def checkpoints(rows: DataFrame) -> DataFrame:
    """The newest checkpoints of a document."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("created_at"))
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= CHECKPOINTS).drop("__n")


def apply_edits(groups: DataFrame, edits: list[tuple[str, dict]]) -> DataFrame:
    """An ordered list of (group id, patch); a preview is the result without a write."""
    for group_id, patch in edits:
        groups = update(groups, group_id, patch)
    return groups
