"""Replacements: modes, values, redacted pages, legends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions.geometry import pieces
from ..functions.synth import synthetic

# The legend's names of types.
TYPE_NAMES = {"PERSON": "Persona", "ORGANIZATION": "Organización", "ADDRESS": "Dirección", "DNI": "DNI", "CUIT": "CUIT", "PHONE": "Teléfono", "EMAIL": "Email", "IBAN": "IBAN", "CREDIT_CARD": "Tarjeta", "DATE": "Fecha", "LICENSE": "Matrícula", "PLATE": "Patente", "CUSTOM": "Custom"}


def resolve_modes(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """Groups with mode: the enabled rule of the highest priority for the group, else for its type, else for the
    document; with none, the group's own mode. The first of equal priorities wins. Rules are few per document, but each
    scope is reduced to one row before it is joined."""
    top = F.max_by("mode", F.struct("priority", (-F.col("n")).alias("early")))
    live = rules.filter("enabled")
    if "n" not in live.columns:
        live = live.withColumn("n", F.dense_rank().over(_by_rule()))
    own = live.filter("scope = 'group'").groupBy(F.col("target_group_id").alias("group_id")).agg(top.alias("g"))
    kind = live.filter("scope = 'type'").groupBy("doc_id", F.col("target_type").alias("entity_type")).agg(top.alias("t"))
    whole = live.filter("scope = 'global'").groupBy("doc_id").agg(top.alias("w"))
    out = groups.join(own, "group_id", "left").join(kind, ["doc_id", "entity_type"], "left").join(whole, "doc_id", "left")
    mine = F.col("replacement_mode") if "replacement_mode" in groups.columns else F.lit("placeholder")
    return out.withColumn("mode", F.coalesce("g", "t", "w", mine)).drop("g", "t", "w")


def _by_rule():
    from pyspark.sql.window import Window

    return Window.partitionBy("doc_id").orderBy("rule_id")


def group_boxes(members: DataFrame) -> DataFrame:
    """(group_id, boxes): all pieces of a group's members that differ in size: all that the fit of a token looks at."""
    sizes = members.select("group_id", F.explode(pieces(F.col("bbox"), F.col("fragments"))).alias("b")).select("group_id", "b.width", "b.height")
    # of boxes of one height the narrowest decides
    tight = sizes.groupBy("group_id", "height").agg(F.min("width").alias("width"))
    return tight.groupBy("group_id").agg(F.collect_list(F.struct("width", "height")).alias("boxes"))


def replacement_values(groups: DataFrame, members: DataFrame, seed: str = "0") -> DataFrame:
    """groups(group_id, entity_type, index_in_type, mode, mask_format, person_gender) with previews for
    each mode and replacement_value for the group's own. Synthetic values are made once per group."""
    gender = F.col("person_gender") if "person_gender" in groups.columns else F.lit(None).cast("string")
    fitted = groups.join(group_boxes(members), "group_id", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast("array<struct<width:double,height:double>>")))
    kind, index = F.col("entity_type"), F.col("index_in_type")
    out = fitted.withColumns({"placeholder": lb.placeholder(kind, gender, index, F.col("boxes")), "ladder": lb.ladder(kind, gender, index)})
    out = out.withColumn("synthetic", synthetic(F.lit(seed), kind, F.col("group_id"), index, gender)).drop("boxes")
    return out.withColumn("replacement_value", value_for(F.col("mode")))


def value_for(mode: Column) -> Column:
    return F.when(mode == "mask", F.col("mask_format")).when(mode == "synthetic", F.col("synthetic")).when(mode == "redact", F.lit("")).otherwise(F.col("placeholder"))


def page_replacements(groups: DataFrame, members: DataFrame) -> DataFrame:
    """K1: a row per member of an enabled group."""
    live = groups.filter("enabled") if "enabled" in groups.columns else groups
    return members.join(live.select("group_id", "canonical_value", "replacement_value", "mode"), "group_id")


def redacted_pages(page: DataFrame, replacements: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """K2, K3: pages with each replaced span's text exchanged; covered(doc_id, page_index) pages are empty. Spans of a page
    don't overlap. The text is rebuilt in one pass from the spans in order."""
    spans = replacements.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement_value"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,end:int,replacement_value:string>>")
    rows = page.join(spans, ["doc_id", "page_index"], "left").withColumn("spans", F.coalesce("spans", none))
    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(F.substring("text", s["at"] + 1, x["start"] - s["at"]), x["replacement_value"])).alias("out")), lambda s: F.concat(F.array_join(s["out"], ""), F.substr(F.col("text"), s["at"] + 1)))
    rows = rows.withColumn("redacted", F.when(F.size("spans") == 0, F.col("text")).otherwise(done))
    if covered is not None:
        rows = rows.join(covered.select("doc_id", "page_index", F.lit(True).alias("__c")), ["doc_id", "page_index"], "left").withColumn("redacted", F.when(F.col("__c"), "").otherwise(F.col("redacted"))).drop("__c")
    return rows.select("doc_id", "page_index", F.col("redacted").alias("text"))


def assembled(page: DataFrame) -> DataFrame:
    """K3: pages joined back into documents."""
    rows = page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("p"))
    return rows.select("doc_id", F.array_join(F.col("p.text"), "\n").alias("text"))


def legend(groups: DataFrame) -> DataFrame:
    """Per document and type the prefixes of its tokens and the number of marked places. No column can hold
    an original value."""
    live = (groups.filter("enabled") if "enabled" in groups.columns else groups).filter("mode = 'placeholder'").withColumn("prefix", lb.prefix(F.col("replacement_value"))).filter("prefix <> ''")
    out = live.groupBy("doc_id", "entity_type").agg(F.array_join(F.array_sort(F.collect_set("prefix")), ", ").alias("prefixes"), F.sum("n_members").alias("n_markers"))
    names = F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])
    return out.select("doc_id", "entity_type", "prefixes", F.try_element_at(names, F.col("entity_type")).alias("type_name"), "n_markers", lb.counted(F.col("n_markers"), "marcador", "marcadores").alias("count_label"))


def export_gate(documents: DataFrame, conflicts: DataFrame) -> DataFrame:
    """K9: documents without an unresolved conflict."""
    return documents.join(conflicts.filter("NOT resolved").select("doc_id").distinct(), "doc_id", "left_anti")


def checked_cover(covered: DataFrame, documents: DataFrame) -> DataFrame:
    """K8: covered pages with an index that their document lacks, which refuse an export."""
    return covered.join(documents.select("doc_id", "n_pages"), "doc_id", "left").filter("n_pages IS NULL OR page_index < 0 OR page_index >= n_pages")
