"""Entity resolution: exact groups by joins and windows, and the sequential rules of one document as a fold."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions import labels as lb
from ..functions.similarity import at_least, grams, max_distance
from ..functions.text import fold
from ..schema import FUZZY_TYPES, MIN_SUGGESTION, NER_CONFIDENCE, OVERLAP, SIMILARITY

IDENTITY = ["doc_id", "entity_type", "page_index", "normalized_value"]


def numbered(occurrences: DataFrame, *order: str) -> DataFrame:
    """seq: the order of arrival within a document."""
    return occurrences.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy(*(order or ("page_index", "start")))).cast("long"))


def distinct_occurrences(occurrences: DataFrame) -> DataFrame:
    """Of occurrences equal in type, page, box and normal form the first to arrive stays."""
    box = F.struct(*(F.col(f"bbox.{n}").alias(n) for n in ("x", "y", "width", "height")))
    first = Window.partitionBy(*IDENTITY, box).orderBy("seq")
    return occurrences.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def without_removed(occurrences: DataFrame, removed: DataFrame) -> DataFrame:
    """removed(doc_id, normalized_value) no longer become entities, whatever their type."""
    return occurrences.join(removed, ["doc_id", "normalized_value"], "left_anti")


def aliases(occurrences: DataFrame, keys: list[str]) -> DataFrame:
    """A2: each spelling's number and first arrival."""
    return occurrences.groupBy(*keys, "value").agg(F.count("*").alias("freq"), F.min("seq").alias("first_seq"))


def canonical(spellings: DataFrame, keys: list[str]) -> DataFrame:
    """A3, A4: the most frequent spelling, then the longest, then the first; and whether spellings that differ beyond case
    tie for it."""
    rank = F.struct("freq", F.length("value").alias("len"), (-F.col("first_seq")).alias("early"))
    best = F.struct("freq", F.length("value").alias("len"))
    # per group the spellings are few, but not bounded: the tie is counted by a second aggregation, not collected
    top = spellings.groupBy(*keys).agg(F.max_by("value", rank).alias("canonical_value"), F.max(best).alias("best"))
    tied = spellings.join(top, keys).filter(best == F.col("best")).groupBy(*keys).agg(F.count_distinct(F.lower("value")).alias("ties"))
    return top.join(tied, keys).select(*keys, "canonical_value", (F.col("ties") >= 2).alias("ambiguous"))


def exact_groups(occurrences: DataFrame) -> DataFrame:
    """A1 by exact keys, A2 to A6, J8, W1: groups of one document, type and normal form. Two shuffles, both on (document,
    type, ...); no document is held in one place.

    (doc_id, entity_type, normalized_value, canonical_value, ambiguous, n_members, mask_format, position, index_in_type,
    group_id)"""
    keys = ["doc_id", "entity_type", "normalized_value"]
    place = F.struct("page_index", F.col("bbox.y").alias("y"), F.col("bbox.x").alias("x"), "normalized_value")
    firsts = occurrences.groupBy(*keys).agg(F.count("*").alias("n_members"), F.min(place).alias("position"))
    masks = occurrences.filter("mask_format IS NOT NULL").groupBy(*keys, "mask_format").agg(F.count("*").alias("n"), F.min(F.struct("page_index", F.col("bbox.y").alias("y"), F.col("bbox.x").alias("x"))).alias("at"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "at")
    masks = masks.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*keys, F.col("mask_format").alias("__mask"))
    named = canonical(aliases(occurrences, keys), keys)
    out = firsts.join(named, keys).join(masks, keys, "left").withColumn("mask_format", F.coalesce("__mask", lb.mask_of(F.col("entity_type")))).drop("__mask")
    order = Window.partitionBy("doc_id", "entity_type").orderBy("position")
    return out.withColumn("index_in_type", F.row_number().over(order)).withColumn("group_id", F.concat_ws(":", "doc_id", "entity_type", "index_in_type"))


def members(occurrences: DataFrame, groups: DataFrame) -> DataFrame:
    """Occurrences with their group's id."""
    return occurrences.join(groups.select("doc_id", "entity_type", "normalized_value", "group_id"), ["doc_id", "entity_type", "normalized_value"])


def similar_pairs(values: DataFrame, key: str = "value", block: Column | None = None, threshold: float = SIMILARITY) -> DataFrame:
    """Pairs a < b of distinct values with similarity at or over the threshold, within a block.

    Strings that close share trigrams: of a string's trigrams, ordered from rare to common, one of the first (allowed
    distance * 3 + 1) must be in the other's first. Only those prefixes are joined, so common trigrams never meet, and no
    trigram is skipped. Strings too short for the bound meet by their lengths."""
    blocked = values.select((block if block is not None else F.lit(0)).alias("block"), F.col(key).alias("v")).distinct().withColumn("len", F.length("v"))
    blocked = blocked.withColumn("far", max_distance(F.ceil(F.col("len") / threshold).cast("int"), threshold)).withColumn("grams", F.array_distinct(grams(F.col("v"))))
    # a string with at most 3 * far trigrams could lose them all
    short = F.size("grams") <= 3 * F.col("far")
    flat = blocked.select("block", "v", "len", "far", F.posexplode("grams").alias("k", "gram"))
    df = flat.groupBy("block", "gram").agg(F.count("*").alias("df"))
    ranked = flat.join(df, ["block", "gram"]).withColumn("rank", F.row_number().over(Window.partitionBy("block", "v").orderBy("df", "gram")))
    prefix = ranked.filter(F.col("rank") <= 3 * F.col("far") + 1).select("block", "v", "len", "far", "gram")
    a, b = prefix.alias("a"), prefix.alias("b")
    near = F.abs(F.col("a.len") - F.col("b.len")) <= F.greatest("a.far", "b.far")
    met = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.gram") == F.col("b.gram")) & (F.col("a.v") < F.col("b.v")) & near).select(F.col("a.block").alias("block"), F.col("a.v").alias("a"), F.col("b.v").alias("b"))
    tiny = blocked.filter(short)
    spread = tiny.select("block", "v", F.explode(F.sequence(F.greatest(F.col("len") - F.col("far"), F.lit(0)), F.col("len") + F.col("far"))).alias("l"))
    met_short = spread.alias("a").join(blocked.alias("b"), (F.col("a.block") == F.col("b.block")) & (F.col("a.l") == F.col("b.len")) & (F.col("a.v") != F.col("b.v"))).select(F.col("a.block").alias("block"), F.least("a.v", "b.v").alias("a"), F.greatest("a.v", "b.v").alias("b"))
    return met.unionByName(met_short).distinct().filter(at_least("a", "b", threshold)).select("block", "a", "b")


def corrected_types(occurrences: DataFrame, corrections: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """corrections(doc_id, normalized_value, corrected_type, detector_type, seq) applied by the equal normal form,
    else, between free-text types, by the first similar one."""
    o, c = occurrences.alias("o"), corrections.alias("c")
    free = F.col("o.entity_type").isin(*FUZZY_TYPES) & F.col("c.detector_type").isin(*FUZZY_TYPES)
    same = F.col("o.normalized_value") == F.col("c.normalized_value")
    met = o.join(c, (F.col("o.doc_id") == F.col("c.doc_id")) & (same | (free & at_least("o.normalized_value", "c.normalized_value", threshold))))
    best = met.groupBy("o.doc_id", "o.seq").agg(F.min_by("c.corrected_type", F.struct((~same).alias("x"), F.col("c.seq"))).alias("corrected"))
    return occurrences.join(best, ["doc_id", "seq"], "left").withColumn("entity_type", F.coalesce("corrected", "entity_type")).drop("corrected")


def genders(people: DataFrame, names: DataFrame, value: str = "canonical_value") -> DataFrame:
    """People with person_gender: by all words but the last, else by the first; initials and ambiguous names say
    nothing."""
    from ..functions.text import comparable

    words = F.split(comparable(F.col(value)), " ")
    many = F.size(words) > 1
    keyed = people.withColumn("__seq", F.when(many, F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " ")).otherwise(words[0])).withColumn("__one", words[0])
    known = names.filter("label IN ('f', 'm')")
    open_key = lambda c: F.when(F.col(c).contains(" ") | ((F.length(c) > 1) & ~F.col(c).contains(".")), F.col(c))
    keyed = keyed.withColumn("__seq", open_key("__seq")).withColumn("__one", open_key("__one"))
    a = known.select(F.col("name").alias("__seq"), F.col("label").alias("__g1"))
    b = known.select(F.col("name").alias("__one"), F.col("label").alias("__g2"))
    return keyed.join(a, "__seq", "left").join(b, "__one", "left").withColumn("person_gender", F.coalesce("__g1", "__g2")).drop("__seq", "__one", "__g1", "__g2")


# ---- one document, in order of arrival


def bounded_distance(a: str, b: str, limit: int) -> int:
    """The edit distance, or limit + 1 where it is larger: common ends are cut off, and only a band is filled."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(max(len(a), len(b)), limit + 1)
    far = limit + 1
    row = [min(j, far) for j in range(len(b) + 1)]
    for i, ch in enumerate(a, 1):
        new = [far] * (len(b) + 1)
        if i <= limit:
            new[0] = i
        for j in range(max(1, i - limit), min(len(b), i + limit) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (ch != b[j - 1]), far)
        if min(new) >= far:
            return far
        row = new
    return row[-1]


def alike(a: str, b: str, threshold: float) -> bool:
    longest = max(len(a), len(b))
    if not longest:
        return True
    if not a or not b:
        return threshold <= 0.0
    limit = int((1 - threshold) * longest) + 1
    d = bounded_distance(a, b, limit)
    return d <= limit and 1 - d / longest >= threshold


Box = tuple[float, float, float, float]


def ratio(a: Box, b: Box) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    smaller = min(a[2] * a[3], b[2] * b[3])
    return w * h / smaller if w > 0 and h > 0 and smaller > 0 else 0.0


def holds(outer: Iterable[Box], inner: Iterable[Box]) -> bool:
    e = 0.01
    outer = list(outer)
    return all(any(i[0] >= o[0] - e and i[1] >= o[1] - e and i[0] + i[2] <= o[0] + o[2] + e and i[1] + i[3] <= o[1] + o[3] + e for o in outer) for i in inner)


@dataclass
class Hit:
    seq: int
    entity_type: str
    page_index: int
    value: str
    normalized_value: str
    source: str
    confidence: float
    bbox: Box
    fragments: tuple[Box, ...] = ()
    mask_format: str | None = None

    @property
    def boxes(self) -> tuple[Box, ...]:
        return self.fragments or (self.bbox,)


@dataclass
class Group:
    number: int
    entity_type: str
    canonical: str
    enabled: bool = True
    needs_review: bool = False
    types: set[str] = field(default_factory=set)
    keys: dict[str, None] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    members: list[Hit] = field(default_factory=list)
    ambiguous: bool = False


@dataclass
class Resolver:
    """M1 to M7: the occurrences of one document, in order of arrival. Also the state of a stream's key."""

    names: frozenset[str] = frozenset()
    threshold: float = SIMILARITY
    removed: set[str] = field(default_factory=set)
    corrections: dict[str, tuple[str, str]] = field(default_factory=dict)
    groups: list[Group] = field(default_factory=list)
    records: dict[int, list[tuple[Hit, Group | None]]] = field(default_factory=dict)
    seen: set[tuple] = field(default_factory=set)
    conflicts: list[dict] = field(default_factory=list)
    held: dict[int, Hit] = field(default_factory=dict)
    contained: list[tuple[Hit, Hit]] = field(default_factory=list)
    exact: dict[str, list[Group]] = field(default_factory=dict)

    def add(self, hit: Hit) -> str:
        """What becomes of an occurrence: duplicate, suppressed, contained, suggested, doubtful, dropped, held, lost, or
        grouped."""
        identity = (hit.entity_type, hit.page_index, hit.bbox, hit.normalized_value)
        if identity in self.seen:
            return "duplicate"
        if hit.normalized_value in self.removed:
            self._record(hit, None)
            return "suppressed"
        page = self.records.get(hit.page_index, [])
        for other, group in page:
            if group is not None and other.entity_type == hit.entity_type and other.bbox != hit.bbox and holds(other.boxes, hit.boxes):
                if hit.source == "manual":
                    self.contained.append((other, hit))
                return "contained"
        if hit.source == "ner" and hit.confidence < NER_CONFIDENCE:
            return self._doubtful(hit)
        for other, group in page:
            if group is None or other.entity_type == hit.entity_type:
                continue
            if max(ratio(a, b) for a in other.boxes for b in hit.boxes) > OVERLAP:
                reason = "disagree" if other.source != hit.source else "overlap"
                if reason == "disagree":
                    wins = hit.source == "regex"
                else:
                    wins = hit.confidence > other.confidence
                if not wins and hit.source == "manual":
                    self._conflict(group, reason, other, hit, False, True)
                    self.held[len(self.conflicts) - 1] = hit
                    self.seen.add(identity)
                    return "held"
                self._conflict(group, reason, other, hit, True, False)
                if not wins and holds(other.boxes, hit.boxes):
                    return "lost"
                break
        self._join(hit)
        return "grouped"

    def _record(self, hit: Hit, group: Group | None) -> None:
        self.seen.add((hit.entity_type, hit.page_index, hit.bbox, hit.normalized_value))
        self.records.setdefault(hit.page_index, []).append((hit, group))

    def _conflict(self, group: Group, reason: str, old: Hit | None, new: Hit, resolved: bool, held: bool) -> None:
        first = (old.source, old.entity_type, old.confidence, old.value) if old else (group.members[0].source, group.entity_type, group.members[0].confidence, group.canonical)
        self.conflicts.append({"group": group.number, "reason": reason, "candidates": [first, (new.source, new.entity_type, new.confidence, new.value)], "resolved": resolved, "held": held})

    def _match(self, hit: Hit) -> Group | None:
        fits = lambda group: group.entity_type == hit.entity_type or hit.entity_type in group.types
        for group in sorted(self.exact.get(hit.normalized_value, ()), key=lambda x: x.number):
            if fits(group):
                return group
        if hit.entity_type in FUZZY_TYPES:
            for group in self.groups:
                if fits(group) and any(alike(hit.normalized_value, key, self.threshold) for key in group.keys):
                    return group
        return None

    def _doubtful(self, hit: Hit) -> str:
        group = self._match(hit)
        if group is None:
            first = (fold(hit.value).split(" ") or [""])[0]
            if hit.entity_type in FUZZY_TYPES and hit.confidence >= MIN_SUGGESTION and (hit.entity_type != "PERSON" or first in self.names):
                made = self._create(hit)
                made.enabled, made.needs_review = False, True
                return "suggested"
            return "dropped"
        self._conflict(group, "low_confidence", None, hit, True, False)
        if hit.normalized_value in group.keys:
            self._extend(group, hit)
        return "doubtful"

    def _join(self, hit: Hit) -> None:
        group = self._match(hit)
        if group is None:
            self._create(hit)
            return
        self._extend(group, hit)
        if group.needs_review:
            group.enabled, group.needs_review = True, False

    def _corrected(self, hit: Hit) -> str:
        if hit.normalized_value in self.corrections:
            return self.corrections[hit.normalized_value][0]
        if hit.entity_type in FUZZY_TYPES:
            for key, (kind, detector) in self.corrections.items():
                if detector in FUZZY_TYPES and alike(hit.normalized_value, key, self.threshold):
                    return kind
        return hit.entity_type

    def _create(self, hit: Hit) -> Group:
        kind = self._corrected(hit)
        group = Group(len(self.groups), kind, hit.value, types={hit.entity_type, kind})
        self.groups.append(group)
        self._extend(group, hit)
        return group

    def _extend(self, group: Group, hit: Hit) -> None:
        group.members.append(hit)
        if hit.normalized_value not in group.keys:
            group.keys[hit.normalized_value] = None
            self.exact.setdefault(hit.normalized_value, []).append(group)
        group.counts[hit.value] = group.counts.get(hit.value, 0) + 1
        top = max(group.counts.values())
        best = [v for v, n in group.counts.items() if n == top]
        size = max(map(len, best))
        best = [v for v in best if len(v) == size]
        group.canonical = best[0]
        group.ambiguous = len({v.lower() for v in best}) > 1
        self._record(hit, group)

    def drop(self, source: str | None = None, pages: set[int] | None = None) -> None:
        """Occurrences of a source, on pages, or both, go; groups left empty go with them."""
        if source is None and pages is None:
            raise ValueError("a source or pages must be given")
        gone = lambda h: (source is None or h.source == source) and (pages is None or h.page_index in pages)
        kept = [hit for rows in self.records.values() for hit, _ in rows if not gone(hit)]
        back = [hit for _, hit in self.contained if not gone(hit)]
        self._again(sorted(kept + back, key=lambda h: h.seq))

    def remove(self, number: int) -> None:
        """The group's normal forms are suppressed from now on, and its occurrences with it."""
        self.removed |= set(self.groups[number].keys)
        hits = sorted((hit for rows in self.records.values() for hit, _ in rows), key=lambda h: h.seq)
        self._again(hits)

    def lift(self, key: str) -> None:
        """U8: a removed normal form may become an entity again."""
        self.removed.discard(key)
        self._again(sorted((hit for rows in self.records.values() for hit, _ in rows), key=lambda h: h.seq))

    def _again(self, hits: list[Hit]) -> None:
        self.groups, self.records, self.seen, self.conflicts, self.held, self.exact, self.contained = [], {}, set(), [], {}, {}, []
        for hit in hits:
            self.add(hit)

    def finished(self) -> list[tuple[int, Group]]:
        """Groups with their numbers within the type, by place in the document."""
        place = lambda h: (h.page_index, h.bbox[1], h.bbox[0], h.normalized_value)
        counts: dict[str, int] = {}
        out = []
        for group in sorted(self.groups, key=lambda x: min(map(place, x.members))):
            counts[group.entity_type] = counts.get(group.entity_type, 0) + 1
            out.append((counts[group.entity_type], group))
        return out


def _boxes(values) -> tuple[Box, ...]:
    return tuple((b["x"], b["y"], b["width"], b["height"]) for b in values) if values is not None else ()


def hit_of(row) -> Hit:
    return Hit(int(row["seq"]), row["entity_type"], int(row["page_index"]), row["value"], row["normalized_value"], row["source"], float(row["confidence"]), _boxes([row["bbox"]])[0], _boxes(row.get("fragments")), row.get("mask_format"))


GROUPS = "doc_id long, group_id string, entity_type string, canonical_value string, index_in_type int, enabled boolean, needs_review boolean, ambiguous boolean, n_members long, aliases array<string>, member_seqs array<long>, n_conflicts long"


def fold_groups(occurrences: DataFrame, names: frozenset[str] = frozenset(), threshold: float = SIMILARITY) -> DataFrame:
    """A1 in full: one shuffle by document, then the sequential rules. A document is the unit that can't be divided, as each
    step depends on the ones before; documents without overlaps, doubtful or free-text occurrences need exact_groups
    only."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state = Resolver(names, threshold)
        for row in rows.sort_values("seq").to_dict("records"):
            state.add(hit_of(row))
        doc = rows["doc_id"].iloc[0]
        by: dict[int, int] = {}
        for c in state.conflicts:
            by[c["group"]] = by.get(c["group"], 0) + 1
        out = [(doc, f"{doc}:{x.entity_type}:{n}", x.entity_type, x.canonical, n, x.enabled, x.needs_review, x.ambiguous, len(x.members), list(x.counts), [h.seq for h in x.members], by.get(x.number, 0)) for n, x in state.finished()]
        return pd.DataFrame(out, columns=[c.split()[0] for c in GROUPS.split(", ")])

    return occurrences.groupBy("doc_id").applyInPandas(run, GROUPS)


def overlap_conflicts(occurrences: DataFrame) -> DataFrame:
    """J7 in a relational form: for each occurrence the first earlier one on its page, of another type, that covers over
    half the smaller of the two, with the reason. (doc_id, seq, other_seq, reason)"""
    a, b = occurrences.alias("a"), occurrences.alias("b")
    share = g.max_fragment_ratio(g.pieces(F.col("a.bbox"), F.col("a.fragments")), g.pieces(F.col("b.bbox"), F.col("b.fragments")))
    met = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_index") == F.col("b.page_index")) & (F.col("b.seq") < F.col("a.seq")) & (F.col("a.entity_type") != F.col("b.entity_type")) & (F.col("a.bbox.x") < F.col("b.bbox.x") + F.col("b.bbox.width")) & (F.col("b.bbox.x") < F.col("a.bbox.x") + F.col("a.bbox.width")) & (share > OVERLAP))
    reason = F.when(F.col("a.source") != F.col("b.source"), "disagree").otherwise("overlap")
    return met.groupBy(F.col("a.doc_id"), F.col("a.seq")).agg(F.min(F.struct(F.col("b.seq").alias("other_seq"), reason.alias("reason"))).alias("m")).select("doc_id", "seq", "m.*")


def contained(occurrences: DataFrame) -> DataFrame:
    """Occurrences without those whose every piece lies in an earlier one of the page and type with another box."""
    a, b = occurrences.alias("a"), occurrences.alias("b")
    inside = g.all_contained(g.pieces(F.col("b.bbox"), F.col("b.fragments")), g.pieces(F.col("a.bbox"), F.col("a.fragments")))
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_index") == F.col("b.page_index")) & (F.col("a.entity_type") == F.col("b.entity_type")) & (F.col("b.seq") < F.col("a.seq")) & ~g.same_box(F.col("a.bbox"), F.col("b.bbox")) & inside, "left_anti")
