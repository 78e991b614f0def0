"""Personal data: regular expressions propose, checksums confirm, words nearby adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start are listed. The first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "local_phone", "ssn")
BASE = KINDS[:4]

#: Whole words that make a kind likelier when they stand within CONTEXT_CHARS before a span or after it.
CONTEXT = {
    "email": ("mail", "e-mail", "contact", "write", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "amex", "payment", "tarjeta", "karte", "carte"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "cell", "fax", "telefon", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "local_phone": ("phone", "telephone", "tel", "call", "mobile", "cell", "fax", "telefon", "teléfono"),
    "ssn": ("ssn", "social security"),
}
CONTEXT_CHARS = 40
#: Score of a span by its pattern alone, by pattern and checksum, and what a context word adds. Spans of the kinds
#: beyond the base count from MIN_SCORE on.
PATTERN_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3, "local_phone": 0.3, "ssn": 0.3}
CHECKED_SCORE = {"card": 0.8, "iban": 0.9, "ip": 0.7}
CONTEXT_SCORE = 0.35
MIN_SCORE = 0.6


@dataclass(frozen=True)
class Rule:
    """pattern is written so that Java's matcher needs no recursion and no second look at a run of characters: groups
    that end a pattern are possessive, and a match starts where its first run starts or where the last match ended."""

    kind: str
    pattern: str
    hint: str
    #: The most that can follow the match of pattern; which end is right, the check decides.
    tail: str = ""


LOCAL = "A-Za-z0-9._%+-"
#: The most characters of a tail with its blanks.
TAIL_CHARS = 60
#: Lengths of IBANs by country, asked first where several ends pass mod 97.
IBAN_LENGTHS = {
    **{15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV"},
    **{22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT"},
    **{26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT"},
}
RULES = (
    Rule("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Rule("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", "."),
    Rule("card", r"[0-9](?:[\x20-]?[0-9])++", ""),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    Rule("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})", "", r"^(?:\x20?[A-Z0-9]){11,30}"),
    Rule("local_phone", r"(?<![0-9+.)-])(?<!\+[0-9]{1,3}[\x20-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])", ""),
    Rule("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """The IBAN remainder: the first four characters go to the end, letters count 10 to 35."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def confirmed(kind: str, value: Column) -> Column:
    """Whether a match passes its kind's check."""
    digits = digits_of(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(value) == 1)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-") & ~value.rlike("0000$")
    return F.lit(True)


def score(kind: str, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(before, F.lit(" "), after))
    words = near.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(CONTEXT[kind])})(?![\p{{L}}\p{{N}}])")
    base = CHECKED_SCORE.get(kind, PATTERN_SCORE[kind])
    return F.least(F.lit(1.0), F.lit(base) + F.when(words, F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0)))


def _tail(rule: Rule, value: Column, rest: Column) -> Column:
    """How many characters of rest belong to the match: an end that no letter or digit follows and that the check
    confirms, the one at the country's length or else the last; 0 if there is none."""
    most = F.length(F.regexp_extract(rest, rule.tail, 0))

    def ranked(k: Column) -> Column:
        whole = F.concat(value, F.substring(rest, F.lit(1), k))
        bare = F.length(F.replace(whole, F.lit(" "), F.lit("")))
        country = F.substring(whole, 1, 2)
        fits = F.lit(False)
        for n, names in IBAN_LENGTHS.items():
            fits = fits | ((bare == n) & country.isin(names.split()))
        ends = F.substring(rest, k, F.lit(2)).rlike(r"^[A-Z0-9](?![A-Za-z0-9])")
        return F.struct(F.when(ends & confirmed(rule.kind, whole), fits).alias("fits"), k.alias("k"))

    best = F.array_max(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), ranked), lambda x: x["fits"].isNotNull()))
    return F.when(most > 0, F.coalesce(best["k"], F.lit(0))).otherwise(F.lit(0))


EMPTY = "array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>"


def _spans(rule: Rule, text: Column, digits: Column) -> Column:
    """The rule's confirmed matches. One expression cuts the text into what stands between matches, the matches and what
    follows them, and running lengths give the places, so that a long text is read once. The fold carries the last
    CONTEXT_CHARS characters, so that the context of a match is what stands around it, other matches included. A rule
    with a tail goes on after its pattern's match, so that a span that follows a false end is seen."""
    ahead = CONTEXT_CHARS + (TAIL_CHARS if rule.tail else 0)
    whole = F.lit(rf"(?s)(.*?)({rule.pattern}|\z)(?=(.{{0,{ahead}}}))")
    gaps, found, nexts = (F.regexp_extract_all(text, whole, F.lit(k)) for k in (1, 2, 3))
    pairs = F.zip_with(
        F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))),
        nexts,
        lambda p, n: F.struct(F.length(p["gap"]).alias("gap"), F.substring(p["gap"], -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"), p["value"].alias("value"), n.alias("after")),
    )
    empty = F.array().cast(EMPTY)
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), F.lit(0).alias("free"), empty.alias("out"))
    if rule.tail:
        # Worked out once for each match, before the fold.
        pairs = F.transform(pairs, lambda p: F.struct(p["gap"].alias("gap"), p["before"].alias("before"), p["value"].alias("value"), p["after"].alias("after"), _tail(rule, p["value"], p["after"]).alias("more")))

    def step(s: Column, p: Column) -> Column:
        head = p["value"]
        start = s["at"] + p["gap"]
        at = start + F.length(head)
        before = F.substring(F.concat(s["last"], p["before"]), -CONTEXT_CHARS, CONTEXT_CHARS)
        if rule.tail:
            value = F.concat(head, F.substring(p["after"], F.lit(1), p["more"]))
            after = F.substring(p["after"], p["more"] + 1, F.lit(CONTEXT_CHARS))
            kept = (p["more"] > 0) & (start >= s["free"])
        else:
            value, after = head, p["after"]
            kept = (value != "") & confirmed(rule.kind, value)
        end = start + F.length(value)
        points = score(rule.kind, before, after)
        if rule.kind not in BASE:
            kept = kept & (points >= MIN_SCORE)
        span = F.struct(start.alias("start"), F.lit(KINDS.index(rule.kind)).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), value.alias("value"), points.alias("score"))
        last = F.substring(F.concat(before, head), -CONTEXT_CHARS, CONTEXT_CHARS)
        free = F.when(kept, end).otherwise(s["free"])
        return F.struct(at.alias("at"), last.alias("last"), free.alias("free"), F.when(kept, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    has = (text.contains(rule.hint) if rule.hint else digits) & text.rlike(rule.pattern)
    return F.when(has, F.aggregate(pairs, first, step, lambda s: s["out"])).otherwise(empty)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, pii), a row per row of docs: pii is an array of (start, rank, end, kind, value, score) in the order of
    start, then of KINDS. Places are code points from 0, the end exclusive.

    Email, ip, card and phone matches count if their check passes (parts of at most 255; 14 to 19 digits under Luhn;
    10 to 15 digits); iban (mod 97), local_phone and ssn matches count if their check passes and pattern, checksum and
    words nearby score MIN_SCORE or more. Matches of one kind don't overlap, those of different kinds may. A null text
    is empty; null and equal ids stay as they are; an empty table gives an empty result; other columns are not read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digits", F.col("text").rlike("[0-9]"))
    out = out.withColumns({f"s{k}": _spans(r, F.col("text"), F.col("digits")) for k, r in enumerate(rules)})
    return out.select("doc_id", F.array_sort(F.concat(*(F.col(f"s{k}") for k in range(len(rules))))).alias("pii"))


def _is(kind: str):
    return lambda k: k == kind


def pii_digest(found: DataFrame) -> DataFrame:
    """find_pii's rows as counts of the base kinds and the joined spans."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    counts = [F.size(F.filter(F.col("pii.kind"), _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
