"""The pattern table: what detectors look for, how they normalise and what they check."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checksums as c
from ..functions import text as t
from ..functions.text import EDGE, WS


def _true(value: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Pattern:
    """normalize and check are expressions over the matched value and its normal form. Every match holds the literal hint
    and something of the cheap expression gate; both are tried first, as most pages hold neither."""

    id: str
    entity_type: str
    regex: str
    mask_format: str
    normalize: Callable[[Column], Column] = field(default=lambda v: v)
    check: Callable[[Column], Column] = _true
    hint: str = ""
    gate: str = ""
    #: Whether the pattern can match at all, and a quick expression that every page with a match holds; the gate if none.
    active: bool = True
    needs: str = ""


def any_case(word: str) -> str:
    """a word in any case, letter by letter, so that \\p{Lu} elsewhere keeps its meaning."""
    return "".join(f"[{ch}{ch.upper()}]" if ch.upper() != ch else re.escape(ch) for ch in word)


def _one_of(*words: str) -> str:
    return "|".join(any_case(w) for w in words)


# The words that addresses and captions are recognised by.
STREET_WORDS = ("calle", "avenida", "pasaje", "boulevard", "diagonal")
STREET_SHORT = ("avda", "av", "pje", "bv")
DOMICILE_KINDS = ("real", "legal", "procesal", "especial", "constituido")
CAPTION_WORDS = "[Cc]aratulad[oa]s?|[Aa]utos|[Cc]ausa|[Ee]xpediente|[Ff]irmad[oa]|[Ff]irma|[Pp]erito|[Ss]uscriben?"

# The expressions from here on, those of the table below included. They are the pattern language that has to
# be matched; only what keeps them from reading a run twice is added.
_START = r"(?<![\p{L}\p{N}])"
_VIA = rf"(?:{_one_of(*STREET_WORDS)}|(?:{_one_of(*STREET_SHORT)})\.?)"
_HOME = rf"{_START}(?:{any_case('domicilio')}(?:{WS}{{1,2}}(?:{_one_of(*DOMICILE_KINDS)}))?|{any_case('domiciliad')}[OoAa]|{any_case('sit')}[OoAa]){WS}{{1,2}}{any_case('en')}{WS}{{1,2}}"
_NAME = r"(?:\p{Lu}[\p{L}'’]*\.?|\d{1,4}[°º]?|d[Ee][Ll]?|l[Aa][Ss]?|l[Oo][Ss]|y|e)"
_NUMBER_WORD = rf"(?:{any_case('n')}[°º]|{any_case('no')}\.|{any_case('nro')}\.?|{any_case('n')}[úuÚU]{any_case('mero')}|{any_case('al')})"
_HEIGHT = rf"{WS}{{1,2}}(?:{_NUMBER_WORD}{WS}{{0,2}})?\d{{1,5}}(?!\d|/|[.,\-‐‑–—]\d)"
ADDRESS = rf"{_START}{_VIA}(?:{WS}{{1,2}}{_NAME}){{1,6}}?{_HEIGHT}|(?<={_HOME}){_NAME}(?:{WS}{{1,2}}{_NAME}){{0,5}}?{_HEIGHT}"
CAPTION = rf"{EDGE}\p{{Lu}}\p{{L}}+,(?:{WS}+\p{{Lu}}\p{{L}}+){{1,3}}{EDGE}(?={WS}+(?:[cs]/|[CS8$]/))|(?<=(?:{CAPTION_WORDS}){WS}{{0,3}}[:,]?{WS}{{0,3}}(?:a{WS}{{1,3}})?){EDGE}\p{{Lu}}\p{{Ll}}+,{WS}+\p{{Lu}}\p{{Ll}}+{EDGE}"
_SEP = rf"(?:{WS}|-)?"
_BLANKS = rf"{WS[:-1]}-]*+"
#: A run of an address's characters is read from its first word character on, or from the end of the last match, and
#: from no other place, so that the scan takes time in proportion to the text.
LOCAL_START = r"(?:(?<![A-Za-z0-9_][.%+-]{0,32})|\G)"
#: What an address pattern's match begins with or stands after.
ADDRESS_GATE = rf"(?<![\p{{L}}\p{{N}}])(?i:{'|'.join(STREET_WORDS)}|(?:{'|'.join(STREET_SHORT)})(?:\.|{WS})|domicili|sit[oa]{WS})"


def in_names(names: tuple[str, ...]) -> Callable[[Column], Column]:
    """the first word is among the lexicon's names."""
    return lambda v: F.element_at(F.split(v, " "), 1).isin(*names) if names else F.lit(False)


def default_patterns(names: tuple[str, ...] = ()) -> tuple[Pattern, ...]:
    """The fourteen patterns and the address keyword, in their order. names are the lexicon's single names."""
    return (
        Pattern("dni-ar", "DNI", rf"{EDGE}\d{{1,2}}\.?\d{{3}}\.?\d{{3}}{EDGE}", "XX.XXX.XXX", lambda v: t.without(v, "."), gate=r"[0-9]{3}", needs="[0-9]"),
        Pattern("cuit-ar", "CUIT", rf"{EDGE}\d{{2}}-?\d{{8}}-?\d{EDGE}", "XX-XXXXXXXX-X", lambda v: t.without(v, "-"), c.cuit_ok, gate=r"[0-9]{8}", needs="[0-9]"),
        Pattern("phone-mobile-ar", "PHONE", rf"(?:\+?54{_SEP})?(?:9{_SEP})?{EDGE}(?:\d{{2}}{_SEP}\d{{4}}{_SEP}\d{{4}}|\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{4}}|\d{{4}}{_SEP}\d{{2}}{_SEP}\d{{4}}){EDGE}", "+XX XXX XXX-XXXX", t.digits_only, gate=r"[0-9]{4}", needs="[0-9]"),
        Pattern("phone-landline-ar", "PHONE", rf"{EDGE}0\d{{1,4}}{_SEP}\d{{3,4}}{_SEP}\d{{4}}{EDGE}", "+XX XXX XXX-XXXX", t.digits_only, gate=r"0[0-9]", needs="[0-9]"),
        Pattern("email", "EMAIL", rf"{LOCAL_START}{EDGE}[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{EDGE}", "xxxx@xxxx.xx", F.lower, hint="@"),
        Pattern("iban", "IBAN", rf"{EDGE}[A-Z]{{2}}\d{{2}}(?:{WS}?[A-Z0-9]){{10,30}}{EDGE}", "XX00 XXXX XXXX XXXX XXXX", t.upper_packed, c.iban_ok, gate=r"[A-Z]{2}[0-9]{2}", needs="[0-9]"),
        Pattern("credit-card", "CREDIT_CARD", rf"{EDGE}(?:\d[ -]*?){{13,19}}{EDGE}", "XXXX XXXX XXXX XXXX", t.digits_only, c.luhn_ok, gate=r"[0-9][ -]*[0-9][ -]*[0-9]", needs="[0-9]"),
        Pattern("date-ar", "DATE", rf"{EDGE}\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}{EDGE}", "XX/XX/XXXX", t.numeric_date, c.date_in_range, gate=r"[0-9][/-][0-9]", needs="[0-9]"),
        Pattern("date-textual-ar", "DATE", rf"{EDGE}{t.TEXT_DATE}{EDGE}", "XX/XX/XXXX", t.textual_date, c.date_in_range, hint=" ", gate=r"[0-9]{4}", needs="[0-9]"),
        Pattern("license-ar", "LICENSE", rf"(?<=[Mm]atr[íi]cula{WS}{{1,4}}[Pp]rofesional{WS}{{0,4}}:?{WS}{{0,4}})\d{{3,8}}{EDGE}|{EDGE}M\.?[NP]\.?{_BLANKS}\d{{1,3}}(?:\.\d{{3}})+{EDGE}|{EDGE}M\.?[NP]\.?{_BLANKS}\d{{3,8}}(?:-\d)?{EDGE}", "XX-XXXX-XX", lambda v: t.without(F.upper(v), "-"), gate=r"M\.?[NP]|rofesional", needs="[0-9]"),
        Pattern("plate-vieja-ar", "PLATE", rf"{EDGE}[A-Z]{{3}}{_SEP}\d{{3}}{EDGE}", "XXX XXX", t.upper_packed, gate=r"[0-9]{3}", needs="[0-9]"),
        Pattern("plate-mercosur-ar", "PLATE", rf"{EDGE}[A-Z]{{2}}{_SEP}\d{{3}}{_SEP}[A-Z]{{2}}{EDGE}", "XX XXX XX", t.upper_packed, gate=r"[0-9]{3}", needs="[0-9]"),
        Pattern("plate-mercosur-moto-ar", "PLATE", rf"{EDGE}[A-Z]{_SEP}\d{{3}}{_SEP}[A-Z]{{3}}{EDGE}", "X XXX XXX", t.upper_packed, gate=r"[0-9]{3}", needs="[0-9]"),
        Pattern("caratula-ar", "PERSON", CAPTION, "XXXXX XXXXX", t.caption_flip, in_names(names), hint=",", gate=r"[csCS8$]/|aratulad|utos|ausa|xpediente|irm|erito|uscribe", active=bool(names)),
        Pattern("address-keyword-ar", "ADDRESS", ADDRESS, "XXXXXX XXX", t.entity_key, gate=ADDRESS_GATE, needs="[0-9]"),
    )


#: Patterns that a user adds: addresses of hosts, North American numbers and access tokens.
CUSTOM_PATTERNS = (
    Pattern("ipv4", "CUSTOM", rf"{EDGE}\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}{EDGE}", "XXX.XXX.XXX.XXX", hint=".", gate=r"[0-9]\.[0-9]", needs="[0-9]"),
    Pattern("phone-us", "PHONE", r"\+1 \(\d{3}\) \d{3}-\d{4}", "+X (XXX) XXX-XXXX", t.digits_only, hint="+1 (", needs="[0-9]"),
    Pattern("token", "CUSTOM", rf"{EDGE}[0-9a-f]{{40}}{EDGE}", "XXXXXXXX", gate=r"[0-9a-f]{40}"),
)


def with_custom(patterns: tuple[Pattern, ...], custom: tuple[Pattern, ...]) -> tuple[Pattern, ...]:
    """A custom pattern replaces the one with its id, else it comes last; each must compile."""
    for p in custom:
        if not compiles(p.regex):
            raise ValueError(f"pattern {p.id} does not compile")
    replaced = {p.id: p for p in custom}
    kept = tuple(replaced.pop(p.id, p) for p in patterns)
    return kept + tuple(p for p in custom if p.id in replaced)


def without_pattern(patterns: tuple[Pattern, ...], pattern_id: str) -> tuple[Pattern, ...]:
    return tuple(p for p in patterns if p.id != pattern_id)


def compiles(regex: str) -> bool:
    """Tried in the JVM that will run it, on the driver; an expression that repeats a repetition is refused, as its
    cost has no bound."""
    from pyspark import SparkContext

    if re.search(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)[+*]", regex):
        return False
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(regex)
    except Exception:  # noqa: BLE001 - whatever the JVM says, the pattern isn't usable
        return False
    return True
