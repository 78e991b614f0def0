import hashlib
import random
import re

import pytest

from tacita.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def brute(text):
    spans = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))
    return [sum(s[3] == kind for s in spans) for kind in BASE], hashlib.sha256(joined.encode()).hexdigest()


def texts():
    rng = random.Random(1)
    bits = ["a.b@c.d", "@", "x@y.z_d@e.f.", "1.2.3.4", "999.1.1.1", "0001.2.3.04", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (017) 555-7713", "+12", "+44 20 7946 0958 +1", "é", "🙂", " ", "\n", "-", "12", "call", "79927398713", "..", "b@c", "+", "("]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(300)]
    return out + ["", "9" * 30000, "1 " * 20000, "a" * 30000, "a@" * 5000, "a@b.c " * 3000, "1." * 10000, "+1" + " " * 30000 + "2", "\x01 a@b.cd \x00 1.2.3.4"]


def test_base_equals_brute_force(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_ip int").repartition(4)
    got = {r.doc_id: ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in pii.pii_digest(pii.find_pii(docs)).collect()}
    want = {i: brute(t) for i, t, _ in rows}
    assert {i for i in want if got[i] != want[i]} == set()
    assert pii.find_pii(docs.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("IBAN: GB82 WEST 1234 5698 7654 32.", "iban:6:33"),
        ("IBAN: GB82 WEST 1234 5698 7654 33.", ""),
        ("DE89370400440532013000", "iban:0:22"),
        ("please call (212) 555-0187 now", "local_phone:12:26"),
        ("part 212-555-0187 of a list", ""),
        ("tel 212-555-0187", "local_phone:4:16"),
        ("tel +1 (017) 555-7713", "phone:4:21"),
        ("my SSN is 123-45-6789", "ssn:10:21"),
        ("ssn 666-45-6789", ""),
        ("code 123-45-6789", ""),
    ],
)
def test_added_kinds(spark, text, spans):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.pii_digest(pii.find_pii(docs)).first()
    assert ",".join(s for s in row.spans.split(",") if s.split(":")[0] != "card") == spans


def test_context_raises_the_score(spark):
    docs = spark.createDataFrame([(1, "visa 4111111111111111"), (2, "4111111111111111")], "doc_id long, text string")
    scores = {r.doc_id: r.pii[0].score for r in pii.find_pii(docs).collect()}
    assert scores[1] > scores[2]


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("SSN: 123-45-6789, 234-56-7890", "ssn:5:16,ssn:18:29"),
        ("123-45-6789, 234-56-7890 are their SSN", "ssn:0:11,ssn:13:24"),
        ("tel 212-555-0187, 212-555-0188, 212-555-0189", "local_phone:4:16,local_phone:18:30,local_phone:32:44"),
        ("SSN é🙂 666-45-6789, 234-56-7890", "ssn:20:31"),
        ("SSN: 123-45-6789" + "." * 41 + " 234-56-7890", "ssn:5:16"),
    ],
)
def test_context_reaches_over_other_matches(spark, text, spans):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.pii_digest(pii.find_pii(docs)).first().spans == spans


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("GB82WEST12345698765432 The account", "iban:0:22"),
        ("DE89370400440532013000 2024", "iban:0:22"),
        ("DE89 3704 0044 0532 0130 00 BIC COBADEFF", "iban:0:27"),
        ("GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00 AND MORE", "iban:0:27,iban:28:55"),
        ("REF AB12 GB82 WEST 1234 5698 7654 32 A", "iban:9:36"),
        ("GB82WEST12345698765432a", ""),
        ("GB82WEST12345698765433 The account", ""),
    ],
)
def test_iban_ends_where_its_checksum_says(spark, text, spans):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.pii_digest(pii.find_pii(docs)).first()
    assert ",".join(s for s in row.spans.split(",") if s.startswith("iban")) == spans
