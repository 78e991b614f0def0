import re
import time

import pytest
from pyspark.sql import functions as F

from tacita.operators import detect
from tacita.operators import patterns as p
from tacita.sources import views

PAGES = [
    (1, 0, "Contrato de servicios. Titular: Juan Pérez, DNI 34.567.891, CUIT 20-34567891-4."),
    (1, 1, "Contacto: juan.perez@example.com o al +54 11 1234-5678."),
    (1, 2, "Matrícula profesional MP-12345-6, patente ABC 123, vence 15/03/2030."),
    (2, 0, "Autos: López, María Fernanda c/ Empresa y el 7 de julio de 2026 en Av. Corrientes 1234, IBAN ES91 2100 0418 4502 0005 1332"),
    (2, 1, "domicilio real en San Martín 450 tarjeta 4111 1111 1111 1111 y AB 123 CD y Matrícula Profesional: 4567 tel 011 4567-8902"),
    (3, 0, "CUIT 20-12345678-9 IBAN ES00 1234 5678 9012 3456 7890 tarjeta 4532 1234 5678 9901 código A34.567.891 A 123 BCD"),
    (3, 1, ""),
    (5, 0, "juan. perezQmail.com x"),
    (6, 0, "juan. perezQmail.com x"),
]
WANT = [
    (1, 0, 48, 58, "dni-ar", "34.567.891", "34567891"),
    (1, 0, 65, 78, "cuit-ar", "20-34567891-4", "20345678914"),
    (1, 1, 10, 32, "email", "juan.perez@example.com", "juan.perez@example.com"),
    (1, 1, 38, 54, "phone-mobile-ar", "+54 11 1234-5678", "541112345678"),
    (1, 2, 22, 32, "license-ar", "MP-12345-6", "MP123456"),
    (1, 2, 42, 49, "plate-vieja-ar", "ABC 123", "ABC123"),
    (1, 2, 57, 67, "date-ar", "15/03/2030", "15/03/2030"),
    (2, 0, 7, 28, "caratula-ar", "López, María Fernanda", "maria fernanda lopez"),
    (2, 0, 45, 63, "date-textual-ar", "7 de julio de 2026", "07/07/2026"),
    (2, 0, 67, 86, "address-keyword-ar", "Av. Corrientes 1234", "av. corrientes 1234"),
    (2, 0, 93, 122, "iban", "ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332"),
    (2, 1, 18, 32, "address-keyword-ar", "San Martín 450", "san martin 450"),
    (2, 1, 41, 60, "credit-card", "4111 1111 1111 1111", "4111111111111111"),
    (2, 1, 63, 72, "plate-mercosur-ar", "AB 123 CD", "AB123CD"),
    (2, 1, 98, 102, "license-ar", "4567", "4567"),
    (2, 1, 107, 120, "phone-landline-ar", "011 4567-8902", "01145678902"),
    (5, 0, 0, 20, "email", "juan. perezQmail.com", "juan.perez@mail.com"),
]


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame(PAGES, "doc_id long, page_index int, text string")


@pytest.fixture(scope="module")
def found(page):
    rows = detect.detect(page, p.default_patterns(("maria", "juan")), F.col("doc_id") % 5 == 0)
    return rows.collect()


def test_every_pattern(found):
    got = sorted(((r.doc_id, r.page_index, r.start, r.end, r.pattern_id, r.value, r.normalized_value) for r in found if r.doc_id != 3), key=lambda r: r[:3])
    assert got == WANT


def test_checks_and_the_run_guard(found):
    got = {r.value for r in found if r.doc_id == 3}
    assert "20-12345678-9" not in got and "34.567.891" not in got and "4532 1234 5678 9901" not in got
    assert not any(v.startswith("ES00") for v in got)
    assert "A 123 BCD" in got


def test_first_row_in_full(found):
    r = next(r for r in found if (r.doc_id, r.page_index, r.start) == (1, 0, 48))
    assert tuple(r.bbox)[:4] == (326.0, 100.0, 66.0, 12.0) and tuple(r.word_span) == (7, 8) and r.mask_format == "XX.XXX.XXX"
    assert r.context.before == "de servicios. Titular: Juan Pérez, DNI "


def test_search(page):
    words = views.words(page)
    hits = lambda q, prefix: {(r.doc_id, r.page_index, r.start_index, r.end_index_exclusive) for r in detect.find_text(words, q, prefix).collect()}
    assert hits("juan per", True) >= {(1, 0, 4, 6), (1, 1, 1, 2)}
    assert hits("JUAN PEREZ", False) >= {(1, 0, 4, 6)} and (1, 0, 4, 6) not in hits("juan per", False)
    assert hits("  ", True) == set()


def test_custom_patterns(spark):
    base = p.default_patterns()
    more = p.with_custom(base, p.CUSTOM_PATTERNS)
    assert [x.id for x in more[: len(base)]] == [x.id for x in base] and len(more) == len(base) + 3
    mine = p.Pattern("email", "EMAIL", "zz", "x")
    assert [x.regex for x in p.with_custom(base, (mine,)) if x.id == "email"] == ["zz"]
    assert all(x.id != "email" for x in p.without_pattern(base, "email"))
    for bad in ("(", "(a+)+"):
        with pytest.raises(ValueError):
            p.with_custom(base, (p.Pattern("x", "CUSTOM", bad, "x"),))


HARD = {
    "letters": "a" * 200_000 + "-12345678",
    "digits": "1" * 200_000,
    "dotted": "a." * 100_000 + "@ x",
    "single": "1.a-" * 50_000 + "12345678",
    "blanks": "7" + " " * 200_000 + "de julio",
    "licence": "MP" + " -" * 100_000 + "x",
    "late": "b" * 200_000 + "@example.com",
    "q": "q" * 200_000 + "Q1",
    "capitals": "Av. " + "A" * 200_000 + " 1",
}


def test_long_runs(spark):
    """No pattern and no guard needs recursion or more time than in proportion to a run."""
    pages = spark.createDataFrame([(5 * k, 0, t) for k, t in enumerate(HARD.values())], "doc_id long, page_index int, text string")
    patterns = p.with_custom(p.default_patterns(("maria",)), p.CUSTOM_PATTERNS)
    began = time.time()
    got = {(list(HARD)[r.doc_id // 5], r.pattern_id) for r in detect.detect(pages, patterns, F.col("doc_id") % 5 == 0).collect()}
    assert ("late", "email") in got and ("letters", "dni-ar") not in got
    assert time.time() - began < 90


def test_emails_start_where_a_scan_would(spark):
    texts = ["..a@b.co", "a@b.com.c@d.org", "x@y a-b@c.de", "%@a.bc", "a@b@c.dd", "ñandu@x.org", "a.b.c@d.ef."]
    rows = detect.detect(spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, page_index int, text string"), tuple(x for x in p.default_patterns() if x.id == "email")).collect()
    plain = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", re.ASCII)
    assert sorted((r.doc_id, r.start, r.value) for r in rows) == [(k, m.start(), m.group()) for k, t in enumerate(texts) for m in plain.finditer(t)]
