import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tacita.functions import geometry as g
from tacita.functions.synth import Draws, synthesize
from tacita.operators import layout, ner
from tacita.operators.layout import W
from tacita.sources import views


def test_lines_columns_and_turned_runs():
    words = [W(0, 300, 10, 20, 10), W(1, 10, 11, 20, 10), W(2, 32, 10, 20, 10), W(3, 10, 30, 20, 10), W(4, 322, 10, 20, 10)]
    assert layout.order_of(words, False) == [1, 2, 0, 4, 3]
    turned = [W(0, 5, 100, 10, 20, 90), W(1, 5, 70, 10, 20, 90), W(2, 50, 10, 20, 10)]
    assert layout.order_of(turned, False) == [2, 0, 1]
    sheet = [W(0, 5, 70, 10, 20, 90), W(1, 5, 100, 10, 20, 90)]
    assert layout.order_of(sheet, True) == [1, 0]


def test_upper_median_and_empty_rectangle():
    assert layout.middle([1, 2, 3, 4]) == 3 and layout.middle([]) == 0.0
    taken = {r * layout.GRID + c for r in range(0, 4) for c in range(0, 4)} - {0, 1, 64, 65, 128, 129}
    assert layout.largest_empty(taken, (0, 3), (0, 3)) == (0, 0, 3, 2)
    assert layout.largest_empty({0}, (0, 0), (0, 0)) is None


def test_spans_from_tokens(spark):
    text = "Ana Perez de Acme/S vive"
    tokens = [("B-PER", 0.9, "Ana"), ("I-PER", 0.7, "Per"), ("B-PER", 0.8, "##ez"), ("O", 0.9, "de"), ("B-ORG", 0.6, "Ac"), ("I-LOC", 0.6, "##me"), ("O", 0.9, "/")]
    rows = spark.createDataFrame([(1, 0, 0, k, e, s, w) for k, (e, s, w) in enumerate(tokens)], "doc_id long, page_index int, chunk int, token_index int, entity string, score double, word string")
    texts = spark.createDataFrame([(1, 0, 0, text)], "doc_id long, page_index int, chunk int, text string")
    spans = ner.label_spans(ner.positioned(rows, texts))
    got = sorted((r.start, r.end, r.entity_type, round(r.confidence, 6)) for r in spans.collect())
    assert got == [(0, 9, "PERSON", 0.8), (13, 17, "ORGANIZATION", 0.6)]
    fixed = ner.repaired(spark.createDataFrame([(1, 0, 0, 0, 2, "PERSON", 0.5), (1, 0, 0, 2, 3, "PERSON", 0.9), (1, 0, 0, 14, 19, "ORGANIZATION", 0.7)], "doc_id long, page_index int, chunk int, start int, end int, entity_type string, confidence double"), texts)
    assert sorted((r.start, r.end, r.value, r.confidence) for r in fixed.collect()) == [(0, 3, "Ana", 0.5), (13, 19, "Acme/S", 0.7)]


def test_addresses_take_their_number(spark):
    rows = [("calle Mitre 450 y", 0, 11), ("calle Mitre 450/2", 0, 11), ("calle Mitre nro. 45, x", 0, 11), ("calle Mitre 12,5", 0, 11), ("calle 9 450", 0, 7)]
    df = spark.createDataFrame([(t, s, e, "ADDRESS") for t, s, e in rows], "text string, start int, end int, entity_type string")
    assert [r.value for r in ner.extended_addresses(df).collect()] == ["calle Mitre 450", "calle Mitre", "calle Mitre nro. 45", "calle Mitre", "calle 9"]
    assert ner.token_windows([300, 200, 100, 600, 1], 508) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_geometry(spark):
    df = spark.range(1).select(g.box(0, 0, 10, 10).alias("a"), g.box(5, 0, 10, 10).alias("b"), g.box(2, 2, 3, 3).alias("c"))
    r = df.select(g.intersection_ratio(F.col("a"), F.col("b")), g.contains(F.col("a"), F.col("c")), g.overlaps(F.col("a"), F.col("b")), g.transformed(F.array(*map(F.lit, (0.0, 1.0, -1.0, 0.0, 5.0, 6.0))), F.col("c")), g.max_fragment_ratio(F.array("a", "c"), F.array("b"))).first()
    assert r[0] == 0.5 and r[1] and r[2] and tuple(r[3])[:4] == (0.0, 8.0, 3.0, 3.0) and r[4] == 0.5


def test_false_values_repeat():
    for kind in ("DNI", "CUIT", "PHONE", "EMAIL", "IBAN", "CREDIT_CARD", "DATE", "PERSON", "ORGANIZATION", "ADDRESS", "LICENSE", "PLATE"):
        assert synthesize("s", kind, "g", 1) == synthesize("s", kind, "g", 1) != ""
    digits = [int(c) for c in synthesize("s", "CUIT", "g1", 1) if c.isdigit()]
    assert (sum(d * w for d, w in zip(digits, (5, 4, 3, 2, 7, 6, 5, 4, 3, 2, 1), strict=True))) % 11 == 0
    for k in range(200):
        card = synthesize("s", "CREDIT_CARD", f"g{k}", 1).replace(" ", "")
        assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(card[::-1])) % 10 == 0
        iban = synthesize("s", "IBAN", f"g{k}", 1).replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert synthesize("s", "CUSTOM", "g", 7) == "custom-7"
    assert 0 <= Draws("x").unit() < 1 and Draws("").state == 0x811C9DC5


def test_orders_of_many_pages_are_those_of_each():
    rng = random.Random(5)
    pages = []
    for k in range(120):
        turns = [0] if k % 3 else [0, 90, 180, 270]
        flat = k % 2 == 0
        pages.append([(rng.uniform(0, 300), 100.0 if flat else rng.uniform(0, 60), rng.uniform(1, 90), 12.0 if flat else rng.uniform(5, 15), rng.choice(turns)) for _ in range(rng.randrange(1, 12))])
    flat = [box for p in pages for box in p]
    x, y, w, h, turn = (np.array(c) for c in zip(*flat, strict=True))
    scanned = np.array([k % 5 == 0 for k in range(len(pages))])
    got = layout.page_orders(np.array([len(p) for p in pages]), x, y, w, h, turn, scanned)
    assert got.tolist() == [i for p, s in zip(pages, scanned, strict=True) for i in layout.order_of([layout.W(i, *box) for i, box in enumerate(p)], bool(s))]


def test_reading_order_moves_no_word_and_joins_none(spark):
    texts = ["b  aé 𝒳 c", "", " ", "one", "x" * 50 + " y " * 30]
    docs = spark.createDataFrame([(k, "\n".join(texts[k % 5 :])) for k in range(10)] + [(99, None)], "doc_id long, text string")
    page = views.pages(docs)
    by_words = layout.reading_order(views.words(page))
    assert by_words.columns == [*views.words(page).columns, "reading_index"]
    expected = {}
    for r in by_words.orderBy("doc_id", "page_index", "reading_index").collect():
        expected.setdefault((r.doc_id, r.page_index), []).append(r.word_index)
    by_text = layout.text_reading_order(page)
    assert {(r.doc_id, r.page_index): list(r.reading) for r in by_text.collect()} == expected
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(by_text)
    assert "Join" not in plan(by_words)


def test_boxes_of_texts_are_those_of_words(spark):
    docs = spark.createDataFrame([(1, "b  aé 𝒳 c \n\nlast ")], "doc_id long, text string")
    rows = views.words(views.pages(docs)).orderBy("page_index", "word_index").collect()
    sizes, x, width = views.text_boxes(pa.array(["b  aé 𝒳 c ", "", "last "]))
    assert sizes.sum() == len(rows)
    assert [(r.bbox.x, r.bbox.width) for r in rows] == list(zip(x.tolist(), width.tolist(), strict=True))
