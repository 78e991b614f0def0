"""Names, labels and table layouts of the document model."""

from __future__ import annotations

from pyspark.sql import types as T

# Entity types in their order, replacement modes, sources, conflict reasons, event kinds.
ENTITY_TYPES = ("PERSON", "ORGANIZATION", "ADDRESS", "DNI", "CUIT", "PHONE", "EMAIL", "IBAN", "CREDIT_CARD", "DATE", "LICENSE", "PLATE", "CUSTOM")
MODES = ("mask", "synthetic", "placeholder", "redact")
SOURCES = ("regex", "ner", "ocr", "manual")
CONFLICT_REASONS = ("overlap", "disagree", "low_confidence", "ambiguous_canonical")
FUZZY_TYPES = ("PERSON", "ORGANIZATION", "ADDRESS")

# Placeholder labels of three lengths per type, and those of persons of known gender.
LABELS = {
    "PERSON": ("PERSONA", "PERS", "PRS"),
    "ORGANIZATION": ("ORGANIZACION", "ORGA", "ORG"),
    "ADDRESS": ("DIRECCION", "DIRE", "DIR"),
    "DNI": ("DNI", "DNI", "DNI"),
    "CUIT": ("CUIT", "CUIT", "CUIT"),
    "PHONE": ("TELEFONO", "TELE", "TEL"),
    "EMAIL": ("EMAIL", "MAIL", "EML"),
    "IBAN": ("IBAN", "IBAN", "IBAN"),
    "CREDIT_CARD": ("TARJETA", "TARJ", "TRJ"),
    "DATE": ("FECHA", "FECH", "FEC"),
    "LICENSE": ("MATRICULA", "MATR", "MAT"),
    "PLATE": ("PATENTE", "PATE", "PAT"),
    "CUSTOM": ("CUSTOM", "CUST", "CST"),
}
GENDERED_LABELS = {"f": ("MUJER", "MUJER", "MUJ"), "m": ("HOMBRE", "HOMB", "HOM")}

# The mask of a type none of whose occurrences brings one.
MASKS = {
    "DNI": "XX.XXX.XXX",
    "CUIT": "XX-XXXXXXXX-X",
    "PHONE": "+XX XXX XXX-XXXX",
    "EMAIL": "xxxx@xxxx.xx",
    "IBAN": "XX00 XXXX XXXX XXXX XXXX",
    "CREDIT_CARD": "XXXX XXXX XXXX XXXX",
    "PERSON": "XXXXX XXXXX",
    "ORGANIZATION": "XXXXXXXX",
    "ADDRESS": "XXXXXX XXX",
    "DATE": "XX/XX/XXXX",
    "LICENSE": "XX-XXXX-XX",
    "PLATE": "XX XXX XX",
    "CUSTOM": "XXXXXXXX",
}

# Thresholds of the model.
NER_CONFIDENCE = 0.7
MIN_SUGGESTION = 0.5
SIMILARITY = 0.88
CONTEXT_CHARS = 40
OVERLAP = 0.5
FONT_HEIGHT_RATIO = 0.64
GLYPH_RATIO = 0.6
DEGRADED_RATIO = 0.5
CHECKPOINTS = 50

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "width", "height")] + [T.StructField("rotation", T.IntegerType())])
WORD = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_index", T.IntegerType()),
        T.StructField("word_index", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("bbox", BOX),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)
OCCURRENCE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("page_index", T.IntegerType()),
        T.StructField("value", T.StringType()),
        T.StructField("normalized_value", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("bbox", BOX),
        T.StructField("fragments", T.ArrayType(BOX)),
        T.StructField("mask_format", T.StringType()),
    ]
)
RULE = "rule_id string, doc_id long, scope string, target_group_id string, target_type string, mode string, priority int, enabled boolean"
