"""Schemas and enumerations of the records that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T

LOCATOR = T.StructType(
    [
        T.StructField("part", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("table", T.IntegerType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("cell", T.IntegerType()),
        T.StructField("paragraph", T.IntegerType()),
    ]
)
SEGMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("seg_no", T.IntegerType(), False),
        T.StructField("segment_id", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("locator", LOCATOR),
    ]
)
FINDING = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("segment_id", T.StringType(), False),
        T.StructField("start", T.IntegerType(), False),
        T.StructField("end", T.IntegerType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("detector", T.StringType(), False),
        T.StructField("entity_key", T.StringType()),
        T.StructField("review_only", T.BooleanType(), False),
    ]
)
FINDING_COLUMNS = [f.name for f in FINDING.fields]
MASK = T.StructType([FINDING["doc_id"], FINDING["segment_id"], FINDING["start"], FINDING["end"]])
GOLD = T.StructType([*MASK.fields, FINDING["category"]])
INVENTORY = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "part", "action", "reason")])
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType())])
#: The annotated corpus, one JSON array of documents.
CORPUS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("segments", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())]))),
        T.StructField(
            "annotations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("segment_id", T.StringType()),
                        T.StructField("start", T.IntegerType()),
                        T.StructField("end", T.IntegerType()),
                        T.StructField("category", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

# The order in which a merged span takes its category, others after them by name.
CATEGORY_PRIORITY = ["person", "email", "phone", "address", "iban", "account_id", "customer_id", "depot_id"]
# Categories whose retained candidates are inspected first.
SENSITIVE_CATEGORIES = ["email", "phone", "iban", "account_id", "customer_id", "depot_id"]
CATEGORIES = [*CATEGORY_PRIORITY, "government_id", "date_of_birth", "username", "ip_address"]

# Model label to category.
MODEL_CATEGORY = {
    "person": "person",
    "full_name": "person",
    "first_name": "person",
    "middle_name": "person",
    "last_name": "person",
    "email": "email",
    "phone_number": "phone",
    "address": "address",
    "street_address": "address",
    "postal_code": "address",
    "iban": "iban",
    "bank_account": "account_id",
    "account_number": "account_id",
    "account_id": "account_id",
    "sensitive_account_id": "account_id",
    "government_id": "government_id",
    "national_id_number": "government_id",
    "passport_number": "government_id",
    "drivers_license_number": "government_id",
    "tax_id": "government_id",
    "tax_number": "government_id",
    "date_of_birth": "date_of_birth",
    "username": "username",
    "ip_address": "ip_address",
}
GROUP_ACTIONS = ("accept", "retain", "replace", "remove")
OCCURRENCE_ACTIONS = ("inherit", "retain", "replace", "remove")
PASSAGE_ACTIONS = ("keep", "replace", "remove")
OUTCOMES = ("uninspected", "clean", "miss")


class SpanloomError(ValueError):
    """An error whose message never carries source text."""
