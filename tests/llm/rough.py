"""Documents that every operator must get through: nulls, ties, repeats, long texts."""

from __future__ import annotations

from quern.llm.common import documents

PROSE = "The river ran on past the mill and under the old stone bridge until nobody heard it. "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = ("size", "fp", "fingerprint", "component_id", "taken", "kept", "tid", "group", "_row", "text_key", "h")


def rough_rows() -> list[tuple]:
    long = " ".join(f"w{i % 7919}x{i % 104729}" for i in range(60_000))
    return [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, "a", 4),
        (4, "one", "en", None, 3),
        (5, "One", "en", None, 3),
        (6, PROSE * 6, "en", "b", 1),
        (7, PROSE * 6, "en", "b", 1),
        (7, PROSE * 6, "en", "b", 1),
        (8, "Ünïcödé 🙂 " * 90 + PROSE, "de", "c", 1),
        (None, PROSE + "A tail.", "en", "c", 1),
        (None, None, None, None, None),
        (9, long, "en", "b", 1),
        (10, "a" * 3000, "en", "c", 3000),
        (11, "x\x00y <|endoftext|> z " * 4, "en", "", 1),
    ]


def rough_documents(spark, clashes: bool = True):
    docs = spark.createDataFrame(rough_rows(), SCHEMA).repartition(3)
    for name in CLASHES if clashes else ():
        docs = docs.selectExpr("*", f"'other' AS {name}")
    return docs


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def small_documents(spark):
    return documents(spark, "/root/testdata/sf0.001")
