"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _key string, _text string, size string, host string, score string"
EXTRA = ("k", "t", "s", "h", "c")


def odd_documents():
    long = "lorem ipsum dolor sit amet, " * 4000
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t", "en", "a", 3), (3, long, "en", "b", 1), (4, long, "en", "b", 1),
            (5, "café ñandú 你好 \U0001f600 word", "es", "a", 1), (5, "café ñandú 你好 \U0001f600 word", "es", "a", 1), (6, "12 34", "en", None, 5),
            (None, "no id at all", "en", "b", 1), (None, long, None, "b", 1), (-7, "one", "fr", "", 3), (8, "a b  c\r\n d", "en", "a", 1)]
    return [(*r, *EXTRA) for r in rows]


def odd_frame(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)
