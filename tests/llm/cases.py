"""Documents with every awkward shape: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))


def awkward(spark, extra=()):
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again until the evening comes and the moon is up.", "en", "a", 10), (2, "", "en", "a", 0), (3, None, "de", None, None), (4, "   \n\t ", None, "b", 5), (5, LONG, "en", "b", len(LONG)),
        (6, "éàü 🙂 naïve\ncafé\ncafé", "fr", "c", 3), (7, "one", "en", "c", 3), (8, "same text here", "en", "c", 3), (8, "same text here", "en", "c", 3), (None, "a row without an id", "en", "a", 1), (9, "same text here", "es", None, 3), (10, "12345 67890 !!!", "de", "a", 1),
        *extra,
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
