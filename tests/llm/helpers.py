"""Small tables with everything awkward in them, and readings of results."""

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 97))
    return " ".join(out)


def awkward() -> list[tuple]:
    """Nulls in every column, empty and long texts, repeated rows and ids, copies, odd code points."""
    a, b = prose(1, 80), prose(2, 80)
    return [
        (5, a, "en", "s1", len(a)), (1, a, "en", "s1", len(a)), (1, a, "en", "s1", len(a)), (7, b, None, None, None), (None, b, "en", "s2", 3), (None, None, None, None, None),
        (9, "", "en", "s2", 0), (10, None, "de", "s2", None), (11, "x", "de", "s3", 1), (12, a[:200] + " " + b[:200], "en", "s3", 401), (1, "other text under one id", "en", "s1", 23),
        (14, prose(3, 6000), "en", "s1", 0), (15, "é" * 60 + "\U0001f600" * 30, "fr", "s2", 90), (16, "é" * 60 + "\U0001f600" * 31, "fr", "s2", 91), (17, " \t\n\r\x0b\f ", "en", "s1", 7), (-3, b + "\n" + a, "en", "s9", 9),
    ]


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


def crowded(df):
    """The same with more columns, under names that operators use themselves."""
    from pyspark.sql import functions as F

    for c in "_k _h _text _gone _size _d _s _z _n _m _t weight before copies source_size epoch score kept removed n_words n_hit items group fp key b".split():
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df
