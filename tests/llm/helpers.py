"""Small tables with every odd case: nulls, empty and long texts, ties, repeats, clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} x" for i in range(20_000))
PASSAGE = "the quick brown fox jumps over a lazy dog while seven wizards quietly box with jinxed vampires under pale moonlight tonight"

ODD = [
    (1, "Plain text with Some words. Mail a.b@c.org or 10.0.0.1, licensed under the MIT License", "en", "s", 10),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, "   \n\t ", "en", "s", 6),
    (5, LONG, "en", "s", len(LONG)),
    (6, "Plain text with Some words. Mail a.b@c.org or 10.0.0.1, licensed under the MIT License", "en", "s", 10),
    (6, "Plain text with Some words. Mail a.b@c.org or 10.0.0.1, licensed under the MIT License", "en", "s", 10),
    (None, "no id here, though some words", "de", "t", 3),
    (7, "İstanbul ΣΊΣΥΦΟΣ naïve é 漢字 \U0001f600 <|endoftext|> it's 'tis", "fr", "u", 3),
    (8, f"Before. {PASSAGE.upper()}! After that more.", "en", "s", 3),
]


def docs(spark, rows=ODD, extra=True):
    """With columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(7) for c in ("id", "fp", "hits", "_part", "html", "spans", "ids", "score", "component_id", "text_hash", "block", "_low")}) if extra else df


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def multiset(xs):
    return sorted(xs, key=lambda t: tuple((x is not None, str(x)) for x in (t if isinstance(t, tuple) else (t,))))
