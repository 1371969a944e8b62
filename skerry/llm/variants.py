"""Spelling variants: words that differ by one character, found through full neighbourhoods.

For every word of the vocabulary all distinct deletions, replacements and
insertions over the observed alphabet are written out and joined with the
vocabulary by equality: what joins is one edit away, so no distance is computed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import cut, n_parts

#: Bytes of the vocabulary's words up to which it is sent to every task; a larger one meets the candidates in a shuffle.
BROADCAST_BYTES = 64 << 20
#: A word's form is at least so many times as frequent.
RATIO = 5


def words(docs: DataFrame, runs: str, id_col: str = "doc_id", text_col: str = "text", edit: int | None = None, least_chars: int = 1) -> DataFrame:
    """(word, n): the runs of characters that match ``runs``, A-Z lower-cased, and their occurrences in all texts.

    With ``edit``, a run whose hash (the unsigned crc32 of ``<id>:<run>``, an
    empty id for null) ``edit`` divides loses the code point at hash modulo
    length; what is shorter than ``least_chars`` code points afterwards isn't
    counted. Null and empty texts have no runs; repeated rows count each; very
    long texts are read whole; other columns aren't looked at, whatever their
    names; an empty table gives an empty one. A frequent word is summed where
    it is read, so it reaches the shuffle once a task.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.regexp_extract_all(docs[text_col].cast("string"), F.lit(runs), F.lit(0))
    got = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(found).alias("w")).filter(F.length("w") >= least_chars)
    got = got.withColumn("w", F.when(F.lower("w") == F.col("w"), F.col("w")).otherwise(F.translate("w", upper, upper.lower())))
    if edit is not None:
        got = got.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "w")))
        at = (F.col("h") % F.length("w")).cast("int")
        got = got.withColumn("w", F.when(F.col("h") % edit == 0, F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))).otherwise(F.col("w")))
    return got.filter(F.length("w") >= least_chars).groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def neighbours(vocabulary: DataFrame, letters: list[str]) -> DataFrame:
    """(word, candidate): every distinct text one deletion, replacement or insertion of one of ``letters`` from each word (distinct).

    A deletion within a run of one character and an insertion after its own
    copy would repeat others, so the first of the run alone is emitted.
    """
    at = vocabulary.select("word", F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("i"))
    part = lambda a, b: F.substring(F.col("word"), a, b)
    i, rest = F.col("i"), F.length("word")
    before = F.when(i > 1, part(i - 1, F.lit(1))).otherwise("")
    at = at.select("word", part(F.lit(1), i - 1).alias("head"), part(i, F.lit(1)).alias("here"), part(i + 1, rest).alias("tail"), before.alias("before"))
    inside = at.filter("here <> ''")
    deleted = inside.filter("here <> before").select("word", F.concat("head", "tail").alias("candidate"))
    each = F.explode(F.lit(letters).cast("array<string>")).alias("c")
    replaced = inside.select("word", "head", "here", "tail", each).filter("c <> here").select("word", F.concat("head", "c", "tail").alias("candidate"))
    inserted = at.select("word", "head", "here", "tail", "before", each).filter("c <> before").select("word", F.concat("head", "c", "here", "tail").alias("candidate"))
    return deleted.unionByName(replaced).unionByName(inserted)


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of the words with a form, by pointer doubling: a chain's counts grow by RATIO a step, so it has few."""
    steps = max(1, math.ceil(math.log(max(most, RATIO), RATIO)))
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return at


def variants(vocabulary: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of ``vocabulary`` (word, n): distinct words and counts.

    ``n_near`` counts the words one edit away; ``form`` is the most frequent of
    them (ties: the smallest in code-point order) if its n is RATIO times the
    word's or more, else null; ``root`` follows forms to the last and is the
    word itself without one. A null or empty word isn't a word and is left out;
    further columns are left out, whatever their names; very long words have
    proportionally many candidates; an empty table gives an empty one.
    """
    spark = vocabulary.sparkSession
    vocab = cut(vocabulary.select(vocabulary["word"], vocabulary["n"]).filter("word <> ''"))
    size = vocab.agg(F.coalesce(F.sum(F.octet_length("word") + 24), F.lit(0)).alias("bytes"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    letters = [r["c"] for r in vocab.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().orderBy("c").collect()]
    known = vocab.select(F.col("word").alias("candidate"), F.col("n").alias("near_n"))
    candidates = neighbours(vocab.select("word").repartition(n_parts(spark)), letters)
    near = candidates.join(F.broadcast(known) if size["bytes"] <= BROADCAST_BYTES else known, "candidate")
    per_word = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("candidate").alias("form"))).alias("best"))
    ok = -F.col("best.less") >= RATIO * F.col("n")
    got = cut(vocab.join(per_word, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("best.form")).alias("form"), F.when(ok, -F.col("best.less")).alias("form_n")
    ))
    roots = _roots(got.filter("form is not null"), size["most"])
    return got.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def frequent(counted: DataFrame, least: int) -> DataFrame:
    return counted.filter(F.col("n") >= least)
