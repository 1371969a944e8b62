"""Licence scans with ordered signature rules, by DataFrame functions alone.

Texts without any of a few stems take no part in matching. On the rest, rules
whose keywords the text holds are matched; a detection is suppressed by one of
higher priority that contains it or lies in it, and by one of its own priority
that contains it (of equal intervals, the label first in order stays).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.license_rules import NARROW, RULES, STEMS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A character of a word in lower-cased text, and one that isn't.
IN, OUT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: A character of no word, in a text as it stands.
OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

CONFIDENCE = (0.0, 0.3, 0.6, 0.8, 0.9, 0.99)


def java_pattern(pattern: str) -> str:
    """Spells out ``~`` and the edges of words; a pattern's own classes stay."""
    out, in_class = [], False
    for i, c in enumerate(pattern):
        escaped = i > 0 and pattern[i - 1] == "\\"
        if c == "[" and not escaped:
            in_class = True
        elif c == "]" and not escaped:
            in_class = False
        if in_class or escaped:
            out.append(c)
        elif c == "~":
            out.append(f"{OUT}+")
        elif c == "^":
            out.append(f"(?<!{IN})")
        elif c == "$":
            out.append(f"(?!{IN})")
        else:
            out.append(c)
    return "".join(out)


def rules() -> list[tuple[str, int, str, str]]:
    got = [tuple(x.strip() for x in line.split(" | ")) for line in RULES.strip().splitlines()]
    return [(label, int(priority), keyword, java_pattern(pattern).replace(f"{OUT}+?", f"{OUT}*")) for label, priority, keyword, pattern in got]


def _phrase(phrase: str) -> str:
    return f"(?<!{IN})" + f"{OUT}+".join(phrase.split()) + f"(?!{IN})"


def _rules_column() -> Column:
    return F.array(
        *[F.struct(F.lit(a).alias("label"), F.lit(b).alias("priority"), F.array(*[F.lit(k) for k in c.split(" & ")]).alias("keywords"), F.lit(d).alias("pattern")) for a, b, c, d in rules()]
    )


def _matches(low: Column) -> Column:
    """All matches of the rules whose keywords the text holds, each with its interval.

    Intervals come from the lengths of the matches and of the parts between
    them. The rules stay a literal within the expression: as a column they
    would be copied into every row.
    """

    def places(rule: Column, ms: Column, ps: Column) -> Column:
        total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
        one = lambda i: F.struct(
            rule["label"].alias("label"), rule["priority"].alias("priority"), (total(F.slice(ps, 1, i)) + total(F.slice(ms, 1, i - 1))).alias("start"), F.length(F.element_at(ms, i)).cast("long").alias("size")
        )
        return F.transform(F.sequence(F.lit(1), F.size(ms)), one)

    def of(rule: Column) -> Column:
        """Null without a match; the text is cut only where there is one."""
        found = F.filter(F.array(F.regexp_extract_all(low, rule["pattern"], F.lit(0))), lambda ms: F.size(ms) > 0)
        got = F.transform(found, lambda ms: F.element_at(F.transform(F.array(F.split(low, rule["pattern"], -1)), lambda ps: places(rule, ms, ps)), 1))
        return F.try_element_at(got, F.lit(1))

    tried = F.filter(_rules_column(), lambda r: F.forall(r["keywords"], lambda k: F.contains(low, k)))
    return F.flatten(F.filter(F.transform(tried, of), lambda x: x.isNotNull()))


def n_words(text: Column) -> Column:
    """Words of any text: the parts between runs of other characters, less the empty ones at its edges."""
    edge = lambda c: F.when(c.rlike(OTHER), 1).otherwise(0)
    parts = F.size(F.split(text, f"{OTHER}+", -1))
    return F.when(text == "", 0).otherwise(parts - edge(F.substring(text, 1, 1)) - edge(F.right(text, F.lit(1)))).cast("long")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, base places and the detections that stay.

    ``detections array<struct<label,priority,start,end>>`` in code points of the
    text, ordered by start; ``n_base``, ``first_word``, ``last_word`` and
    ``base_labels array<string>`` are of the base phrases. Null text: empty (0
    words, nothing found). Repeated rows and null ids give rows like any other;
    other columns are left out; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    has_stem = lambda x: F.contains(F.lower("_text"), F.lit(x))
    gate = reduce(lambda a, b: a | b, [has_stem(x) & F.lower("_text").rlike(java_pattern(NARROW[x])) if x in NARROW else has_stem(x) for x in STEMS])
    base = "|".join(f"(?:{_phrase(p)})" for p in PHRASES)
    none = F.lit(None).cast("long")

    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    df = df.select("doc_id", n_words(F.col("_text")).alias("n_words"), F.when(gate, F.translate("_text", UPPER, LOWER)).alias("_low"))

    def of_row(low: Column) -> Column:
        """Everything about a text that passed the gate; bound once."""
        ms, ps = F.regexp_extract_all(low, F.lit(base), F.lit(0)), F.split(low, base, -1)
        return F.struct(ms.alias("ms"), ps.alias("ps"))

    df = df.withColumn("_base", F.when(F.col("_low").isNotNull(), of_row(F.col("_low"))))
    n_base = F.coalesce(F.size(F.col("_base.ms")), F.lit(0)).cast("long")
    last = F.element_at("_base.ms", -1)
    has = lambda p: F.exists("_base.ms", lambda m: m.rlike(f"^{_phrase(p)}$"))
    labels = F.array_compact(F.array(*[F.when(has(p), F.lit(v)) for p, v in PHRASES.items()]))
    df = df.select(
        "doc_id", "n_words", "_low", n_base.alias("n_base"),
        F.when(n_base > 0, n_words(F.element_at("_base.ps", 1))).otherwise(none).alias("first_word"),
        F.when(n_base > 0, F.col("n_words") - n_words(F.element_at("_base.ps", -1)) - n_words(last)).otherwise(none).alias("last_word"),
        F.when(n_base > 0, F.array_sort(F.array_distinct(labels))).otherwise(F.array().cast("array<string>")).alias("base_labels"),
    )
    df = df.withColumn("_found", F.when(F.col("_low").isNotNull(), _matches(F.col("_low"))))
    loses = """
        exists(_found, b -> b.start <= a.start AND b.start + b.size >= a.start + a.size AND (
            b.priority > a.priority OR b.priority = a.priority AND (b.size > a.size OR b.label < a.label))
          OR b.priority > a.priority AND b.start >= a.start AND b.start + b.size <= a.start + a.size)
    """
    kept = f"array_sort(transform(array_distinct(filter(_found, a -> NOT {loses})), a -> named_struct('start', a.start, 'end', a.start + a.size, 'label', a.label, 'priority', a.priority)))"
    return df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.coalesce(F.expr(kept), F.expr("array()").cast("array<struct<start:bigint,end:bigint,label:string,priority:int>>")).alias("detections"))
