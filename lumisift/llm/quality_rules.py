"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every measure comes from one pass of built-in expressions over the whole text. Null and empty texts have no words:
all measures are zero, base_failed is true and kept is false. Repeated rows and further columns are independent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import WORD_GAP

#: Frequent function words of the corpus's languages.
STOP_WORDS = (
    "the be to of and that have with in for is was "
    "le la les de et un une des du en que pas "
    "el los las y del por con una "
    "der die das und den von mit ein eine nicht ist zu"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; an open side is None."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. A measure is a count, or the ratio of two.
RULES = (
    Rule("word length", "word_chars / n_words", 2.0, 16.0),
    Rule("symbols a word", "n_symbols / n_words", None, 0.25),
    Rule("shouts a word", "n_shouts / n_words", None, 0.25),
    Rule("stop words", "n_stop", 2.0, None),
    Rule("repeated lines", "n_dup_lines / n_lines", None, 0.5),
)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shift(name: str, value: Column, bits: Column) -> Column:
    return F.call_function(name, value, bits)


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + k) for k in range(3)]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more.

    Windows sort by a hash packed with their place; equal neighbours are compared as text, so hash collisions don't count.
    """
    n = F.size(words)
    bits = F.length(F.bin(n.cast("long"))).cast("int")

    def starts(packed: Column) -> Column:
        same = lambda v, j: F.coalesce(_shift("shiftright", v, bits) == _shift("shiftright", F.get(packed, j), bits), F.lit(False))
        mask = _shift("shiftleft", F.lit(1).cast("long"), bits) - 1
        found = F.transform(packed, lambda v, j: F.when(same(v, j - 1) | same(v, j + 1), v.bitwiseAND(mask).cast("int")))
        return F.transform(F.filter(found, lambda i: i.isNotNull()), lambda i: F.struct(F.concat_ws(" ", *_window(words, i)).alias("g"), i.alias("i")))

    def verified(found: Column) -> Column:
        same = lambda v, j: F.coalesce(v["g"] == F.get(found, j)["g"], F.lit(False))
        kept = F.transform(found, lambda v, j: F.when(same(v, j - 1) | same(v, j + 1), v["i"]))
        return F.array_sort(F.filter(kept, lambda i: i.isNotNull()))

    def covered(places: Column) -> Column:
        widths = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeats(hashes: Column) -> Column:
        packed = F.transform(hashes, lambda h, i: _shift("shiftleft", h, bits).bitwiseOR(i.cast("long")))
        found = let(F.array_sort(packed), lambda p: let(F.array_sort(starts(p)), lambda f: let(verified(f), covered)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)

    windows = F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0)))
    return let(F.transform(windows, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), repeats)


def measured(text: Column) -> Column:
    """A struct of counts of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(text, F.lit(r"!!")).cast("long").alias("n_shouts"),
            F.size(F.array_intersect(words, F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    return let(F.array_remove(F.split(text, WORD_GAP), ""), of)


def verdict(counts: dict[str, Column], rules=RULES) -> Column:
    """The table as one Boolean expression; a ratio whose divisor is zero passes no bound."""
    out = F.lit(True)
    for r in rules:
        top, _, bottom = r.measure.partition(" / ")
        value = counts[top].cast("double")
        if bottom:
            value = value / F.nullif(counts[bottom], F.lit(0).cast("long"))
        if r.low is not None:
            out = out & F.coalesce(value >= F.lit(float(r.low)), F.lit(False))
        if r.high is not None:
            out = out & F.coalesce(value <= F.lit(float(r.high)), F.lit(False))
    return out


def apply_rules(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """docs with a struct `__quality` of the counts, base_failed and kept."""
    m = docs.withColumn("__quality", measured(F.col(text)))
    fields = ["n_words", "word_chars", "n_symbols", "n_shouts", "n_stop", "n_repeat_words"]
    counts = {f: F.col(f"__quality.{f}") for f in fields} | {"n_lines": F.col("__quality.lines.n"), "n_dup_lines": F.col("__quality.lines.dup")}
    base = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
    return m.withColumn("__quality", F.struct(*[c.alias(k) for k, c in counts.items()], base.alias("base_failed"), (~base & verdict(counts, rules)).alias("kept")))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", *[f"__quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), l AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS r(i) WHERE len(w) >= 3
), dup AS (
  SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN dup USING (doc_id, g), unnest([0, 1, 2]) AS x(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(t, '!!')) AS BIGINT) AS n_shouts,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(list_distinct(list_filter(w, lambda x: x IN ({_STOPS})))) AS n_stop
  FROM d JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(word_chars / n_words BETWEEN 2.0 AND 16.0 AND n_symbols / n_words <= 0.25 AND n_shouts / n_words <= 0.25
    AND n_stop >= 2 AND n_dup_lines / n_lines <= 0.5, false) AS kept
FROM b
"""
