"""Quality rules whose thresholds adapt to each language and source.

Every measure of a document is an integer (per mille of something). Its distribution within a language and source is kept
as a mergeable quantile sketch: a histogram whose bins keep the five leading bits of a value (relative error under 1/32,
a few hundred bins whatever the number of rows, merged by adding counts, the same however rows are dealt). From the
median and the lower quartile come upper limits (an excess of junk at the top doesn't move either). A group of few
documents takes the limits of its language's merged sketch, a language of few that of all. Documents beyond a limit go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, stored, words

#: Per measure: the least spread (in its own unit) taken for a quartile distance, so that near-constant groups don't reject on trifles.
LEAST_SPREAD = {"symbol_rate": 30, "dup_line_rate": 60, "repeat_rate": 30, "upper_rate": 30, "bang_rate": 20, "word_length": 400}
#: Spreads above the median at which a measure is beyond its group's limit.
REACH = 6
#: Documents below which a group takes its limits from a merged sketch.
LEAST_DOCS = 30
#: Rows of the table of limits, and of that of rejected documents, up to which it is broadcast (a row has 16 bytes).
MOST_GROUPS, MOST_REJECTED = 100_000, 500_000


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the base counts of every whole text, in one pass and without a shuffle. Null texts count as empty.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words (words inside a three-word window that is
    found at least twice in the text) and base_failed; besides, _lines, _upper and _bangs for the rates.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_w", words(F.col(text_col))).withColumn("_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_lines": F.size("_l").cast("long"),
            "_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
            "_bangs": F.regexp_count(text, F.lit("!")).cast("long"),
            "_h": F.transform("_w", lambda w: F.xxhash64(w)),
        }
    ).drop("_w", "_l")
    h = F.col("_h")
    df = df.withColumn("_s", F.when(F.size(h) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("k"), i.alias("i"))))))
    s = F.col("_s")
    twice = F.filter(s, lambda x, j: (x["k"].eqNullSafe(F.get(s, j - 1)["k"])) | (x["k"].eqNullSafe(F.get(s, j + 1)["k"])))
    df = df.drop("_h").withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_s")
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    # the id makes the column opaque to the optimiser: a filter on it, pushed down, would sort the windows anew for every element
    opaque = F.when(F.monotonically_increasing_id() >= 0, covered)
    df = df.withColumn("n_repeat_words", F.coalesce(opaque, F.lit(0)).cast("long")).drop("_at")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _rates() -> dict[str, Column]:
    per = lambda a, b: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {"symbol_rate": per("n_symbols", "n_words"), "dup_line_rate": per("n_dup_lines", "_lines"), "repeat_rate": per("n_repeat_words", "n_words"), "upper_rate": per("_upper", "word_chars"), "bang_rate": per("_bangs", "n_words"), "word_length": per("word_chars", "n_words")}


def _cleared(v: Column) -> Column:
    """The value with all but its five leading bits cleared."""
    low = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    unit = F.pow(F.lit(2.0), low).cast("long")
    return v - F.pmod(v, unit)


def limits(rows: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Upper limits per (language, source) as columns max_<measure>, from sketches of all rows given."""
    rates = _rates()
    long = rows.select(F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.explode(F.array(*[F.struct(F.lit(k).alias("m"), c.alias("v")) for k, c in rates.items()])).alias("x"))
    sketch = long.groupBy("_lang", "_source", F.col("x.m").alias("m"), _cleared(F.col("x.v")).alias("bin")).agg(F.count("*").alias("n"))
    sketch = stored(sketch, "sketches")

    def quantiles(keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "m", "bin").agg(F.sum("n").alias("n"))
        part = ", ".join([*keys, "m"])
        ranked = merged.withColumns({"upto": F.expr(f"sum(n) over (partition by {part} order by bin)"), "of": F.expr(f"sum(n) over (partition by {part})")})
        at = lambda num, den: F.min(F.when(den * F.col("upto") >= num * F.col("of"), F.col("bin")))
        return ranked.groupBy(*keys, "m").agg(F.max("of").alias("docs"), at(1, 4).alias("q1"), at(1, 2).alias("q2"))

    own = quantiles(["_lang", "_source"])
    lang = quantiles(["_lang"]).select(F.col("_lang").alias("_l2"), F.col("m").alias("m2"), F.col("docs").alias("d2"), F.col("q1").alias("q12"), F.col("q2").alias("q22"))
    every = quantiles([]).select(F.col("m").alias("m3"), F.col("q1").alias("q13"), F.col("q2").alias("q23"))
    all_ = own.join(lang, (F.col("_lang").eqNullSafe(F.col("_l2"))) & (F.col("m") == F.col("m2"))).join(F.broadcast(every), F.col("m") == F.col("m3"))
    pick = lambda a, b, c: F.when(F.col("docs") >= LEAST_DOCS, F.col(a)).when(F.col("d2") >= LEAST_DOCS, F.col(b)).otherwise(F.col(c))
    least = F.create_map(*[F.lit(x) for kv in LEAST_SPREAD.items() for x in kv])
    q1, q2 = pick("q1", "q12", "q13"), pick("q2", "q22", "q23")
    limit = q2 + REACH * F.greatest(q2 - q1, least[F.col("m")])
    return all_.groupBy("_lang", "_source").agg(*[F.max(F.when(F.col("m") == k, limit)).alias(f"max_{k}") for k in LEAST_SPREAD])


def judged(base: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Add `kept` to rows with base counts: false where the base failed or a measure is beyond its group's limit.

    Nulls in language or source form groups of their own; an empty table gives an empty table.
    """
    table = stored(limits(base.filter(~F.col("base_failed")), lang_col, source_col), "limits")
    near = base.join(hinted(table, MOST_GROUPS), base[lang_col].eqNullSafe(table["_lang"]) & base[source_col].eqNullSafe(table["_source"]), "left")
    fine = F.lit(True)
    for k, c in _rates().items():
        fine &= c <= F.col(f"max_{k}")
    return near.withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(False))).drop("_lang", "_source", *[f"max_{k}" for k in LEAST_SPREAD])


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def report(docs: DataFrame) -> DataFrame:
    """One row a document: id, base counts, base_failed and kept. Texts are read once; only counts are written and reread."""
    base = with_base(docs.select("doc_id", "text", "lang", "source")).drop("text")
    return judged(stored(base, "counts")).select("doc_id", *BASE, "kept")


def _name(docs: DataFrame, lang_col: str, source_col: str, id_col: str, text_col: str) -> list[Column]:
    """128 bits of all that a verdict depends on, and the id; nulls count as values of their own."""
    parts = [x for c in (id_col, lang_col, source_col, text_col) for x in (docs[c].isNull(), docs[c])]
    return [F.xxhash64(F.lit(k), *parts).alias(f"_name{k}") for k in (1, 2)]


def keep_good(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that the rules keep, with their own columns only, whatever their names.

    Texts are counted once; only counts are written. Rejected documents leave by an anti join on a 128-bit name of id, language, source and text, broadcast
    where few are rejected. Null and empty texts are rejected (no words); rows that repeat an id are judged each by its own text; an empty table stays empty.
    """
    slim = docs.select(*_name(docs, "lang", "source", id_col, text_col), docs["lang"].alias("lang"), docs["source"].alias("source"), docs[text_col].alias("text"))
    bad = judged(stored(with_base(slim).drop("text"), "counts")).filter(~F.col("kept")).select("_name1", "_name2").distinct()
    bad = stored(bad, "rejected")
    one, two = _name(docs, "lang", "source", id_col, text_col)
    return docs.join(hinted(bad, MOST_REJECTED), (one == bad["_name1"]) & (two == bad["_name2"]), "left_anti")
