"""Line dedup by a log-template tree: lines that recur across documents, up to variable fields, are dropped.

A line's leaf in the tree is its token count and its leading tokens, tokens with a digit counting as a variable. Within a
leaf, a token at a place is constant if it recurs there in enough distinct surroundings; every other place is a variable
field. The constants make the template. A template recurs if lines of it stand in enough distinct surroundings (the
leaves before and after them in their document), in at least a share of the distinct texts that hold it, and if at least
half of its places are constant. The surroundings tell boilerplate from copies of whole documents: copies repeat their
lines among the same neighbours, and are left to document dedup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, hinted, stored, words

#: Leading tokens that pick a leaf.
DEPTH = 3
#: Tokens below which a line is never boilerplate.
LEAST_TOKENS = 4
#: Distinct surroundings from which a leaf, a token at its place, or a template recurs.
LEAST_SURROUNDINGS = 5
#: Distinct surroundings for each ten distinct texts, at least.
TENTHS = 3
#: Rows up to which leaves or templates are broadcast.
MOST_BROADCAST = 50_000
#: Constant tokens of all leaves together up to which their table is broadcast (some 50 bytes each).
MOST_CONSTANTS = 200_000
FIELD = "<*>"


_S, _W = SPACE[:-1], WORD[:-1]
#: The leading tokens of a line, with what is between them.
_LEAD = f"^{_S}*+({_W}++(?:{_S}++{_W}++){{0,{DEPTH - 1}}}+)"


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _leaf(line: Column, count: Column) -> Column:
    """A hash of the token count and the leading tokens."""
    lead = F.split(F.regexp_extract(line, _LEAD, 1), SPACE)
    return F.xxhash64(count, F.array_join(F.transform(lead, _masked), " "))


def _key(text: Column) -> Column:
    """128 bits that name a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _lines(docs: DataFrame, text_col: str, with_line: bool) -> DataFrame:
    """One row for each line of LEAST_TOKENS or more: text hash, place in the text, leaf and surroundings (as hashes), and the line if asked for.

    Surroundings are the leaves of the lines with a word before and after.
    """
    text = F.col(text_col)
    split = docs.filter(text.isNotNull()).select(_key(text).alias("text_key"), F.split(text, "\n").alias("_l"))
    counted = split.select("text_key", F.filter(F.transform("_l", lambda x, i: F.struct(x.alias("line"), i.alias("at"), F.regexp_count(x, F.lit(WORD)).alias("n"))), lambda x: x["n"] > 0).alias("_l"))
    leafed = counted.withColumn("_k", F.transform("_l", lambda x: _leaf(x["line"], x["n"])))
    k = F.col("_k")
    around = lambda i: F.xxhash64(F.get(k, i - 1), F.get(k, i + 1))
    parts = lambda x, i: [x["at"].alias("at"), x["n"].alias("n"), F.get(k, i).alias("leaf"), around(i).alias("around")] + ([x["line"].alias("line")] if with_line else [])
    each = F.filter(F.transform("_l", lambda x, i: F.struct(*parts(x, i))), lambda x: x["n"] >= LEAST_TOKENS)
    return leafed.select("text_key", F.explode(each).alias("x")).select("text_key", "x.*").drop("n")


def _recurs() -> list[Column]:
    return [F.count_distinct("around").alias("surroundings"), F.count_distinct("text_key").alias("texts")]


_ENOUGH = f"surroundings >= {LEAST_SURROUNDINGS} and 10 * surroundings >= {TENTHS} * texts"


def recurring_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The places of the lines to drop: (text_key, dropped array<int>), one row for each distinct text that has any.

    Texts are parsed twice: for the leaves (hashes only are shuffled), and for the lines of recurring leaves, whose tokens
    are counted by place. Counts are pre-aggregated, so no line, however common, gathers in one task.
    """
    leaves = _lines(docs, text_col, False).groupBy("leaf").agg(*_recurs()).filter(_ENOUGH).select("leaf")
    leaves = stored(leaves, "leaves")
    near = _lines(docs, text_col, True).join(hinted(leaves, MOST_BROADCAST), "leaf").distinct()
    near = near.withColumn("tokens", F.transform(words(F.col("line")), _masked)).drop("line")
    near = stored(near, "lines")
    # tokens that recur at their place of a leaf; lines of equal leaf and surroundings count once
    spread = near.groupBy("leaf", "around", "tokens").count().select("leaf", "around", F.posexplode("tokens").alias("place", "token"))
    constant = spread.groupBy("leaf", "place", "token").agg(F.count_distinct("around").alias("n")).filter(F.col("n") >= LEAST_SURROUNDINGS)
    constant = constant.filter(F.col("token") != FIELD).select("leaf", F.struct("place", "token").alias("c")).groupBy("leaf").agg(F.collect_list("c").alias("constants"))
    # written first, so that a leaf with many lines meets a plain table: broadcast if small, else a join whose skew Spark can split
    constant = stored(constant, "constants")
    constant = hinted(constant, MOST_CONSTANTS, constant.agg(F.coalesce(F.sum(F.size("constants")), F.lit(0))).collect()[0][0])
    template = near.join(constant, "leaf", "left").withColumn("template", F.transform("tokens", lambda t, i: F.when(F.array_contains(F.col("constants"), F.struct(i.alias("place"), t.alias("token"))), t).otherwise(F.lit(FIELD))))
    template = template.withColumn("n_const", F.size(F.filter("template", lambda t: t != FIELD))).filter(2 * F.col("n_const") >= F.size("template"))
    template = template.select("text_key", "at", "around", F.xxhash64("leaf", "template").alias("template"))
    common = template.groupBy("template").agg(*_recurs()).filter(_ENOUGH).select("template")
    return template.join(hinted(stored(common, "templates"), MOST_BROADCAST), "template").groupBy("text_key").agg(F.sort_array(F.collect_set("at")).alias("dropped"))


def cleaned(docs: DataFrame, text_col: str = "text", length_col: str | None = None, counts: bool = True) -> DataFrame:
    """All documents with their recurring lines dropped from the text, and, with `counts`, n_lines and n_dropped added as _n_lines and _n_dropped.

    Every row stays, also one that loses all lines; a null text stays null. Lines without a word are kept as they are. A column of the
    text's length, if named, is set anew where lines went. Other columns stay as they are; without `counts` they may have any name.
    """
    # as many texts may be marked as there are: always a merge join, whose skewed keys (copies) Spark splits
    marks = stored(recurring_lines(docs, text_col), "marks").select(F.col("text_key").alias("__key"), F.col("dropped").alias("__dropped"))
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(text_col).alias("__text"), _key(docs[text_col]).alias("__key"))
    marked = held.join(marks.hint("merge"), "__key", "left")
    lines, dropped = F.split("__text", "\n"), F.col("__dropped")
    short = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(dropped, i)), "\n")
    text = F.when(dropped.isNull(), F.col("__text")).otherwise(short)
    worded = F.array_size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    length = lambda c: F.when(dropped.isNull(), F.col("__row")[c]).otherwise(F.length(short).cast(docs.schema[c].dataType))
    own = [text.alias(c) if c == text_col else length(c).alias(c) if c == length_col else F.col("__row")[c].alias(c) for c in names]
    if not counts:
        return marked.select(*own)
    return marked.select(*own, F.coalesce(worded, F.lit(0)).alias("_n_lines"), F.coalesce(F.array_size(dropped), F.lit(0)).alias("_n_dropped"))


def report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_lines and n_dropped (lines with a word) and the MD5 of the text that is left (null text: null)."""
    done = cleaned(docs.select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_dropped").cast("long").alias("n_dropped"), F.md5("text").alias("text_md5"))


def _sql_leaf(line: str) -> str:
    tokens = f"regexp_extract_all({line}, '[^\\x20\\x09-\\x0D]+')"
    return f"len({tokens}) || ' ' || array_to_string(list_transform({tokens}[1:{DEPTH}], lambda t: case when regexp_matches(t, '[0-9]') then '{FIELD}' else t end), ' ')"


SQL = f"""
with texts as (select distinct text from documents where text is not null),
raw as (select text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as spot from texts),
lines as (select *, {_sql_leaf('line')} as leaf, list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), lambda t: case when regexp_matches(t, '[0-9]') then '{FIELD}' else t end) as tokens
          from raw where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
placed as (select *, coalesce(lag(leaf) over (partition by text order by spot), '') || chr(10) || coalesce(lead(leaf) over (partition by text order by spot), '') as around from lines),
leaves as (select leaf from placed where len(tokens) >= {LEAST_TOKENS} group by leaf having count(distinct around) >= {LEAST_SURROUNDINGS} and 10 * count(distinct around) >= {TENTHS} * count(distinct text)),
near as (select * from placed where leaf in (select leaf from leaves) and len(tokens) >= {LEAST_TOKENS}),
spread as (select leaf, around, unnest(tokens) as token, generate_subscripts(tokens, 1) as place from near),
constant as (select leaf, place, token from spread where token <> '{FIELD}' group by all having count(distinct around) >= {LEAST_SURROUNDINGS}),
tokened as (select text, spot, leaf, around, unnest(tokens) as token, generate_subscripts(tokens, 1) as place from near),
fields as (select t.text, t.spot, any_value(t.leaf) as leaf, any_value(t.around) as around, list(case when c.token is null then '{FIELD}' else t.token end order by t.place) as template, count(c.token) as n_const, count(*) as n
           from tokened t left join constant c on c.leaf = t.leaf and c.place = t.place and c.token = t.token group by t.text, t.spot),
common as (select leaf, template from fields where 2 * n_const >= n group by all having count(distinct around) >= {LEAST_SURROUNDINGS} and 10 * count(distinct around) >= {TENTHS} * count(distinct text)),
dropped as (select f.text, f.spot from fields f join common c on c.leaf = f.leaf and c.template = f.template),
left_over as (select r.text, count(*) filter (regexp_matches(r.line, '[^\\x20\\x09-\\x0D]')) as n_lines, count(d.spot) as n_dropped, string_agg(case when d.spot is null then r.line end, chr(10) order by r.spot) as short
              from raw r left join dropped d on d.text = r.text and d.spot = r.spot group by r.text)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped, case when documents.text is not null then md5(coalesce(short, '')) end as text_md5
from documents left join left_over on left_over.text = documents.text
"""
