"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set is its distinct five-word shingles. Documents of equal sets are one class. A class keeps the K least hashes of its
set: two sets of similarity J share about J * K of them, so two that are near share at least LEAST of them (but for a chance of
about one in a million at the threshold itself). Inverted lists of retained values give the overlaps: as a pair must share
LEAST values, it shares one of the rarest K - LEAST + 1 of either side, and only those are listed; values that many documents
have in common drop out by that. Short lists give their pairs; the union sketch of a pair estimates its similarity and
drops the hopeless; full sets verify the rest.

Long lists that overlap are one group, and no group is compared pair by pair. Its core is the shingles that more than half of its
members have. A member differs from the core by what it lacks of it and what it has beyond it; how many of these differences a pair has
in common decides exactly whether it is linked (`_cost`). So all members near enough to the core are linked with the one nearest to it,
without a comparison, and any other link shares differences, at least as many as its sides' distances ask for. The rarest differences
of a member, as many as that bound leaves, make lists anew. Each holds at most half of the group, so that after a logarithmic number
of levels all are short; a level's rows are bounded by its members' shingles. Links become components by rounds of least labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected
from .common import hinted, in_batches, mix64, shingle_hashes, stored, word_hashes

#: Words of a shingle; retained hashes; shared retained values that a link needs at least.
WIDTH, K, LEAST = 5, 64, 30
#: Sets up to this size have all partners' hashes retained too, so that the exact bound holds for them.
WHOLE = K * 3 // 4
#: Per cent of the union that a link's intersection has at least.
PERCENT = 75
#: Lists up to this length give all their pairs (at most 16 a member); those of longer ones are found by differences from a core.
SHORT = 32
#: The same for lists of differences, whose pairs are tested by marks where they stand: that is cheaper than a level.
MARKED = 128
#: Rows up to which ids of documents to fetch are broadcast.
MOST_BROADCAST = 200_000


def _sets(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, hashes in word_hashes(batch.column(text_at).to_pylist()):
        yield i, np.unique(shingle_hashes(hashes, WIDTH))


def _set_id(s: np.ndarray) -> bytes:
    """128 bits of a set, the same for equal sets."""
    with np.errstate(over="ignore"):
        a = mix64(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) if len(s) else 0
        b = np.bitwise_xor.reduce(mix64(s ^ np.uint64(0xD1342543DE82EF95))) if len(s) else 0
    return np.array([a, np.uint64(b) ^ mix64(np.array([len(s)], np.uint64))[0]], "<u8").tobytes()


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_id, sketch): set_id names the set (null for an empty one), sketch has its K least hashes, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, sids, kept = [], [], []
                for _, s in _sets(part, 2):
                    sizes.append(len(s))
                    sids.append(_set_id(s) if len(s) else None)
                    kept.append(np.sort(mix64(s) >> np.uint64(1))[:K].view(np.int64))
                flat = np.concatenate(kept) if kept else np.empty(0, np.int64)
                offs = np.cumsum([0] + [len(x) for x in kept]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(sids, pa.binary()), lists], names=["doc_id", "text_key", "n_shingles", "set_id", "sketch"])

    return in_batches(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), run, "doc_id long, text_key long, n_shingles long, set_id binary, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, shingles): the full sets, ascending, of the wanted classes (sid, set_id, rep), from the texts of their representatives; one row a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [(_set_id(s), np.sort(s.view(np.int64))) for _, s in _sets(part, 1) if len(s)]
                offs = np.cumsum([0] + [len(s) for _, s in rows]).astype(np.int32)
                flat = np.concatenate([s for _, s in rows]) if rows else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.binary()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=["set_id", "shingles"])

    reps = wanted.select("rep").distinct()
    texts = docs.select("doc_id", "text").join(hinted(reps, MOST_BROADCAST), F.col("doc_id").eqNullSafe(F.col("rep"))).select("doc_id", "text")
    made = in_batches(texts, run, "set_id binary, shingles array<long>")
    # rows that repeat an id may bring other sets along; the join leaves the wanted ones, once
    return made.join(hinted(wanted.select("sid", "set_id"), MOST_BROADCAST), "set_id").dropDuplicates(["sid"]).select("sid", "shingles")


def inverted(classes: DataFrame) -> DataFrame:
    """(v, sid, n): the listed values of each class: of those that another class retains too, the rarest, as many as the bound leaves."""
    each = classes.select("sid", F.col("n_shingles").alias("n"), F.explode("sketch").alias("v"))
    shared = each.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    hits = each.join(shared, "v").groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("hits"))  # at most K each
    need = F.when(F.col("n") <= WHOLE, F.ceil(F.col("n") * PERCENT / 100)).otherwise(F.lit(LEAST)).cast("int")
    hits = hits.withColumn("keep", F.size("hits") - need + 1).filter("keep > 0")
    return hits.select("sid", "n", F.explode(F.slice("hits", F.lit(1), F.col("keep"))).alias("x")).select("x.v", "sid", "n")


def _pairs_of(lists: DataFrame, keys: list[str], extra: Sequence[str] = (), test: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The distinct pairs (a, b) of lists of bounded length whose sizes allow a link and which pass the test; a is the lesser name."""

    def fits(a: Column, b: Column) -> Column:
        near = (100 * a["n"] >= PERCENT * b["n"]) & (100 * b["n"] >= PERCENT * a["n"])
        return near & test(a, b) if test else near

    held = lists.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("sid", "n", *extra))).alias("m"))
    before = lambda x, i: F.filter(F.slice(F.col("m"), F.lit(1), i), lambda y: fits(y, x))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(before(x, i), lambda y: F.struct(y["sid"].alias("a"), x["sid"].alias("b")))))
    return held.select(F.explode(pairs).alias("q")).select("q.a", "q.b").distinct()


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose union sketch doesn't rule out a link."""
    s = classes.select("sid", "sketch")
    both = pairs.join(s.select(F.col("sid").alias("a"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("sid").alias("b"), F.col("sketch").alias("sb")), "b")
    both = both.withColumn("u", F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K)).withColumn("both", F.size(F.array_intersect("u", F.array_intersect("sa", "sb"))))
    enough = F.when(F.size("u") < K, 100 * F.col("both") >= PERCENT * F.size("u")).otherwise(F.col("both") >= LEAST)
    return both.filter(enough).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that their full sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (at_x, x), (at_y, y) = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(2), batch.column(3)))
            linked = []
            for i in range(batch.num_rows):
                p, q = x[at_x[i] : at_x[i + 1]], y[at_y[i] : at_y[i + 1]]
                inter = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
                linked.append(100 * inter >= PERCENT * (len(p) + len(q) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    both = pairs.select("a", "b").join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("xb")), "b")
    return in_batches(both.select("a", "b", "xa", "xb"), run, "a long, b long")


def _grouped(lists: DataFrame) -> DataFrame:
    """(g, sid, n, label): the members of long lists, each once; those of lists that overlap are in one group."""
    first = stored(lists.groupBy("v").agg(F.min("sid").alias("a")), "first")
    roots = connected(lists.join(hinted(first, MOST_BROADCAST), "v").select("a", F.col("sid").alias("b")).distinct())
    members = lists.select("sid", "n").distinct().join(roots.withColumnRenamed("node", "sid"), "sid")
    # a number that two roots share makes one group of theirs, which changes nothing but the work
    return members.select(F.xxhash64("root").alias("g"), "sid", "n", F.col("sid").alias("label"))


def _cost(lacks: Column, beyond: Column) -> Column:
    """A member's distance from its group's core.

    A pair's intersection is the core less what either side lacks, plus the differences (both lacked, or both beyond) in common. Put into
    100 * inter >= PERCENT * union, that is: (100 + PERCENT) * (differences in common) >= cost + cost - (100 - PERCENT) * (core's size).
    """
    return 100 * lacks + PERCENT * beyond


def _by_group(rows: DataFrame, **aggregates: Column) -> DataFrame:
    """Rows with aggregates of their group. No window: a group's rows stay spread over tasks."""
    made = stored(rows.groupBy("g").agg(*[c.alias(k) for k, c in aggregates.items()]), "groups")
    return rows.join(hinted(made, MOST_BROADCAST), "g")


def _apart(groups: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, sid, n, label, p, cost, differences): each member's distance and differences from the core of its group, of p shingles.

    And (g, e, f): how many members have a difference in common, where more than one has.
    """
    groups = _by_group(groups, members=F.count("*"))
    held = groups.join(sets, "sid")
    each = held.select("g", "members", F.explode("shingles").alias("e")).groupBy("g", "e").agg(F.count("*").alias("f"), F.any_value("members").alias("members")).filter("f > 1")
    each = stored(each.withColumn("core", 2 * F.col("f") > F.col("members")), "counts")
    # a core has at most twice as many shingles as the group's mean set
    core = stored(each.filter("core").groupBy("g").agg(F.collect_list("e").alias("core")), "cores")
    apart = held.join(core, "g", "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
    apart = apart.withColumns({"lacks": F.array_except("core", "shingles"), "beyond": F.array_except("shingles", "core")})
    cost = _cost(F.size("lacks"), F.size("beyond")).cast("long")
    rare = each.withColumn("f", F.when(F.col("core"), F.col("members") - F.col("f")).otherwise(F.col("f"))).filter("f > 1").select("g", "e", "f")
    return stored(apart.select("g", "sid", "n", "label", F.size("core").alias("p"), cost.alias("cost"), F.concat("lacks", "beyond").alias("differences")), "apart"), rare


def _compared(groups: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A level: links by nearness to the core, and lists (g, e, sid, n, label, ..., len) in which all other links that are needed meet.

    Members linked with the nearest one (not lone) are connected; of the links among them none is needed. So a pair has a lone side, and
    its sides' costs say how many differences it shares at least, `need`. What no partner can reach drops out, then the bounds are taken anew.
    """
    apart, rare = _apart(groups, sets)
    rows = _by_group(apart, nearest=F.min(F.struct("cost", "sid")))
    rows = rows.withColumn("slack", (100 - PERCENT) * F.col("p")).withColumn("lone", F.col("cost") + F.col("nearest.cost") > F.col("slack"))
    star = rows.filter("not lone and sid <> nearest.sid").select(F.col("nearest.sid").alias("a"), F.col("sid").alias("b"))
    # of each member, the differences that others have too, rarest first
    some = rows.join(hinted(stored(rows.filter("lone").select("g").distinct(), "open"), MOST_BROADCAST), "g")
    d = some.select("g", "sid", F.explode("differences").alias("e")).join(rare, ["g", "e"]).groupBy("g", "sid").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("d"))
    rows = some.drop("differences").join(d, ["g", "sid"])
    # a partner's size bounds what it lacks of the core
    least = 100 * (F.col("p") - F.floor(100 * F.col("n") / PERCENT))
    for _ in range(2):
        rows = _by_group(stored(rows.drop("any", "alone"), "rows"), any=F.min("cost"), alone=F.min(F.when(F.col("lone"), F.col("cost")))).filter("alone is not null")
        partner = F.greatest(F.when(F.col("lone"), F.col("any")).otherwise(F.col("alone")), least)
        need = F.greatest(F.ceil((F.col("cost") + partner - F.col("slack")) / (100 + PERCENT)), F.lit(1)).cast("int")
        rows = rows.withColumn("need", need).filter("size(d) >= need")
    label = F.when(F.col("lone"), F.col("label")).otherwise(F.col("nearest.sid"))
    rows = rows.withColumns({"label": label, "bits": _bits(F.col("d")), "s": F.size("d")})
    own = ["sid", "n", "label", "lone", "cost", "slack", "bits", "s"]
    anew = rows.select("g", *own, F.posexplode(F.slice("d", F.lit(1), F.size("d") - F.col("need") + 1)).alias("at", "x"))
    anew = stored(anew.select("g", F.col("x.e").alias("e"), *own, (F.col("s") - F.col("at")).alias("left")), "anew")
    # in the list of the first difference that a pair has in common, it has no more than those from there on
    met = anew.groupBy("g", "e").agg(F.min("cost").alias("any"), F.min(F.when(F.col("lone"), F.col("cost"))).alias("alone"), F.count("*").alias("len")).filter("len > 1 and alone is not null")
    anew = anew.join(met.drop("len"), ["g", "e"]).filter((100 + PERCENT) * F.col("left") >= F.col("cost") + F.when(F.col("lone"), F.col("any")).otherwise(F.col("alone")) - F.col("slack"))
    anew = stored(anew.drop("any", "alone"), "lists")
    names = [F.bit_xor(F.xxhash64("sid", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    sizes = anew.groupBy("g", "e").agg(F.count("*").alias("len"), F.bool_or("lone").alias("any"), F.min("label").alias("lo"), F.max("label").alias("hi"), *names).filter("len > 1 and any and lo <> hi")
    # of long lists with the same members, one
    sizes = sizes.groupBy("g", "len", "h1", "h2", F.when(F.col("len") <= MARKED, F.col("e")).alias("e0")).agg(F.min("e").alias("e"))
    return star, anew.join(sizes.select("g", "e", "len"), ["g", "e"])


#: Words of 64 bits in which a member's differences are marked.
MARKS = 8


def _bits(d: Column) -> Column:
    """Marks of differences, which are hashes: the lowest six bits name a bit, the next ones the word."""
    word = lambda k: F.aggregate(F.filter(d, lambda x: (F.shiftrightunsigned(x["e"], 6) % MARKS) == k), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["e"].bitwiseAND(F.lit(63)).cast("int"))))
    return F.array(*[word(k) for k in range(MARKS)])


def _possible(a: Column, b: Column) -> Column:
    """Whether a pair of a list may have enough differences in common, and isn't known to be connected.

    A mark that the other side doesn't have stands for one difference at least that isn't in common.
    """
    only = lambda x, y: sum((F.bit_count(x["bits"][k].bitwiseAND(F.bitwise_not(y["bits"][k]))) for k in range(MARKS)), F.lit(0))
    most = F.least(a["s"] - only(a, b), b["s"] - only(b, a), a["left"], b["left"])
    return (a["label"] != b["label"]) & (a["lone"] | b["lone"]) & ((100 + PERCENT) * most >= a["cost"] + b["cost"] - a["slack"])


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): linked pairs of classes that connect every component of all links."""
    lists = stored(inverted(classes), "lists")
    sizes = lists.groupBy("v").agg(F.count("*").alias("len")).filter("len > 1")
    lists = stored(lists.join(sizes, "v"), "sized")
    short = stored(_likely(_pairs_of(lists.filter(f"len <= {SHORT}"), ["v"]), classes), "pairs")
    groups = stored(_grouped(lists.filter(f"len > {SHORT}")), "groups")
    wanted = short.select(F.explode(F.array("a", "b")).alias("sid")).union(groups.select("sid")).distinct().join(classes.select("sid", "set_id", "rep"), "sid")
    sets = stored(full_sets(docs, stored(wanted, "wanted")), "sets")
    found = [_verified(short, sets)]
    while not groups.isEmpty():
        star, anew = _compared(groups, sets)
        anew = stored(anew, "again")
        pairs = _pairs_of(anew.filter(f"len <= {MARKED}"), ["g", "e"], ["label", "lone", "cost", "slack", "bits", "s", "left"], _possible)
        found += [star, _verified(stored(_likely(pairs, classes), "pairs"), sets)]
        groups = stored(anew.filter(f"len > {MARKED}").select(F.xxhash64("g", "e").alias("g"), "sid", "n", "label"), "groups")
    made = found[0]
    for f in found[1:]:
        made = made.union(f)
    return stored(made.distinct(), "links")


def _named(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, text_key, n_shingles, and component_id."""
    rows = stored(sketched(docs), "sketches")
    sets = rows.filter("set_id is not null")
    classes = sets.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("nameless"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sketch").alias("sketch"))
    # a class goes by a number, which is half as long as its name; it is fixed once the table is written
    classes = stored(classes.withColumn("sid", F.monotonically_increasing_id()), "classes")
    roots = connected(links(docs, classes))
    joined = classes.select("sid", "set_id", "rep", "last", "nameless").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    least = joined.filter("root is not null").groupBy("root").agg(F.min("rep").alias("least"))
    joined = joined.join(least, "root", "left").withColumn("component", F.coalesce("least", "rep"))
    # only classes with a row that isn't its component's first; all other documents are their own components
    named = stored(joined.filter("not (component <=> last) or nameless").select("set_id", "component"), "components")
    out = rows.select("doc_id", "text_key", "n_shingles", "set_id").join(named, "set_id", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def components(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept (whether that is its own).

    Texts without words have no shingles and are linked with nothing. Rows that repeat an id with an equal set are one document and are kept
    or dropped together. A null id counts as the largest: it is a component's name only where there is no other.
    """
    return _named(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near duplicates, the one of the smallest id; own columns only."""
    gone = _named(docs).filter("not (doc_id <=> component_id)").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    gone = stored(gone, "gone")
    return docs.join(hinted(gone, MOST_BROADCAST), docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_key"]), "left_anti")
