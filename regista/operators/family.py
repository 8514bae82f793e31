"""Families: substring links by trigrams, record linkage, groups by year gaps, edges, documents of relatives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regista.functions.names import surnames
from regista.functions.ranks import materialise, with_rank


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of a text."""
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


#: Parts in which the texts of a needle are ranked before the lowest ids of all parts are ranked together.
PARTS = 32


def _tried(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text): each distinct text of texts (text) that contains a distinct needle of needles (needle) of three letters or more."""
    words = needles.where(F.length("needle") >= 3).select("needle").distinct()
    t = texts.where("text is not null").select("text").distinct().select("text", F.explode(trigrams(F.col("text"))).alias("gram"))
    counts = t.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    n = words.select("needle", F.explode(trigrams(F.col("needle"))).alias("gram")).join(counts, "gram", "left")
    # a trigram that no text has is the rarest: the needle then meets none
    rarest = n.groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(t, "gram").where(F.contains("text", F.col("needle"))).select("needle", "text")


def containing(needles: DataFrame, texts: DataFrame, most: int | None = None) -> DataFrame:
    """(needle_id, text_id) where text contains needle, for needles (needle_id, needle) of three letters or more and texts (text_id, text), never the same id.

    The needle's rarest trigram meets the texts' trigrams in an equi join, so
    nothing is lost and few pairs are tried; contains() decides. Equal needles
    and equal texts are tried once. With most, the lowest text ids of each
    needle: equal needles share one list of these, which is ranked part by
    part, and no rows of a needle id are sorted.
    """
    pairs = _tried(needles, texts)
    own = F.col("needle_id") != F.col("text_id")
    if most is None:
        return needles.join(pairs, "needle").join(texts.select("text_id", "text"), "text").where(own).select("needle_id", "text_id")
    # equal needles share their lowest texts, one more than asked for, as one of them may be the needle's own
    met = pairs.join(texts.where("text_id is not null").select("text_id", "text"), "text").select("needle", "text_id", F.pmod(F.xxhash64("text_id"), F.lit(PARTS)).alias("_part"))
    for by in (["needle", "_part"], ["needle"]):
        met = met.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("text_id"))).where(F.col("_n") <= most + 1)
    lowest = met.groupBy("needle").agg(F.collect_list("text_id").alias("_lowest"))
    # as good as all ids have one needle, and no rows of theirs are brought together
    several = needles.groupBy("needle_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("needle_id")
    lists = needles.where("needle_id is not null").select("needle_id", "needle").join(lowest, "needle").select("needle_id", "_lowest")
    more = lists.join(several, "needle_id", "left_semi").groupBy("needle_id").agg(F.array_sort(F.flatten(F.collect_list("_lowest"))).alias("_lowest"))
    every = lists.join(several, "needle_id", "left_anti").select("needle_id", F.array_sort("_lowest").alias("_lowest")).union(more)
    return every.select("needle_id", F.explode(F.slice(F.filter("_lowest", lambda x: x != F.col("needle_id")), 1, most)).alias("text_id"))


def contained_elsewhere(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id): those of texts (text_id, text) that contain a needle of three letters or more of another id, for needles (needle_id, needle). Equal needles are one row with two of their ids, so no pairs of rows are made."""
    ends = needles.groupBy("needle").agg(F.min("needle_id").alias("low"), F.max("needle_id").alias("high"))
    # of all needles of a text, too, two different ids tell whether one is another's
    found = _tried(needles, texts).join(ends, "needle").groupBy("text").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return texts.join(found, "text").where("low <> text_id or high <> text_id").select("text_id").distinct()


def first_word(name: Column) -> Column:
    """The first token, or the whole name where that is shorter than three letters."""
    t = F.get(F.split(F.trim(name), r"\s+"), F.lit(0))
    return F.when(F.length(t) >= 3, t).otherwise(F.trim(name))


def relatives(people: DataFrame, children: int = 20) -> DataFrame:
    """(id, role, other) for people (id, nome, pai, mae, conjuge, avo_paterno, avo_paterna, avo_materno, avo_materna).

    Parents: the lowest id whose given name contains the parent's first name;
    children: up to so many whose father or mother contains the own first name;
    spouse and grandparents as parents.
    """
    given = people.where("nome is not null").select(F.col("id").alias("text_id"), F.col("nome").alias("text"))
    out = None
    for column, role in (("pai", "father"), ("mae", "mother"), ("conjuge", "spouse"), ("avo_paterno", "grandfather_paternal"), ("avo_paterna", "grandmother_paternal"), ("avo_materno", "grandfather_maternal"), ("avo_materna", "grandmother_maternal")):
        if column in people.columns:
            needles = people.where(F.length(F.trim(column)) >= 3).select(F.col("id").alias("needle_id"), first_word(F.col(column)).alias("needle"))
            rows = containing(needles, given, 1).select(F.col("needle_id").alias("id"), F.lit(role).alias("role"), F.col("text_id").alias("other"))
            out = rows if out is None else out.union(rows)
    own = people.where("nome is not null").select(F.col("id").alias("needle_id"), first_word(F.col("nome")).alias("needle"))
    parents = people.select(F.col("id").alias("text_id"), F.concat_ws(" \u0001 ", "pai", "mae").alias("text"))
    kids = containing(own, parents, children).select(F.col("needle_id").alias("id"), F.lit("child").alias("role"), F.col("text_id").alias("other"))
    return kids if out is None else out.union(kids)


def family_document(people: DataFrame) -> DataFrame:
    """Each person with a sorted list of relatives (role, id, name)."""
    links = relatives(people).join(people.select(F.col("id").alias("other"), "nome"), "other")
    lists = links.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("role", F.col("other").alias("id"), "nome"))).alias("relatives"))
    return people.join(lists, "id", "left")


def next_at_or_after(wanted: DataFrame, known: DataFrame, on: list[str], place: str, value: str) -> DataFrame:
    """wanted (on, place) with the value of the first of known (on, place, value) at its place or after it; null if there is none.

    Both should have a row for each key and place, which bounds what a key
    holds by its places. The window runs backwards over both sides in one
    order, so each row is looked at once.
    """
    a = wanted.select(*on, place, F.lit(0).alias("_side"), F.lit(None).cast(known.schema[value].dataType).alias(value))
    b = known.select(*on, place, F.lit(1).alias("_side"), value)
    back = Window.partitionBy(*on).orderBy(F.col(place).desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.union(b).withColumn(value, F.last(value, ignorenulls=True).over(back)).where("_side = 0").drop("_side")


def linked_in_time(first: DataFrame, later: DataFrame, key: str, gap: int = 1) -> DataFrame:
    """(first_id, later_id): for each of first (id, year, key) the earliest of later with the same key at least gap years after; years of 0 don't count.

    What is looked for depends on the key and the year alone. So each key has
    one row for a year of either side, however many rows it has, and a key is
    never a group of more rows than there are years; the rows themselves meet
    what was found in a join, which can be split.
    """
    a = first.where(f"year > 0 and {key} is not null").select(F.col("id").alias("first_id"), key, (F.col("year") + gap).alias("year"))
    b = later.where(f"year > 0 and {key} is not null").groupBy(key, "year").agg(F.min("id").alias("later_id"))
    found = next_at_or_after(a.select(key, "year").distinct(), b, [key], "year", "later_id").where("later_id is not null")
    return a.join(found, [key, "year"]).select("first_id", "later_id")


def connections(people: DataFrame, name: str) -> DataFrame:
    """(role, id) around a name: births and deaths that contain it, and siblings, whose father contains the name of a parent of those births."""
    own = people.where(F.contains(F.lower("nome"), F.lit(name.lower())))
    births, deaths = own.where("tipo_registo = 'BIRT'"), own.where("tipo_registo = 'DEAT'")
    parents = births.where(F.length("pai") >= 3).select(F.col("pai").alias("needle"), F.col("id").alias("needle_id")).distinct()
    fathers = people.where("tipo_registo = 'BIRT' and pai is not null").select(F.col("id").alias("text_id"), F.col("pai").alias("text"))
    siblings = contained_elsewhere(parents, fathers)
    return births.select(F.lit("birth").alias("role"), "id").union(deaths.select(F.lit("death"), "id")).union(siblings.select(F.lit("sibling"), "text_id"))


def relation(diff: Column) -> Column:
    """What another record is by its years after the own one."""
    return F.when(diff >= 15, "child").when(diff <= -15, "parent").when(F.abs(diff) <= 5, "sibling")


#: Ids of a class that one row holds, about the pairs of ids of a unit of work, the fewest for which a task is worth while, and the most tasks.
CLASS_IDS, UNIT_PAIRS, TASK_PAIRS, TASKS = 32, 1 << 24, 1 << 20, 4096


def _classes(people: DataFrame, on: list[str]) -> DataFrame:
    """(on, year, part, ids): the ids of people of one group and year, at most about CLASS_IDS in a row; rows without an id, a year or a group are left out."""
    known = people.select("id", "year", *on).where(" and ".join(f"{c} is not null" for c in ("id", "year", *on)))
    sizes = known.groupBy(*on, "year").agg(F.ceil(F.count(F.lit(1)) / CLASS_IDS).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    classes = known.join(sizes, [*on, "year"]).groupBy(*on, "year", part.alias("part")).agg(F.collect_list("id").alias("ids"))
    return classes.select(*on, "year", "part", "ids")


def relations_by_years(people: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """(id, other, relation) for people and others (id, year) that agree on the columns.

    The result has a row for each related pair, so the columns should name a
    small group, such as a surname and a place. People of one group and year
    are a class, and have one relation to another class: classes are joined,
    and the pairs of ids are written out last, so that a row of the join makes
    up to CLASS_IDS times CLASS_IDS of them, which Spark holds at once. Classes are small and pairs many,
    so tasks go by the pairs, which are counted first: a group of more than
    UNIT_PAIRS has its classes dealt out on both sides, and each deal of one
    side meets each of the other in a unit of its own.
    """
    a = materialise(_classes(people, on))
    b = a if others is people else materialise(_classes(others, on))
    a_sizes, b_sizes = (df.groupBy(*on).agg(F.sum(F.size("ids")).alias(name)) for df, name in ((a, "a_n"), (b, "b_n")))
    pairs = F.col("a_n").cast("double") * F.col("b_n")
    groups = a_sizes.join(b_sizes, on).select(*on, pairs.alias("pairs"), F.ceil(F.sqrt(pairs / UNIT_PAIRS)).alias("deals"))
    work = groups.agg(F.sum("pairs").alias("pairs"), F.sum(F.col("deals") * F.col("deals")).alias("units")).first()
    tasks = int(max(1, min(work["units"] or 1, (work["pairs"] or 0) / TASK_PAIRS, TASKS)))

    def dealt(df: DataFrame, own: str, met: str) -> DataFrame:
        rows = df.join(groups, on).withColumn(own, F.pmod(F.xxhash64("year", "part"), "deals")).withColumn(met, F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
        return rows.select(*on, "_a", "_b", "year", "ids").repartition(tasks, *on, "_a", "_b")

    met = dealt(a, "_a", "_b").withColumnRenamed("year", "own").join(dealt(b, "_b", "_a").withColumnRenamed("ids", "others"), [*on, "_a", "_b"])
    related = met.select("ids", "others", relation(F.col("year") - F.col("own")).alias("relation")).where("relation is not null")
    each = related.select("others", "relation", F.explode("ids").alias("id")).select("id", "relation", F.explode("others").alias("other"))
    return each.where("id <> other").select("id", "other", "relation")


def _nearest_later(people: DataFrame, others: DataFrame, on: list[str], least: int, most: int | None, k: int) -> DataFrame:
    """(id, other, diff): up to k others of each person's group whose year is at least so many years later, the nearest first, and of a year the smallest ids; at most so many years later."""
    ranked = with_rank(others.select(*on, "year", F.col("id").alias("other")), *on, "year", "other")
    starts = ranked.groupBy(*on, "year").agg(F.min("rank").alias("rank"))
    ends = ranked.groupBy(*on).agg(F.max("rank").alias("end"))
    wanted = people.select(*on, (F.col("year") + least).alias("year")).distinct()
    found = next_at_or_after(wanted, starts, on, "year", "rank").where("rank is not null").join(ends, on)
    # one more than asked for, as the person may be among them
    places = found.select(*on, (F.col("year") - least).alias("year"), F.sequence("rank", F.least("end", F.col("rank") + k)).alias("ranks"))
    each = people.join(places, [*on, "year"]).select("id", F.col("year").alias("own"), F.explode("ranks").alias("rank"))
    rows = each.join(ranked.select("rank", "other", "year"), "rank").where("id <> other").select("id", "other", (F.col("year") - F.col("own")).alias("diff"))
    return rows if most is None else rows.where(F.col("diff") <= most)


def nearest_relations(people: DataFrame, others: DataFrame, on: list[str], k: int = 3) -> DataFrame:
    """(id, other, relation, diff, rank): for each of people (id, year, on) the k others (id, year, on) that are nearest in time as child (15 years later or more), parent (15 years earlier or more) and sibling (5 years apart at most).

    Nearest is by years, then by id. Rows without a year or with a null in on
    are left out; ids are unique in a group. No pairs of a group are made:
    others have a rank in one order, and a person reads the ranks that follow
    the place of its own year, at most k + 1 for each relation, so a group of
    any size makes no more than that for a row, and the ranks are dealt out by
    ranges. Later years are earlier ones if all are negative.
    """
    known = "year is not null and " + " and ".join(f"{c} is not null" for c in on)
    a, b = (df.where(known).select("id", "year", *on) for df in (people, others))
    minus = lambda df: df.withColumn("year", -F.col("year"))
    told = [
        _nearest_later(a, b, on, 15, None, k).withColumn("relation", F.lit("child")),
        _nearest_later(minus(a), minus(b), on, 15, None, k).select("id", "other", (-F.col("diff")).alias("diff"), F.lit("parent").alias("relation")),
        _nearest_later(a, b, on, 0, 5, k).withColumn("relation", F.lit("sibling")),
        _nearest_later(minus(a), minus(b), on, 1, 5, k).select("id", "other", (-F.col("diff")).alias("diff"), F.lit("sibling").alias("relation")),
    ]
    every = told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])
    best = Window.partitionBy("id", "relation").orderBy(F.abs("diff"), "other")
    return every.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "other", "relation", "diff", "rank")


def ancestors(people: DataFrame, links: DataFrame, generations: int) -> DataFrame:
    """(id, other, generation): whoever of links (child, parent) is up to so many generations above each of people (id), by the shortest way; nobody is above himself.

    A turn takes one generation: the last one found meets its parents in a
    join, and whoever a person has already is left out, so circles end. The
    lineage is cut after each turn.
    """
    up = links.where("child <> parent").select(F.col("child").alias("at"), F.col("parent").alias("other")).distinct()
    found = last = materialise(people.select("id", F.col("id").alias("other"), F.lit(0).alias("generation")).distinct())
    for n in range(1, generations + 1):
        further = last.select("id", F.col("other").alias("at")).join(up, "at").select("id", "other").distinct()
        last = materialise(further.join(found, ["id", "other"], "left_anti").withColumn("generation", F.lit(n)))
        if not last.take(1):
            break
        found = found.union(last)
    return found.where("generation > 0")


def family_tree(people: DataFrame, links: DataFrame, couples: DataFrame) -> DataFrame:
    """(id, from, to, role): the edges of each person's tree: grandparents to parents, parents to the person, the person to the spouse, and the couple to the person's children.

    people (id), links (child, parent), couples (a, b), each couple once in
    either order. Roles: grandparent, parent, spouse, child. A person who is
    met twice, as in a circle, keeps the nearest place above; own children are
    below in any case.
    """
    above = ancestors(people, links, 2)
    up = links.where("child <> parent").distinct()
    parents = above.where("generation = 1").select("id", F.col("other").alias("from"), F.col("id").alias("to"), F.lit("parent").alias("role"))
    middle = above.where("generation = 1").select("id", F.col("other").alias("child"))
    elders = above.where("generation = 2").select("id", F.col("other").alias("parent"))
    grand = middle.join(up, "child").join(elders, ["id", "parent"]).select("id", F.col("parent").alias("from"), F.col("child").alias("to"), F.lit("grandparent").alias("role"))
    both = couples.select("a", "b").union(couples.select("b", "a")).where("a <> b").distinct()
    spouses = people.select("id").distinct().join(both, F.col("id") == F.col("a")).select("id", F.col("id").alias("from"), F.col("b").alias("to"), F.lit("spouse").alias("role"))
    children = people.select("id").distinct().join(up, F.col("id") == F.col("parent")).select("id", F.col("id").alias("from"), F.col("child").alias("to"), F.lit("child").alias("role"))
    return parents.union(grand).union(spouses).union(children).distinct()


def gap_groups(rows: DataFrame, key: str, place: str, gap: int, least: int = 2) -> DataFrame:
    """Runs of rows of a key in order of place, cut where the step exceeds gap; those of at least so many members: key, run, size, first, last."""
    w = Window.partitionBy(key).orderBy(place)
    cut = (F.coalesce(F.col(place) - F.lag(place).over(w), F.lit(0)) > gap).cast("int")
    runs = rows.withColumn("_cut", cut).withColumn("run", F.sum("_cut").over(w))
    return runs.groupBy(key, "run").agg(F.count(F.lit(1)).alias("size"), F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("size") >= least)


def surname_groups(people: DataFrame, gap: int = 20) -> DataFrame:
    """Family groups of people (id, nome, year) by surname candidate and year gaps; a missing year is 0."""
    rows = people.select(F.explode(surnames(F.col("nome"))).alias("surname"), F.coalesce("year", F.lit(0)).alias("year"), "id")
    return gap_groups(rows, "surname", "year", gap)


def edges(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, detail), one for each name, parents added as stubs; edges (parent, child, type), repeats kept."""
    own = people.select(F.col("nome").alias("name"), "id", F.lit(0).alias("stub"))
    kinds = [people.where(f"{c} is not null and {c} <> ''").select(F.col(c).alias("parent"), F.col("nome").alias("child"), F.lit(t).alias("type")) for c, t in (("pai", "father"), ("mae", "mother"))]
    links = kinds[0].union(kinds[1])
    stubs = links.select(F.col("parent").alias("name"), F.lit(None).cast("long").alias("id"), F.lit(1).alias("stub"))
    nodes = own.union(stubs).groupBy("name").agg(F.min(F.struct("stub", "id")).alias("k"))
    return nodes.select("name", F.col("k.id").alias("id"), (F.col("k.stub") == 1).alias("stub")), links


def cosine(x: Column, y: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


#: About the numbers in the vectors of a part that asks, how many times as large a part is that is asked, and queries that meet it at a time.
BLOCK, WIDE, ASKED = 1 << 19, 8, 64
#: Rows of a part that are looked at as one when the best are chosen, pairs that are scored at a time, and pairs or rows for which a task is worth while.
GROUPED, SCORED, TASK_LOOKS, TASK_ROWS = 32, 1024, 1 << 22, 1 << 15


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length, or null ones, as rows of doubles; a null is nan."""
    if vectors.null_count or not len(vectors.flatten()):
        return np.full((len(vectors), 1), np.nan)
    flat = pc.cast(vectors.flatten(), pa.float64())
    return pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed from the first place to the last as cosine() does, so equal vectors have equal ones."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def _pairs_of_most(x: np.ndarray, y: np.ndarray, same_x: np.ndarray, same_y: np.ndarray, k: int, more: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, similarity) of the k rows of y most like each row of x, of equal ones the first, never those of the same number; no number stands more often than more in same_y.

    Inner products of unit vectors in single precision choose what is scored,
    with a margin of twice their error. The best of every GROUPED of them bound
    the k-th best of all from below, so few are looked at one by one.
    """
    most = k + more
    # of equal vectors the first ones go before the others in any case
    whole = np.ascontiguousarray(y)
    _, at, turn, n = np.unique(whole.view(np.dtype((np.void, whole.shape[1] * 8)))[:, 0], return_index=True, return_inverse=True, return_counts=True)
    if n.max() > most:
        order = np.argsort(turn, kind="stable")
        kept = np.sort(order[np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n) < most])
        y, same_y = y[kept], same_y[kept]
    else:
        kept = np.arange(len(y))
    most, rows = min(most, len(y)), max(1, min(GROUPED, len(y) // (4 * most)))
    xx, yy = _products(x, x), _products(y, y)
    width, close = -(-len(y) // rows), (x.shape[1] + 8) * 2.0**-23
    unit_x = (x / np.sqrt(xx)[:, None]).astype(np.float32)
    unit_y = np.zeros((x.shape[1], rows * width), dtype=np.float32)
    unit_y[:, : len(y)] = (y / np.sqrt(yy)[:, None]).T
    for start in range(0, len(x), ASKED):
        like = unit_x[start : start + ASKED] @ unit_y
        like[:, len(y) :] = -4
        like = like.reshape(len(like), rows, width)
        best = like.max(axis=1)
        least = np.partition(best, width - most, axis=1)[:, width - most] - close
        i, column = np.nonzero(best >= least[:, None])
        told, row = np.nonzero(like[i, :, column] >= least[i][:, None])
        i, j = start + i[told], row * width + column[told]
        other = same_x[i] != same_y[j]
        i, j = i[other], j[other]
        score = np.empty(len(i))
        for s in range(0, len(i), SCORED):
            a, b = i[s : s + SCORED], j[s : s + SCORED]
            score[s : s + SCORED] = _products(np.asfortranarray(x[a]), np.asfortranarray(y[b])) / np.sqrt(xx[a] * yy[b])
        order = np.lexsort((j, -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield i[first], kept[j[first]], score[first]


def _by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The places and the rows of the vectors of each length that have a direction."""
    lengths, out = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False), {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        x = _matrix(vectors.take(pa.array(at)))
        xx = _products(x, x)
        known = np.isfinite(xx) & (xx > 0)
        if known.any():
            out[int(n)] = at[known], x[known]
    return out


def _best_of_part(asking: pa.Table, asked: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """id, other and similarity of k of asked (id, embedding), in order of the id, that are most like each of asking (id, embedding), of equal ones those of least id; of those without a similarity some more."""
    a_ids, b_ids = asking["id"].combine_chunks(), asked["id"].combine_chunks()
    coded = b_ids.dictionary_encode()
    same_b = coded.indices.to_numpy()
    same_a = pc.fill_null(pc.index_in(a_ids, value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False)
    more = int(np.bincount(same_b).max())
    a, b = (_by_length(t["embedding"].combine_chunks()) for t in (asking, asked))

    def told(i: np.ndarray, j: np.ndarray, score: np.ndarray | None) -> pa.RecordBatch:
        similarity = pa.nulls(len(i), pa.float64()) if score is None else pa.array(score)
        return pa.record_batch({"id": a_ids.take(pa.array(i)), "other": b_ids.take(pa.array(j)), "similarity": similarity})

    def unlike(i: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
        left = np.setdiff1d(np.arange(len(b_ids)), known)[: k + more]
        for start in range(0, len(i), BLOCK // 64 + 1):
            some = i[start : start + BLOCK // 64 + 1]
            m, n = np.repeat(some, len(left)), np.tile(left, len(some))
            yield told(m[same_a[m] != same_b[n]], n[same_a[m] != same_b[n]], None)

    for length, (at, x) in a.items():
        known, y = b.get(length, (np.zeros(0, dtype=np.int64), x[:0]))
        if len(known):
            for i, j, score in _pairs_of_most(x, y, same_a[at], same_b[known], k, more):
                yield told(at[i], known[j], score)
        if len(known) < k + more:
            yield from unlike(at, known)
    without = np.setdiff1d(np.arange(len(a_ids)), np.concatenate([at for at, _ in a.values()] or [np.zeros(0, dtype=np.int64)]))
    yield from unlike(without, np.zeros(0, dtype=np.int64))


def _best_of_parts(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (_on, _asking, _asked, _side, id, embedding) in this order: what _best_of_part() tells of each pair of parts, one after the other."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if held[0] and held[1]:
                with np.errstate(all="ignore"):
                    yield from _best_of_part(pa.Table.from_batches(held[0]), pa.Table.from_batches(held[1]), k)

        for batch in batches:
            named = [batch.column(c) for c in ("_on", "_asking", "_asked", "_side")]
            rows, new = batch.select(["id", "embedding"]), np.zeros(max(0, batch.num_rows - 1), dtype=bool)
            for c in named:
                new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start < end:
                    *now, side = (c[start].as_py() for c in named)
                    if now != unit:
                        yield from done()
                        unit, held = now, ([], [])
                    held[side].append(rows.slice(start, end - start))
        yield from done()

    return read


def nearest(queries: DataFrame, rows: DataFrame, on: str, k: int) -> DataFrame:
    """(id, other, similarity, rank): the k of rows (id, embedding, on) that agree with a query (id, embedding, on) on that column and are most like it by cosine(), of equal ones those of least id, never itself. A query may stand under several values of on.

    All pairs are looked at, and none of them is a row: both sides of a value
    of on are dealt into parts of a bounded size, each part that asks meets
    each part that is asked in a unit of its own, and a task holds one unit at
    a time, of which each query keeps the best k. Sizes are counted first, as
    tasks go by the pairs. Time grows with the pairs, but by some nanoseconds
    each. Null vectors, those of other lengths, and those without a direction
    have a null similarity and come last.
    """
    a, b = (df.where("id is not null").select("id", "embedding", on) for df in (queries, rows))
    sizes = [df.groupBy(on).agg(F.count(F.lit(1)).alias(f"_{s}_n"), F.max(F.greatest(F.lit(1), F.size("embedding"))).alias(f"_{s}_long")) for s, df in (("a", a), ("b", b))]
    long = F.greatest("_a_long", "_b_long")
    parts = [F.ceil(F.col("_a_n") * long / BLOCK).alias("_askings"), F.ceil(F.col("_b_n") * long / (BLOCK * WIDE)).alias("_askeds")]
    many = materialise(sizes[0].join(sizes[1], on).select(on, F.col("_a_n").cast("double").alias("_a_n"), F.col("_b_n").cast("double").alias("_b_n"), *parts))
    looks, moved = F.col("_a_n") * F.col("_b_n") / TASK_LOOKS, (F.col("_a_n") * F.col("_askeds") + F.col("_b_n") * F.col("_askings")) / TASK_ROWS
    work = many.agg(F.sum(looks + moved).alias("work"), F.sum(F.col("_askings") * F.col("_askeds")).alias("units")).first()
    # units are of unlike keys, which share tasks by chance, so there are more tasks than units
    tasks = int(max(1, min(3 * (work["units"] or 1), work["work"] or 0, TASKS)))

    def dealt(df: DataFrame, side: int, own: str, met: str) -> DataFrame:
        each = df.join(many, on).withColumn(own, F.pmod(F.xxhash64("id"), f"{own}s")).withColumn(met, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{met}s") - 1)))
        return each.select(F.col(on).cast("string").alias("_on"), "_asking", "_asked", F.lit(side).alias("_side"), "id", "embedding")

    unit = ["_on", "_asking", "_asked"]
    both = dealt(a, 0, "_asking", "_asked").union(dealt(b, 1, "_asked", "_asking")).repartition(tasks, *unit).sortWithinPartitions(*unit, "_side", "id")
    kind = both.schema["id"].dataType.simpleString()
    found = both.mapInArrow(_best_of_parts(k), f"id {kind}, other {kind}, similarity double")
    best = Window.partitionBy("id").orderBy(F.col("similarity").desc_nulls_last(), "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def most_similar(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(id, other, similarity, rank): the k rows of the same label most like each of the queries (id, embedding, label), without itself."""
    return nearest(queries.select("id", "embedding", "label"), rows.select("id", "embedding", "label"), "label", k)


def potential_relatives(similar: DataFrame, people: DataFrame, years: int = 10) -> DataFrame:
    """similar (id, other, ...), the output of most_similar(), with flags from people (id, surname, place, year): same_surname, same_place, near_in_time (at most so many years apart); unknown values give no flag."""
    own = people.select("id", F.col("surname").alias("s1"), F.col("place").alias("p1"), F.col("year").alias("y1"))
    other = people.select(F.col("id").alias("other"), F.col("surname").alias("s2"), F.col("place").alias("p2"), F.col("year").alias("y2"))
    both = similar.join(own, "id").join(other, "other")
    flag = lambda test: F.coalesce(test, F.lit(False))
    flags = {"same_surname": flag(F.col("s1") == F.col("s2")), "same_place": flag(F.col("p1") == F.col("p2")), "near_in_time": flag(F.abs(F.col("y1") - F.col("y2")) <= years)}
    return both.withColumns(flags).drop("s1", "p1", "y1", "s2", "p2", "y2")


def books_with_place(books: DataFrame, places: DataFrame) -> DataFrame:
    """Books (book_id, place_id, ...) with the name of their place (place_id, place); a book without a known place has no row."""
    return books.join(places, "place_id")
