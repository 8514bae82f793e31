"""Fuzzy line deduplication by MinHash over character shingles, on built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regista.llm.common import materialise, placed_within, text_of, unpacked, whole
from regista.llm.linking import among, confirmed, linked_sets, live, star_pairs

#: Characters (UTF-16 units in signatures, code points in the test) of a shingle.
WIDTH = 8
#: Least Jaccard similarity of two lines, in percent.
PERCENT = 80
#: Bins of the signature; the smallest shingle hash of each bin is kept.
BINS = 16
#: Hashes that a long line sends to the bins: those below a bound that depends on its length, so that about this many stay. As the bound keeps the smallest, it never changes the minimum of a bin, but leaves a bin empty for one bin in fifty.
SENT = 64
#: Bins of a band, as steps from its first bin: no two bands share more than one bin.
STEPS = (0, 1, 3, 7)
BANDS = 10
BLANK = " \t\n\x0b\x0c\r"


def normal(line: Column) -> Column:
    """The form in which lines are compared: lower case, without outer white space."""
    rare = reduce(lambda a, b: a | b, [F.contains(line, F.lit(c)) for c in BLANK[1:]])
    return F.lower(F.when(rare, F.btrim(line, F.lit(BLANK))).otherwise(F.trim(line)))


def normal_lines(text: Column) -> Column:
    """The lines of a text in their normal form; made here, as part of one expression, they are made once however often they are used."""
    return F.transform(F.split(text, "\n"), normal)


def _long_lines(docs: DataFrame) -> DataFrame:
    """(id, norm) of the lines that have a shingle; lines may repeat."""
    lines = docs.select(F.explode_outer(normal_lines(text_of())).alias("norm"))
    return lines.where(F.length("norm") >= WIDTH).select(F.xxhash64("norm").alias("id"), "norm")


def _hashed(lines: DataFrame, *columns: str) -> DataFrame:
    """A row with columns and h, the hash of a shingle, for each place of lines (columns, units); units is encoded with two bytes a character."""
    places = F.sequence(F.lit(1), F.length("units") - (2 * WIDTH - 1), F.lit(2))
    each = lines.select(*columns, "units", F.explode(places).alias("at"))
    return each.select(*columns, F.xxhash64(F.substring("units", F.col("at"), F.lit(2 * WIDTH))).alias("h"))


def _repeats(norm: Column) -> Column:
    """Whether the first, middle or last shingle of a line stands in it elsewhere, as it does if a line repeats itself."""
    n = F.length(norm)
    middle = F.floor(n / 2).cast("int")
    begins = F.contains(F.substring(norm, F.lit(2), n), F.substring(norm, F.lit(1), F.lit(WIDTH)))
    inside = F.contains(F.substring(norm, middle + 1, n), F.substring(norm, middle, F.lit(WIDTH)))
    return begins | inside | F.contains(F.substring(norm, F.lit(1), n - 1), F.substring(norm, n - (WIDTH - 1), F.lit(WIDTH)))


def signatures(lines: DataFrame) -> DataFrame:
    """(id, keys) for lines (id, norm): one-permutation MinHash in BINS bins, cut into BANDS overlapping bands. Lines that repeat an id have one row.

    A long line sends only the hashes below a bound that depends on its length.
    That does not change the least hash of a bin; but a line that repeats
    itself has few different ones, and so sends all.
    """
    n = F.floor(F.length("units") / 2).cast("int") - (WIDTH - 1)
    # bound to a variable, or else the normal form would be made again for each use of it
    every = F.get(F.transform(F.array("norm"), lambda x: F.when(F.length(x) > 2 * SENT, _repeats(x)).otherwise(True)), F.lit(0))
    units = lines.select("id", F.encode("norm", "UTF-16BE").alias("units"), every.alias("every"))
    units = units.select("id", "units", F.coalesce(F.when(F.col("every"), 0).otherwise(n), F.lit(0)).alias("n"))
    low = F.col("h").bitwiseAND(F.lit((1 << 60) - 1))
    sent = _hashed(units, "id", "n").where(low.cast("double") * F.col("n") < F.lit(float(SENT) * (1 << 60)))
    sent = sent.select("id", F.shiftrightunsigned("h", 60).cast("int").alias("bin"), F.shiftright(low, 29).cast("int").alias("h"))
    bins = sent.groupBy("id").agg(*[F.min(F.when(F.col("bin") == b, F.col("h"))).alias(f"m{b}") for b in range(BINS)])

    def band(t: int) -> Column:
        cols = [F.col(f"m{(t * BINS // BANDS + s) % BINS}") for s in STEPS]
        return F.when(F.coalesce(*cols).isNotNull(), F.xxhash64(F.lit(t), *[F.coalesce(c, F.lit(-s - 1)) for s, c in enumerate(cols)]))

    return bins.select("id", F.array_compact(F.array(*map(band, range(BANDS)))).alias("keys"))


def shingles(units: Column) -> Column:
    """The 64-bit hashes of the shingles of a line that is encoded with four bytes a character, each once."""
    places = F.sequence(F.lit(1), F.length(units) - (4 * WIDTH - 1), F.lit(4))
    return F.array_distinct(F.transform(places, lambda k: F.xxhash64(F.substring(units, k, F.lit(4 * WIDTH)))))


def alike(x: Column, y: Column, percent: int) -> Column:
    """100 * |a and b| >= percent * |a or b| for the sets a, b of all shingles of two lines, each shingle told by a 64-bit hash."""
    # what is used again is bound to a variable, or else it would be computed again
    coded = F.transform(F.array(F.struct(F.encode(x, "UTF-32").alias("x"), F.encode(y, "UTF-32").alias("y"))), lambda s: F.struct(shingles(s["x"]).alias("a"), shingles(s["y"]).alias("b")))
    sizes = F.transform(coded, lambda s: F.struct(F.size(F.array_intersect(s["a"], s["b"])).cast("long").alias("both"), (F.size(s["a"]) + F.size(s["b"])).cast("long").alias("all")))
    return F.exists(sizes, lambda s: s["both"] * 100 >= (s["all"] - s["both"]) * percent)


def line_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every line of docs (doc_id, text) with its component of fuzzy copies.

    Columns: doc_id, line_no (from 0), component_doc, component_line (the first
    line of the component, in order of doc_id, line number and a hash of the
    text, null ids last), kept (it is that first line). Lines are compared in
    lower case without outer white space; two lines are linked if their sets of
    8-character shingles have a Jaccard similarity of at least percent, tested
    on the whole sets. Candidates share a band of their MinHash signatures.
    Lines equal in that form are one node from the start. A line of fewer than
    8 characters in that form has no shingle and is always kept, so blank lines
    and list marks stay; lines of any length are read whole. A null text is one
    empty line. Unlike rows under one doc_id, or without one, are judged each
    by itself; rows that repeat both doc_id and text have equal results. An
    empty table stays empty; other columns are ignored. Line ids are 64-bit
    hashes of the normal form.
    """
    return _placed(docs, percent).select(
        "doc_id",
        "line_no",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_doc"),
        F.coalesce("first.line_no", "line_no").alias("component_line"),
        "kept",
    )


def _line_classes(docs: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the lines that are linked with others."""
    members, nodes = live(materialise(signatures(_long_lines(docs))))
    stars = materialise(star_pairs(members))
    texts = materialise(among(_long_lines(docs), "id", nodes.select("id")).groupBy("id").agg(F.first("norm").alias("norm")).join(nodes, "id").select("node", "norm"))
    items = texts.select(F.col("node").alias("id"), F.col("norm").alias("items"))

    def test(pairs: DataFrame) -> DataFrame:
        return confirmed(pairs, items, lambda x, y: alike(x, y, percent))

    def sets(ids: DataFrame) -> DataFrame:
        units = texts.join(ids, "node", "left_semi").select("node", F.encode("norm", "UTF-32").alias("units"))
        return units.select("node", F.explode(shingles(F.col("units"))).alias("h"))

    part = linked_sets(stars, members, sets, test, percent)
    return part.join(nodes, "node").select("id", "component")


def _placed(docs: DataFrame, percent: int, *more: Column) -> DataFrame:
    """A row for each line: doc_id, line_no, id (null for short lines), more, first (the place of the component's first line, null for a line alone), kept."""
    part = _line_classes(docs, percent)
    found = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), *more, F.posexplode_outer(normal_lines(text_of())).alias("line_no", "norm"))
    found = materialise(found.withColumn("id", F.when(F.length("norm") >= WIDTH, F.xxhash64("norm"))).drop("norm"))
    some = found.where("id is not null")
    twice = some.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    classes = materialise(twice.join(part, "id", "full").select("id", F.coalesce("component", F.col("id")).alias("component"), F.col("component").isNotNull().alias("linked")))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no", "text_hash")
    first = some.join(classes, "id").groupBy("component", "linked").agg(F.min(place).alias("first"))
    firsts = materialise(classes.join(first, ["component", "linked"]).select("id", "first"))
    return found.join(firsts, "id", "left").withColumn("kept", F.col("first").isNull() | (place == F.col("first")))


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the lines that line_components() does not keep; n_chars, where there is such a column, follows the text.

    Line breaks between kept lines stay. A document of which no line is kept,
    because all of them stand in earlier documents, is left out; so are no
    others. Of rows that repeat both doc_id and text all but one keep only
    their lines without a shingle. All columns of docs come back, in their
    order, whatever their names. A null text is one empty line, which is kept;
    an empty table stays empty.
    """
    row = F.xxhash64("doc_id", "text")
    placed = _placed(docs, percent, row.alias("row"))
    short = F.col("id").isNull()
    flags = placed.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("line_no", "kept", short.alias("short")))).alias("flags"), F.min("kept").alias("all_kept"), F.min(short).alias("bare"))
    repeated = materialise(docs.groupBy(row.alias("row")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row", F.lit(True).alias("again")))
    changed = flags.join(repeated, "row", "left").where("not all_kept or (again and not bare)")
    changed = changed.select("row", F.col("flags.kept").alias("kept"), F.col("flags.short").alias("short"), F.coalesce("again", F.lit(False)).alias("again"))
    out = docs.select(whole(docs).alias("doc"), row.alias("row")).join(changed, "row", "left")
    if repeated.take(1):
        # only rows that repeat are numbered
        again = F.coalesce("again", F.lit(False))
        numbered = placed_within(out.where(again), "row", "at")
        numbered = numbered.withColumn("kept", F.when(F.col("at") == 1, F.col("kept")).otherwise(F.col("short"))).drop("at")
        out = out.where(~again).union(numbered)
    out = out.where(F.col("kept").isNull() | F.exists("kept", lambda x: x))
    flagged = F.arrays_zip(F.split(text_of("doc.text"), "\n").alias("line"), F.col("kept").alias("kept"))
    text = F.when(F.col("kept").isNull(), F.col("doc.text")).otherwise(F.array_join(F.transform(F.filter(flagged, lambda z: z["kept"]), lambda z: z["line"]), "\n"))
    out = out.select("doc", text.alias("text"))
    return unpacked(out, docs.columns, "doc", text=F.col("text"), n_chars=F.length("text").cast("long"))
