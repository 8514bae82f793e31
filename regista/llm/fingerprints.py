"""I-Match document fingerprints, on built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regista.llm.common import materialise, text_of, whole

#: Terms are kept if log(documents / documents with the term) lies in this band.
IDF_BAND = (2.3, 6.9)
#: Lexicon subsets: SCALES sizes of them, EACH of a size, a random half, quarter, eighth ... of the lexicon; the sizes are those of which a text holds about two terms, one, a half and a quarter. Large ones tell copies, small ones still agree after an edit.
SCALES, EACH = 4, 8
SUBSETS = SCALES * EACH
#: The lexicon is broadcast up to so many terms (8 bytes each), and joined by a shuffle beyond.
BROADCAST_TERMS = 1_000_000
#: Ranges in which neighbours are looked up; a range holds about the same number of rows.
RANGES, RANGE_ROWS = 1024, 2000
NOTHING = "-" * 16


def terms(text: Column) -> Column:
    """The distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def lexicon(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Hashes (term) of the terms in the band, by document frequencies over all documents.

    A term in the band stands in at least documents / exp(band[1]) documents,
    so there are exp(band[1]) (about 1000) times the mean number of distinct
    terms of a document at most.
    """
    n = docs.count()
    counts = docs.select(F.explode(terms(text_of())).alias("t")).groupBy(F.xxhash64("t").alias("term")).agg(F.count(F.lit(1)).alias("df"))
    return counts.where(F.log(F.lit(float(max(1, n))) / F.col("df")).between(*band)).select("term")


def subset_hashes(kept: Column) -> Column:
    """One hash for each lexicon subset, of the sorted distinct term hashes that lie in it; null if none does.

    Subset sizes follow the number of terms: of n terms, subsets of the share
    1 / 2 ** j are used for SCALES sizes from j = log2(n) - 1 on. A size has
    its own slots, by j modulo SCALES, and its number goes into the hash, so
    texts with about as many terms can be compared.
    """

    def of(s: Column) -> Column:
        def one(k: int) -> Column:
            size, mask = s["sizes"][k // EACH], s[f"mask{k // EACH}"]
            inside = F.filter(s["terms"], lambda t: F.xxhash64(t, F.lit(k)).bitwiseAND(mask) == 0)
            return F.get(F.transform(F.array(inside), lambda x: F.when(F.size(x) > 0, F.xxhash64(size, x))), F.lit(0))

        return F.array(*map(one, range(SUBSETS)))

    first = F.greatest(F.floor(F.log2(F.size(kept).cast("double"))).cast("int") - 1, F.lit(0))
    # sizes and masks are bound to variables, or else they would be worked out again for each term
    sized = F.transform(F.array(F.struct(kept.alias("terms"), first.alias("first"))), lambda s: F.struct(s["terms"].alias("terms"), F.array(*[s["first"] + F.pmod(F.lit(r) - s["first"], F.lit(SCALES)) for r in range(SCALES)]).alias("sizes")))
    masked = F.transform(sized, lambda s: F.struct(s["terms"].alias("terms"), s["sizes"].alias("sizes"), *[(F.call_function("shiftleft", F.lit(1).cast("long"), s["sizes"][r]) - 1).alias(f"mask{r}") for r in range(SCALES)]))
    return F.get(F.transform(masked, of), F.lit(0))


def hashes_of(kept: Column, every: Column) -> Column:
    """subset_hashes(kept); for a text without any term in the band the hash of all its distinct terms alone, so that unlike ones differ; for a text without terms, where both are null, nulls."""
    spare = F.concat(F.array(every), F.array_repeat(F.lit(None).cast("bigint"), SUBSETS - 1))
    return F.when(F.size(kept) > 0, subset_hashes(kept)).otherwise(spare)


def printed(hashes: Column) -> Column:
    """Subset hashes as text, NOTHING for a null."""
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit(NOTHING))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of the subsets with terms in a or b on which a and b agree; 1 if neither has any."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x == y, 2).when(x.isNull() & y.isNull(), 0).otherwise(1))
    used = F.size(F.filter(pairs, lambda x: x > 0))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.filter(pairs, lambda x: x == 2)) / used)


def _collected(texts: DataFrame, lex: DataFrame, keys: list[str]) -> DataFrame:
    """The subset hashes (hashes) of texts (keys, text); texts without any term have no row. A text's terms are combined in the task that reads it."""
    found = texts.select(*keys, F.explode_outer(terms(F.col("text"))).alias("t")).where("t is not null").select(*keys, F.xxhash64("t").alias("term"))
    both = found.join(lex, "term", "left").groupBy(*keys).agg(F.sort_array(F.collect_set(F.when(F.col("in_band"), F.col("term")))).alias("kept"), F.bit_xor("term").alias("every"))
    return both.select(*keys, hashes_of(F.col("kept"), F.col("every")).alias("hashes"))


def _lexicon_of(docs: DataFrame, band: tuple[float, float]) -> DataFrame:
    lex = materialise(lexicon(docs, band).withColumn("in_band", F.lit(True)))
    return F.broadcast(lex) if lex.count() <= BROADCAST_TERMS else lex


def fingerprint(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """docs (doc_id, text) with a column fingerprint, the joined subset hashes, in place of one of that name; a null text counts as ''. Other columns stay as they are, whatever their names; texts are read whole, equal texts once; an empty table stays empty."""
    lex = _lexicon_of(docs, band)
    kept = _collected(docs.select(F.xxhash64(text_of()).alias("key"), text_of().alias("text")).dropDuplicates(["key"]), lex, ["key"])
    out = docs.select(whole(docs).alias("doc"), F.xxhash64(text_of()).alias("key")).join(kept, "key", "left")
    hashes = F.coalesce("hashes", F.array_repeat(F.lit(None).cast("bigint"), SUBSETS))
    columns = [c for c in docs.columns if c.lower() != "fingerprint"]
    return out.select(*[F.col("doc").getField(c).alias(c) for c in columns], printed(hashes).alias("fingerprint"))


def compared(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Fingerprints of docs (doc_id, text) and of edited texts, and their likeness.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text has the last floor(n_chars / 2)
    code points replaced by the first as many of the next document in order of
    (doc_id, text), after the last the first. A fingerprint joins the hashes
    of 32 lexicon subsets. The lexicon holds the terms whose inverse document
    frequency, over all documents, lies in the band; a text without any such
    term has the hash of all its terms instead. A null text counts as ''; null
    ids come last, in an order of their own; equal texts have equal
    fingerprints. Texts of any length are read whole. One document is its own
    next. An empty table stays empty; other columns are ignored.
    """
    lex = _lexicon_of(docs, band)
    n = docs.count()
    cuts = min(RANGES, n // RANGE_ROWS)
    bounds = docs.approxQuantile("doc_id", [i / cuts for i in range(1, cuts)], 1 / (8 * cuts)) if cuts > 1 else []
    steps = F.array(*[F.lit(int(b)) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<bigint>")
    spread = F.lit(cuts + 1) + F.pmod(F.xxhash64(text_of()), F.lit(max(1, cuts)))  # rows without an id have an order of their own
    part = F.when(F.col("doc_id").isNull(), spread.cast("int")).otherwise(F.size(F.filter(steps, lambda b: b < F.col("doc_id"))))
    rows = docs.select(part.alias("part"), "doc_id", text_of().alias("text"))

    whole = Window.orderBy("part")  # a row for each range
    sizes = materialise(
        rows.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
        .select(
            "part",
            "least",
            F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
            F.coalesce(F.lag("part").over(whole), F.max("part").over(Window.partitionBy(F.lit(1)))).alias("before"),
        )
    )
    heads = rows.join(F.broadcast(sizes.select("part", "least", "before")), "part").where(F.col("doc_id").eqNullSafe(F.col("least")))
    heads = materialise(heads.groupBy("before").agg(F.min("text").alias("head")))

    inside = Window.partitionBy("part").orderBy("doc_id", "text")
    placed = rows.withColumns({"at": F.row_number().over(inside), "next": F.lead("text").over(inside)})
    placed = placed.join(heads.withColumnRenamed("before", "part"), "part", "left").withColumn("next", F.coalesce("next", "head")).drop("head")
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - half), F.substring("next", F.lit(1), half))
    placed = placed.select("part", "at", "doc_id", "text", edited.alias("edited"))

    both = placed.select("part", "at", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("v"))
    kept = _collected(both.select("part", "at", "v.which", "v.text"), lex, ["part", "at", "which"])
    kept = kept.groupBy("part", "at").agg(*[F.first(F.when(F.col("which") == w, F.col("hashes")), ignorenulls=True).alias(name) for w, name in ((0, "f"), (1, "e"))])
    none = F.array_repeat(F.lit(None).cast("bigint"), SUBSETS)
    told = placed.select("part", "at", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    told = told.join(kept, ["part", "at"], "left").join(F.broadcast(sizes.select("part", "start")), "part")
    told = materialise(
        told.select(
            (F.col("start") + F.col("at") - 1).alias("rank"), "doc_id", "n_chars", "edited_sha256",
            F.coalesce("f", none).alias("f"), F.coalesce("e", none).alias("e"),
        )
    )
    after = told.select(F.pmod(F.col("rank") - 1, F.lit(max(1, n))).alias("rank"), F.col("f").alias("g"))
    return told.join(after, "rank").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("f")).alias("fingerprint"),
        printed(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"),
        likeness(F.col("f"), F.col("g")).alias("near_next"),
    )
