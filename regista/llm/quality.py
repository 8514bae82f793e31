"""Quality rules: repetition counts, and divergence from language references, on built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regista.llm.common import materialise, text_of, unpacked, whole, words
from regista.llm.linking import BROADCAST_IDS

#: What base_counts() adds.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
WINDOW = 5
MIN_WORDS = 10
#: A text fails if more than this percentage of its words lie in repeated windows.
MAX_REPEATED = 20
#: Shorter texts are not held against a reference: code points for characters, letter runs for words.
MIN_CHARS, MIN_TERMS = 200, 120
#: Greatest Jensen-Shannon distance (base 2, 0 to 1) from the reference of the language.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.28
#: A language needs this share of the documents that are long enough to get a reference of its own, so that there are 1000 at most; others share one.
MIN_SHARE = 0.001

#: Character classes, as Java patterns; odd characters, which are in none of KNOWN, and the rest, mostly lower-case letters, form two more.
CLASSES = (r"\x20\x09-\x0D", r"\p{Lu}", r"\p{Lo}\p{Lt}\p{Lm}\p{M}", r"\p{Nd}", r".,;:!?'\"()\-", r"#*$%&|<>")
KNOWN = r"\p{L}\p{M}\p{Nd}\x20\x09-\x0D.,;:!?'\"()\-#*$%&|<>"
#: Common words of a few languages: fixed values, public knowledge.
COMMON = (
    "the", "of", "and", "to", "a", "in", "is", "it", "that", "was", "for", "on", "with", "as", "be",
    "de", "la", "le", "et", "les", "des", "en", "un", "que", "qui", "pour",
    "der", "die", "und", "das", "von", "zu", "den", "ist", "mit",
    "el", "los", "y", "se", "por", "del", "con", "o", "e", "do",
)


def _repeated(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words to docs with _w, their words. Windows are compared as strings, so nothing rests on a hash."""
    n = F.size("_w")
    slices = [F.slice("_w", F.lit(k + 1), F.greatest(n - (WINDOW - 1), F.lit(0))).alias(str(k)) for k in range(WINDOW)]
    windows = F.arrays_zip(*slices).cast("array<string>")  # words have no blanks, so the printed windows differ where the words do
    docs = docs.withColumn("_g", F.when(n >= WINDOW, windows))
    some = F.size(F.array_distinct("_g")) < F.size("_g")
    numbered = F.sort_array(F.arrays_zip(F.col("_g").alias("g"), F.sequence(F.lit(0), F.size("_g") - 1).alias("i")))
    docs = docs.withColumn("_s", F.when(some, numbered)).drop("_g")
    s = F.col("_s")
    twice = F.filter("_s", lambda x, k: F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)))
    docs = docs.withColumn("_p", F.when(s.isNotNull(), F.array_sort(F.transform(twice, lambda x: x["i"])))).drop("_s")
    p = F.col("_p")
    steps = F.zip_with(F.slice(p, 2, F.size(p)), p, lambda b, a: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return docs.withColumn("n_repeat_words", F.when(p.isNotNull(), covered).otherwise(F.lit(0).cast("long"))).drop("_p")


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    docs = docs.withColumn("_w", words(text)).withColumn("_l", lines)
    docs = docs.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        }
    ).drop("_l")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return _repeated(docs).drop("_w").withColumn("base_failed", failed)


def histograms(docs: DataFrame) -> DataFrame:
    """Adds _chars and _terms: counts by character class and by common word, the rest last; null for texts too short to compare."""
    text = text_of()
    counts = [F.length(F.regexp_replace(text, f"[^{c}]+", "")) for c in CLASSES] + [F.length(F.regexp_replace(text, f"[{KNOWN}]+", ""))]
    found = F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")
    docs = docs.withColumn("_counts", F.array(*counts)).withColumn("_all", found).withColumn("_n", F.size("_all")).withColumn("_hits", F.filter("_all", lambda w: w.isin(*COMMON)))
    each = [F.size("_hits") - F.size(F.array_remove("_hits", w)) for w in COMMON]
    return docs.withColumns(
        {
            "_chars": F.when(F.length(text) >= MIN_CHARS, F.concat("_counts", F.array(F.length(text) - F.aggregate("_counts", F.lit(0), lambda a, x: a + x)))),
            "_terms": F.when(F.col("_n") >= MIN_TERMS, F.array(*each, F.col("_n") - F.size("_hits"))),
        }
    ).drop("_counts", "_hits", "_n", "_all")


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / total)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays that each sum to 1; null if either is null."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / ((x + y) / 2))).otherwise(F.lit(0.0))

    each = F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2)
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.when(total < 0, F.lit(0.0)).otherwise(total))


def references(h: DataFrame) -> DataFrame:
    """Mean histograms (lang, ref_chars, ref_terms) of the documents (lang, _chars, _terms) that are long enough, one row for each frequent language and one with lang null for all documents together."""
    h = h.select("lang", _shares(F.col("_chars")).alias("c"), _shares(F.col("_terms")).alias("t"))
    width = {"c": len(CLASSES) + 2, "t": len(COMMON) + 1}
    means = [F.avg(F.get(F.col(k), F.lit(i))).alias(f"{k}{i}") for k, n in width.items() for i in range(n)]
    sums = materialise(h.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("nt"), *means))
    total = sums.agg(F.sum("n")).first()[0] or 0

    def packed(df: DataFrame) -> DataFrame:
        full = {k: F.array(*[f"{k}{i}" for i in range(n)]) for k, n in width.items()}
        return df.select("lang", full["c"].alias("ref_chars"), F.when(F.col("t0").isNotNull(), full["t"]).alias("ref_terms"))

    pooled = [F.sum(F.col(f"{k}{i}") * F.col(w)) / F.sum(F.when(F.col(f"{k}{i}").isNotNull(), F.col(w))) for k, w in (("c", "n"), ("t", "nt")) for i in range(width[k])]
    names = [f"{k}{i}" for k, n in width.items() for i in range(n)]
    everything = sums.agg(*[p.alias(x) for p, x in zip(pooled, names, strict=True)]).where("c0 is not null").withColumn("lang", F.lit(None).cast("string"))
    own = sums.where(F.col("lang").isNotNull() & (F.col("n") >= F.lit(MIN_SHARE * total)))
    return packed(own.select("lang", *names)).unionByName(packed(everything.select("lang", *names)))


def judge(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Adds the counts of base_counts(), char_distance, word_distance and kept to docs (text, lang, ...).

    A text is held against the mean character-class and common-word histograms
    of its language, learnt from all documents of that language that are long
    enough. It is rejected if a base rule fails (fewer than 10 words, or more
    than 20 percent of its words in 5-word windows that the text repeats) or a
    distance exceeds its limit. Texts shorter than the guards have null
    distances and only the base rules hold. Documents without a language, or
    of a rare one, are held against the mean over all documents. A null text
    counts as ''. Rows are judged one by one, so repeated rows have equal
    results; added columns replace those of the same name, others stay as they
    are, whatever their names. Texts of any length are read whole, once. An
    empty table stays empty. With columns, some of docs that clash with no
    added one, only those and the added ones come back.
    """
    if columns is None:
        # worked on under names of their own, so that no column of docs can clash
        found = judge(docs.select(whole(docs).alias("doc"), "lang", "text"), ["doc"])
        new = [c for c in found.columns if c != "doc"]
        own = [c for c in docs.columns if c.lower() not in new]
        return found.select(*[F.col("doc").getField(c).alias(c) for c in own], *new)
    marked = histograms(base_counts(docs))
    marked = materialise(marked.select(*columns, F.col("lang").alias("_key"), *COUNTS, "_chars", "_terms"))
    long = marked.where("_chars is not null").withColumn("lang", F.col("_key"))
    refs = materialise(references(long))  # 1001 rows at most
    pooled = refs.where("lang is null").first()
    own = F.broadcast(refs.where("lang is not null").withColumnRenamed("lang", "_lang"))
    marked = marked.join(own, F.col("_key") == F.col("_lang"), "left")

    def far(counts: str, ref: str) -> Column:
        spare = F.array(*[F.lit(x) for x in pooled[ref]]) if pooled and pooled[ref] else F.lit(None).cast("array<double>")
        return distance(_shares(F.col(counts)), F.coalesce(ref, spare))

    def within(name: str, most: float) -> Column:
        return F.coalesce(F.col(name) <= most, F.lit(True))

    out = marked.withColumns({"char_distance": far("_chars", "ref_chars"), "word_distance": far("_terms", "ref_terms")})
    kept = ~F.col("base_failed") & within("char_distance", MAX_CHAR_DISTANCE) & within("word_distance", MAX_WORD_DISTANCE)
    out = out.withColumn("kept", kept)
    return out.drop("_lang", "_key", "ref_chars", "ref_terms", "_chars", "_terms")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns as they are, whatever their names.

    Verdicts are made once, on narrow rows, and cut from their lineage; the
    rejected rows, named by a hash of doc_id, lang and text, are then taken
    out. Rows that repeat another in these share its verdict. A null text is
    rejected, as it has fewer than 10 words; texts of any length are read
    whole; an empty table stays empty.
    """
    row = F.xxhash64("doc_id", "lang", "text")
    verdicts = materialise(judge(docs.select("lang", "text", row.alias("row")), ["row"]).select("row", "kept"))
    rejected = verdicts.where("not kept").select("row").distinct()
    if rejected.count() <= BROADCAST_IDS:
        rejected = F.broadcast(rejected)
    return unpacked(docs.select(whole(docs).alias("doc"), row.alias("row")).join(rejected, "row", "left_anti"), docs.columns, "doc")
