"""Name expressions: keys, splitting, spelling variants, phonetic codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters with marks and their plain forms, position by position.
MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"
#: Titles that are no part of a name: fixed values.
TITLES = ("d", "don", "dom", "doña", "dona", "sr", "sra", "s", "snr", "snra")
#: Spelling folds of a search text, in order: fixed values.
FOLDS = (("ph", "f"), ("y", "i"), ("w", "v"), ("ck", "k"), ("th", "t"), ("joam", "joao"), ("theresa", "teresa"), ("thereza", "teresa"))
#: Phonetic rewrites, in order, and the digit of each consonant: fixed values.
REWRITES = (("PH", "F"), ("TH", "T"), ("RH", "R"), ("Y", "I"), ("W", "V"), ("LH", "L"), ("NH", "N"), ("CH", "X"), ("SC", "S"), ("XC", "S"))
SOUNDS = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6", "AEIOUH": "0"}
LINKS = ("de", "da", "do", "dos", "das", "e")


def without_accents(text: Column) -> Column:
    """The text with marked letters made plain; '' for null."""
    return F.coalesce(F.translate(text, MARKED, PLAIN), F.lit(""))


def token_key(token: Column) -> Column:
    """Lower-case ASCII letters and digits of a token: "D'Ávila" gives 'davila'."""
    return F.regexp_replace(F.lower(without_accents(token)), "[^a-z0-9]", "")


def match_key(name: Column) -> Column:
    """A whole name for comparison: no accents, lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(without_accents(name)), r"\s+", " "))


def tokens(name: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(name, F.lit("")), r"\s+"), "")


def untitled(name: Column) -> Column:
    """Tokens of a name that are no titles."""
    return F.filter(tokens(name), lambda t: ~F.lower(F.regexp_replace(t, r"[.,;:]+$", "")).isin(*TITLES))


def given_name(name: Column) -> Column:
    """All tokens but the last, or the only one; at most 100 characters."""
    t = untitled(name)
    given = F.when(F.size(t) > 1, F.array_join(F.slice(t, F.lit(1), F.size(t) - 1), " ")).otherwise(F.array_join(t, " "))
    return F.substring(given, 1, 100)


def surname(name: Column) -> Column:
    """The last of several tokens, at most 50 characters; '' for one token."""
    t = untitled(name)
    return F.when(F.size(t) > 1, F.substring(F.element_at(t, -1), 1, 50)).otherwise(F.lit(""))


def surnames(name: Column) -> Column:
    """Surname candidates: each link word with its next token, and every token from the third on."""
    t = tokens(name)
    linked = F.filter(F.transform(t, lambda x, i: F.when(F.lower(x).isin(*LINKS) & (i + 1 < F.size(t)), F.concat_ws(" ", F.lower(x), F.get(t, i + 1)))), lambda x: x.isNotNull())
    later = F.filter(F.transform(t, lambda x, i: F.when((i >= 1) & ~F.lower(x).isin(*LINKS), x)), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(linked, later))


def folded(text: Column) -> Column:
    """A search text in its modern spelling."""
    out = F.lower(without_accents(text))
    for old, new in FOLDS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def phonetic_code(word: Column) -> Column:
    """Portuguese phonetic code: a letter and three digits; '0000' for a word without letters.

    Neighbouring letters of one sound count once; vowels, H and letters without
    a sound part them. The sounds become digits, runs of a digit shrink to one,
    the first letter's own digit and all 0 go.
    """
    text = F.regexp_replace(F.upper(without_accents(word)), "[^A-Z]", "")
    for old, new in REWRITES:
        text = F.replace(text, F.lit(old), F.lit(new))
    letters, digits = "".join(SOUNDS), "".join(d * len(k) for k, d in SOUNDS.items())
    sounds = F.translate(text, letters, digits)
    for d in "0123456":
        sounds = F.regexp_replace(sounds, f"{d}+", d)
    tail = F.replace(F.substring(sounds, F.lit(2), F.length(sounds)), F.lit("0"), F.lit(""))
    return F.when(text == "", F.lit("0000")).otherwise(F.substring(F.concat(F.substring(text, 1, 1), tail, F.lit("000")), 1, 4))


def phonetic_pairs(words: DataFrame) -> DataFrame:
    """(first, second, code): the pairs of distinct words (word) with the same phonetic code, the lesser first; words without a letter have none."""
    coded = words.select("word", phonetic_code(F.col("word")).alias("code")).where("code <> '0000'")
    return coded.withColumnRenamed("word", "first").join(coded.withColumnRenamed("word", "second"), "code").where("first < second").select("first", "second", "code")


def variant_table(clusters: DataFrame) -> DataFrame:
    """(norm, variant) from spelling clusters (cluster, name): each key with every spelling of its clusters. A key may lie in several clusters."""
    keyed = clusters.select("cluster", "name", token_key(F.col("name")).alias("norm"))
    return keyed.alias("k").join(clusters.alias("v"), "cluster").select("k.norm", F.col("v.name").alias("variant")).distinct()


def expanded_variants(queries: DataFrame, clusters: DataFrame, most: int = 32) -> DataFrame:
    """Spellings of each query (query): all combinations of its tokens' variants, itself first, at most so many; a token without a cluster stands for itself."""
    table = variant_table(clusters).groupBy("norm").agg(F.sort_array(F.collect_set("variant")).alias("variants"))
    each = queries.select("query", F.posexplode(tokens(F.col("query"))).alias("at", "token")).withColumn("norm", token_key(F.col("token")))
    each = each.join(table, "norm", "left").withColumn("all", F.array_distinct(F.concat(F.array("token"), F.coalesce("variants", F.array().cast("array<string>")))))
    lists = each.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "all"))), lambda x: x["all"]).alias("lists"))

    def product(acc: Column, words: Column) -> Column:
        joined = F.flatten(F.transform(acc, lambda a: F.transform(words, lambda w: F.ltrim(F.concat_ws(" ", a, w)))))
        return F.slice(joined, 1, most * most)

    combos = F.aggregate("lists", F.array(F.lit("")), product)
    unique = F.filter(combos, lambda x, i: F.array_position(F.transform(combos, F.lower), F.lower(x)) == i + 1)
    return lists.select("query", F.slice(unique, 1, most).alias("variants"))


def gedcom_name(name: Column) -> Column:
    """'Ana da Silva' as 'Ana /da Silva/'; a single name between slashes."""
    t = untitled(name)
    rest = F.array_join(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), " ")
    return F.when(F.size(t) > 1, F.concat(F.element_at(t, 1), F.lit(" /"), rest, F.lit("/"))).when(F.size(t) == 1, F.concat(F.lit("/"), F.element_at(t, 1), F.lit("/")))


def gedcom_date(date: Column) -> Column:
    """A date as '15 JAN 1864'."""
    return F.concat(F.dayofmonth(date).cast("string"), F.lit(" "), F.upper(F.date_format(date, "MMM")), F.lit(" "), F.year(date).cast("string"))
