"""From page documents to one table of persons and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regista.functions.dates import lenient_date, strict_date
from regista.functions.names import given_name, surname
from regista.functions.text import SHORT, death_details, page_reason, person_in_text


def _text(*keys: str, n: int = 100) -> Column:
    """The first of several keys that is not empty, cut."""
    return F.substring(F.coalesce(*[F.nullif(F.trim(F.col(k)), F.lit("")) for k in keys]), 1, n)


def whole_number(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^-?\d{1,9}$"), F.trim(text).cast("int"))


def joined_names(names: Column) -> Column:
    """A list of names as one text, blanks left out; null for none."""
    return F.nullif(F.array_join(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""), "; "), F.lit(""))


def _named(rows: DataFrame, name: Column) -> DataFrame:
    return rows.withColumn("_name", name).where("_name is not null").withColumns({"nome": given_name(F.col("_name")), "sobrenome": surname(F.col("_name"))}).drop("_name")


def marriage_persons(pages: DataFrame) -> DataFrame:
    """Two persons of each marriage entry, each with the other as spouse; a bride or groom without a name is left out."""
    e = pages.select("file_id", "transcription", F.posexplode("persons").alias("at", "e"))

    def side(own: str, other: str, p: str) -> Column:
        return F.struct(
            _text(f"e.{own}").alias("name"), _text(f"e.{other}").alias("conjuge"), _text(f"e.{p}father").alias("pai"), _text(f"e.{p}mother").alias("mae"),
            _text(f"e.{p}naturalidade").alias("naturalidade"), _text(f"e.{p}estado_civil").alias("estado_civil"), whole_number(F.col(f"e.{p}idade")).alias("idade"), _text(f"e.{p}ocupacao").alias("profissao"), F.lit("groom" if own == "name" else "bride").alias("papel"),
        )

    both = e.select("file_id", "at", strict_date(F.col("e.marriage_date")).alias("data_casamento"), joined_names(F.col("e.testemunhas")).alias("testemunhas"), _text("e.numero_assento", n=20).alias("numero_assento"), F.explode(F.array(side("name", "spouse", ""), side("spouse", "name", "spouse_"))).alias("p"))
    rows = _named(both.select("file_id", "at", "data_casamento", "testemunhas", "numero_assento", "p.*"), F.col("name")).drop("name")
    return rows.withColumn("tipo_registo", F.lit("MARR"))


def baptism_persons(pages: DataFrame) -> DataFrame:
    e = pages.select("file_id", F.posexplode("baptized").alias("at", "e"))
    more = {"pai": ("father", "pai"), "mae": ("mother", "mae"), "avo_paterno": ("avo_paterno",), "avo_paterna": ("avo_paterna",), "avo_materno": ("avo_materno",), "avo_materna": ("avo_materna",), "godfather": ("godfather",), "godmother": ("godmother",), "legitimidade": ("legitimidade",), "naturalidade": ("place", "father_naturalidade"), "assinatura": ("assinatura",)}
    rows = e.withColumns({c: _text(*[f"e.{k}" for k in keys]) for c, keys in more.items()})
    rows = rows.withColumn("data_nascimento", F.coalesce(strict_date(F.col("e.birth_date")), strict_date(F.col("e.baptism_date"))))
    return _named(rows, _text("e.name", "e.nome")).drop("e").withColumn("tipo_registo", F.lit("BIRT"))


def death_persons(pages: DataFrame) -> DataFrame:
    """Persons of death entries; of a page with one entry, details of its transcription fill what the entry lacks."""
    e = pages.select("file_id", "transcription", F.size("deceased").alias("n"), F.posexplode("deceased").alias("at", "e"))
    more = {"pai": ("father", "pai"), "mae": ("mother", "mae"), "conjuge": ("spouse", "conjuge"), "testamento": ("testamento",)}
    rows = e.withColumns({c: _text(*[f"e.{k}" for k in keys]) for c, keys in more.items()})
    rows = rows.withColumn("d", F.when(F.col("n") == 1, death_details(F.col("transcription"))))
    rows = rows.withColumns({"data_obito": strict_date(F.col("e.death_date")), "idade": F.coalesce(whole_number(F.col("e.age")), F.col("d.idade")), "testamento": F.coalesce("testamento", "d.testamento")})
    rows = rows.withColumns({c: F.col(f"d.{c}") for c in ("causa_morte", "naturalidade", "numero_assento", "hora_obito", "profissao", "estado_civil", "sacramentos", "local_sepultamento", "assinatura")})
    return _named(rows, _text("e.name", "e.nome")).drop("e", "d", "n", "transcription").withColumn("tipo_registo", F.lit("DEAT"))


def text_persons(pages: DataFrame, noise: tuple[str, ...] = ()) -> DataFrame:
    """The person of pages without entries whose text is a death record; noise are the words, in lower case, that are no parts of names."""
    empty = F.lit(True)
    for c in ("deceased", "baptized", "persons"):
        empty = empty & (F.coalesce(F.size(c), F.lit(0)) <= 0)
    # the length is asked for by itself, so that the optimizer leaves out the whole branch where pages have no text
    rows = pages.where((F.length("raw_text") >= SHORT) & empty & (F.upper(F.coalesce("record_type", F.lit("DEAT"))) == "DEAT") & (page_reason(F.col("raw_text")) == "valid"))
    # explode(), so that the filter has the person as a column, or else the text would be read for the filter and again for the row
    rows = rows.select("file_id", F.lit(0).alias("at"), "raw_text", F.explode(F.array(person_in_text(F.col("raw_text"), noise))).alias("p")).where("p is not null")
    return rows.select("file_id", "at", "p.nome", "p.sobrenome", strict_date(F.col("raw_text")).alias("data_obito"), F.substring("raw_text", 1, 4000).alias("texto_original"), F.lit("DEAT").alias("tipo_registo"))


def persons(pages: DataFrame, noise: tuple[str, ...] = ()) -> DataFrame:
    """The person table of page documents: baptisms before marriages before deaths before running text, one form for each page; see text_persons() for noise."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    births, weddings = pages.where(n("baptized")), pages.where(~n("baptized") & n("persons"))
    deaths = pages.where(~n("baptized") & ~n("persons") & n("deceased"))
    parts = [baptism_persons(births), marriage_persons(weddings), death_persons(deaths), text_persons(pages, noise)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def simple_rows(records: DataFrame) -> DataFrame:
    """Older form: records (nome, data, qualidade, ...) with names of three letters or more, a date, its year, status pending and quality 0.5 where none is given."""
    date = lenient_date(F.col("data"))
    rows = records.where(F.length(F.trim("nome")) >= 3).withColumns({"data": date, "ano": F.year(date), "status": F.lit("pendente")})
    return rows.withColumn("qualidade", F.coalesce("qualidade", F.lit(0.5))) if "qualidade" in records.columns else rows.withColumn("qualidade", F.lit(0.5))
