import datetime

import pytest
from pyspark.sql import functions as F

from regista.functions import dates, names, text


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize("value, expected", [("João", "Joao"), (None, ""), ("Ação", "Acao")])
def test_accents(spark, value, expected):
    assert one(spark, names.without_accents, value) == expected


@pytest.mark.parametrize("value, expected", [("  D'Ávila  ", "davila"), ("São-Pedro!", "saopedro"), (None, "")])
def test_token_key(spark, value, expected):
    assert one(spark, names.token_key, value) == expected


CODES = {"João": "J000", "Joam": "J500", "Teresa": "T620", "Theresa": "T620", "Filipe": "F410", "Philipe": "F410", "Luis": "L200", "Luiz": "L200", "Luys": "L200", "Mateus": "M320", "Matheus": "M320", "Manuel": "M540", "Gonçalves": "G524", "Xavier": "X160", "Sancho": "S520", "Ana": "A500", "Inês": "I520", "": "0000", "123": "0000"}


@pytest.mark.parametrize("word", CODES)
def test_phonetic_code(spark, word):
    assert one(spark, names.phonetic_code, word) == CODES[word]


def test_a_letter_of_two_sounds_alone_has_pairs(spark):
    words = spark.createDataFrame([("ß",), ("Sé",), ("S",), ("1",), ("",)], "word string")
    assert {tuple(r) for r in names.phonetic_pairs(words).collect()} == {("S", "Sé", "S000"), ("S", "ß", "S000"), ("Sé", "ß", "S000")}


@pytest.mark.parametrize("name, given, last", [("Dom João da Silva", "João da", "Silva"), ("Ana", "Ana", ""), ("  ", "", "")])
def test_name_split(spark, name, given, last):
    assert one(spark, names.given_name, name) == given
    assert one(spark, names.surname, name) == last


def test_gedcom_name(spark):
    assert one(spark, names.gedcom_name, "D. Ana da Silva") == "Ana /da Silva/"
    assert one(spark, names.gedcom_name, "Ana") == "/Ana/"


def test_variants(spark):
    clusters = spark.createDataFrame([(1, "João"), (1, "Joam"), (1, "Joan"), (2, "Manuel"), (2, "Manoel")], "cluster int, name string")
    queries = spark.createDataFrame([("joao Manoel",), ("Zulmira",)], "query string")
    found = {r["query"]: r["variants"] for r in names.expanded_variants(queries, clusters).collect()}
    assert found["Zulmira"] == ["Zulmira"]
    assert found["joao Manoel"][0] == "joao Manoel"
    assert len(found["joao Manoel"]) == 4 * 2
    assert "Joam Manuel" in found["joao Manoel"]


STRICT = {"2020-3-5": "2020-03-05", "05/12/1899": "1899-12-05", "3 de Maio de 1901": "1901-05-03", "13/13/1901": None, "1499-05-03": None, "": None, None: None, "1892-02-00": "1892-02-01", "1900-02-29": None, "Aos vinte e dois dias do mes de março de mil oitocentos e noventa e dois annos faleceu": "1892-03-22", "no dia dez de maio de mil setecentos e trinta": "1730-05-10"}


@pytest.mark.parametrize("value", STRICT)
def test_strict_date(spark, value):
    expected = STRICT[value] and datetime.date.fromisoformat(STRICT[value])
    assert one(spark, dates.strict_date, value) == expected


def test_year_words(spark):
    assert one(spark, dates.year_number, "mil oito centos e noventa e dois") == 1892
    assert one(spark, dates.year_number, "mil") is None
    assert one(spark, dates.day_number, "vinte e hum") == 21


def test_lenient_date(spark):
    assert one(spark, dates.lenient_date, "em 1834") == datetime.date(1834, 1, 1)
    assert one(spark, lambda c: dates.lenient_date(c, bare_year=False), "em 1834") is None
    assert one(spark, dates.lenient_date, "7 de nada de 1834") == datetime.date(1834, 1, 7)


def test_period_and_pages(spark):
    assert tuple(one(spark, dates.period, "1654-1790")) == (1654, 1790)
    assert tuple(one(spark, dates.period, "1654")) == (1654, None)
    assert one(spark, dates.page_numbers, "1-3, 10,x") == [1, 2, 3, 10]


def test_details(spark):
    t = "Assento n.º 12. Faleceu com setenta e dois annos, natural da Guarda, viúva, moleira, não fez testamento, recebeu os sacramentos. Pároco João Sena"
    d = one(spark, text.death_details, t)
    assert (d["idade"], d["naturalidade"], d["numero_assento"], d["estado_civil"], d["testamento"], d["sacramentos"]) == (72, "Guarda", "12", "viúva", "não fez testamento", "recebeu os sacramentos")


def test_person_in_text(spark):
    t = "Livro de assentos desta freguesia. Aqui jaz D. Manuel de Sousa Pinto que foi desta terra"
    assert tuple(one(spark, text.person_in_text, t)) == ("Manuel Sousa", "Pinto")
    assert one(spark, text.person_in_text, "curto") is None


ENTRY = "com sessenta e cinco anos e com doze filhos"
READ = {
    ("idade", ENTRY): 65,
    ("idade", "com sua mulher, com quarenta annos"): 40,
    ("idade", "com 200 annos"): 200,
    ("idade", "com trinta. Annos depois"): None,
    ("causa_morte", "faleceu de bexigas. morte repentina"): "faleceu de bexigas",
    ("causa_morte", "foi morte repentina, faleceu de bexigas"): "morte repentina",
    ("naturalidade", "natural de Ié, natural da Guarda"): "Guarda",
    ("naturalidade", "natural da " + "x" * 70): "x" * 60,
    ("hora_obito", "às 3 horas e pelas 7 horas da tarde"): "7h da tarde",
    ("profissao", "o Sapateiro e a moleira"): "sapateiro",
    ("sacramentos", "sem sacramentos e recebeu os sacramentos"): "recebeu os sacramentos",
    ("testamento", "fez testamento mas não fez testamento"): "não fez testamento",
    ("local_sepultamento", "sepultado nesta igreja, sepultada no novo cemitério de São João"): "novo cemitério de São João",
    ("local_sepultamento", "sepultado no cemitério"): "no cemitério",
    ("assinatura", "O Pároco, João. Cura Ana de Sá. Fim, etc"): "Ana de Sá. Fim",
}


def test_fields_of_entries(spark):
    rows = [(k, field, phrase) for k, (field, phrase) in enumerate(READ)]
    found = spark.createDataFrame(rows, "k int, field string, t string").select("k", text.death_details(F.col("t")).alias("d")).collect()
    assert {rows[r.k][1:]: r.d[rows[r.k][1]] for r in found} == READ
    assert not any(one(spark, text.death_details, None).asDict().values())


NAMED = {
    "escrito por mim, e o Cura Ana de Sá Pinto o leu, com D. Rui, aos tres": ("Ana", "Pinto"),
    "disse o Padre José, e mais o Padre Luis Leal, que assim o fizeram": ("Luis", "Leal"),
    "era filho de Sousa e filho de Pedro Nunes, que Deus tem em sua gloria": ("Pedro", "Nunes"),
    "D. Ana de Lima Rosa Maria Vaz Pires Leal, senhora desta terra e casa": ("Ana Lima Rosa Maria", "Vaz"),
    "morreu o Zé Ruivo da Costa, que morava junto da ponte e da ribeira velha": ("Ruivo", "Costa"),
    "morreu a Ana Sousa-Pinto, que morava junto da ponte e da ribeira velha": ("Ana", "Sousa"),
}


@pytest.mark.parametrize("phrase", NAMED)
def test_names_after_lead_ins(spark, phrase):
    assert tuple(one(spark, text.person_in_text, phrase)) == NAMED[phrase]


def test_noise_words_are_no_names(spark):
    phrase = "consta que D. Freguesia de Santa, e D. Ana Freguesia Vaz, são desta terra"
    assert tuple(one(spark, lambda c: text.person_in_text(c, ("freguesia",)), phrase)) == ("Ana", "Vaz")


def test_years_of_many_forms(spark):
    words = {"mil e seis cento e sete": 1607, "mil, setecentos centos e dous": 1702, "mil quinhentos noventa e nove da era": 1599, "mil oitocentos e vinte annos e dez": 1820, "1850": 1850, "": None, "nada": None}
    assert {w: one(spark, dates.year_number, w) for w in words} == words
    assert [one(spark, dates.day_number, w) for w in ("trinta e hum", "vinte e dez", "vinte", "muitos", "")] == [31, None, 20, None, None]


def test_line_readers(spark):
    pages = spark.createDataFrame([("f", "12. Ana da Silva, 3/4/1801, filha de José da Silva e de Maria Sousa\n\nJoão Pinto - 1790\nnada")], "file_id string, text string")
    found = {r["line_no"]: r for r in text.baptism_lines(pages).collect()}
    assert found[1]["number"] == "12" and found[1]["date"] == datetime.date(1801, 4, 3) and found[1]["mother"] == "Maria Sousa"
    assert found[3]["year"] == 1790
    assert text.death_lines(pages).count() == 1
    assert one(spark, text.unmistaken, "18O1 “Ola” Olga") == '1801 "Ola" Olga'


def test_quality_score(spark):
    df = spark.createDataFrame([("Ana Silva", datetime.date(1800, 1, 1), "3"), (None, None, None)], "n string, d date, k string")
    got = [r[0] for r in df.select(text.record_quality(F.col("n"), F.col("d"), F.col("k"))).collect()]
    assert got == [1.0, 0.4]
