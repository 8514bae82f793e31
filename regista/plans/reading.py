"""Queries that read entries word by word: details, names and dates, in many forms, each before the whole text of a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regista.functions import dates, text
from regista.plans.registry import Tables, query

#: For each detail, forms of it in a text and what is to be read of each. {k} is the document's id, {h} an hour from 1 to 12.
DETAILS = {
    "numero_assento": (("Assento n.º {k}", "{k}"), ("assento nº {k}", "{k}"), ("ASSENTO N. {k}", "{k}"), ("Assento n.{k}", "{k}"), ("Livro de assentos", None)),
    "idade": (("com {h} annos", "{h}"), ("com sessenta e dois anos", "62"), ("com idade de cento e tres annos", "103"), ("com duzentos anos", None), ("com muitos annos", None), ("com vinte annos", "20"), ("de poucos anos", None)),
    "causa_morte": (("morte repentina", "morte repentina"), ("Faleceu de febre maligna", "Faleceu de febre maligna"), ("faleceu de repente em sua casa", "faleceu de repente em sua casa"), ("faleceu em paz", None)),
    "naturalidade": (("natural da Guarda", "Guarda"), ("natural e morador na Vila Nova de Foz", "Vila Nova de Foz"), ("NATURAL de {k} lugares", "{k} lugares"), ("natural desta terra", None)),
    "hora_obito": (("pelas {h} horas da noite", "{h}h da noite"), ("pela 1 hora da tarde", "1h da tarde"), ("às {h} horas", "{h}h"), ("à 1 hora", "1h"), ("pelas {h} horas", None), ("de noite", None)),
    "profissao": (*((w, w.lower()) for w in ("Moleira", "pedreiro", "proprietário", "Lavrador", "jornaleira", "sapateiro", "alfaiate")), ("sem officio", None), ("lavradores", None)),
    "estado_civil": (*((w, w.lower()) for w in ("viúva", "Casado", "solteira", "menor", "inocente")), ("de estado incerto", None)),
    "sacramentos": (("recebeu os sacramentos", "recebeu os sacramentos"), ("Sem sacramentos", "sem sacramentos"), ("sem receber sacramentos", "sem sacramentos"), ("pediu os sacramentos", None)),
    "testamento": (("fez testamento", "fez testamento"), ("Não fez testamento", "não fez testamento"), ("deixou testamento", None)),
    "local_sepultamento": (("sepultada no antigo cemitério da vila", "antigo cemitério da vila"), ("foi sepultado no segundo cemiterio", "segundo cemiterio"), ("sepultado nesta igreja matriz", "nesta igreja matriz"), ("sepultado ali", None), ("levado para fora", None)),
    "assinatura": (("O Pároco João de Andrade Sena", "João de Andrade Sena"), ("o vigário Manuel P. Pires", "Manuel P. Pires"), ("Prior Dinis", "Dinis"), ("a igreja", None)),
}
#: Forms of names and what is to be read of each: given names, surname. Only the first seven leads stand before a document's text.
NAMES = (
    ("foi visto o corpo de D. Manuel de Sousa Pinto desta terra", "Manuel Sousa", "Pinto"),
    ("D. Ana e D. Rita Maria da Luz Vaz, ambas destas casas e terras", "Rita Maria Luz", "Vaz"),
    ("no Livro desta igreja consta o Obito de Maria Rosa, que Deus tem", "Maria", "Rosa"),
    ("no Assento da Joana Vaz Pires Leal Souto se diz o que se segue aqui", "Joana Vaz Pires", "Leal"),
    ("na presença do Padre José do Carmo que o escreveu de seu punho", "José", "Carmo"),
    ("o muito Reverendo Padre Luis Antunes fez o que era de seu officio", "Luis", "Antunes"),
    ("e eu Reverendo Simão Vaz o fiz escrever nesta casa e nesta terra", "Simão", "Vaz"),
    ("perante mim Vigário Antonio Leal, nesta casa e nesta mesma terra", "Antonio", "Leal"),
    ("o Escrivão Pedro da Cunha e Sá escreveu isto nesta casa e nesta terra", "Pedro", "Cunha"),
    ("era ella filha de Domingos Alves, lavrador e homem bom desta terra", "Domingos", "Alves"),
    ("deixou por herdeira minha sobrinha Clara Nunes e mais ninguem della", "Clara", "Nunes"),
    ("aos trinta annos faleceo o tomé gil que morava junto daquella ponte", None, None),
    ("nada se sabe de quem seja, nem donde veio, nem que nome tinha elle", None, None),
)
LAST_NAMES = (
    ("consta que Bento de Lemos morava naquella casa junto da ponte velha", "Bento", "Lemos"),
    ("por doença morreo a Luzia Ramos Vaz, pessoa pobre e sem herdeiros", "Luzia Ramos", "Vaz"),
    ("sendo de idade falleceu Gaspar Velho, sem herdeiros que se saibam", "Gaspar", "Velho"),
)
#: Forms of dates and what is to be read of each.
DATES = (
    ("Aos vinte e dois dias do mes de março de mil oito centos e noventa e dois annos faleceu", "1892-03-22"),
    ("Em os tres dias do mez de septembro, mil settecentos e quarenta annos", "1740-09-03"),
    ("aos trinta e hum de Janeiro de mil novecentos", "1900-01-31"),
    ("Em dez de mayo de mil seiscentos e dous falece", "1602-05-10"),
    ("no dia dezanove de outubro de mil quinhentos noventa e nove foi", "1599-10-19"),
    ("no dia trinta de fevereiro de mil oitocentos, e a 7 de abril de 1801", "1801-04-07"),
    ("a 5 de Junho de 1790, aos quatro de julho de mil setecentos e noventa annos", "1790-07-04"),
    ("aos dois de agosto de mil oitocentos e dez e aos seis dias do mes de maio de mil oitocentos e onze annos", "1811-05-06"),
    ("---TRANSCRIPTION--- em oito de dezembro de mil sete centos e trinta", "1730-12-08"),
    ("31 de abril de 1800 e 12 de dez de 1800", "1800-12-12"),
    ("aos vinte e quarenta de maio de mil e sem conta", None),
    ("sem data alguma", None),
)


def _chosen(forms: tuple, of: int, k: Column) -> Column:
    """The part of of the form whose number is k modulo their number."""
    told = F.get(F.array(*[F.lit(f[of]) for f in forms]), (k % len(forms)).cast("int"))
    return F.replace(F.replace(told, F.lit("{k}"), k.cast("string")), F.lit("{h}"), (k % 12 + 1).cast("string"))


def _sql(forms: tuple, of: int, shift: int = 0) -> str:
    values = ", ".join("NULL" if f[of] is None else "'" + f[of].replace("'", "''") + "'" for f in forms)
    return f"replace(replace([{values}][(doc_id + {shift}) % {len(forms)} + 1], '{{k}}', CAST(doc_id + {shift} AS VARCHAR)), '{{h}}', CAST((doc_id + {shift}) % 12 + 1 AS VARCHAR))"


@query("SELECT doc_id, " + ", ".join(f"CAST({_sql(forms, 1, n)} AS {'INTEGER' if c == 'idade' else 'VARCHAR'}) AS {c}" for n, (c, forms) in enumerate(DETAILS.items())) + " FROM documents")
def death_entry_fields(spark, sf_dir):
    """All details of death entries in all their forms; the whole text of a document follows each entry."""
    entry = F.concat_ws(", ", *[_chosen(forms, 0, F.col("doc_id") + n) for n, forms in enumerate(DETAILS.values())], F.concat_ws(". ", F.lit("e assim"), "text"))
    return Tables(spark, sf_dir).documents.select("doc_id", text.death_details(entry).alias("d")).select("doc_id", *[f"d.{c}" for c in DETAILS])


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN {_sql(LAST_NAMES, 1)} ELSE {_sql(NAMES, 1)} END AS nome, CASE WHEN doc_id % 4 = 0 THEN {_sql(LAST_NAMES, 2)} ELSE {_sql(NAMES, 2)} END AS sobrenome FROM documents
""")
def names_after_lead_ins(spark, sf_dir):
    """Names behind all their lead-ins; the first ones stand before the whole text of a document in small letters, in which no other name is."""
    k = F.col("doc_id")
    told = F.when(k % 4 == 0, _chosen(LAST_NAMES, 0, k)).otherwise(F.concat_ws(" ", _chosen(NAMES, 0, k), F.lower("text")))
    return Tables(spark, sf_dir).documents.select("doc_id", text.person_in_text(told).alias("p")).select("doc_id", "p.nome", "p.sobrenome")


@query(f"SELECT doc_id, CAST({_sql(DATES, 1)} AS DATE) AS found FROM documents")
def dates_in_words(spark, sf_dir):
    """Dates in words and digits before the whole text of a document."""
    return Tables(spark, sf_dir).documents.select("doc_id", dates.running_date(F.concat_ws(" . ", _chosen(DATES, 0, F.col("doc_id")), "text")).alias("found"))
