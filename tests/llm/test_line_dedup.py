import numpy as np

from regista.llm.line_dedup import dedup_lines, line_components
from tests.llm.brute import line_shingles, union


def brute(rows, percent=80):
    lines = {(d, i): line for d, t in rows for i, line in enumerate((t or "").split("\n"))}
    sets = {k: line_shingles(v) for k, v in lines.items()}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return bool(x) and bool(y) and 100 * len(x & y) >= percent * len(x | y)

    return union(list(lines), linked)


def test_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    expected = brute(rows)
    got = {(r["doc_id"], r["line_no"]): (r["component_doc"], r["component_line"]) for r in line_components(docs).collect()}
    assert got.keys() == expected.keys()
    assert sum(got[k] != expected[k] for k in got) <= 0.005 * len(got)  # bands find all but a few pairs at the threshold


def test_texts_lose_copied_lines(spark):
    line = "the quick brown fox jumps over the lazy dog again and again, until the evening falls over the hills and all is quiet there"
    rows = [(1, line + "\n\n- x\n" + "only here, a line of its own", 5), (2, "first of two\n" + line.upper() + "  \n- x", 0), (3, line.replace("brown", "drown"), 0), (4, None, 0), (5, "", 0), (4, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in dedup_lines(df).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_chars"] == len(rows[0][1])
    assert got[2]["text"] == "first of two\n- x" and got[2]["n_chars"] == 16
    assert 3 not in got and got[4]["text"] is None and got[5]["text"] == ""
    assert dedup_lines(df).count() == 5  # a null text is an empty line, which stays however often
    assert dedup_lines(df.limit(0)).count() == 0 and line_components(df.limit(0)).count() == 0


def test_long_and_repeated_lines(spark):
    long = " ".join(f"word{i}" for i in range(4000))
    rows = [(1, long), (2, long + " end"), (2, long + " end"), (None, long)]
    got = line_components(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as kept", "1 as id", "2 as line")).collect()
    assert len(got) == 4 and {(r["component_doc"], r["component_line"]) for r in got} == {(1, 0)}
    assert [r["kept"] for r in got if r["doc_id"] == 1] == [True] and not any(r["kept"] for r in got if r["doc_id"] != 1)


def test_repetitive_lines_are_linked(spark):
    phrase = "to be filled in; "
    rows = [(k, phrase * n) for k, n in enumerate((40, 300, 2000))] + [(9, "=-" * 700), (10, "=-" * 90), (11, "a line that stands here alone")]
    got = {r["doc_id"]: r["component_doc"] for r in line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 9: 9, 10: 9, 11: 11}


def test_short_lines_stay_however_they_are_indented(spark):
    text = "          \n            }\n      - x     \n        }"
    df = spark.createDataFrame([(1, text), (2, text), (3, "\t\t        end   ")], "doc_id long, text string")
    assert all(r["kept"] for r in line_components(df).collect())
    assert {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()} == {1: text, 2: text, 3: "\t\t        end   "}


def test_planted_pairs_are_found(spark):
    rng, abc = np.random.default_rng(5), list("abcdefghijklmnopqrstuvwxyz ")
    rows = []
    for k in range(400):
        n = int(rng.choice([60, 150, 400]))
        cut = int(n * rng.uniform(0.05, 0.10))  # similarity of about 80 to 90 percent
        line = "".join(rng.choice(abc, n + 7))
        rows += [(2 * k, "x" + line + "x"), (2 * k + 1, "x" + line[: n + 7 - cut] + "".join(rng.choice(abc, cut)) + "x")]
    sets = {k: line_shingles(v) for k, v in rows}
    near = [k for k in range(400) if 5 * len(sets[2 * k] & sets[2 * k + 1]) >= 4 * len(sets[2 * k] | sets[2 * k + 1])]
    got = {r["doc_id"]: r["component_doc"] for r in line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 150 and sum(got[2 * k + 1] == 2 * k for k in near) >= 0.97 * len(near)
    assert all(got[2 * k + 1] == 2 * k + 1 for k in range(400) if k not in near)


def test_rows_without_an_id_of_their_own(spark):
    line = "a line that stands in many documents of this small table"
    rows = [(None, line), (None, "other words first\n" + line), (7, line + " "), (7, "unlike, but under the same id"), (-3, "- x\n" + line), (-3, "- x\n" + line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_components(df).collect()
    assert len(got) == 9 and sum(r["kept"] for r in got if r["component_doc"] == -3 and r["component_line"] == 1) == 2  # in both of the equal rows
    assert {r["component_line"] for r in got} <= {0, 1}
    out = dedup_lines(df.selectExpr("*", "1 as row", "2 as kept", "3 as doc", "4 as _line", "5 as n_chars"))
    assert out.columns == ["doc_id", "text", "row", "kept", "doc", "_line", "n_chars"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == sorted([("None", "other words first"), ("7", "unlike, but under the same id"), ("-3", "- x\n" + line), ("-3", "- x")])
