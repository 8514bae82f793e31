import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from regista.llm import private_data
from regista.llm.private_data import KINDS, Field

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SCHEMA = "doc_id long, text string, spans string, n_ip string"


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return kind == "email" or 13 <= len(digits) <= 19 and sum(n - 9 * (n > 9) for n in doubled) % 10 == 0


def plain(text):
    return [(k, m.start(), m.end()) for k, kind in enumerate(KINDS, 1) for m in re.finditer(PATTERNS[kind], text or "") if holds(kind, m.group())]


def card(start):
    return next(start + c for c in "0123456789" if private_data.luhn(start + c))


def corpus(n=300):
    """Texts with base mentions; the second half repeats them in other forms."""
    draw, rows = random.Random(4), []
    digits = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    for d in range(n):
        phone, ip = (digits(3), digits(3), digits(4)), [str(draw.randrange(1, 255)) for _ in range(4)]
        told = [f"+1 ({phone[0]}) {phone[1]}-{phone[2]}", ".".join(ip), card("4" + digits(14)), f"an.{digits(2)}@mail{digits(1)}.example.com"]
        rows.append((d, " some words here. ".join(["", told[d % 4], digits(12), ""])))
        rows.append((n + d, f"{digits(7)} or {digits(4)}-{digits(2)}-{digits(2)} and {digits(9)}"))
    return rows


@pytest.fixture(scope="module")
def field(spark):
    return private_data.fit(spark.createDataFrame(corpus(), "doc_id long, text string"))


def added(spark, field, text):
    (row,) = private_data.spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).collect()
    assert all(s in row.found for s in row.base)
    return [(KINDS[k - 1], text[s:e]) for k, s, e in row.found if [k, s, e] not in row.base]


def test_base_spans_equal_the_patterns():
    draw = random.Random(9)
    alphabet = "0123456789" * 3 + "..@@+-() ab%_é\n"
    texts = ["".join(draw.choice(alphabet) for _ in range(120)) for _ in range(3000)]
    texts += ["a@b@c.de@f.g.h", "@@a@b.c", "1.2.3.4.5.6.7.8", "1.1.1.256", "0001.02.3.4", "+1 5", "x+49 (30) 901820 1", "4111-1111 1111-1111", "a@b..c", ".@a.b", card("12345678901234567")]
    assert any(plain(t) for t in texts[:3000])
    assert [private_data.base_spans(t) for t in texts] == [plain(t) for t in texts]


def test_mentions_linked_with_base_ones_are_added(spark, field):
    far = " and many other words follow" * 50
    assert added(spark, field, f"Call +1 (509) 555-6973.{far}; later 509 555 6973 again") == [("phone", "509 555 6973")]
    assert added(spark, field, f"106.158.249.239{far} 106, 158, 249, 239") == [("ip", "106, 158, 249, 239")]
    assert added(spark, field, f"{card('481132910613569')}{far} {card('481132910613569')[:-1]}{(int(card('481132910613569')[-1]) + 1) % 10} end") == [("card", card("481132910613569")[:-1] + str((int(card("481132910613569")[-1]) + 1) % 10))]
    assert added(spark, field, f"eau.42@mail9.example.com{far} eau.42 at mail9 dot example dot com") == [("email", "eau.42 at mail9 dot example dot com")]


@pytest.mark.parametrize("text", ["In 509 555 6973 cases", "look at example.com", "5927243074273351 and 5927243074273351", "1234567, 89 and 2024-01-02 10:11:12", "1 2 3 4 5 6 7 8 9 " * 400, "", "abcdef 0595765af"])
def test_clean_texts_get_no_span(spark, field, text):
    assert added(spark, field, text) == []


def test_messages_give_the_exact_marginals_of_trees():
    draw = np.random.default_rng(3)
    field = Field(draw.normal(size=(private_data.FEATURES, 5)), np.array([0.7, 2.0, 1.0]), np.array([-0.3, -1.0, 0.2]))
    x, known = draw.normal(size=(6, private_data.FEATURES)), np.array([-1, 2, -1, -1, -1, 0])
    links = np.array([(0, 0, 1), (1, 1, 2), (2, 1, 3), (1, 3, 4), (0, 0, 5)])
    pair, score, total = field.pair(), x @ field.unary, np.zeros((6, 5))
    for labels in itertools.product(range(5), repeat=6):
        if labels[1] == 2 and labels[5] == 0:
            p = np.exp(sum(score[i, y] for i, y in enumerate(labels) if known[i] < 0) + sum(pair[k][labels[i], labels[j]] for k, i, j in links))
            for i, y in enumerate(labels):
                total[i, y] += p
    assert np.allclose(field.marginals(x, known, links), total / total.sum(axis=1, keepdims=True), atol=1e-6)


def test_label_is_carried_round_loops_and_over_others(spark, field):
    text = (" and so on" * 9).join(["+1 (509) 555-6973", " 509 555 6973", " 509.555.6973", " (509) 555-6973"])
    assert added(spark, field, text) == [("phone", "509 555 6973"), ("phone", "509.555.6973"), ("phone", "(509) 555-6973")]


def test_query_columns_nulls_repeats_long_texts_and_empty_tables(spark):
    long = "word " * 60_000 + "eau@a.de " + "9" * 2000 + " é " * 1000 + "+49 30 901820 " + "+(" * 2000 + "a" * 2000 + "@"
    rows = [(None, None), (1, ""), (2, "x eau@a.de, 1.2.3.4"), (2, "x eau@a.de, 1.2.3.4"), (3, long), (None, "é 1.2.3.4")]
    told = private_data.private_data(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)).collect()
    joined = lambda t: ",".join(f"{KINDS[k - 1]}:{s}:{e}" for k, s, e in plain(t))
    expected = [(d, *[sum(s[0] == k for s in plain(t)) for k in (1, 2, 3, 4)], hashlib.sha256(joined(t).encode()).hexdigest()) for d, t in rows]
    key = lambda r: (r[0] or -1, r[5])
    assert sorted((tuple(r)[:6] for r in told), key=key) == sorted(expected, key=key)
    assert all(set(joined(t).split(",")) <= set(r.spans.split(",")) for r, (_, t) in zip(told, rows, strict=True) if t)
    assert private_data.private_data(spark.createDataFrame([], SCHEMA)).count() == 0


def test_masking_keeps_the_rest():
    assert private_data.masked("a eau@a.de b 1.2.3.4", private_data.base_spans("a eau@a.de b 1.2.3.4")) == "a [email] b [ip]"
