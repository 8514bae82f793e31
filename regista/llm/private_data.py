"""Personal data in texts: plain patterns, and a skip-chain conditional random field that finds further mentions of what they find."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regista.llm.common import uniform
from regista.llm.hashing import pieces

KINDS = ("email", "ip", "card", "phone")
#: Labels of a mention: none, or a kind by its place in KINDS, from 1.
NONE, LABELS = 0, len(KINDS) + 1
#: The patterns of the kinds and the numbers of digits that cards and phones have. A run of digits is taken whole at once, which changes no match and keeps the time linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)
#: Looser mentions that the field labels: digits in groups, and addresses with words for their signs.
NUMBER = re.compile(r"(?<![A-Za-z0-9_@])\+?\(?[0-9](?:[\x20().,/-]{0,2}[0-9])++")
ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\s?@\s?|\s?[\[({]at[\])}]\s?|\sat\s)[A-Za-z0-9-]++(?:(?:\.|\s?[\[({]dot[\])}]\s?|\sdot\s)[A-Za-z0-9-]++)+", re.I)
SIGNS = ((re.compile(r"\s?[\[({]at[\])}]\s?|\sat\s|\s?@\s?"), "@"), (re.compile(r"\s?[\[({]dot[\])}]\s?|\sdot\s"), "."))
MENTION_DIGITS = (7, 19)
#: Code points between two mentions that are next to each other in the chain.
NEXT = 64
#: Documents that the weights are fitted to, on average: a bounded draw by a hash of the id.
SAMPLE = 20_000
#: Kinds of edges: in the chain; between mentions with all signs alike; between similar ones.
CHAIN, SAME, SIMILAR = range(3)
EDGES = 3
#: A mention is added if its label is likelier than all others together.
LIKELY = 0.5
TURNS, DAMPING = 50, 0.3


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(label, start, end) of what the patterns find, by kind and start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1)
        if start < at and domain:
            last = domain.end()
            out.append((1, start, last))
        at = text.find("@", at + 1 if not (start < at and domain) else last)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((2, m.start(), m.end()))
    for m in CARD.finditer(text):
        d = only_digits(m.group()) if m.end() - m.start() <= 2 * CARD_DIGITS[1] else ""
        if CARD_DIGITS[0] <= len(d) <= CARD_DIGITS[1] and luhn(d):
            out.append((3, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if PHONE_DIGITS[0] <= len(only_digits(m.group())) <= PHONE_DIGITS[1]:
                out.append((4, m.start(), m.end()))
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of looser mentions outside the spans of base, in order."""
    parts, at = [], 0
    for start, end in sorted((s, e) for _, s, e in base):
        if end > at:
            parts += [text[at : max(start, at)], "\n" * (end - max(start, at))]
            at = end
    rest = "".join(parts) + text[at:]
    out = []
    if "@" in rest or " at " in rest or "at]" in rest or "at)" in rest or "at}" in rest:
        out = [m.span() for m in ADDRESS.finditer(rest)]
    taken = iter([*out, (len(rest), len(rest))])
    start, end = next(taken)
    for m in NUMBER.finditer(rest):
        while end <= m.start():
            start, end = next(taken, (len(rest) + 1, len(rest) + 1))
        if m.end() <= start and not re.match("[A-Za-z0-9_@]", rest[m.end() : m.end() + 1]) and m.end() - m.start() <= 3 * MENTION_DIGITS[1] and MENTION_DIGITS[0] <= len(only_digits(m.group())) <= MENTION_DIGITS[1]:
            out.append(m.span())
    return sorted(out)


def plain(mention: str) -> str:
    """What is compared of a mention: its digits, or an address in lower case with its signs."""
    if re.search(r"[A-Za-z]", mention):
        for pattern, sign in SIGNS:
            mention = pattern.sub(sign, mention.lower())
        return mention
    return only_digits(mention)


def features(mention: str) -> list[float]:
    d, letters = only_digits(mention), bool(re.search(r"[A-Za-z]", mention))
    groups = re.findall("[0-9]+", mention)
    n = len(d)
    shape = [not letters and a <= n <= b for a, b in ((0, 8), (9, 10), (11, 12), (13, 14), (15, 16), (17, 99))]
    signs = [c in mention for c in "+(.-,/ "]
    told = [letters, letters and "@" in mention, not letters and luhn(d), not letters and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups), not letters and len(groups) == 1]
    return [1.0, *map(float, shape), *map(float, signs), *map(float, told)]


FEATURES = len(features("1"))


def _alike(mention: str) -> list[tuple]:
    """Keys that equal and similar mentions share: all signs; the local part; the last seven digits; each half of the digits."""
    p = plain(mention)
    if "@" in p:
        return [(SAME, p), (SIMILAR, p.partition("@")[0])]
    half = len(p) // 2
    return [(SAME, p), (SIMILAR, "last", p[-7:])] + ([(SIMILAR, "low", len(p), p[:half]), (SIMILAR, "high", len(p), p[half:])] if half >= 4 else [])


def edges(units: list[tuple[int, int, str]], known: list[bool]) -> list[tuple[int, int, int]]:
    """(kind, i, j) between a document's mentions (start, end, text) in order: neighbours in the text, equal ones and similar ones. Each is joined with the one before it in its group, and with the first known one of the group, so there are few edges for a mention, however often something is repeated, and what is known is never further than one step."""
    out = [(CHAIN, i - 1, i) for i in range(1, len(units)) if units[i][0] >= 0 and 0 <= units[i][0] - units[i - 1][1] <= NEXT]
    keys = [_alike(text) for _, _, text in units]
    anchor = {key: i for i in reversed(range(len(units))) if known[i] for key in keys[i]}
    before: dict[tuple, int] = {}
    joined = set()
    for i, own in enumerate(keys):
        for key in own:
            for j in (anchor.get(key), before.get(key)):
                if j is not None and j != i and (i, j) not in joined:
                    joined |= {(i, j), (j, i)}
                    out.append((key[0], *sorted((i, j))))
            before[key] = i
    return out


def _other_form(mention: str, label: int, step: int) -> tuple[str, str]:
    """A base mention in a form that the patterns do not know, and the same form of something else, whose digits are some steps on; which form follows from a hash of the mention."""
    h = zlib.crc32(mention.encode())
    other = re.sub("[0-9]", lambda m: str((int(m.group()) + step + (h >> (m.start() % 24)) % 5) % 10), mention)
    if label == 1:
        at, dot = ((" at ", " dot "), ("[at]", "[dot]"), ("(at)", "."))[h % 3]
        mix = lambda x: x.replace("@", at).replace(".", dot)
        return mix(mention), mix("".join(chr((ord(c) - 97 + 4 + step + h % 11) % 26 + 97) if "a" <= c <= "z" else c for c in other))
    if label == 4:
        digits = only_digits(mention)[-10:]
        form = ("{0}{1}{2}", "{0} {1} {2}", "({0}) {1}-{2}", "{0}.{1}.{2}", "{0}-{1}-{2}")[h % 5]
        cut = lambda d: form.format(d[:3], d[3:6], d[6:])
        return cut(digits), cut(only_digits(other)[-10:])
    sign = "/" if h % 2 else ", "
    if label == 2:
        return mention.replace(".", sign), other.replace(".", sign)
    d = only_digits(mention)
    k = h % len(d)
    wrong = d[:k] + str((int(d[k]) + 1) % 10) + d[k + 1 :]
    spaced = lambda x: x if h % 3 else ".".join(x[i : i + 4] for i in range(0, len(x), 4))
    return spaced(wrong), spaced(only_digits(other))


def _plain_numbers(mention: str, n: int = 4) -> list[str]:
    """Dates, amounts and other numbers in groups, which are none of the kinds: made from a hash of a mention."""
    out = []
    for k in range(n):
        digits = str(zlib.crc32(f"{k} {mention}".encode())) + str(zlib.crc32(f"{mention} {k}".encode()))
        shapes = (((4, 2, 2, 2), "-- "), ((1 + int(digits[0]) % 3, 3, 3), ",,"), ((2, 2, 4, 2, 2), "// ."), ((3, 3, 4), "- "))
        sizes, signs = shapes[k % len(shapes)]
        text, at = "", 0
        for size, sign in zip(sizes, [*signs, ""], strict=False):
            text += digits[at : at + size] + sign
            at += size
        out.append(text if len(only_digits(text)) >= MENTION_DIGITS[0] else text + digits[-7:])
    return out


def _units(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]], list[int]]:
    """Base spans, all mentions (start, end, text) in order and their labels, -1 for those that the patterns don't tell."""
    base = base_spans(text)
    labels = {(s, e): k for k, s, e in reversed(base)}
    spans = sorted([*labels, *mentions(text, base)])
    return base, [(s, e, text[s:e]) for s, e in spans], [labels.get(x, -1) for x in spans]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each mention of the drawn texts its label, features and neighbours' labels, flat in one list. Base mentions stand for themselves, for another form of theirs elsewhere in the text, and for other things in that form and plain numbers, which are none, be they repeated or not."""
    for batch in pieces(batches):
        found = []
        for text in batch.column(0).to_pylist():
            base, units, labels = _units(text or "")
            known = [k > 0 for k in labels]
            labels = [max(0, k) for k in labels]
            for k, s, e in base:
                form, decoy = _other_form(text[s:e], k, 3)
                again = _other_form(text[s:e], k, 1)[1]
                for form, label in ((form, k), (decoy, NONE), (again, NONE), (again, NONE), *((x, NONE) for x in _plain_numbers(text[s:e]))):
                    units.append((-1, -1, form))
                    labels.append(label)
            counts = np.zeros((len(units), EDGES, LABELS))
            known += [False] * (len(units) - len(known))
            for kind, i, j in edges(units, known):
                counts[j, kind, labels[i]] += 1
                if units[j][0] >= 0 or units[i][0] < 0:  # what was made up tells nothing of what was found
                    counts[i, kind, labels[j]] += 1
            found += [[float(k), *features(u[2]), *c.ravel()] for u, k, c in zip(units, labels, counts, strict=True)]
        yield pa.record_batch({"row": pa.array(found, pa.list_(pa.float64()))})


class Field:
    """Weights: of each feature for each label, and for each kind of edge what equal labels and a label beside none add."""

    def __init__(self, unary: np.ndarray, same: np.ndarray, beside: np.ndarray):
        self.unary, self.same, self.beside = unary, same, beside

    def pair(self) -> np.ndarray:
        """Log potentials of the labels of two mentions, for each kind of edge."""
        told = np.eye(LABELS)
        mixed = np.zeros((LABELS, LABELS))
        mixed[NONE, 1:] = mixed[1:, NONE] = 1
        return self.same[:, None, None] * told + self.beside[:, None, None] * mixed

    @staticmethod
    def fitted(rows: np.ndarray, turns: int = 600, rate: float = 0.5, weight: float = 1e-4) -> Field:
        """Pseudo-likelihood: each label given those of its neighbours, with squared weights held small; a convex problem, solved by gradients with momentum."""
        field = Field(np.zeros((FEATURES, LABELS)), np.zeros(EDGES), np.zeros(EDGES))
        if not len(rows):
            field.unary[0, NONE] = 10.0
            return field
        y, x = rows[:, 0].astype(int), rows[:, 1 : 1 + FEATURES]
        around = rows[:, 1 + FEATURES :].reshape(len(rows), EDGES, LABELS)
        mixed = np.repeat(around[:, :, :1], LABELS, axis=2)
        mixed[:, :, NONE] = around[:, :, 1:].sum(axis=2)
        told = np.eye(LABELS)[y]
        speed = [np.zeros_like(field.unary), np.zeros(EDGES), np.zeros(EDGES)]
        for _ in range(turns):
            score = x @ field.unary + np.einsum("nel,e->nl", around, field.same) + np.einsum("nel,e->nl", mixed, field.beside)
            score -= score.max(axis=1, keepdims=True)
            p = np.exp(score)
            gap = (told - p / p.sum(axis=1, keepdims=True)) / len(rows)
            steps = (x.T @ gap, np.einsum("nel,nl->e", around, gap), np.einsum("nel,nl->e", mixed, gap))
            for k, (w, g) in enumerate(zip((field.unary, field.same, field.beside), steps, strict=True)):
                speed[k] = 0.9 * speed[k] + rate * (g - weight * w)
                w += speed[k]
        return field

    def marginals(self, x: np.ndarray, known: np.ndarray, links: np.ndarray) -> np.ndarray:
        """Probabilities of the labels of mentions with features x, of known labels (-1: not known) and links (kind, i, j), by loopy belief propagation. Documents that are no neighbours do not meet, so a whole batch is one graph."""
        score = x @ self.unary
        fixed = known >= 0
        score[fixed] = -50.0
        score[fixed, known[fixed]] = 50.0
        if len(links):
            pair = self.pair()[np.concatenate([links[:, 0], links[:, 0]])]
            source, target = np.concatenate([links[:, 1], links[:, 2]]), np.concatenate([links[:, 2], links[:, 1]])
            n = len(links)
            back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
            message = np.zeros((2 * n, LABELS))
            for _ in range(TURNS):
                total = score.copy()
                np.add.at(total, target, message)
                out = (total[source] - message[back])[:, :, None] + pair
                high = out.max(axis=1, keepdims=True)
                new = np.log(np.exp(out - high).sum(axis=1)) + high[:, 0]
                new -= new.max(axis=1, keepdims=True)
                change = np.abs(new - message).max()
                message = DAMPING * message + (1 - DAMPING) * new
                if change < 1e-6:
                    break
            np.add.at(score, target, message)
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame) -> Field:
    """The field for docs (doc_id, text), fitted to about SAMPLE documents drawn by a hash of their ids; what the driver gets are their mentions' numbers. The patterns are the teacher, no labels are read."""
    n = docs.count()
    drawn = docs.where(uniform(F.coalesce("doc_id", F.lit(-1)), 53) < min(1.0, SAMPLE / max(1, n)))
    rows = [r["row"] for r in drawn.select("text").mapInArrow(_examples, "row array<double>").toLocalIterator()]
    table = np.array(sorted(rows)) if rows else np.zeros((0, 1 + FEATURES + EDGES * LABELS))
    return Field.fitted(table)


def spans(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, base, found) for docs (doc_id, text): label, start and end of each span, in code points, by kind and start. found has base and what the field adds."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sides, owner, known, links, shapes, where = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                base, units, labels = _units(text) if re.search("[0-9@]| at |at[])}]", text) else ([], [], [])
                sides.append(base)
                first = len(owner)
                links += [(kind, first + i, first + j) for kind, i, j in edges(units, [k > 0 for k in labels])]
                for unit, label in zip(units, labels, strict=True):
                    owner.append(row)
                    known.append(label)
                    shapes.append(features(unit[2]))
                    where.append(unit[:2])
            added = defaultdict(list)
            if -1 in known:
                p = field.marginals(np.array(shapes), np.array(known), np.array(links, dtype=np.int64).reshape(-1, 3))
                for k in np.flatnonzero((np.array(known) < 0) & (p[:, 1:].max(axis=1) > LIKELY)):
                    added[owner[k]].append((int(p[k, 1:].argmax()) + 1, *where[k]))
            every = [sorted(base + added[row]) for row, base in enumerate(sides)]
            kind = pa.list_(pa.list_(pa.int64()))
            yield pa.record_batch({"doc_id": batch.column(0), "base": pa.array([[list(s) for s in x] for x in sides], kind), "found": pa.array([[list(s) for s in x] for x in every], kind)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(told, "doc_id long, base array<array<long>>, found array<array<long>>")


def _joined(column: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(kinds, (s[0] - 1).cast("int")), s[1].cast("string"), s[2].cast("string"))), ",")


def private_data(docs: DataFrame) -> DataFrame:
    """Personal data of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the hash are of the spans that the patterns find, leftmost
    first and without overlaps within a kind. The field adds mentions that the
    patterns miss, such as the same number without its signs: it labels all
    looser mentions of a text together. Mentions next to each other, and ones
    that repeat or resemble each other however far apart, share potentials;
    those that the patterns find have their label, and messages carry it along.
    So a text without such mentions costs one search. Places are code points.
    A null text is empty and has no spans; rows that repeat have equal results;
    a null doc_id is carried; an empty table stays empty; other columns are
    ignored. Texts of any length are read whole in linear time.
    """

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s[0] == kind)).cast("long").alias(f"n_{KINDS[kind - 1]}")

    counts = [number(k) for k in range(1, LABELS)]
    return spans(docs, fit(docs)).select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("found").alias("spans"))


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """A text with its spans replaced by [kind]; of spans that overlap the first by start stays."""
    out, at = [], 0
    for k, start, end in sorted(found, key=lambda s: (s[1], s[2], s[0])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[k - 1]}]"]
            at = end
    return "".join(out) + text[at:]
