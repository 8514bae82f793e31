"""Reading of running text word by word: cues, clauses, numbers and names, found in one array of words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is neither a letter nor a digit.
SIGN = r"[^\p{L}\p{N}]"


class Word:
    """The word at a place of spoken(): raw, word and whole (whether no sign is behind it); all null beyond the ends."""

    def __init__(self, t: Column, i: Column):
        self._t, self._i = t, i

    @property
    def raw(self) -> Column:
        return F.get(self._t["raw"], self._i)

    @property
    def word(self) -> Column:
        return F.get(self._t["word"], self._i)

    @property
    def whole(self) -> Column:
        return self.raw.rlike(r"[\p{L}\p{N}]\z")


#: A step of a cue: any of these words, or a test of the word at a place.
Step = tuple[str, ...] | Callable[[Word], Column]

LINKS = ("de", "da", "do")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def record(**fields: Column) -> Column:
    """A struct whose names hold wherever it is used, also beside explode(), which drops aliases inside of other columns."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def plain(text: Column) -> Column:
    """The text with single blanks between its words and none around it."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t\n\x0B\f\r]\s*| \s+", " "))


def _split(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def _marked(words: Column, begins: Callable[[Column], Column]) -> Column:
    return F.array_compact(F.transform(words, lambda w, i: F.when(begins(w), i)))


def spoken(text: Column, begins: tuple[str, ...] = ()) -> Column:
    """The words of a text: raw, word (lower case, without signs around it), and marks, the places from 0 of the words begins: a cue can only be found where its first word is among them.

    Signs are taken off in the whole text, in which words lie a blank apart,
    so that no word is worked on by itself.
    """
    sign = SIGN.replace("]", " ]")
    bare = lambda s: F.lower(F.regexp_replace(s, f"{sign}+(?![^ ])|(?<![^ ]){sign}+", ""))
    words = once(plain(text), lambda s: record(raw=_split(s), word=F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(bare(s), " "))))
    marks = lambda t: _marked(t["word"], lambda w: w.isin(*begins)) if begins else F.array().cast("array<int>")
    return once(words, lambda t: record(raw=t["raw"], word=t["word"], marks=marks(t)))


def raw_words(text: Column, begins: Callable[[Column], Column]) -> Column:
    """The words of a text that is plain() as they are: raw, and marks, the places from 0 of those for which begins holds."""
    return once(_split(text), lambda t: record(raw=t, marks=_marked(t, begins)))


def number(digits: int) -> Step:
    """A step that takes a number of at most so many digits."""
    return lambda w: w.word.rlike(f"^[0-9]{{1,{digits}}}$")


def places(t: Column, *steps: Step) -> Column:
    """Where in the words t, from 0, words of the steps follow each other without a sign between them. Only marked places are looked at."""

    def fits(i: Column) -> Column:
        tests = []
        for k, step in enumerate(steps):
            at = Word(t, i + k)
            tests.append(step(at) if callable(step) else at.word.isin(*step))
        tests += [Word(t, i + k).whole for k in range(len(steps) - 1)]
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return F.coalesce(out, F.lit(False))

    return F.filter(t["marks"], fits)


def has(t: Column, *steps: Step) -> Column:
    return F.size(places(t, *steps)) > 0


def first(found: Column) -> Column:
    """The first of an array, null if it is empty."""
    return F.get(found, F.lit(0))


def word_at(t: Column, steps: tuple[Step, ...], skip: int) -> Column:
    """The word so many places behind the first place of a cue."""
    return once(first(places(t, *steps)), lambda i: Word(t, i + skip).word)


def clause(t: Column, i: Column, most: int | None = None, signs: str = ",.") -> Column:
    """The text from word i to the next of the signs; no more words than are needed for most characters."""
    told = F.slice(t["raw"], i + 1, F.lit(most) if most else F.greatest(F.size(t["raw"]), F.lit(1)))
    return F.regexp_extract(F.array_join(told, " "), f"^[^{signs}]*", 0)


def told_after(t: Column, cues: tuple[tuple[tuple[Step, ...], int], ...], least: int, most: int, signs: str = ",.") -> Column:
    """The clause that follows the first cue with one of at least so many characters, cut to most; a cue is its steps and how many words lie before the clause."""
    found = F.concat(*[_clauses(t, steps, skip, most, signs) for steps, skip in cues])
    best = F.array_min(F.filter(found, lambda s: F.length(F.trim(s["told"])) >= least))
    return F.trim(F.substring(best["told"], 1, most))


def _clauses(t: Column, steps: tuple[Step, ...], skip: int, most: int, signs: str) -> Column:
    ended = F.filter(places(t, *steps), lambda i: Word(t, i + (skip - 1)).whole)
    return F.transform(ended, lambda i: record(at=i, told=clause(t, i + skip, most, signs)))


def capital(raw: Column) -> Column:
    """The capitalised word that a word begins with, '' if it begins with none."""
    return F.regexp_extract(raw, "^[A-ZÀ-Ú][a-zà-ú]+", 0)


def name_from(t: Column, i: Column, more: int, links: tuple[str, ...] = LINKS, linked: bool = False) -> Column:
    """The words of a name that begins at word i: capitalised words, up to more after the first, with links between them; null unless there are two capitalised words. With linked there must be a link before each but the first.

    The words are taken one by one. A state tells what the name has so far,
    which link waits for its name, and whether the name can go on: it can't
    behind a sign, a word that is no name, or the last word that is allowed.
    """
    zero = record(parts=F.array().cast("array<string>"), link=F.lit(None).cast("string"), n=F.lit(0), open=F.lit(True))

    def step(s: Column, w: Column) -> Column:
        name = capital(w)
        fits = (name != "") & (s["link"].isNotNull() | (s["n"] == 0) if linked else F.lit(True))
        waits = w.isin(*links) & (s["n"] > 0) & s["link"].isNull()
        taken = record(
            parts=F.concat(s["parts"], F.array_compact(F.array(s["link"], name))),
            link=F.lit(None).cast("string"),
            n=s["n"] + 1,
            open=(name == w) & (s["n"] < more),
        )
        waiting = record(parts=s["parts"], link=w, n=s["n"], open=F.lit(True))
        ended = record(parts=s["parts"], link=s["link"], n=s["n"], open=F.lit(False))
        return F.when(~s["open"], s).when(fits, taken).when(waits, waiting).otherwise(ended)

    return F.aggregate(F.slice(t["raw"], i + 1, 2 * more + 1), zero, step, lambda s: F.when(s["n"] >= 2, s["parts"]))
