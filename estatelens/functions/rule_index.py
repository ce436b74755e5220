"""An inverted index from the words that patterns require to the patterns.

Every match of a pattern holds one of a few words of letters (``required_words``). Texts are taken
apart into runs of letters; the distinct runs of all texts form a dictionary, and only there, once
for each run, it is asked which words it holds. An equi-join of a text's runs with that dictionary
gives the candidate (text, rule) pairs, and expressions are run for those alone: the work follows
what texts hold, not the number of rules.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants, _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import kept

#: Entries of a dictionary that are sent to all tasks; a larger one is joined by shuffles.
SMALL = 20_000
#: Bytes of lines that are sent to all tasks.
SMALL_BYTES = 16 << 20
_REPEATS = (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT)
#: Parts that look at what stands around a match, or are not looked into.
_AROUND = (_constants.ASSERT, _constants.ASSERT_NOT, _constants.GROUPREF_EXISTS, _constants.ATOMIC_GROUP)
#: Characters that have a meaning in patterns.
_SPECIAL = set(r"\.^$*+?{}[]|()")


@lru_cache(maxsize=None)
def required_words(pattern: str) -> frozenset[str]:
    """Runs of letters, in lower case, one of which every match holds; empty where a match needs none."""
    return frozenset(_required(_parser.parse(pattern)) or ())


def _required(parts) -> set[str] | None:
    """The best words of a sequence: those whose shortest is longest, then the fewest."""
    found: list[set[str]] = []
    run = ""
    for kind, told in [*parts, (None, None)]:
        if kind is _constants.LITERAL and chr(told).isascii() and chr(told).isalpha():
            run += chr(told).lower()
            continue
        if run:
            found.append({run})
            run = ""
        if kind is _constants.SUBPATTERN:
            inner = _required(told[3])
        elif kind in _REPEATS and told[0] > 0:
            inner = _required(told[2])
        elif kind is _constants.BRANCH:
            sides = [_required(side) for side in told[1]]
            inner = set().union(*sides) if all(sides) else None
        else:
            inner = None
        if inner:
            found.append(inner)
    return max(found, key=lambda words: (min(map(len, words)), -len(words)), default=None)


def is_plain(pattern: str) -> bool:
    """Whether the pattern is a text that matches itself only."""
    return not _SPECIAL & set(pattern)


class RuleIndex:
    """Rules are the numbers of ``patterns``, from 0."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        self.by_word: dict[str, list[int]] = {}
        self.always: list[int] = []
        for rule, pattern in enumerate(patterns):
            words = required_words(pattern)
            for word in words:
                self.by_word.setdefault(word, []).append(rule)
            if not words:
                self.always.append(rule)

    def _runs(self, text: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]+"), F.lit(0)))

    def dictionary(self, texts: DataFrame, text: str) -> DataFrame:
        """(run, rules) of the runs of letters that hold a word, with the rules that these words may match."""
        # once for each run: a condition on the grouped column itself would be asked of every occurrence
        runs = texts.select(F.explode(self._runs(text)).alias("each")).groupBy("each").agg(F.min("each").alias("run"))
        words = F.array(*[F.struct(F.lit(w).alias("word"), F.array(*map(F.lit, rules)).alias("rules")) for w, rules in self.by_word.items()])
        held = F.flatten(F.transform(F.filter(words, lambda w: F.contains(F.col("run"), w["word"])), lambda w: w["rules"]))
        return runs.select("run", F.array_distinct(held).alias("rules")).where(F.size("rules") > 0)

    def candidates(self, texts: DataFrame, text: str) -> DataFrame:
        """``texts`` with a column ``rule``: a row for each rule that may match; the same pair may come more than once."""
        found = []
        if self.by_word:
            known = kept(self.dictionary(texts, text), "dictionary")
            known = F.broadcast(known) if known.count() <= SMALL else known
            runs = texts.select("*", F.explode(self._runs(text)).alias("run"))
            found.append(runs.join(known, "run").select(*texts.columns, F.explode("rules").alias("rule")))
        if self.always or not found:
            found.append(texts.select("*", F.explode(F.array(*map(F.lit, self.always)).cast("array<int>")).alias("rule")))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def rules(self, texts: DataFrame, columns: str, rows: list[tuple]) -> DataFrame:
        """The patterns as a table (rule, pattern, plain, ...) with what ``rows`` say of each; as many rows as rules."""
        told = [(rule, pattern, is_plain(pattern), *row) for rule, (pattern, row) in enumerate(zip(self.patterns, rows, strict=True))]
        return F.broadcast(texts.sparkSession.createDataFrame(told, f"rule int, pattern string, plain boolean, {columns}"))


def distinct_lines(texts: DataFrame, text: str) -> DataFrame:
    """(line): the different lines of all texts, stored. Estates repeat most of their lines, so rules are asked of each once."""
    return kept(texts.select(F.explode(F.split(text, "\n", -1)).alias("line")).distinct(), "lines")


def sent(book: DataFrame) -> DataFrame:
    """What is told of lines, as a side of a join by line: for all tasks if it is small, else left to shuffles."""
    size = book.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line")).alias("bytes")).first()
    return F.broadcast(book) if size["n"] <= SMALL and (size["bytes"] or 0) <= SMALL_BYTES else book


@lru_cache(maxsize=None)
def may_cross(pattern: str) -> bool:
    """Whether a match might need more than one line: it may hold a line feed, or looks at what stands around it."""
    told = _parser.parse(pattern)
    return _crosses(told, bool(told.state.flags & re.DOTALL))


@lru_cache(maxsize=None)
def is_local(pattern: str) -> bool:
    """Whether a match within a line is one within the text: nothing but word and line boundaries is looked at around it."""
    told = _parser.parse(pattern)
    allowed = {_constants.AT_BOUNDARY, _constants.AT_NON_BOUNDARY}
    if told.state.flags & re.MULTILINE:
        allowed |= {_constants.AT_BEGINNING, _constants.AT_END}
    return all(kind not in _AROUND and (kind is not _constants.AT or what in allowed) for kind, what in _parts(told))


@lru_cache(maxsize=None)
def needed(pattern: str) -> tuple[str, ...]:
    """Texts that every match holds, all of them, as they are written; none for patterns that do not tell cases apart."""
    told = _parser.parse(pattern)
    return () if told.state.flags & re.IGNORECASE else tuple(dict.fromkeys(_needed(told)))


def _needed(parts) -> list[str]:
    found, run = [], ""
    for kind, told in [*parts, (None, None)]:
        if kind is _constants.LITERAL:
            run += chr(told)
            continue
        if run:
            found.append(run)
            run = ""
        if kind is _constants.SUBPATTERN and not told[1]:  # one with flags of its own tells nothing
            found += _needed(told[3])
        elif kind in _REPEATS and told[0] > 0:
            found += _needed(told[2])
    return found


def _parts(parts):
    """All parts of a parsed pattern, at any depth."""
    for kind, told in parts:
        yield kind, told
        if kind is _constants.SUBPATTERN:
            yield from _parts(told[3])
        elif kind in _REPEATS:
            yield from _parts(told[2])
        elif kind is _constants.BRANCH:
            for side in told[1]:
                yield from _parts(side)


def _crosses(parts, dot_all: bool) -> bool:
    for kind, told in _parts(parts):
        if kind in _AROUND or kind is _constants.ANY and dot_all:
            return True
        if kind is _constants.AT and told not in (_constants.AT_BOUNDARY, _constants.AT_NON_BOUNDARY):
            return True
        if kind is _constants.SUBPATTERN and told[1]:  # flags of its own
            return True
        if kind is _constants.LITERAL and told == 10 or kind is _constants.NOT_LITERAL and told != 10:
            return True
        if kind is _constants.IN:
            negated = told[0][0] is _constants.NEGATE
            if any(_has_line_feed(*x) for x in told if x[0] is not _constants.NEGATE) != negated:
                return True
    return False


def _has_line_feed(kind, told) -> bool:
    if kind is _constants.RANGE:
        return told[0] <= 10 <= told[1]
    return told == 10 if kind is _constants.LITERAL else told in (_constants.CATEGORY_SPACE, _constants.CATEGORY_NOT_DIGIT, _constants.CATEGORY_NOT_WORD)


def matches(text: Column) -> Column:
    """Whether the row's pattern matches the text."""
    return F.when(F.col("plain"), F.contains(text, F.col("pattern"))).otherwise(F.rlike(text, F.col("pattern")))
