"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers rewrite the words of a clause, each reading what the one before wrote:

* insult: a word, or the stem of a word, that a lexicon learned from labels has, becomes an
  insult of its weight; closed-class words become symbols of their role, others a plain word;
* threat: a verb of harm after a modal or future word becomes a threat, else a plain word;
* negation: insults and threats after a word that negates become negated ones. A comma ends the
  negation only before a word of address or an insult ("not now, you fool"), so what stands in
  apposition stays negated;
* reported speech: inside quotation marks, or after a verb of saying, they become reported ones;
* target: remembers whether the clause names the person addressed or spoken of.

``compose`` joins transducers: states pair up, outputs feed inputs, weights add. The grammar is
the composition of all five, worked out once; a text is read by that one automaton. A clause
that matches gives an attack with a category and a strength, and a text's score is that of its
strongest clause. The strength of a lexicon entry is its log-odds between labelled classes; a
category's factor is the share of toxic texts among those in which it is the strongest, drawn
towards a fixed prior where there is little evidence.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import materialize
from .labels import MOST_ROWS, training_rows

# Closed-class words of the grammar in English, German, French and Spanish.
TARGETS = frozenset("you your yours yourself he she they him them her u du dich dir ihr euch sie er dein tu te toi vous ton ta tes il elle ils usted tú ti vosotros él ella ellos".split())
NEGATIONS = frozenset("not no never nobody none neither nor without cannot isn aren wasn don doesn didn won nicht kein keine keinen nie niemals ohne ne pas jamais aucun aucune sans nunca jamás ningún ninguna sin tampoco".split())
REPORTERS = frozenset("said says say saying claimed claims claim wrote writes called calls quoted quotes reported reports sagte sagt schrieb behauptet nannte dit disait écrit appelle prétend dijo dice escribió llamó afirma".split())
MODALS = frozenset("will would gonna shall going must should ll werde werden wird will vais va vont irai voy va vamos".split())
HARMS = frozenset("kill hurt destroy beat stab shoot murder strangle hang burn töten umbringen schlagen verletzen tuer frapper détruire matar golpear destruir".split())

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n|,\"«»“”„]")
WORD = re.compile(r"[^\W\d_]+")
ENDS = frozenset(".!?;:\n|")
OPEN_QUOTES, CLOSE_QUOTES = frozenset("«“„"), frozenset("»”")
STEMS = (4, 5, 6)
CATEGORIES = {"insult": 0.9, "insult at target": 0.97, "negated insult": 0.3, "reported insult": 0.35, "threat at target": 0.9, "threat": 0.4, "negated threat": 0.2, "reported threat": 0.3}
#: Weight of a prior factor, in labelled texts.
PRIOR_TEXTS = 8.0
#: Least share of the toxic training texts (and least number) with a word of the lexicon.
LEAST_SHARE, LEAST_TEXTS = 0.004, 3
#: Share of the toxic training texts from which a strong word needs no further evidence.
AMPLE_SHARE = 0.03
#: Least odds, toxic to other, of a word of the lexicon.
LEAST_ODDS = 40.0
SKETCHES = 4


def features(text: str) -> set[str]:
    """Distinct words, and stems (marked by a star) of longer words."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, input) -> (state, output, weight), one for each pair; a pair without an arc writes what it reads and stays."""

    start: object
    arcs: dict[tuple, tuple]

    def step(self, state: object, symbol: str) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def run(self, symbols: Iterable[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for symbol in symbols:
            state, written, weight = self.step(state, symbol)
            out.append((written, weight))
        return out


def compose(first: Transducer, second: Transducer, alphabet: Iterable[str]) -> Transducer:
    """The transducer that writes what ``second`` writes on reading what ``first`` writes, over all states that can be reached."""
    start = (first.start, second.start)
    arcs, open_states, seen = {}, [start], {start}
    while open_states:
        a, b = open_states.pop()
        for symbol in alphabet:
            to_a, written, weight = first.step(a, symbol)
            to_b, out, more = second.step(b, written)
            arcs[(a, b), symbol] = ((to_a, to_b), out, weight + more)
            if (to_a, to_b) not in seen:
                seen.add((to_a, to_b))
                open_states.append((to_a, to_b))
    return Transducer(start, arcs)


#: What the insult transducer writes: insult, harm, modal, target, negation, report, plain word, and marks.
INSULT, HARM, MODAL, TARGET, NEGATION, REPORT, PLAIN, COMMA, OPEN, CLOSE, QUOTE, END = SYMBOLS = ("insult", "harm", "modal", "target", "negation", "report", "plain", "comma", "open", "close", "quote", "end")
THREAT_WEIGHT = 6.0
ATTACKS = ("insult", "threat")


def threat_transducer() -> Transducer:
    arcs = {("plain", MODAL): ("modal", PLAIN, 0.0), ("modal", MODAL): ("modal", PLAIN, 0.0), ("modal", HARM): ("modal", "threat", THREAT_WEIGHT), ("plain", HARM): ("plain", PLAIN, 0.0), ("modal", END): ("plain", END, 0.0)}
    return Transducer("plain", arcs)


def negation_transducer() -> Transducer:
    arcs = {(s, NEGATION): ("negated", PLAIN, 0.0) for s in ("open", "negated", "comma")} | {(s, END): ("open", END, 0.0) for s in ("negated", "comma")}
    arcs |= {("negated", COMMA): ("comma", COMMA, 0.0)} | {("negated", a): ("negated", f"negated {a}", 0.0) for a in ATTACKS}
    arcs |= {("comma", s): ("negated", s, 0.0) for s in (PLAIN, REPORT, OPEN, CLOSE, QUOTE)} | {("comma", "threat"): ("negated", "negated threat", 0.0)}
    arcs |= {("comma", s): ("open", s, 0.0) for s in (TARGET, INSULT)}
    return Transducer("open", arcs)


def report_transducer() -> Transducer:
    """States: (inside quotation marks, after a verb of saying). Marks may enclose several clauses."""
    arcs = {}
    for quoted in (False, True):
        for said in (False, True):
            at = (quoted, said)
            arcs |= {(at, REPORT): ((quoted, True), PLAIN, 0.0), (at, OPEN): ((True, said), PLAIN, 0.0), (at, CLOSE): ((False, said), PLAIN, 0.0), (at, QUOTE): ((not quoted, said), PLAIN, 0.0), (at, END): ((quoted, False), END, 0.0)}
            if quoted or said:
                arcs |= {(at, a): (at, f"reported {a}", 0.0) for a in ATTACKS}
    return Transducer((False, False), arcs)


def target_transducer() -> Transducer:
    """Writes whether the clause that ends had a target."""
    return Transducer(False, {(False, TARGET): (True, PLAIN, 0.0), (True, TARGET): (True, PLAIN, 0.0), (True, END): (False, "end at target", 0.0)})


STAGES = (threat_transducer(), negation_transducer(), report_transducer(), target_transducer())
AUTOMATON = functools.reduce(lambda a, b: compose(a, b, SYMBOLS), STAGES)
MARKS = dict.fromkeys(ENDS, END) | dict.fromkeys(OPEN_QUOTES, OPEN) | dict.fromkeys(CLOSE_QUOTES, CLOSE) | {'"': QUOTE, ",": COMMA}
ROLES = dict.fromkeys(REPORTERS, REPORT) | dict.fromkeys(MODALS, MODAL) | dict.fromkeys(HARMS, HARM) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(TARGETS, TARGET) | MARKS


@dataclass
class Grammar:
    lexicon: dict[str, float] = field(default_factory=dict)
    factors: dict[str, float] = field(default_factory=lambda: dict(CATEGORIES))

    def insult(self, word: str) -> float:
        """Weight that the insult transducer puts out for a word, 0 if it has none."""
        best = self.lexicon.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                best = max(best, self.lexicon.get(word[:n] + "*", 0.0))
        return best

    def symbols(self, text: str) -> Iterator[tuple[str, float]]:
        """The insult transducer's output for each word and mark of a text, and the end of its last clause."""
        for token in TOKEN.findall(text.lower()):
            role = ROLES.get(token)
            weight = 0.0 if role else self.insult(token)
            yield (INSULT if weight else role or PLAIN), weight
        yield END, 0.0

    def attacks(self, text: str) -> list[tuple[str, float]]:
        """(category, weight) of the strongest insult and the strongest threat of each clause that matches."""
        out, best, state, arcs = [], {}, AUTOMATON.start, AUTOMATON.arcs
        for symbol, weight in self.symbols(text):
            state, written, more = arcs[state, symbol]
            if symbol == END:
                for name, (strength, kind) in best.items():
                    out.append((f"{kind} at target" if kind == name and written != END else kind, strength))
                best = {}
            elif written in CATEGORIES:
                name = written.rsplit(" ", 1)[-1]
                if weight + more > best.get(name, (0.0,))[0]:
                    best[name] = (weight + more, written)
        return out

    def score(self, text: str | None) -> float:
        """Chance that the text is toxic, by its strongest clause; 0.02 without any."""
        return max((self.factors[kind] / (1 + math.exp(3.0 - weight)) for kind, weight in self.attacks(text)), default=0.02) if text and self.may_match(text) else 0.02

    def may_match(self, text: str) -> bool:
        """Whether any clause can match: most texts have no word of the grammar's attacks."""
        words = set(WORD.findall(text.lower()))
        if not words.isdisjoint(HARMS) or not words.isdisjoint(self.lexicon.keys()):
            return True
        return any(not {w[:n] + "*" for w in words if len(w) > n}.isdisjoint(self.lexicon.keys()) for n in STEMS)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest hashes of each text's word triples under ``SKETCHES`` functions."""
    multipliers = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)[:SKETCHES]
    for batch in batches:
        sketches = []
        for text in batch.column("text").to_pylist():
            words = WORD.findall(text.lower()) or [text]
            triples = {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
            hashes = np.fromiter((xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in triples), np.uint64, len(triples))
            with np.errstate(over="ignore"):
                mixed = hashes[:, None] * multipliers
                sketches.append((mixed ^ (mixed >> np.uint64(32))).min(axis=0).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("label"), pa.array(sketches, pa.list_(pa.int64()))], ["text", "label", "sketch"])


def _counted(only: frozenset[str] | None):
    """Texts with each feature, counted per task; ``only``: no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = features(text)
                counts.update(own if only is None else own & only)
                if len(counts) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])

    return run


def _owned(only: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(features(t) & only) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string()))], ["features"])

    return run


def _covering(strong: dict[str, float], texts: list[list[str]], least: int, ample: float) -> dict[str, float]:
    """The features that explain toxic texts which stronger ones do not.

    Words that copies of a toxic text share have high odds too; what attacks in those texts is
    also in others, so such words explain nothing new. A word in ample texts is taken as it is,
    unless a chosen word that it is the stem of accounts for nearly all of them.
    """
    holders: dict[str, list[int]] = {}
    for k, own in enumerate(texts):
        for w in own:
            holders.setdefault(w, []).append(k)
    open_texts = set(range(len(texts)))
    chosen = {}
    for w in sorted(holders, key=lambda w: (-round(strong[w], 1), -len(w.rstrip("*")), w)):
        new = open_texts.intersection(holders[w])
        longer = max((len(holders[c]) for c in chosen if w[-1] == "*" and c.startswith(w[:-1])), default=0)
        if len(new) >= least or len(holders[w]) >= ample and longer < 0.8 * len(holders[w]):
            chosen[w] = strong[w]
            open_texts -= new
    return chosen


def _strongest(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                found = grammar.attacks(text) if grammar.may_match(text) else []
                if found:
                    counts[max(found, key=lambda a: grammar.factors[a[0]] * a[1])[0], label] += 1
        kinds = [k for k, _ in counts], [x for _, x in counts], list(counts.values())
        yield pa.RecordBatch.from_arrays([pa.array(kinds[0], pa.string()), pa.array(kinds[1], pa.int32()), pa.array(kinds[2], pa.int64())], ["kind", "label", "n"])

    return run


def train(docs: DataFrame, labels: DataFrame, in_training: Column, most: int = MOST_ROWS) -> Grammar:
    """Learn lexicon and factors from about ``most`` labelled texts of each class.

    Near copies count once: of the texts of a class that share the smallest hash of their word
    triples, under any of a few hash functions, one is used, so repeated rows weigh no more than
    one. Null labels and ids are left out, null texts are empty ones; entries of equal strength are
    chosen in the order of length, then letters. Without texts of both classes (an empty table
    included) the lexicon is empty and the factors are the priors. Other columns are not read.
    """
    rows = training_rows(docs, labels, "toxic", in_training, most)
    rows = materialize(rows.mapInArrow(_sketched, "text string, label int, sketch array<long>"), "toxic-sample")
    for k in range(SKETCHES):
        rows = rows.dropDuplicates(["label", f"sketch_{k}"]) if k else rows.select("text", "label", *[F.col("sketch")[n].alias(f"sketch_{n}") for n in range(SKETCHES)]).dropDuplicates(["label", "sketch_0"])
    rows = materialize(rows.select("text", "label"), "toxic-sample")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return Grammar()
    shape = "feature string, n long"
    total = lambda df: df.groupBy("feature").agg(F.sum("n").alias("n"))
    frequent = max(LEAST_TEXTS, LEAST_SHARE * toxic)
    seen = {r["feature"]: r["n"] for r in total(rows.where("label = 1").select("text").mapInArrow(_counted(None), shape)).where(F.col("n") >= frequent).collect()}
    against = {r["feature"]: r["n"] for r in total(rows.where("label = 0").select("text").mapInArrow(_counted(frozenset(seen)), shape)).collect()}
    odds = {w: (n + 0.5) / (toxic + 1) / ((against.get(w, 0) + 0.5) / (other + 1)) for w, n in seen.items()}
    strong = {w: math.log(x) for w, x in odds.items() if x >= LEAST_ODDS}
    # the toxic texts' strong features, MOST_ROWS rows at most
    owned = rows.where("label = 1").select("text").mapInArrow(_owned(frozenset(strong)), "features array<string>").collect()
    grammar = Grammar(_covering(strong, [r["features"] for r in owned], max(2, int(LEAST_SHARE / 2 * toxic)), max(8.0, AMPLE_SHARE * toxic)))
    hits: Counter[tuple[str, int]] = Counter()
    for r in rows.mapInArrow(_strongest(grammar), "kind string, label int, n long").groupBy("kind", "label").agg(F.sum("n").alias("n")).collect():
        hits[r["kind"], r["label"]] = r["n"]
    for kind, prior in CATEGORIES.items():
        yes, no = hits[kind, 1], hits[kind, 0]
        grammar.factors[kind] = (yes + prior * PRIOR_TEXTS) / (yes + no + PRIOR_TEXTS)
    return grammar


def scores(grammar: Grammar) -> Iterable:
    """A column function: the score of a text, read whole; null and empty texts score as texts without an attack.

    Repeated rows score alike; an empty table gives no rows.
    """

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([grammar.score(t) for t in text], dtype="float64")

    return score
