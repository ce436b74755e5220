"""Secret scans: fixed patterns, and Markov models of random strings and ordinary identifiers.

Every run of token characters is scored with two character models, one of random strings, one
of ordinary identifiers: the sum over neighbouring characters of the logarithm of their
probability under the first over that under the second. Runs with a ratio of at least the
threshold are spans of kind ``markov``, unless a fixed pattern's span covers them whole; a run
that a fixed span covers in part is scored whole, so nothing of a longer token is left beside it.

The models are trained from labelled samples, (value, label) rows: label 1 are the values that
the fixed patterns find in sampled documents and strings in five alphabets made from ids by
SHA-256; label 0 are the tokens that sampled documents have outside such values, also in
capitals, and decimal numbers. A quarter of the values is held out. The threshold is the
logarithm of the odds against a secret (``ODDS_AGAINST``), or more where held-out ordinary
tokens ask for it. Runs shorter than ``least`` characters are not looked at: below it the models
cannot tell, since fewer than half of the held-out random strings, cut to that length, reach the
threshold.

Everything is a DataFrame operation; the models come to the driver as one probability ratio
per pair of characters and go back as a literal.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# The patterns of the three base kinds, as the contract states them.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",  # runs are maximal, so the least length may stand in the pattern
    "hex": r"[0-9a-f]{24,}",
}
KINDS = ("assign", "access", "hex", "markov")
LEAST_ASSIGNED = 6
RUN = "[A-Za-z0-9+/_=-]"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Documents whose tokens train the model of ordinary identifiers, about, at most.
SAMPLE_DOCS = 1000
#: Documents whose fixed-pattern values, and ids whose digests, train the model of random strings, about, at most.
SAMPLE_STRINGS = 8000
#: Odds against a token being a secret, before its characters are looked at.
ODDS_AGAINST = 1e6
#: Share of held-out ordinary tokens that may reach the threshold.
FALSE_ALARMS = 1e-5
#: Weight, in pairs, of a character's frequency alone in what follows another.
BACK_OFF = 5.0
#: Share of a model's probability that is spread evenly, so that no single pair decides.
EVEN = 0.02
#: Lengths tried for ``least``.
LENGTHS = range(4, 33)
SPAN = "array<struct<start:bigint,ord:int,end:bigint,value:string>>"


class Model(NamedTuple):
    """Log-likelihood ratios of all pairs of characters, row by row of the alphabet; the threshold of their sum; the shortest run scored."""

    ratios: list[float]
    threshold: float
    least: int


def _places(text: Column, kind: str, pattern: str, wanted) -> Column:
    """Spans of the pattern's matches whose value is ``wanted``: gaps and matches alternate, so lengths add up to places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else hits
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
    steps = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))

    def walk(done: Column, step: Column) -> Column:
        start = done["at"] + F.length(step["gap"])
        end = start + F.length(step["hit"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end"), step["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(wanted(step["value"]), F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(steps, nothing, walk)["spans"]).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    wanted = lambda kind: lambda v: F.length(v) >= (LEAST_ASSIGNED if kind == "assign" else 1)
    return F.array_sort(F.concat(*[_places(text, k, p, wanted(k)) for k, p in PATTERNS.items()]))


def _uncovered(runs: Column, base: Column) -> Column:
    return F.filter(runs, lambda c: ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])))


def random_runs(text: Column, model: Model) -> Column:
    """Spans of the runs that the models take for random strings."""
    return _places(text, "markov", f"{RUN}{{{model.least},}}", lambda v: log_ratio(v, model.ratios) >= model.threshold)


def _chosen(most: int, n: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(min(1.0, most / max(1, n)) * (1 << 20))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(value, label) rows from bounded samples of ``docs``; see the module's text."""
    n = docs.count()
    sampled = docs.where(_chosen(max(SAMPLE_STRINGS, SAMPLE_DOCS), n)).select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    held = sampled.select(F.explode(base_spans(text)).alias("s")).select(F.col("s.value").alias("value"), F.lit(1).alias("label"))
    digest = F.unhex(F.sha2(F.concat(F.lit("random"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    coded, hexed = F.base64(digest), F.hex(digest)
    kept = lambda c, out: F.regexp_replace(c, out, "")
    made = F.array(kept(coded, "="), F.lower(hexed), F.upper(kept(coded, "[^A-Za-z0-9]")), F.lower(kept(coded, "[^A-Za-z0-9]")), F.translate(kept(coded, "="), "+/", "-_"))
    number = F.abs(F.xxhash64("doc_id", F.lit("number"))).cast("string")
    numbers = F.transform(F.sequence(F.lit(2), F.lit(18), F.lit(4)), lambda k: F.substring(number, F.lit(1), k))
    strings = sampled.where(_chosen(SAMPLE_STRINGS // 4, n))
    random = strings.select(F.explode(made).alias("value"), F.lit(1).alias("label"))
    digits = strings.select(F.explode(numbers).alias("value"), F.lit(0).alias("label"))
    few = sampled.where(_chosen(SAMPLE_DOCS, n)).select(text.alias("text"), base_spans(text).alias("base"))
    values = F.transform("base", lambda s: s["value"])
    words = few.select(F.explode(F.array_except(F.regexp_extract_all("text", F.lit(RUN + "{2,}"), F.lit(0)), values)).alias("value"))
    # what looks like a fixed pattern's value, or mixes letters and digits at length, has no sure label
    words = words.where(~F.col("value").rlike("[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}|^(?=.*[0-9])(?=.*[A-Za-z]).{12,}$"))
    words = words.unionByName(words.select(F.upper("value").alias("value"))).withColumn("label", F.lit(0))
    return held.unionByName(random).unionByName(digits).unionByName(words)


def _held_out(value: Column) -> Column:
    return F.pmod(F.xxhash64(value, F.lit("fold")), F.lit(4)) == 0


def _pairs(samples: DataFrame) -> DataFrame:
    """Neighbouring characters of the samples, counted by label; characters outside the alphabet part a string."""
    c = F.col("value")
    known = samples.where(F.length(c) > 1).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: c.substr(i, F.lit(2)))).alias("pair"))
    a, b = F.instr(F.lit(ALPHABET), F.substring("pair", 1, 1)), F.instr(F.lit(ALPHABET), F.substring("pair", 2, 1))
    return known.select("label", a.alias("a"), b.alias("b")).where("a > 0 AND b > 0").groupBy("label", "a", "b").count()


def train(samples: DataFrame) -> Model:
    """The model of (value, label) rows. Null values and labels other than 0 and 1 are left out; no rows: nothing is a secret."""
    samples = materialize(samples.where("value IS NOT NULL AND label IN (0, 1)").groupBy("value", "label").agg(F.count(F.lit(1)).alias("n")), "samples")
    size = len(ALPHABET)
    counts = [[[0.0] * size for _ in range(size)] for _ in range(2)]
    for label, a, b, k in _pairs(samples.where(~_held_out(F.col("value")))).collect():  # two rows per pair of characters
        counts[label][a - 1][b - 1] += k
    logs = []
    for table in counts:
        seen = [sum(row[b] for row in table) + 0.5 for b in range(size)]
        alone = [x / sum(seen) for x in seen]  # what follows a character that was rarely met
        logs.append([[math.log((1 - EVEN) * (k + BACK_OFF * p) / (sum(row) + BACK_OFF) + EVEN / size) for k, p in zip(row, alone, strict=True)] for row in table])
    ratios = [r - w for row_w, row_r in zip(*logs, strict=True) for r, w in zip(row_r, row_w, strict=True)]
    told = samples.where((F.col("label") == 0) & _held_out(F.col("value"))).select("n", log_ratio(F.col("value"), ratios).alias("r"))
    # the ratio that no more than the given share of ordinary tokens, with their numbers, reaches
    high = told.where(F.col("r") >= math.log(ODDS_AGAINST)).groupBy(F.ceil("r").alias("r")).agg(F.sum("n").alias("n")).orderBy(F.desc("r"))
    allowed, threshold = FALSE_ALARMS * (told.agg(F.sum("n")).first()[0] or 0), math.log(ODDS_AGAINST)
    for r, n in high.collect():  # a row for each whole number
        allowed -= n
        if allowed < 0:
            threshold = float(r)
            break
    cut = samples.where((F.col("label") == 1) & _held_out(F.col("value"))).select("value", F.explode(F.array(*map(F.lit, LENGTHS))).alias("length")).where(F.length("value") >= F.col("length"))
    passed = cut.groupBy("length").agg(F.avg((log_ratio(F.substring("value", F.lit(1), F.col("length")), ratios) >= threshold).cast("int")).alias("share"))
    least = passed.where("share >= 0.5").agg(F.min("length")).first()[0]
    return Model(ratios, threshold, least or LENGTHS[-1])


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """Sum over neighbouring characters; 0 for a single character and for pairs outside the alphabet."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # folded to one literal
    size = len(ALPHABET)
    begin = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("total"))

    def step(done: Column, c: Column) -> Column:
        at = F.instr(F.lit(ALPHABET), c)
        known = (at > 0) & (done["before"] > 0)
        return F.struct(at.alias("before"), (done["total"] + F.when(known, F.get(table, (done["before"] - 1) * size + at - 1)).otherwise(0.0)).alias("total"))

    return F.aggregate(F.split(token, ""), begin, step)["total"]


def _told(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["ord"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with_spans(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (columns text and any others) with ``_base`` and ``_spans``. Each column is worked out on its own, once a row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumns({"_base": base_spans(text), "_random": random_runs(text, model)})
    return found.withColumn("_spans", F.array_sort(F.concat("_base", _uncovered(F.col("_random"), F.col("_base"))))).drop("_random")


def scan(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(doc_id, base, spans, told, base_told) for every row of ``docs`` (doc_id, text, ...).

    ``base`` and ``spans`` are arrays of (start, ord, end, value), ``ord`` the kind's place in
    ``KINDS``; places are code points, the end is exclusive. ``samples`` (value, label) trains the
    models, by default ``labelled_samples(docs)``. A null text is the empty text, without spans; a
    text of any length is scanned whole; spans of equal start are told in the order of ``KINDS``.
    Repeated rows and null ids are kept; other columns, whatever their names, are dropped. An
    empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _with_spans(rows, train(labelled_samples(rows) if samples is None else samples))
    return found.select("doc_id", F.col("_base").alias("base"), F.col("_spans").alias("spans"), _told(F.col("_spans")).alias("told"), _told(F.col("_base")).alias("base_told"))


def redact(docs: DataFrame, mark: str = "[SECRET]", samples: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret of its text replaced by ``mark`` and n_chars, where it is a column, renewed.

    Overlapping and touching spans give one mark. Rows without secrets, null and empty texts
    included, stay as they are, even where their text holds the mark already; no row goes, and
    repeated rows, null ids, texts of any length and columns of any name are kept. An empty table
    gives an empty result.
    """
    rows = docs.select("doc_id", "text")
    model = train(labelled_samples(rows) if samples is None else samples)
    # the row travels as one struct, so no name of its columns can clash
    found = _with_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text"), model)
    text, spans = F.col("text"), F.col("_spans")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(done: Column, s: Column) -> Column:
        between = F.array(F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), F.lit(mark))
        fresh = (s["start"] > done["at"]) | (F.size(done["out"]) == 0)  # a span that meets the one before widens it
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(fresh, F.concat(done["out"], between)).otherwise(done["out"]).alias("out"))

    def finish(done: Column) -> Column:
        return F.concat(F.array_join(done["out"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))

    secret = F.size(spans) > 0
    hidden = found.withColumn("_text", F.when(secret, F.aggregate(spans, begin, cut, finish)).otherwise(text))
    fresh = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        fresh["n_chars"] = F.when(secret, F.length("_text").cast(kind)).otherwise(F.col("doc.n_chars"))
    return hidden.select(*[fresh.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
