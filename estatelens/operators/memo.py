"""Content-addressed profiles: equal scripts are scanned once, and known ones never again.

A profile depends on a script's content, the extension of its name, and the rule packs. The memo
keeps profiles under the content's fingerprint and the extension, in a folder for each version of
the packs, so changed packs start anew. A portfolio is kept as counts and sums by language, module
and level; a new version of the estate takes away what the changed and lost scripts had added and
adds what the changed and new ones do, without looking at the others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..plans import rulepacks as packs
from ..sources import commits
from ..sources.tables import kept
from . import readiness

KEY = ["content_hash", "extension"]
CELL = ["language", "module", "level"]
SUMS = ["n_scripts", "score", "consultant_hours", "assisted_hours"]


def pack_version() -> str:
    """A digest of everything in the rule packs."""
    told = {name: value for name, value in vars(packs).items() if name.isupper()}
    return hashlib.sha256(repr(sorted(told.items())).encode()).hexdigest()[:16]


def keyed(scripts: DataFrame) -> DataFrame:
    """``scripts`` with what their profile is found by; a null content has the key of the empty one."""
    return scripts.withColumns({"content_hash": fingerprint(F.coalesce("content", F.lit(""))), "extension": F.coalesce(F.regexp_extract("filename", r"(\.[^.]*)\z", 1), F.lit(""))})


class Memo:
    """Verdicts by content, under ``path``; ``scanned`` is the number of contents that the last call had to scan."""

    def __init__(self, path: str, version: str | None = None):
        self.path = f"{path}/{version or pack_version()}"
        self.scanned = 0

    def _known(self, scripts: DataFrame) -> DataFrame:
        return commits.read(scripts.sparkSession, self.path, "verdicts", f"content_hash string, extension string, {readiness.VERDICT}").drop("commit_key")

    def learn(self, scripts: DataFrame) -> None:
        """Scan the contents of ``scripts`` (with keys) that the memo does not have, each once.

        The rows that are scanned are named by the digest of their keys: a call that died is made
        up for by the next one, and the same call twice adds nothing.
        """
        spark = scripts.sparkSession
        first = scripts.groupBy(*KEY).agg(F.min("script_id").alias("script_id"))
        new = kept(first.join(self._known(scripts).select(*KEY), KEY, "left_anti"), "new")  # else each use would hash all contents again
        told = new.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*KEY)), F.lit(0)).alias("digest")).first()
        self.scanned = told["n"]
        if not told["n"]:
            return
        asked = scripts.drop(*KEY).join(new, "script_id")
        verdicts = readiness.verdicts(asked.select("script_id", "filename", "content"))
        rows = new.join(verdicts, "script_id").drop("script_id")
        commits.append(spark, self.path, f"{told['n']}-{told['digest']}", {"verdicts": rows})

    def verdicts(self, scripts: DataFrame) -> DataFrame:
        """``readiness.verdicts`` of ``scripts``, of which only unknown contents are scanned."""
        own = keyed(scripts)
        self.learn(own)
        return own.select("script_id", *KEY).join(self._known(scripts), KEY).drop(*KEY)


def _signed(verdicts: DataFrame, sign: int) -> DataFrame:
    return verdicts.select(*CELL, F.lit(sign).cast("long").alias("n_scripts"), *[(F.col(c) * sign).alias(c) for c in SUMS[1:]])


def cells(verdicts: DataFrame) -> DataFrame:
    """Counts and sums by language, module and level: at most as many rows as there are such triples."""
    return _summed(_signed(verdicts, 1))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_scripts <> 0")


def changed_cells(old_cells: DataFrame, memo: Memo, old: DataFrame, new: DataFrame) -> DataFrame:
    """The cells of ``new`` from those of ``old``: verdicts are asked for of the scripts that differ only.

    Both versions are (script_id, filename, content), of which only keys are compared; the memo knows
    the contents of ``old``, so of the scripts that differ only new contents are scanned.
    """
    a = keyed(old).select("script_id", F.struct(*KEY).alias("was"))
    b = keyed(new).select("script_id", F.struct(*KEY).alias("now"))
    differ = a.join(b, "script_id", "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("script_id")
    differ = kept(differ, "differ")
    of = lambda scripts: memo.verdicts(scripts.join(differ, "script_id", "left_semi"))
    gone = _signed(of(old), -1)
    came = _signed(of(new), 1)
    return _summed(old_cells.select(*CELL, *SUMS).unionByName(gone).unionByName(came))


def portfolio(of_cells: DataFrame) -> DataFrame:
    """``readiness.portfolio`` from cells."""
    total = lambda c: F.sum(c)
    rolled = of_cells.rollup(*CELL).agg(
        F.grouping_id().alias("grouping"), total("n_scripts").alias("n_scripts"), F.round(total("score") / total("n_scripts"), 6).alias("avg_score"),
        total("consultant_hours").alias("consultant_hours"), total("assisted_hours").alias("assisted_hours"),
    )
    return readiness.with_savings(rolled)
