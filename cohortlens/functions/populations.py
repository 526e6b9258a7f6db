"""Terms of a lexicon in texts: which occur, and in which line.

A term has patterns; one mention comes out for each (term, surface), with the first matching line as evidence.  Patterns are compared by the
JVM's regular expressions in one projection, without Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
KINDS = ("biomarker", "demographic", "disease_severity", "prior_therapy", "line_of_therapy", "disease_stage")
EVIDENCE_CHARS = 300

Lexicon = Sequence[tuple[str, str, Sequence[str]]]  # term, kind, patterns


def _any(patterns: Sequence[str]) -> str:
    return "(?iU)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def terms_in(text: Column, lexicon: Lexicon) -> Column:
    """array<struct<term_id, kind>> of the terms that occur."""
    hit = lambda term, kind, ps: F.when(text.rlike(_any(ps)), F.struct(F.lit(term).alias("term_id"), F.lit(kind).alias("kind")))
    return F.array_compact(F.array(*[hit(*e) for e in lexicon]).cast("array<struct<term_id: string, kind: string>>"))


def term_hits(rows: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """rows without the text, one for each term that occurs: term_id, kind added."""
    rest = [c for c in rows.columns if c != text]
    return rows.select(*rest, F.inline(terms_in(F.col(text), lexicon)))


def mentions(studies: DataFrame, surfaces: Mapping[str, Column], lexicon: Lexicon, key: str = "nct_id") -> DataFrame:
    """key, term_id, kind, surface, evidence_line.  surfaces: name -> text; lists are to be joined by newlines."""

    def one(name: str, text: Column) -> DataFrame:
        hits = studies.select(key, text.alias("_t")).where(F.col("_t").isNotNull())
        line = lambda ps: F.substring(F.trim(F.get(F.filter(F.split("_t", "\n"), lambda x: x.rlike(_any(ps))), F.lit(0))), 1, EVIDENCE_CHARS)
        found = [F.when(F.col("_t").rlike(_any(ps)), F.struct(F.lit(term).alias("term_id"), F.lit(kind).alias("kind"), line(ps).alias("evidence_line"))) for term, kind, ps in lexicon]
        return hits.select(key, F.inline(F.array_compact(F.array(*found).cast("array<struct<term_id: string, kind: string, evidence_line: string>>")))).withColumn("surface", F.lit(name))

    return reduce(DataFrame.unionByName, [one(n, c) for n, c in surfaces.items()])
