"""Cross-site line dedup in DataFrame functions only.

A line's spread is the number of distinct sites it stands on. Fixed-width counts
per line hash come first: a line met fewer times than the threshold, or on one
site alone, can't reach it. For the rest HyperLogLog sketches of the site merge by
aggregation; estimates clearly over or under the threshold decide, and lines near
it get an exact distinct count. Boilerplate lines are then removed everywhere but
at their first place (smallest id, then smallest line number).

All aggregates combine on the map side, so a line on a third of all rows reaches a
reducer as one row for each map task. The places of lines met often enough are written
once; where they meet a table of lines, the key is the line and a salt of the place, so
such a line divides into ``SALTS`` tasks. Line equality is that of 64-bit hashes.

Defined results: null text is empty text; a null site is one more site; lines
shorter than ``min_chars`` after trimming spaces never count; rows that share an
id share the fate of equal lines at equal places; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

SALTS = 32


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, site, line_no, h for each line long enough."""
    at = docs.select("doc_id", F.xxhash64("site").alias("site"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return at.where(F.length(F.trim("line")) >= min_chars).select("doc_id", "site", "line_no", F.xxhash64("line").alias("h"))


def _salted(places: DataFrame) -> DataFrame:
    """places with salt, by document, so that a line on a third of all documents meets a table of lines in SALTS tasks."""
    return places.withColumn("salt", F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(SALTS)))


def _for_each_salt(table: DataFrame) -> DataFrame:
    """table (one row for each h) once for each salt."""
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int = 10, margin: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """The places (as lines, with a salt) of lines met often enough, written once; and h, first place of every line that stands on at least min_sites sites.

    margin: relative distance from the threshold within which sketches don't decide.
    """
    often = lines.groupBy("h").agg(F.count("*").alias("n"), F.min("site").alias("a"), F.max("site").alias("b"))
    often = often.where((F.col("n") >= min_sites) & ((F.col("a") != F.col("b")) | F.lit(min_sites <= 1))).select("h")
    met = materialize(_salted(lines).join(_for_each_salt(often), ["h", "salt"], "left_semi"))
    sketched = materialize(met.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min(F.struct("doc_id", "line_no")).alias("first")))
    low, high = min_sites * (1 - margin), min_sites * (1 + margin)
    near = sketched.where((F.col("sites") >= low) & (F.col("sites") <= high)).select("h", "first")
    exact = met.join(_for_each_salt(near.select("h")), ["h", "salt"], "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count("*").alias("exact"))
    sure = sketched.where(F.col("sites") > high).select("h", "first")
    return met, sure.unionByName(near.join(exact.where(F.col("exact") >= min_sites), "h").select("h", "first"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once for a row and not wherever body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(lines: Column, removed: Column) -> Column:
    """lines but those removed: the stretches between these, in order, so that the work grows with the lines alone."""

    def between(own: Column) -> Column:
        of_row = F.filter(own["removed"], lambda r: F.xxhash64(F.get(own["lines"], r["line_no"])) == r["h"])
        edges = F.concat(F.array(F.lit(-1)), F.sort_array(F.transform(of_row, lambda r: r["line_no"])), F.array(F.size(own["lines"])))
        stretch = lambda e, j: F.slice(own["lines"], F.get(e, j) + 2, F.get(e, j + 1) - F.get(e, j) - 1)
        return _let(edges, lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda j: stretch(e, j))))

    return F.when(removed.isNull(), lines).otherwise(_let(F.struct(lines.alias("lines"), removed.alias("removed")), between))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 8, min_chars: int = 10, with_columns: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed and the text left over, one row for each row of docs.

    with_columns: all of docs' columns with the text replaced instead.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(site_col).alias("site"))
    lines = _lines(own, min_chars)
    met, spread = spread_lines(lines, min_sites)
    again = met.join(_for_each_salt(spread), ["h", "salt"]).where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("first")))
    removed = again.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("line_no", "h")).alias("__removed"))
    joined = docs.join(removed, docs[id_col].eqNullSafe(F.col("__id")), "left")
    lines_of = F.split(F.coalesce(docs[text_col], F.lit("")), "\n")
    kept = _without(lines_of, F.col("__removed"))
    if with_columns:
        return joined.select(*(F.when(F.col("__removed").isNull(), docs[c]).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else docs[c] for c in docs.columns))
    out = joined.select(docs[id_col].alias("doc_id"), F.size(lines_of).cast("long").alias("n_lines"), kept.alias("__kept"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("__kept")).cast("long").alias("n_removed"), F.array_join("__kept", "\n").alias("text"))
