"""Strand fold, merging, report, votes and direction over motif rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions import alphabet as al
from ..sources.scratch import written
from .kernel import with_flip
from .ranks import with_rank

# Rows printed from, answers from, votes by forward, total and ratio, ratio candidates, answers.
PRINT_FROM, ANSWER_FROM = 10, 20
TOP_FORWARD, TOP_TOTAL, TOP_RATIO, RATIO_CANDIDATES, ANSWERS = 4, 4, 4, 20, 10


def strand_fold(rows: DataFrame, cfg: ScanConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """by, level, k, kmer, fwd, bwd, both: counts by strand; bwd is -1 for motifs that are their own other strand."""
    folded = with_flip(rows, "kmer", "flip")
    own = F.when(F.col("direction") == "backward", F.col("flip")).otherwise(F.col("kmer"))
    one_way = F.col("direction") != "both"
    key = F.when(one_way, F.least("kmer", "flip")).otherwise(F.col("kmer"))
    folded = folded.select(*by, "level", "k", key.alias("key"), own.alias("own"), one_way.alias("one_way"), "cnt")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("cnt"))), F.lit(0)).cast("long")
    out = folded.groupBy(*by, "level", "k", F.col("key").alias("kmer")).agg(count(F.col("one_way") & (F.col("own") == F.col("key"))).alias("fwd"), count(F.col("one_way") & (F.col("own") != F.col("key"))).alias("bwd"), count(~F.col("one_way")).alias("both"))
    out = out.withColumn("bwd", F.when(al.is_palindrome(F.col("kmer")), F.lit(-1).cast("long")).otherwise(F.col("bwd")))
    return out.where(~al.has_short_period(F.col("kmer"), cfg.min_mer))


def merge_files(folded: DataFrame) -> DataFrame:
    return folded.groupBy("level", "k", "kmer").agg(*(F.sum(c).alias(c) for c in ("fwd", "bwd", "both")))


def report(folded: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows that are printed, with the order in their level as rank."""
    total = F.col("fwd") + F.col("bwd") + F.col("both")
    sign = F.when(F.col("fwd") > F.col("bwd"), "+").when(F.col("fwd") < F.col("bwd"), "-").otherwise("?")
    ranked = with_rank(folded.where(total >= PRINT_FROM).select(*by, "level", "k", "kmer", "fwd", "bwd", "both"), (*by, "level"), [F.desc("fwd"), F.desc("both"), "k", "kmer"])
    return ranked.select(*by, "level", "rank", "k", al.decode(F.col("kmer")).alias("motif"), F.greatest("fwd", "bwd").alias("most"), F.least("fwd", "bwd").alias("least"), "both", sign.alias("sign"))


def vote_scores(merged: DataFrame) -> DataFrame:
    """level, k, kmer, score: one vote for each of the level's first by forward count, by total and by strand ratio.

    Votes, calls and answers read the merged motifs in several branches, so these are written once: a scan runs once.
    """
    return _votes(written(merged)[0])


def _votes(merged: DataFrame) -> DataFrame:
    rows = merged.withColumn("total", F.col("fwd") + F.col("bwd") + F.col("both")).where(F.col("total") >= PRINT_FROM)
    rows = rows.select("level", "k", "kmer", "total", F.greatest("fwd", "bwd").alias("f"), F.least("fwd", "bwd").alias("b"))
    rank = lambda *o: F.row_number().over(Window.partitionBy("level").orderBy(*o, "k", "kmer"))
    by_forward, by_total = F.desc("f"), F.desc("total")
    forward = rows.where("f > 0").withColumn("r", rank(by_forward)).where(F.col("r") <= TOP_FORWARD)
    total = rows.withColumn("r", rank(by_total)).where(F.col("r") <= TOP_TOTAL)
    two_way = rows.where("f > 0 and b >= 0")
    near = two_way.withColumn("r", rank(by_forward)).where(F.col("r") <= RATIO_CANDIDATES).unionByName(two_way.withColumn("r", rank(by_total)).where(F.col("r") <= RATIO_CANDIDATES)).drop("r").distinct()
    ratio = near.withColumn("r", rank(F.col("b") / F.col("f"))).where(F.col("r") <= TOP_RATIO)
    votes = forward.unionByName(total).unionByName(ratio)
    return votes.groupBy("level", "k", "kmer").agg(F.count("*").cast("int").alias("score"))


def direction_call(merged: DataFrame) -> DataFrame:
    """k, kmer, score (both levels and bonuses) and direction of every voted motif."""
    return _calls(written(merged)[0])


def _calls(merged: DataFrame) -> DataFrame:
    score = _votes(merged).groupBy("k", "kmer").agg(F.sum("score").cast("int").alias("votes"))
    of = lambda level: merged.where(F.col("level") == level).select("k", "kmer", F.col("fwd").alias(f"{level}_f"), F.col("bwd").alias(f"{level}_b"))
    rows = score.join(of("low"), ["k", "kmer"], "left").join(of("high"), ["k", "kmer"], "left").na.fill(0)
    low, high = F.signum(F.col("low_f") - F.col("low_b")).cast("int"), F.signum(F.col("high_f") - F.col("high_b")).cast("int")
    x = F.least("low_f", "low_b") * F.greatest("high_f", "high_b")
    y = F.least("high_f", "high_b") * F.greatest("low_f", "low_b")
    larger_low = F.col("low_f") + F.col("low_b") > F.col("high_f") + F.col("high_b")
    call = F.when(low == high, low).when(low == 0, high).when(high == 0, low).when(x == y, F.when(larger_low, low).otherwise(high)).when(x < y, low).otherwise(high)
    bonus = ((low != 0) & (low == high)).cast("int") + (al.distinct_bases(F.col("kmer")) > 2).cast("int")
    return rows.select("k", "kmer", (F.col("votes") + bonus).alias("score"), call.alias("direction"))


def putative(merged: DataFrame) -> DataFrame:
    """The answers: k, motif, score, sign and their rank from 1; one row without a motif where no motif is frequent."""
    merged, _ = written(merged)
    gate = merged.agg(F.coalesce(F.max(F.col("fwd") + F.col("bwd") + F.col("both")) >= ANSWER_FROM, F.lit(False)).alias("open"))
    sign = F.when(F.col("direction") > 0, "+").when(F.col("direction") < 0, "-").otherwise("?")
    order = [F.desc("score"), F.desc(al.distinct_bases(F.col("kmer"))), "k", "kmer"]
    found = _calls(merged).orderBy(*order).limit(ANSWERS).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # ANSWERS rows
    found = found.join(F.broadcast(gate.where("open"))).select("k", al.decode(F.col("kmer")).alias("motif"), "score", sign.alias("sign"), "rank")
    none = gate.where("not open").select(F.lit(-1).alias("k"), F.lit("NO_PUTATIVE_TRM").alias("motif"), F.lit(-1).alias("score"), F.lit("?").alias("sign"), F.lit(1).alias("rank"))
    return found.unionByName(none)
