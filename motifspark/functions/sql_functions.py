"""The motif functions as session SQL functions, and segments and windows as table functions.

After ``register(spark)`` a query in SQL alone can do what ``alphabet`` and ``scan`` do:

    select r.read_id, w.pos, trm_strand_canonical(trm_canonical(w.kmer)) as motif
    from reads r, lateral trm_windows(r.seq, 6) w

They are SQL expressions that Catalyst inlines; nothing leaves the JVM. A table function
is one ``select inline(...)`` without a subquery: so a lateral join to it is a generator on
the rows, and no join of the table with its own distinct texts.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_ENCODE = "translate(upper({seq}), 'TGCA0123', '0123xxxx')"
# name and arguments, what it returns, body
SCALARS = (
    ("trm_encode(seq string)", "string", _ENCODE.format(seq="seq")),
    ("trm_decode(motif string)", "string", "translate(motif, '0123', 'TGCA')"),
    ("trm_reverse_complement(motif string)", "string", "reverse(translate(motif, '0123', '3210'))"),
    ("trm_canonical(motif string)", "string", "array_min(transform(sequence(1, length(motif)), i -> substr(concat(motif, motif), i, length(motif))))"),
    ("trm_other_strand(motif string)", "string", "trm_canonical(trm_reverse_complement(motif))"),
    ("trm_strand_canonical(motif string)", "string", "least(motif, trm_other_strand(motif))"),
    ("trm_is_palindrome(motif string)", "boolean", "motif = trm_other_strand(motif)"),
    ("trm_distinct_bases(motif string)", "int", "size(array_distinct(split(motif, '')))"),
    ("trm_is_homopolymer(motif string)", "boolean", "motif = repeat(left(motif, 1), length(motif))"),
    ("trm_has_short_period(motif string, below int)", "boolean", "exists(filter(sequence(1, below - 1), p -> p >= 3 and p < length(motif)), p -> left(motif, length(motif) - p) = substr(motif, p + 1))"),
    ("trm_sign(fwd bigint, bwd bigint)", "string", "case when fwd > bwd then '+' when fwd < bwd then '-' else '?' end"),
)
TABLES = (
    ("trm_halves(seq string)", "side string, seg string", "select inline(array(struct('L', left(trm_halves.seq, length(trm_halves.seq) div 2)), struct('R', substr(trm_halves.seq, length(trm_halves.seq) div 2 + 1)))) as (side, seg)"),
    (
        "trm_slices(seq string, size int)",
        "slice int, seg string",
        """select inline(flatten(transform(array(length(trm_slices.seq)), n -> transform(if(n div trm_slices.size > 0, sequence(1, cast(n div trm_slices.size as int)), cast(array() as array<int>)), i -> struct(i, substr(trm_slices.seq,
(i - 1) * trm_slices.size + if(i > (n div trm_slices.size + 1) div 2, n % trm_slices.size, 0) + 1, trm_slices.size + if(i = (n div trm_slices.size + 1) div 2, n % trm_slices.size, 0))))))) as (slice, seg)""",
    ),
    (
        "trm_windows(seq string, k int)",
        "pos int, kmer string",
        f"""select inline(filter(flatten(transform(array({_ENCODE.format(seq="trm_windows.seq")}), enc -> transform(
if(length(trm_windows.seq) >= trm_windows.k, sequence(1, length(trm_windows.seq) - trm_windows.k + 1), cast(array() as array<int>)), i -> struct(i as pos, substr(enc, i, trm_windows.k) as kmer)))), w -> not w.kmer rlike '[^0-3]')) as (pos, kmer)""",
    ),
)


def register(spark: SparkSession) -> None:
    for name, kind, body in SCALARS:
        spark.sql(f"create or replace temporary function {name} returns {kind} return {body}")
    for name, columns, body in TABLES:
        spark.sql(f"create or replace temporary function {name} returns table ({columns}) return {body}")
