"""The ``opN_<name>`` queries over the given tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, language_model, line_dedup, mixing, ngram_join, packing, periodic, pii, quality, search, substring_dedup, suffix_dedup
from .storage import read_table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    none = F.lit(None)
    part = F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"), none.cast("string").alias("ref"), none.cast("double").alias("units"))
    chats = chat_format.format_chats(rows.unionByName(extra).withColumn("parts", F.array(part)))
    read = chats.withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.read_loss(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_attachment_tokens",
    )


_ESCAPED_LEN = "length({x}) + (length({x}) - length(replace({x}, chr(92), '')))" + "".join(f" + (length({{x}}) - length(replace({{x}}, '{c}', ''))) // {len(c)}" for c in chat_format.CONTROLS)
OP1_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len(chat_format.TURN) + len(chat_format.END) + 2} + length(role) + {_ESCAPED_LEN.format(x="text")})::bigint as formatted_chars,
  0::bigint as n_attachment_tokens
from rows group by conv_id"""


_REMOVED = "aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", F.expr(_REMOVED).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents"))
    kinds = [*pii.BASE_KINDS, *pii.ADDED_KINDS]
    rank = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, lambda s: F.struct(rank(s), s["start"], s["end"], s["kind"]))), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(F.concat("base", "added")).cast("long").alias("n_spans"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.expr(_REMOVED).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


MIX_WEIGHTS = {"domain": {"d0": 2.0, "d1": 1.0, "d2": 1.0}, "language": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "source": {"src0": 0.5}}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"), domain_of_source(F.col("source")), weights=MIX_WEIGHTS)


def domain_of_source(source):
    """A source's domain in these tables: its number modulo 3."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    return F.concat(F.lit("d"), F.when(number != "", F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 3").cast("string")).otherwise(F.lit("")))


def _share_sql(keys: list[str], above: list[str]) -> str:
    """One level of the tree in SQL: the children's shares of their parent's."""
    level = keys[-1]
    cases = " ".join(f"when '{k}' then {v!r}::double" for k, v in MIX_WEIGHTS[level].items())
    part = f"partition by {', '.join(above)}" if above else ""
    parent = "(select floor(sum(tokens) * 0.5) from leaves)" if not above else "p.share"
    join = f"join s_{above[-1]} p using ({', '.join(above)})" if above else ""
    cols = ", ".join(keys)
    return f"""n_{level} as (select {cols}, sum(tokens) * 2 as supply, sum(tokens) as tokens, case {level} {cases} else 1.0::double end as weight from leaves group by {cols}),
r_{level} as (select n_{level}.*, {parent}::double as budget, supply / weight as ratio from n_{level} {join}),
l_{level} as (select *, (budget - coalesce(sum(supply) over b, 0)) / (sum(weight) over ({part}) - coalesce(sum(weight) over b, 0)) as lv from r_{level}
  window b as ({part} order by ratio, {cols} rows between unbounded preceding and 1 preceding)),
s_{level} as (select {cols}, tokens, floor(least(supply, coalesce(greatest(max(lv) filter (lv <= ratio) over ({part}), 0) * weight, supply)))::bigint as share from l_{level})"""


OP7_SQL = f"""
with d as (
  select doc_id, 'd' || coalesce((try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as bigint) % 3)::varchar, '') as domain, coalesce(lang, '') as language, coalesce(source, '') as source,
    len(regexp_extract_all(text, '[^ \t-\r]+')) as n_tokens from documents),
leaves as (select domain, language, source, sum(n_tokens) as tokens from d where n_tokens > 0 group by 1, 2, 3),
{_share_sql(["domain"], [])},
{_share_sql(["domain", "language"], ["domain"])},
{_share_sql(["domain", "language", "source"], ["domain", "language"])},
c as (select d.*, (share // tokens)::bigint as whole, (share % tokens)::bigint as rest from d join s_source using (domain, language, source) where n_tokens > 0),
o as (select *, sum(n_tokens) over (partition by domain, language, source order by md5('7:' || whole || ':' || doc_id), doc_id) as upto from c)
select doc_id, domain, language, source, n_tokens::bigint as n_tokens, whole + (upto <= rest)::bigint as epochs from o where whole + (upto <= rest)::bigint > 0"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = """
with l as (
  select doc_id, source, line, row_number() over (partition by doc_id order by i) - 1 as no
  from (select doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
spread as (
  select line, min(doc_id * 1000000 + no) as first_at from l where length(trim(line)) >= 10
  group by line having count(distinct source) + max((source is null)::int) >= 8),
j as (select l.*, coalesce(l.doc_id * 1000000 + l.no > s.first_at, false) as gone from l left join spread s using (line))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by no) filter (not gone), '')) as kept_sha256
from j group by doc_id"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents")).drop("class_distance", "common_distance")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS_SQL = """unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term"""
OP11_SQL = f"""
with t as (select doc_id, {_TERMS_SQL} from documents),
q as (select item_id, {_TERMS_SQL} from benchmark),
sizes as (select doc_id, count(*) as n from t group by doc_id),
total as (select count(*) as docs, sum(n)::bigint as l from sizes),
met as (select doc_id, term, count(*) as tf from t semi join q using (term) group by all),
weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from met, total group by term),
parts as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l))) as part from met join weights using (term) join sizes using (doc_id), total),
scores as (select item_id, doc_id, sum(part)::bigint as score from q join parts using (term) group by all),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20"""


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, whose last words repeat in one document of ten, as the id's CRC says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def turned(words):  # a lambda's argument, so that a text is split once and not for each word
        n = F.size(words)
        bound = F.struct(words.alias("words"), (g % n).cast("int").alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).cast("int").alias("p"))
        tail = lambda w: F.transform(F.sequence(w["a"], F.size(w["words"]) - 1), lambda i: F.get(w["words"], w["a"] + (i - w["a"]) % w["p"]))
        return F.get(F.transform(F.array(bound), lambda w: F.array_join(F.concat(F.slice(w["words"], F.lit(1), w["a"]), tail(w)), " ")), F.lit(0))

    words = F.array(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    whole = F.get(F.transform(words, lambda w: F.when(F.size(w) > 0, turned(w))), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(whole, F.col("text"))).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(with_periodic_tails(read_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    out = out.withColumn("longest", longest)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.concat(listed, F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_pii": op4_pii,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_join": op10_ngram_join,
    "op11_lexical_search": op11_lexical_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_packing": op13_packing,
}
ORACLE_SQL = {"op1_chat_formatting": OP1_SQL, "op7_mixing": OP7_SQL, "op8_line_dedup": OP8_SQL, "op11_lexical_search": OP11_SQL}
