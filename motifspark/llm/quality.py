"""Quality rules by distribution divergence.

Base rules count words, symbols, repeated lines and repeated 3-word windows.
A document that passes them and is long enough is then compared with its
language's reference: the Jensen-Shannon distance (base 2, 0..1) between its
histograms of character classes and of common words and the reference's.
References are the mean histograms of all base-passing documents of a language;
there is one per listed language, so the table of references has a fixed bound.

Defined results: null text is an empty text and fails the word minimum; a null
or unlisted language has no reference and only the base rules apply, as do they
alone for documents under ``min_reference_words`` words (the limit on the sum of
both distances, which is the finer one, starts at ``min_sum_words``); repeated rows are
judged one by one; columns other than the id, text and language are not read.
Line and window equality is that of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

# Frequent function words of each reference language.
COMMON_WORDS = {
    "de": "der die und das in zu den ist von mit sich auf für nicht ein eine im auch als es".split(),
    "en": "the of and to in a is that it for on was be with as at by this from are".split(),
    "es": "de la que el en y a los se del las un por con no una su para es lo".split(),
    "fr": "le la de et les des en un une du est que pour dans qui au par sur pas avec".split(),
}

# Character classes: 0 continuation byte, 1 lower, 2 upper, 3 digit, 4 white space,
# 5 prose punctuation, 6 listed symbol, 7 other ASCII, 8 beyond ASCII (lead byte).
N_CLASSES = 9
CLASS = np.full(256, 7, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 1, 2, 3
CLASS[list(tx.SEPARATORS)] = 4
CLASS[list(b".,;:!?'\"-()")] = 5
CLASS[list(b"#*$%&|<>")] = 6
CLASS[128:192], CLASS[192:] = 0, 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _common_hashes() -> np.ndarray:
    return np.sort([tx.span_hash(tx.byte_prefix(b := np.frombuffer(w.encode(), np.uint8)), np.array([0]), np.array([len(b)]), "byte")[0] for w in sorted({w for ws in COMMON_WORDS.values() for w in ws})])


COMMON = _common_hashes()


def features(buf: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The base counts of each text, its class histogram and its common-word histogram."""
    n = len(off) - 1
    classes = np.bincount(np.repeat(np.arange(n), np.diff(off)) * N_CLASSES + CLASS[buf], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    starts, ends, doc = tx.words(buf, off)
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": classes.sum(1) - classes[:, 0] - classes[:, 4], "n_symbols": classes[:, 6]}

    l_start, l_end, l_doc = tx.lines(buf, off)
    has_word = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    l_start, l_end, l_doc = l_start[has_word], l_end[has_word], l_doc[has_word]
    sums = tx.byte_prefix(buf)
    salt = tx.mix(np.arange(n, dtype=np.uint64) + tx.U(1))
    _, again = tx.repeated(tx.span_hash(sums, l_start, l_end, "byte") + salt[l_doc])
    out["n_dup_lines"] = np.bincount(l_doc[again], minlength=n)

    at, grams = tx.ngrams(tx.span_hash(sums, starts, ends, "byte"), doc, 3)
    many, _ = tx.repeated(grams + salt[doc[at]])
    hit = np.zeros(len(doc), bool)
    for k in range(3):
        hit[at[many] + k] = True
    out["n_repeat_words"] = np.bincount(doc[hit], minlength=n)

    low = tx.span_hash(tx.byte_prefix(tx.LOWER[buf]), starts, ends, "byte")
    place = np.minimum(np.searchsorted(COMMON, low), len(COMMON) - 1)
    place = np.where(COMMON[place] == low, place, len(COMMON))
    width = len(COMMON) + 1
    common = np.bincount(doc * width + place, minlength=n * width).reshape(n, width)
    return out, classes[:, 1:], common


def base_failed(f: dict[str, np.ndarray], min_words: int = 50) -> np.ndarray:
    return (f["n_words"] < min_words) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q, in 0..1; rows need not be normalised."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1)
    q = q / max(q.sum(), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(-1)
        return np.sqrt(np.maximum(0, (kl(p) + kl(np.broadcast_to(q, p.shape))) / 2))


def _renamed(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))


def language_references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each listed language the mean class and common-word histograms of its base-passing documents."""
    n_class, n_common = N_CLASSES - 1, len(COMMON) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {lang: np.zeros(n_class + n_common) for lang in COMMON_WORDS}
        for batch, buf, off in tx.chunks(batches):
            f, classes, common = features(buf, off)
            ok = ~base_failed(f)
            langs = np.array(batch.column("lang").to_pylist(), object)
            both = np.hstack([classes / np.maximum(classes.sum(1, keepdims=True), 1), common / np.maximum(common.sum(1, keepdims=True), 1)])
            for lang in total:
                total[lang] += both[ok & (langs == lang)].sum(0)
        for lang, v in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(v), "k": np.arange(len(v)), "v": v})

    rows = _renamed(docs, id_col, text_col, lang_col).mapInArrow(sums, "lang string, k long, v double").groupBy("lang", "k").agg(F.sum("v").alias("v")).collect()  # listed languages x histogram bins
    refs = {lang: np.zeros(n_class + n_common) for lang in COMMON_WORDS}
    for r in rows:
        refs[r["lang"]][r["k"]] = r["v"]
    return {lang: (v[:n_class], v[n_class:]) for lang, v in refs.items() if v.sum() > 0}


class Judge:
    """The verdict on a batch against given references; goes to the tasks by closure."""

    def __init__(self, refs: dict, max_class: float, max_common: float, max_sum: float, min_reference_words: int, min_sum_words: int):
        self.refs, self.max_class, self.max_common, self.max_sum = refs, max_class, max_common, max_sum
        self.min_words, self.min_sum_words = min_reference_words, min_sum_words

    def __call__(self, langs: list, buf: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        f, classes, common = features(buf, off)
        d_class, d_common = np.zeros(len(langs)), np.zeros(len(langs))
        langs = np.array(langs, object)
        for lang, (ref_class, ref_common) in self.refs.items():
            mine = (langs == lang) & (f["n_words"] >= self.min_words)
            d_class[mine], d_common[mine] = js_distance(classes[mine], ref_class), js_distance(common[mine], ref_common)
        f["base_failed"] = base_failed(f)
        far = (d_class > self.max_class) | (d_common > self.max_common) | ((d_class + d_common > self.max_sum) & (f["n_words"] >= self.min_sum_words))
        f["kept"] = ~f["base_failed"] & ~far
        return f, d_class, d_common, f["kept"]


def judge_for(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", max_class: float = 0.3, max_common: float = 0.5, max_sum: float = 0.44, min_reference_words: int = 50, min_sum_words: int = 100) -> Judge:
    return Judge(language_references(docs, id_col, text_col, lang_col), max_class, max_common, max_sum, min_reference_words, min_sum_words)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """One row for each row of docs: the base counts, both distances and the verdict."""
    judge = judge_for(docs, id_col, text_col, lang_col, **limits)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, class_distance double, common_distance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tx.chunks(batches):
            f, d_class, d_common, _ = judge(batch.column("lang").to_pylist(), buf, off)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(f[c].astype(np.int64)) for c in COUNTS), pa.array(f["base_failed"]), pa.array(f["kept"]), pa.array(d_class), pa.array(d_common)], ["doc_id", *COUNTS, "base_failed", "kept", "class_distance", "common_distance"])

    return _renamed(docs, id_col, text_col, lang_col).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **limits) -> DataFrame:
    """The rows of docs whose verdict is to keep, with all their columns; no join and no shuffle of texts."""
    judge = judge_for(docs, id_col, text_col, lang_col, **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tx.chunks(batches, text_col):
            kept = judge(batch.column(batch.schema.get_field_index(lang_col)).to_pylist(), buf, off)[3]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
