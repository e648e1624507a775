"""Personal data: generators propose spans, boosted trees choose among them.

Base spans (email, ip, card, phone) always stay. Beside them high-recall
generators propose overlapping candidates: loosely written emails and phones, long
numbers, addresses, secrets, of any length. Boosted trees score a candidate by its
format (length, shares of digits, letters and capitals, entropy, separators,
checksum) and context (keywords before it, what stands beside it). Scores are
calibrated by isotonic regression on a fold that the trees haven't seen, and a
threshold for each kind, set there for a wanted precision, selects what is added.

The classifier is fitted on ``planted`` strings: seeded personal data and look-alikes
of each kind whose label is how they were made, not what they look like, each put
into a piece of a document. The pieces come from at most ``sample_rows`` documents
(those least by a hash of their id), one of 200 characters from a hashed place of
each. Labels, and so the thresholds, don't depend on the corpus or its size.
Candidates are searched in every whole text; a generator is left out for a text only
where a byte that each of its matches needs is missing.

Defined results: null text is empty; offsets are code points, ends exclusive; added
spans inside a base span or in another added one are left out; repeated rows are handled
one by one. Where ids tie among those that lend pieces (null or repeated ids), which of
their rows do is free.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .boosting import BoostedTrees, isotonic

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_like", "ip_like", "number", "phone_like", "secret")
ALIKE_WEIGHT = 3.0  # look-alikes for each personal string in texts, as thresholds reckon; planted are as many of both

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# A text can only hold a match of a pattern if it has its need: an at sign or "at" in brackets, a digit, a colon, an equals sign or colon, a word of LONG_RUN bytes.
LONG_RUN = 16
_LOOSE = [
    ("email_like", "at", re.compile(r"(?i)(?<![\w.%+-])[\w.%+-]++\s?(?:@|[(\[]at[)\]])\s?[\w-]++(?:(?:\.|\s?[(\[]dot[)\]]\s?)[\w-]++)+")),
    ("ip_like", "digit", re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}")),
    ("ip_like", "colon", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("number", "digit", re.compile(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){7,}+(?![0-9])")),
    ("phone_like", "digit", re.compile(r"(?<![0-9])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
    ("secret", "mark", re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b[\"']?\s?[=:]\s?[\"']?([^\s\"']{6,})")),
    ("secret", "long", re.compile(r"\b[A-Z][0-9A-Z]{15,}+\b|\b[0-9a-fA-F]{24,}+\b|(?<![\w+/.-])[\w+/.-]{24,}+")),
]
_KEYWORDS = ("mail", "contact", "phone", "tel", "call", "card", "visa", "account", "ip", "host", "server", "password", "token", "key", "version", "page", "isbn", "order", "ssn", "secret")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_ok(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in s.split("."))


def emails(s: str) -> list[tuple[int, int]]:
    """Around each @: the local characters before it and the longest domain after it."""
    out, done, at = [], 0, s.find("@")
    while at >= 0:
        start = at
        while start > done and s[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(s, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        at = s.find("@", max(done, at + 1))
    return out


def base_spans(s: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(s)]
    out += [("ip", *m.span()) for m in _IP.finditer(s) if _ip_ok(m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(s) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(s) if 9 <= len(_digits(m[0])) <= 15]
    return out


def needs(s: str) -> set[str]:
    """What a text has of that which patterns need."""
    out = {"mark", "colon"} if ":" in s else {"mark"} if "=" in s else set()
    low = s.lower() if "(" in s or "[" in s else ""
    if "@" in s or "(at" in low or "[at" in low:
        out.add("at")
    if re.search("[0-9]", s):
        out.add("digit")
    if re.search(rf"\S{{{LONG_RUN}}}", s):
        out.add("long")
    return out


def proposals(s: str, have: set[str] | None = None) -> list[tuple[str, int, int]]:
    have = needs(s) if have is None else have
    return sorted({(kind, *m.span(m.lastindex or 0)) for kind, need, p in _LOOSE if need in have for m in p.finditer(s)})


def outside(cand: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The candidates that lie inside no base span."""
    spans = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in spans], np.maximum.accumulate([b for _, b in spans]).tolist() if spans else []
    return [c for c in cand if (i := bisect_right(starts, c[1])) == 0 or reach[i - 1] < c[2]]


def outermost(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that lie in no other; of equal ones the first by kind. By kind, then start."""
    out, reach = [], -1
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if b > reach:
            out.append((kind, a, b))
            reach = b
    return sorted(out)


def featured(s: str, kind: str, a: int, b: int) -> list[float]:
    got, before = s[a:b], s[max(0, a - 32) : a].lower()
    n = b - a
    digits = sum("0" <= c <= "9" for c in got)
    counts = [got.count(c) / n for c in set(got)]
    groups = re.findall(r"[0-9]+", got)
    words = re.findall(r"[A-Za-z]+", got)
    return [
        float(ADDED_KINDS.index(kind)), n, digits, digits / n, sum(c.isupper() for c in got) / n, sum(c.isalpha() for c in got) / n,
        -sum(p * math.log2(p) for p in counts), len(counts), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        got.count("."), got.count("-"), got.count(" "), got.count(":"), got.count("/"), "@" in got, "(" in got or "[" in got,
        float(digits > 1 and luhn(_digits(got))), max((int(g) for g in groups if len(g) <= 9), default=0),
        max(map(len, words), default=0), len(words), sum(len(w) for w in words if w.islower()) / n,
        *(k in before for k in _KEYWORDS), a == 0 or s[a - 1].isspace(), b == len(s) or s[b].isspace(), a > 0 and s[a - 1] in "+($#\"'",
        bool(re.match("[ .-]?[0-9]", s[b : b + 2])), bool(re.search("[0-9][ .-]?$", s[max(0, a - 2) : a])), got.startswith("AKIA"), a > 0 and s[a - 1].isalnum(), b < len(s) and s[b].isalnum(),
    ]


def planted(seed: int, n: int, pieces: list[str]) -> list[tuple[str, int, int, bool]]:
    """Seeded strings in pieces of text: (text, start, end, whether personal). Every other one is a look-alike."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda lo, hi: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(lo, hi)))
    any_of = lambda k, chars: "".join(r.choice(chars) for _ in range(k))
    hexa = lambda k: any_of(k, "0123456789abcdef")
    mixed = lambda k: any_of(k, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    checked = lambda k, right: next(d for d in iter(lambda: num(k), "") if luhn(d) == right)
    fours = lambda right, mark: mark.join(re.findall("[0-9]{4}", checked(16, right)))
    shout = lambda lo, hi: "".join(r.choice("BCDFGHKLMNPRSTVWZ") + r.choice("AEIOU") + r.choice(["", "", "N", "R", "S", "T", "CH"]) for _ in range(r.randint(lo, hi)))
    say = lambda *leads: r.choice([*leads, *leads, word(3, 8)])
    mark, quote = lambda: r.choice(["=", ": ", " = ", ":"]), lambda: r.choice(['"', ""])
    name, host = lambda: word(3, 9) + r.choice(["", "." + word(3, 9), num(2)]), lambda: word(3, 9)
    personal = [
        lambda: (say("mail", "contact", "write to") + " ", f"{name()} (at) {host()} (dot) {r.choice(['com', 'org', 'de'])}"),
        lambda: (say("mail", "contact") + " ", f"{name()}{r.choice(['[at]', ' [at] ', ' @ ', '(AT)'])}{host()}.{r.choice(['com', 'net', 'fr'])}"),
        lambda: (say("host", "server", "ip") + " ", ":".join(hexa(r.randint(1, 4)) for _ in range(8))),
        lambda: (say("device", "host") + " ", ":".join(hexa(2) for _ in range(6))),
        lambda: (say("account", "card", "visa") + " ", fours(True, ".")),
        lambda: (r.choice(["account ", "account no ", "ssn ", "card "]), r.choice([num(r.randint(9, 12)), f"{num(3)}-{num(2)}-{num(4)}"])),
        lambda: (say("call", "phone", "tel") + " ", r.choice([f"{num(3)}-{num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"])),
        lambda: (r.choice(["password", "pwd", "passwd"]) + mark() + quote(), word(3, 8) + num(r.randint(2, 5)) + r.choice("!?#%") + word(1, 4)),
        lambda: (r.choice(["token", "api_key", "secret", "api-key"]) + mark() + quote(), r.choice([hexa, mixed, lambda k: (hexa(8) * k)[:k]])(r.randint(20, r.choice([60, 120, 400])))),
        lambda: (say("key", "id") + " ", r.choice(["AKIA" + any_of(16, upper + r.choice(["", "0123456789"])), any_of(4, upper) + any_of(16, upper + "0123456789")])),
        lambda: (say("bearer", "key") + " ", f"{mixed(20)}.{mixed(r.randint(40, 200))}.{mixed(43)}"),
        lambda: (say("key", "hash") + " ", hexa(r.choice([32, 40, 64, 96]))),
    ]
    alike = [
        lambda: (say("see", "at") + " ", f"{word(2, 9)} @ {num(2)}.{num(2)}"),
        lambda: (say("array", "index") + " ", f"{word(1, 3)}[at]{num(1)}.{num(1)}"),
        lambda: (r.choice(["version ", "release ", "section ", "v"]), ".".join(str(r.randint(0, 40)) for _ in range(r.choice([3, 5])))),
        lambda: (say("from", "time") + " ", f"{r.randint(0, 23)}:{num(2)}:{num(2)}"),
        lambda: (r.choice(["isbn ", "isbn: "]), f"97{r.choice('89')}-{num(1)}-{num(4)}-{num(4)}-{num(1)}"),
        lambda: (r.choice(["order ", "page ", "part ", "item "]), r.choice([num(r.randint(8, 12)), f"{num(4)}-{num(4)} {num(4)}"])),
        lambda: (r.choice(["lots ", "ranges ", "scores "]), f"{num(2)}-{num(3)}-{num(3)}"),
        lambda: (r.choice(["password", "token", "secret"]) + mark(), r.choice(["required", "optional", "<yours>", "changes", "expired", "******", "unknown"])),
        lambda: (r.choice(["token", "api_key"]) + mark() + quote(), r.choice(["a", "0", "x"]) * r.randint(20, 60)),
        lambda: (say("see", "the") + " ", r.choice(["A", "X", "0A"]) * 20),
        lambda: (say("so", "and", "key") + " ", (lambda x: x * (1 + 15 // len(x)))(shout(3, 9)) if r.random() < 0.3 else shout(7, 11)),
        lambda: (say("card", "visa", "no", "account") + " ", fours(False, r.choice(["-", " ", ".", ""]))),
        lambda: (say("model", "serial", "lot") + " ", f"{word(2, 9)}{num(r.randint(8, 12))}{word(2, 9)}"),
        lambda: (say("in", "under") + " ", "/".join(word(2, 12) for _ in range(r.randint(3, 9)))),
        lambda: (say("so", "and") + " ", r.choice(["-", "_", "."]).join(word(2, 12) for _ in range(r.randint(3, 9)))),
    ]
    out = []
    for i in range(n):
        real, kinds = i % 2 == 0, alike if i % 2 else personal
        lead, core = kinds[i // 2 % len(kinds)]()
        piece = r.choice(pieces) if pieces else ""
        cut = piece.rfind(" ", 0, r.randint(0, len(piece))) + 1
        before = piece[:cut] + lead
        out.append((before + core + ('"' if lead.endswith('"') else "") + " " + piece[cut:], len(before), len(before) + len(core), real))
    return out


def labelled(rows: list[tuple[str, int, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates that cover most of a planted string, or lie in it; those that leave out over a tenth of one are no finds."""
    x, y = [], []
    for s, a, b, personal in rows:
        for kind, c, d in outside(proposals(s), base_spans(s)):
            if 2 * (min(b, d) - max(a, c)) > min(b - a, d - c):
                x.append(featured(s, kind, c, d))
                y.append(personal and 10 * (min(b, d) - max(a, c)) >= 9 * (b - a))
    return np.array(x, float), np.array(y, float)


class Redactor:
    """A fitted classifier and a calibrated threshold for each kind; goes to the tasks by closure."""

    def __init__(self, pieces: list[str], seed: int, precision: float, made: int):
        x, y = labelled(planted(seed, made, pieces))
        fold = np.random.default_rng(seed).random(len(y)) < 0.3
        self.trees = BoostedTrees().fit(x[~fold], y[~fold])
        held, truth = x[fold], y[fold]
        self.knots = isotonic(self.trees.probability(held), truth)
        p = self.probability(held)
        self.limits = {}
        for k, kind in enumerate(ADDED_KINDS):
            mine = held[:, 0] == k
            order = np.argsort(-p[mine], kind="stable")
            q = p[mine][order]
            found = truth[mine][order]
            right = np.cumsum(found) / np.cumsum(np.where(found > 0, 1, ALIKE_WEIGHT))
            last = np.append(q[1:] != q[:-1], True) if len(q) else np.empty(0, bool)  # equal scores are taken together
            good = np.flatnonzero((right >= precision) & last)
            self.limits[kind] = float(max(0.5, (q[good[-1]] + np.append(q, 0)[good[-1] + 1]) / 2)) if len(good) else 2.0  # half way to the next score, which is too low

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.probability(x), *self.knots)

    def chosen(self, s: str, cand: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        if not cand:
            return []
        p = self.probability(np.array([featured(s, *c) for c in cand], float))
        return outermost([c for c, q in zip(cand, p.tolist(), strict=True) if q >= self.limits[c[0]]])

    def spans(self, s: str, have: set[str] | None = None) -> tuple[list, list]:
        have = needs(s) if have is None else have
        base = base_spans(s) if "digit" in have or "at" in have else []
        return base, self.chosen(s, outside(proposals(s, have), base))


_DIGIT, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_MARK[list(b"@=:([")] = True


def _worth(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The texts that have a byte, or a word of LONG_RUN bytes, that some pattern needs."""
    marked = np.concatenate([[0], np.cumsum(_DIGIT[buf] | _MARK[buf])])
    out = marked[off[1:]] > marked[off[:-1]]
    starts, ends, doc = tx.words(buf, off)
    out[doc[ends - starts >= LONG_RUN]] = True
    return np.flatnonzero(out)


def fitted(docs: DataFrame, sample_rows: int = 2000, seed: int = 5, precision: float = 0.9, made: int = 7200) -> Redactor:
    """docs: doc_id, text. sample_rows: the bound on rows that lend a piece of text to the planted strings; made: how many of these."""
    hashed = docs.select(F.xxhash64("doc_id").alias("h"), "text")
    last = hashed.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]  # hashes only, so that no partition sends texts
    place = F.expr("substr(text, 1 + cast(pmod(h, greatest(length(text) - 200, 1)) as int), 200)")
    rows = hashed.where(F.col("h") <= F.lit(last)).select(place).limit(sample_rows).collect() if last is not None else []
    return Redactor(sorted(r[0] for r in rows), seed, precision, made)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, base and added: arrays of struct<kind, start, end>, one row for each row of docs."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    redactor = fitted(own, **options)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tx.chunks(batches):
            base: list = [[] for _ in range(batch.num_rows)]
            added: list = [[] for _ in range(batch.num_rows)]
            texts = batch.column("text")
            for i in _worth(buf, off).tolist():
                b, c = redactor.spans(texts[i].as_py())
                base[i] = [dict(zip(("kind", "start", "end"), x, strict=True)) for x in b]
                added[i] = [dict(zip(("kind", "start", "end"), x, strict=True)) for x in c]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(added, kind)], ["doc_id", "base", "added"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return own.mapInArrow(run, f"doc_id long, base {spans}, added {spans}")
