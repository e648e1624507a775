"""N-gram Jaccard join: near-duplicate components by a count-vector R-tree.

A document is its set of distinct k-word shingles (lower-cased). Shingles are
hashed into ``GROUPS`` groups; a document's counts by group are a point. Two points
bound the overlap of their sets by the sum of coordinate minima, and a page of an
R-tree (points packed by set size, with the maxima of each coordinate) bounds it
for all its points, so pages and points that can't reach the similarity are left
out. Surviving pairs are verified on the whole sets.

So that no point is searched against all others:

* equal sets form one class (an aggregation by a 128-bit set hash);
* a class sends its rarest ``n - ceil(t * n) + 1`` shingles to the shingles' tasks; two
  sets with similarity t share one of these whatever the common order is. The order
  is by a count sketch of all shingles, so that widely shared passages come last;
* shingles that meet the same classes are taken as one. Where a shingle meets more than
  one class, the R-tree of these classes yields links that span each group of possible
  partners (never all pairs of a group); the parities of finer counts bound the overlap
  a second time, as few counts tell long sets apart badly;
* the components of those links are the groups of possible partners. Groups of very
  long sets (``DIVIDED``) are divided again by the R-tree of points with more counts
  (``FINE``), each class once and without its set;
* what is left in a group is brought together and verified on the whole sets, again by
  an R-tree search. A group over BLOCK sets or BLOCK_GRAMS shingles goes in pairs of blocks.

Every link between different sets lies inside one such group and is found or
implied by found ones, so components are exact.

Defined results: a text with fewer than k words is one shingle; one without words,
or null, has no set and is its own component; rows that share an id, or have none,
each have the component of their own set; a component's id is the least of its rows',
a null id being less than all. Classes are told apart by 64-bit set hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .anchors import NO_ID, ids, own_rows, row_hashes
from .components import components
from .storage import arrow_rows, materialize

GROUPS = 32
SKETCH = 1 << 18
PAGE = 64
FINE = 1024
PARITIES = 4096
DIVIDED = 2 * PARITIES  # shingles of a group's sets, in the mean, beyond which parities tell them apart badly
BLOCK = 4096
BLOCK_GRAMS = 1 << 22
ARROW_ROWS = 1000


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, in a row, and their bounds."""
    n = len(off) - 1
    starts, ends, doc = tx.words(buf, off)
    word = tx.span_hash(tx.byte_prefix(tx.LOWER[buf]), starts, ends, "byte")
    at, grams = tx.ngrams(word, doc, k)
    owner = doc[at]
    bounds = tx.word_bounds(doc, n)
    size = np.diff(bounds)
    few = np.flatnonzero((size > 0) & (size < k))
    if len(few):
        whole = tx.span_hash(tx.prefix(word, "word"), bounds[few], bounds[few + 1], "word")
        owner, grams = np.concatenate([owner, few]), np.concatenate([grams, whole])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    if len(owner):
        first = np.concatenate([[True], (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])])
        owner, grams = owner[first], grams[first]
    return grams, np.searchsorted(owner, np.arange(n + 1))


def _set_hash(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(tx.mix(grams ^ tx.U(salt)), out=sums[1:])
        out.append(tx.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    return out[0], out[1]


def vectors(grams: np.ndarray, bounds: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Each set's count of shingles by group; groups: a power of two."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    return np.bincount(owner * groups + (grams >> tx.U(65 - groups.bit_length())).astype(np.int64), minlength=n * groups).reshape(n, groups)


def _sets_and_sketch(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "a", "b", "doc_id", "row", "n"]
        sketch = np.zeros(SKETCH, np.int64)
        for batch, buf, off in tx.chunks(batches):
            grams, bounds = shingle_sets(buf, off, k)
            sketch += np.bincount((grams >> tx.U(46)).astype(np.int64), minlength=SKETCH)
            a, b = _set_hash(grams, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(tx.signed(a)), pa.array(tx.signed(b)), pa.array(ids(batch)), pa.array(row_hashes(batch)), pa.array(np.diff(bounds))], names)
        at = np.flatnonzero(sketch)
        zero = np.zeros(len(at), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(at), pa.array(sketch[at]), pa.array(zero), pa.array(zero), pa.array(zero)], names)

    return run


def _prefixes(k: int, percent: int, sketch) -> Callable:
    """The rarest shingles of each class, as rows, and its point on the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = sketch.value
        for batch, buf, off in tx.chunks(batches):
            grams, bounds = shingle_sets(buf, off, k)
            n = np.diff(bounds)
            mine = tx.signed(_set_hash(grams, bounds)[0]) == batch.column("a").to_numpy()
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((grams, rarity[(grams >> tx.U(46)).astype(np.int64)], owner))
            place = np.arange(len(grams)) - bounds[owner]
            taken = order[(place < (n + (-percent * n // 100) + 1)[owner]) & mine[owner]]
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(grams[taken])), pa.array(batch.column("a").to_numpy()[owner[taken]])], ["token", "class_id"])

    return run


def _points(k: int) -> Callable:
    """Each class's point and its parities, in one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tx.chunks(batches):
            grams, bounds = shingle_sets(buf, off, k)
            v = vectors(grams, bounds).astype(np.int32)
            odd = parities([grams[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(np.diff(bounds)), pa.array([r.tobytes() + q.tobytes() for r, q in zip(v, odd, strict=True)], pa.binary())], ["class_id", "n", "point"])

    return run


def _fine_points(k: int) -> Callable:
    """The point of FINE counts of each class, for its tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tx.chunks(batches):
            grams, bounds = shingle_sets(buf, off, k)
            mine = tx.signed(_set_hash(grams, bounds)[0]) == batch.column("a").to_numpy()
            v = vectors(grams, bounds, FINE).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("task"), batch.column("a"), pa.array(np.diff(bounds)), pa.array([r.tobytes() for r in v], pa.binary())], ["token", "class_id", "n", "point"]).filter(pa.array(mine))

    return run


def _slices(sets: list[np.ndarray], grams: int = 1 << 18, most: int = 256) -> Iterator[tuple[int, int]]:
    """Bounds of runs of sets with about so many grams and so many sets at most, for memory that follows neither a group nor its longest text."""
    a = size = 0
    for i, x in enumerate(sets):
        if i > a and (size + len(x) > grams or i - a == most):
            yield a, i
            a, size = i, 0
        size += len(x)
    if sets:
        yield a, len(sets)


def points_of(sets: list[np.ndarray]) -> np.ndarray:
    """The count vectors of sets."""
    out = np.empty((len(sets), GROUPS), np.int32)
    for a, b in _slices(sets):
        out[a:b] = vectors(np.concatenate(sets[a:b]), np.concatenate([[0], np.cumsum([len(x) for x in sets[a:b]])]))
    return out


def parities(sets: list[np.ndarray], bits: int = PARITIES) -> np.ndarray:
    """For each set the parity of its count in each of ``bits`` finer groups, packed. Where two differ, so do the sets."""
    out = np.empty((len(sets), bits // 64), np.uint64)
    for a, b in _slices(sets):
        part = sets[a:b]
        owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
        odd = np.bincount(owner * bits + (np.concatenate(part) >> tx.U(20) & tx.U(bits - 1)).astype(np.int64), minlength=len(part) * bits) & 1
        out[a:b] = np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(len(part), -1)
    return out


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each binary value as uint64, without a copy."""
    out = []
    for chunk in column.chunks:
        chunk = chunk.cast(pa.large_binary())
        off = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2], np.uint8)
        out += [data[a:b].view(np.uint64) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return out


def spanning_links(n: np.ndarray, points: np.ndarray, percent: int, verify: Callable | None = None, fine: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span each group of points that the bound (and verify, where given) ties together.

    fine: the parities of counts in many more groups, a second bound on the overlap for points that pass the first.

    An R-tree of one level of pages: points in order of set size, PAGE to a page, with the page's coordinate maxima.
    """
    k = len(n)
    order = np.lexsort((points[:, 0], n))
    size, at = n[order], points[order]
    fine = None if fine is None else fine[order]
    pages = np.arange(0, k, PAGE)
    top = np.maximum.reduceat(at, pages, axis=0)
    page_low, page_high = size[pages], size[np.append(pages[1:], k) - 1]
    left = np.diff(np.append(pages, k))
    open_ = np.ones(k, bool)
    out = []
    for seed in range(k):
        if not open_[seed]:
            continue
        open_[seed] = False
        left[seed // PAGE] -= 1
        queue = [seed]
        while queue:
            q = queue.pop()
            s, v = size[q], at[q]
            near = np.flatnonzero((left > 0) & (100 * page_high >= percent * s) & (percent * page_low <= 100 * s))
            near = near[(100 + percent) * np.minimum(top[near], v).sum(1) >= percent * (s + page_low[near])]
            if not len(near):
                continue
            rest = np.concatenate([np.arange(p * PAGE, min((p + 1) * PAGE, k)) for p in near])
            rest = rest[open_[rest]]
            bound = np.minimum(at[rest], v).sum(1)
            rest = rest[(100 + percent) * bound >= percent * (s + size[rest])]
            if fine is not None and len(rest):
                apart = np.bitwise_count(fine[rest] ^ fine[q]).sum(1, dtype=np.int64)
                rest = rest[(100 + percent) * (s + size[rest] - apart) >= 2 * percent * (s + size[rest])]
            for p in rest.tolist():
                if verify is None or verify(order[q], order[p]):
                    open_[p] = False
                    left[p // PAGE] -= 1
                    queue.append(p)
                    out.append((int(order[q]), int(order[p])))
    return out


def _groups(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.Table]:
    """Tables of whole keys (the first column) from batches in order of key."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= block_bytes:
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                held[-1] = batch.slice(0, cut)
                yield pa.Table.from_batches(held)
                held, size = [batch.slice(cut)], 0
    if held:
        yield pa.Table.from_batches(held)


def _possible(percent: int, groups: int = GROUPS, bits: int = 0) -> Callable:
    """Links between the classes of each shingle (or task) whose points, and parities behind them, allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 1 << 23):
            token, cls, n = (t.column(c).to_numpy() for c in ("token", "class_id", "n"))
            raw = np.frombuffer(b"".join(t.column("point").to_pylist()), np.uint8).reshape(len(token), -1)
            points = np.ascontiguousarray(raw[:, : 4 * groups]).view(np.int32)
            fine = np.ascontiguousarray(raw[:, 4 * groups :]).view(np.uint64) if bits else None
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            many = np.diff(np.append(start, len(token)))
            two = start[many == 2]
            both = n[two] + n[two + 1]
            ok = (100 + percent) * np.minimum(points[two], points[two + 1]).sum(1) >= percent * both
            if bits:
                ok &= (100 + percent) * (both - np.bitwise_count(fine[two] ^ fine[two + 1]).sum(1, dtype=np.int64)) >= 2 * percent * both
            pairs = [np.stack([cls[two[ok]], cls[two[ok] + 1]], 1)]
            for a, m in zip(start[many > 2].tolist(), many[many > 2].tolist(), strict=True):
                found = spanning_links(n[a : a + m], points[a : a + m], percent, fine=fine[a : a + m] if bits else None)
                if found:
                    pairs.append(cls[a + np.array(found)])
            p = np.unique(np.sort(np.concatenate(pairs), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 1]), pa.array(p[:, 0])], ["a", "b"])

    return run


def _with_sets(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tx.chunks(batches):
            grams, bounds = shingle_sets(buf, off, k)
            ok = tx.signed(_set_hash(grams, bounds)[0]) == batch.column("a").to_numpy()
            data = pa.array([grams[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("task"), batch.column("a"), data], ["task", "class_id", "data"]).filter(pa.array(ok))

    return run


def _verified(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 1 << 22):
            task, cls = t.column("task").to_numpy(), t.column("class_id").to_numpy()
            sets = _views(t.column("data"))
            start = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])).tolist() + [len(task)]
            links: list = []
            for a, b in zip(start, start[1:], strict=False):
                own = sets[a:b]
                n = np.array([len(x) for x in own])

                def alike(i: int, j: int, own=own) -> bool:
                    x, y = own[i], own[j]
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    return 100 * common >= percent * (len(x) + len(y) - common)

                links += [(int(cls[a + i]), int(cls[a + j])) for i, j in spanning_links(n, points_of(own), percent, alike, parities(own) if b - a > PAGE else None)]
            p = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(p.max(1) if len(p) else p[:, 0]), pa.array(p.min(1) if len(p) else p[:, 1])], ["a", "b"])

    return run


def _tasks(groups: DataFrame, sums: DataFrame) -> DataFrame:
    """a, task: the tasks in which each node of the groups meets all others; sums: component, blocks. Groups of over two blocks go in pairs of them."""
    placed = groups.join(sums.select("component", F.col("blocks").cast("int").alias("blocks")), "component").selectExpr("node as a", "component", "blocks", "cast(pmod(xxhash64(node), blocks) as int) as block")
    other = F.when(F.col("blocks") <= 2, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block")))
    task = F.when(F.col("blocks") <= 2, F.xxhash64("component")).otherwise(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")))
    return placed.withColumn("other", F.explode(other)).select("a", task.alias("task"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, one row for each row of docs. percent: the least Jaccard similarity."""
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        out = _joined(docs, id_col, text_col, k, percent)
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(null("doc_id"), "n_shingles", null("component_id"))


def _joined(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """doc_id, row, n_shingles, component (a set hash; null without a set), component_id. All Python runs in here (what it makes is written); what is returned is a join of tables."""
    spark = docs.sparkSession
    own = own_rows(docs, id_col, text_col)
    seen = materialize(own.mapInArrow(_sets_and_sketch(k), "kind int, a long, b long, doc_id long, row long, n long"))
    counts = seen.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).toPandas()  # SKETCH rows at most
    rarity = np.zeros(SKETCH, np.int64)
    rarity[counts["a"].to_numpy()] = counts["n"].to_numpy()
    sketch = spark.sparkContext.broadcast(rarity)
    sets = seen.where("kind = 0").select("doc_id", "row", "a", "b", "n")
    classes = materialize(sets.where("n > 0").groupBy("a", "b", "n").agg(F.min(F.struct("doc_id", "row")).alias("least")).select("a", "b", "n", "least.*"))
    chosen = own.join(classes.select("doc_id", "row", "a"), ["doc_id", "row"])

    tokens = chosen.mapInArrow(_prefixes(k, percent, sketch), "token long, class_id long")
    # Shingles that the same classes share are one from here on: a shared passage counts once and not for each of its words.
    of_token = "over (partition by token)"
    met = tokens.selectExpr("class_id", f"count(*) {of_token} as many", f"bit_xor(xxhash64(class_id)) {of_token} as who").where("many > 1")
    shared = materialize(met.selectExpr("xxhash64(who, many) as token", "class_id").distinct())
    wanted = shared.select(F.col("class_id").alias("a")).distinct()
    chosen = materialize(own.join(classes.join(wanted, "a", "left_semi").select("doc_id", "row", "a"), ["doc_id", "row"]).select("a", "text"))
    points = chosen.mapInArrow(_points(k), "class_id long, n long, point binary").dropDuplicates(["class_id"])
    met = shared.join(points, "class_id").select("token", "class_id", "n", "point")
    possible = met.repartition("token").sortWithinPartitions("token").mapInArrow(_possible(percent, bits=PARITIES), "a long, b long")
    groups = materialize(components(possible))

    sized = groups.join(classes.select(F.col("a").alias("node"), "n").groupBy("node").agg(F.max("n").alias("n")), "node")
    sums = sized.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("grams"))
    long_sets = materialize(sums.where((F.col("grams") > BLOCK_GRAMS / 32) & (F.col("grams") > DIVIDED * F.col("size"))))
    if not long_sets.isEmpty():
        divide = groups.join(long_sets.select("component"), "component", "left_semi")
        points = chosen.join(_tasks(divide, long_sets.withColumn("blocks", F.ceil(F.col("size") / BLOCK))), "a").mapInArrow(_fine_points(k), "token long, class_id long, n long, point binary")
        parts = components(points.repartition("token").sortWithinPartitions("token").mapInArrow(_possible(percent, FINE), "a long, b long"))
        groups = materialize(groups.join(long_sets.select("component"), "component", "left_anti").select("node", "component").unionByName(parts))

    sized = groups.join(sized.select("node", "n"), "node")
    sums = sized.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("grams"))
    tasks = _tasks(groups, sums.withColumn("blocks", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("grams") / BLOCK_GRAMS))))
    ready = chosen.join(tasks, "a").mapInArrow(_with_sets(k), "task long, class_id long, data binary")
    links = ready.repartition("task").sortWithinPartitions("task").mapInArrow(_verified(percent), "a long, b long")
    found = components(links)

    of_class = classes.join(found.withColumnRenamed("node", "a"), "a", "left").select("a", "b", "n", "doc_id", F.coalesce("component", "a").alias("component"))
    least = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = sets.join(of_class.drop("doc_id").join(least, "component"), ["a", "b", "n"], "left")
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The first row of each component (least id, then hash of its text), with all columns; rows without a set stay."""
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        near = materialize(_joined(docs, id_col, text_col, k, percent).where("component is not null").select("doc_id", "row", "component"))
    first = near.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    gone = near.join(first, "component").where("doc_id <> least.doc_id or row <> least.row").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    again = near.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).count().where("count > 1").drop("count")
    keys = ["__id", "__row"]
    marked = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn("__row", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    left = marked.join(gone, keys, "left_anti")
    # Rows that are equal in id and text: one of them stays.
    others = sorted(c for c in docs.columns if c not in (id_col, text_col))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*map(F.col, others or keys)))
    repeated = left.join(again, keys, "left_semi").withColumn("__nth", number).where("__nth = 1")
    return left.join(again, keys, "left_anti").select(docs.columns).unionByName(repeated.select(docs.columns))
