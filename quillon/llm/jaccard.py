"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

A document's set holds its distinct k-word shingles as 64-bit hashes; documents of equal sets form one class, and the join
runs over classes, so a group of exact copies costs as much as one document.

Order: a shingle's rank is (frequency class, hash); frequencies come from one hashed counter array of a fixed size, summed
over all tasks. Classes are powers of two above the array's median, so frequent shingles stand out from the noise of shared
counters however large the corpus is. A set x of n shingles linked with any other shares at least o = ceil(t * n) of them, so two linked sets share
at least l shingles within their first n - o + l each (the l-prefix). Each document chooses its l from 1 to 4 by estimated
cost: the postings that its prefix meets plus the verification of the candidates that share l of them. Every prefix shingle
carries the smallest l that includes it; a pair is counted under the smaller of its two l, and is verified only when it shares
so many. Where more than 64 classes may share a shingle, its postings carry 512 parities (bit i: whether the set holds an odd
number of hashes of class i); two sets whose parities differ in h bits differ in h shingles at least, so many pairs of a large
group of near copies are ruled out without reading their sets. Postings of a shingle that thousands of classes may share are dealt
to tiles (pairs of buckets of classes), so no task holds such a list whole.

Two rounds give the components exactly. First, documents that share one of three minimum hashes are compared with one pivot of
that group, and in large groups with three more in turn (stars, never all pairs; a large group's rows are salted over tasks). Then the prefix join proposes only pairs whose components still differ; so a large group of
near copies, joined by the stars, isn't compared within itself, and every link between different components is verified.

Defined results: without words or text the set is empty and the document is linked with nothing (component_id is its own
doc_id); null ids are never a component's smallest id unless all are null; repeated rows are linked; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import Scratch, array_rows, cut, maybe_broadcast, ship, small, sum_arrays, sweep
from .textkit import Block, blocks, mix, signed

U = np.uint64
CELL_BITS = 22
STARS = 3
PIVOTS = 4
MOST_L = 4
LONG = 64
CROWD = 1 << 14  # classes of a shingle's list that one task compares; beyond, the list is dealt to tiles
GROUP = 256  # rows of a minimum-hash group that one task reads; beyond, they are salted


def fingerprint(s: np.ndarray) -> int:
    """Class of a set: its hashes are distinct, so their mixed sum and number identify it."""
    return int(mix(np.array([mix(s ^ U(0x51ED270B)).sum(dtype=U) + U(len(s))], U))[0])


def needed(n, percent: int):
    """Least overlap of a set of n with any set it is linked to."""
    return -(-percent * n // 100)


def sign_documents(k: int):
    """Rows (doc_id, n, fp, m0, m1, m2) for each document, and the task's shingle counters as array rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = np.zeros(1 << CELL_BITS, np.int32), set()
        names = ["doc_id", "n", "fp", "m0", "m1", "m2", "part", "task", "cells"]
        for batch in blocks(batches):
            block = Block(batch.column("text"), lower=True)
            rows = np.zeros((5, block.n_docs), U)
            fresh = []
            for d, s in enumerate(block.shingles(block.hashes(), k)):
                rows[0, d] = len(s)
                if len(s):
                    rows[1, d] = fp = fingerprint(s)
                    rows[2:, d] = [s[0], mix(s * U(0xA0761D6478BD642F) + U(1)).min(), mix(s * U(0xE7037ED1A0B428DB) + U(2)).min()]
                    if fp not in seen:
                        seen.add(fp)
                        fresh.append(s)
            if fresh:
                np.add.at(cells, (np.concatenate(fresh) & U((1 << CELL_BITS) - 1)).astype(np.int64), 1)
            none = pa.nulls(block.n_docs, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows[0].astype(np.int32)), *(signed(r) for r in rows[1:]), none, none, pa.nulls(block.n_docs, pa.binary())], names)
        for batch in array_rows(cells):
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), *(pa.nulls(m, pa.int64()) for _ in range(4)), *batch.columns], names)

    return run


def parities(s: np.ndarray) -> bytes:
    odd = np.bincount((mix(s ^ U(0x2545F491)) & U(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def choose_l(estimate: np.ndarray, n: int, base: int, most: int) -> int:
    """The l of the least estimated cost; estimate: frequencies of the shingles in prefix order."""
    met = np.cumsum(np.maximum(estimate[: base + most - 1] - 1, 0))
    ls = np.arange(1, most + 1)
    gen = met[np.minimum(base + ls - 2, len(met) - 1)]
    return int(np.argmin(gen + gen / ls**1.5 * (2 + n / 64.0))) + 1


def tiles(token: np.ndarray, fp: np.ndarray, estimate: np.ndarray, crowd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, tokens and sides once shingles of more than `crowd` postings are dealt to tiles: a class goes to its bucket's tile with each
    other bucket (side: its bucket; there only classes of different buckets are compared) and with itself (side -1, as for other shingles)."""
    k = -(-estimate // crowd)
    row = np.repeat(np.arange(len(token)), k)
    other = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    bucket = (mix(fp ^ U(0x7F4A7C15))[row] % k[row].astype(U)).astype(np.int64)
    low, high = np.minimum(bucket, other), np.maximum(bucket, other)
    split = k[row] > 1
    tile = np.where(split, mix(token[row] ^ mix((low * k[row] + high + 1).astype(U))), token[row])
    return row, tile, np.where(split & (bucket != other), bucket, -1)


def index_prefixes(k: int, percent: int, cells, crowd: int = CROWD):
    """Rows (token, side, fp, n, level, l, parity) of each class that a task meets; parity is null where few share the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, typical), seen = cells.value, set()
        for batch in blocks(batches):
            block = Block(batch.column("text"), lower=True)
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            odd: list[bytes | None] = []
            for s in block.shingles(block.hashes(), k):
                n = len(s)
                if not n or (fp := fingerprint(s)) in seen:
                    continue
                seen.add(fp)
                counter = table[(s & U((1 << CELL_BITS) - 1)).astype(np.int64)].astype(np.int64)
                estimate = np.maximum(counter - typical, 1)
                kind = np.log2(estimate).astype(np.int64)  # s ascends, so a stable sort by kind is the order
                order = np.argsort(kind, kind="stable")
                o = needed(n, percent)
                base, most = n - o + 1, min(MOST_L, o)
                prefix = order[: base + most - 1]
                l = choose_l(counter[prefix], n, base, most)
                prefix = prefix[: base + l - 1]
                level = np.maximum(np.arange(len(prefix)) - base + 2, 1)
                on = counter[prefix] > 1  # a counter of 1 proves that no other class has the shingle
                prefix, level = prefix[on], level[on]
                if len(prefix):
                    row, token, side = tiles(s[prefix], np.full(len(prefix), fp, U), counter[prefix], crowd)
                    for x, v in zip(out, (token, side, np.full(len(row), fp, U), np.full(len(row), n), level[row], np.full(len(row), l)), strict=True):
                        x.append(v)
                    many = estimate[prefix][row] > LONG
                    mark = parities(s) if many.any() else None
                    odd += [mark if x else None for x in many.tolist()]
            if out[0]:
                c = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays([signed(c[0]), pa.array(c[1].astype(np.int32)), signed(c[2]), pa.array(c[3].astype(np.int32)), pa.array(c[4].astype(np.int32)), pa.array(c[5].astype(np.int32)), pa.array(odd, pa.binary())], ["token", "side", "fp", "n", "level", "l", "parity"])

    return run


def propose(percent: int):
    """From index rows sorted by token: (a, b, l) for each pair of different components that share a token of its prefixes."""

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """table: whole runs of equal tokens, by component and class; classes that several tasks met are there more than once."""
        again = (np.diff(table["token"].to_numpy(), prepend=0) == 0) & (np.diff(table["fp"].to_numpy(), prepend=0) == 0)
        again[:1] = False
        table = table.filter(pa.array(~again)).combine_chunks()
        token, side, fp, n, level, l, comp = (table[x].to_numpy() for x in ("token", "side", "fp", "n", "level", "l", "comp"))

        def emit(i: np.ndarray, j: np.ndarray, odd: np.ndarray | None = None, start: int = 0) -> Iterator[pa.RecordBatch]:
            both = np.minimum(l[i], l[j])
            on = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (np.maximum(level[i], level[j]) <= both) & (fp[i] != fp[j]) & ((side[i] < 0) | (side[i] != side[j]))
            i, j, both = i[on], j[on], both[on]
            if odd is not None and len(i):
                apart = np.bitwise_count(odd[i - start] ^ odd[j - start]).sum(axis=1, dtype=np.int64)
                total = n[i].astype(np.int64) + n[j]
                on = 100 * (total - apart) >= percent * (total + apart)
                i, j, both = i[on], j[on], both[on]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[i], fp[j])), pa.array(np.maximum(fp[i], fp[j])), pa.array(both)], ["a", "b", "l"])

        starts = np.flatnonzero(np.diff(token, prepend=token[0] - 1))
        size = np.diff(np.append(starts, len(token)))
        for m in np.unique(size):
            if m < 2:
                continue
            at = starts[size == m]
            if m <= LONG:
                x, y = np.triu_indices(m, 1)
                step = max(1, 500_000 // len(x))
                for k in range(0, len(at), step):
                    yield from emit((at[k : k + step, None] + x).ravel(), (at[k : k + step, None] + y).ravel())
                continue
            for a in at:  # rows of a run are sorted by component: each meets the rows after its component's
                last = a + m
                if comp[a] == comp[last - 1]:
                    continue
                cells = table["parity"].slice(a, m).to_pylist()
                odd = None if None in cells else np.frombuffer(b"".join(cells), np.uint64).reshape(m, -1)
                after = a + np.searchsorted(comp[a:last], comp[a:last], "right")
                lengths = last - after
                i, total = np.arange(a, last), np.cumsum(lengths)
                done = 0
                while done < m:
                    upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + 200_000, "right")))
                    part = lengths[done:upto]
                    first = np.repeat(after[done:upto], part)
                    inside = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
                    yield from emit(np.repeat(i[done:upto], part), first + inside, odd, a)
                    done = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last token may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column("token").to_numpy()
            cut_at = int(np.searchsorted(token, token[-1]))
            if not cut_at and held and held[-1].column("token")[-1].as_py() == token[-1]:
                held.append(batch)
                continue
            whole = pa.Table.from_batches([*held, batch.slice(0, cut_at)]).combine_chunks()
            held = [batch.slice(cut_at)]
            if len(whole):
                yield from pairs(whole)
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return run


def sets_of(docs: DataFrame, classes: DataFrame, k: int, bound: int = 2_000_000) -> DataFrame:
    """(fp, items) of the asked classes (column fp, distinct), one row each. Up to `bound` classes are sent to the tasks;
    beyond, the sets of all classes meet them in a join."""
    spark = docs.sparkSession
    some = classes.limit(bound + 1).toArrow()["fp"].to_numpy()
    asked = spark.sparkContext.broadcast(np.sort(some)) if len(some) <= bound else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        want = None if asked is None else set(asked.value.view(U).tolist())
        for batch in blocks(batches):
            block = Block(batch.column("text"), lower=True)
            fps, items = [], []
            for s in block.shingles(block.hashes(), k):
                if len(s) and (fp := fingerprint(s)) not in seen and (want is None or fp in want):
                    seen.add(fp)
                    fps.append(fp)
                    items.append(s.view(np.int64))
            if fps:
                flat = pa.array(np.concatenate(items))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([signed(np.array(fps, U)), pa.ListArray.from_arrays(pa.array(ends), flat)], ["fp", "items"])

    out = docs.select("text").mapInArrow(run, "fp long, items array<long>")
    if asked is None:
        out = out.join(classes, "fp", "left_semi")
    return out.dropDuplicates(["fp"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes with 100 * intersection >= percent * union."""
    needed_sets = maybe_broadcast(cut(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()))
    sets = sets.join(needed_sets, "fp", "left_semi")
    left, right = sets.select(F.col("fp").alias("a"), F.col("items").alias("_x")), sets.select(F.col("fp").alias("b"), F.col("items").alias("_y"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("_x", "_y"))
    union = F.size("_x") + F.size("_y") - F.col("_s")
    return both.withColumn("_s", shared).filter(100 * F.col("_s") >= percent * union).select("a", "b")


def joined_roots(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """Components of all links so far: those before are stars already, so few rounds join the new links."""
    return components(found if roots is None else found.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def classes_and_roots(docs: DataFrame, k: int, percent: int, crowd: int = CROWD, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and root (the component's smallest class; null for empty sets) of every row of docs."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    with Scratch(spark) as scratch:
        both = scratch.table(docs.mapInArrow(sign_documents(k), "doc_id long, n int, fp long, m0 long, m1 long, m2 long, part int, task int, cells binary"))
        signs = both.filter("part is null")
        counters = sum_arrays(both.filter("part is not null").select("part", "task", "cells"), "int32", 1 << CELL_BITS, both.agg(F.max("task")).first()[0] or 0)
        cells = spark.sparkContext.broadcast((counters, int(np.median(counters))))  # a full counter stays full: only the order depends on it
        del counters
        classes = scratch.table(signs.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), *(F.first(f"m{i}").alias(f"m{i}") for i in range(STARS))))
        # Stars: each class of a minimum-hash group against one pivot of the group; large groups get further pivots, for those
        # of its classes that aren't yet in the pivot's component.
        keys = classes.select("fp", "n", F.explode(F.array(*(F.xxhash64(F.lit(i), f"m{i}") for i in range(STARS)))).alias("key"))
        groups = scratch.table(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
        large = maybe_broadcast(groups.filter(F.col("c") > group).select("key", F.ceil(F.col("c") / group).alias("_k")))  # at most STARS / group rows a class
        salt = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("_k")), F.lit(0).cast("long")).alias("salt")
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("c") / group) - 1)).alias("salt")
        grouped = keys.join(large, "key", "left").select("fp", "n", "key", salt)
        grouped = scratch.table(grouped.join(groups.select("key", "c", salts), ["key", "salt"]))
        sets = scratch.table(sets_of(docs, grouped.select("fp").distinct(), k), codec="uncompressed")  # hashes
        roots = None
        for turn in range(PIVOTS):
            rows = grouped if turn == 0 else grouped.filter(F.col("c") > 16).join(maybe_broadcast(roots.select(F.col("node").alias("fp"), "root")), "fp", "left")
            rows = rows.withColumn("root", F.lit(None).cast("long") if turn == 0 else F.coalesce("root", "fp"))
            pivots = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("fp", F.lit(turn)).alias("o"), "fp", "n", "root")).alias("p"), F.max("c").alias("c"))
            close = 100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")
            apart = (F.col("fp") != F.col("p.fp")) & (F.lit(turn == 0) | (F.col("root") != F.col("p.root")))
            pairs = rows.join(pivots.select("key", "p", salts), ["key", "salt"]).filter(apart & close).select(F.least("fp", "p.fp").alias("a"), F.greatest("fp", "p.fp").alias("b")).distinct()
            found = scratch.table(verified(scratch.table(pairs), sets, percent))
            if turn == 0 or not small(found, 0):
                roots = joined_roots(roots, found)
            sweep(spark)
        index = docs.select("text").mapInArrow(index_prefixes(k, percent, cells, crowd), "token long, side int, fp long, n int, level int, l int, parity binary")
        labels = maybe_broadcast(roots.select(F.col("node").alias("fp"), "root"))
        index = index.join(labels, "fp", "left").withColumn("comp", F.coalesce("root", "fp")).select("token", "side", "fp", "n", "level", "l", "comp", "parity")
        index = index.repartition(F.col("token")).sortWithinPartitions("token", "comp", "fp")
        found = index.mapInArrow(propose(percent), "a long, b long, l int").groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("l").alias("l"))
        found = scratch.table(found.filter("shared >= l").select("a", "b"))
        missing = found.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(sets.select("fp"), "fp", "left_anti")
        missing = scratch.table(missing)
        sweep(spark)
        more = scratch.table(sets_of(docs, missing, k))
        roots = joined_roots(roots, scratch.table(verified(found, sets.unionAll(more), percent)))
        class_root = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        least = class_root.groupBy("root").agg(F.min("first").alias("least"))
        answer = class_root.join(least, "root").select(F.col("fp").alias("class_id"), "least", "root")
        out = signs.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("fp")).alias("class_id"))
        return cut(out.join(answer, "class_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "class_id", "root"))


def ngram_jaccard(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (documents of equal sets; null for empty ones) of every row of docs."""
    return classes_and_roots(docs, k, percent).select("doc_id", "n_shingles", "component_id", "class_id")


def with_class(docs: DataFrame, name: str, k: int) -> DataFrame:
    """docs with the class of each row's set in column `name`; null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            block = Block(batch.column("text"), lower=True)
            fps = [fingerprint(s) if len(s) else None for s in block.shingles(block.hashes(), k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x if x is None else x - (x >> 63 << 64) for x in fps], pa.int64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` long"]))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component, whatever the ids: the row of the smallest id (null last), then of the
    smallest class, then of the smallest text. Rows of empty sets all stay.

    An id that occurs once names its row. Rows of ids that are null or repeated are told apart by their class as well."""
    groups = classes_and_roots(docs, k, percent)
    sweep(docs.sparkSession)
    first = groups.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class_id")).alias("w")).select("w.doc_id", "w.class_id")
    first = cut(first)
    several = cut(groups.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias("_several")))
    stay = first.select("doc_id").unionAll(groups.filter("n_shingles = 0").select("doc_id")).filter("doc_id is not null").distinct()
    stay = maybe_broadcast(cut(stay.select(F.col("doc_id").alias("_stay"))), 4_000_000)
    rows = docs.join(stay, docs["doc_id"] == F.col("_stay"), "left_semi")
    if small(several, 0):
        return rows
    by = maybe_broadcast(several)
    rows = rows.join(by, docs["doc_id"] == F.col("_several"), "left_anti")
    name = "_class"
    while name in docs.columns:
        name += "_"
    other = cut(with_class(docs.join(by, docs["doc_id"].eqNullSafe(F.col("_several")), "left_semi"), name, k))
    empty = other.filter(F.col(name).isNull()).drop(name)
    mine = other.join(first.select(F.col("doc_id").alias("_d"), F.col("class_id").alias("_c")), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col(name) == F.col("_c")), "left_semi")
    cells = [F.col(f"`{c}`") for c in docs.columns]
    one = mine.groupBy("doc_id", name).agg(F.min_by(F.struct(*cells), F.struct("text", F.xxhash64(*cells))).alias("_row"))  # partial sums first: a hot row isn't gathered
    return rows.unionAll(empty).unionAll(one.select("_row.*"))
