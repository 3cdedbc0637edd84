"""A hidden Markov language model over word classes.

Tokens are lower-case (A-Z) words and one end. A word's class is the top 15 bits of its hash (the last two share one); the end is a
class of its own. The
model is P(text) = HMM(classes) * product of P(word | class): latent states emit classes, and a class emits its words with
(c + 1) / (N_class + V_class + 1), where an unseen word takes the remaining unit. So the HMM has a fixed size whatever the
vocabulary, frequent words nearly own their class, and word counts cover the whole corpus.

Training: Baum-Welch. Each task runs the scaled forward and backward passes over whole texts, of many at once, and its expected
counts are summed over tasks in doubles. Every round takes all training documents. Scoring: the scaled forward recursion over the whole
text, so the likelihood is exact. A text of more than 4096 tokens goes through in pieces of 512: their transfer matrices give the exact
forward and backward vectors at the pieces' borders.

Word counts: words of at least 1/2^20 of all tokens (at most 2^20 of them, a proven bound) are sent to the tasks; other words
meet their counts in a join on the word, where none of them is hot.

Defined results: null and empty texts are one end token; a null id counts as training; repeated rows are scored each; an empty
table gives an empty result; without training text the model is uniform; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ARRAY_SCHEMA, Scratch, array_rows, crc_mod, cut, ship, sum_arrays
from .textkit import Block, blocks, signed

U = np.uint64
CLASSES = 1 << 15
END = CLASSES - 1
STATES = 8
LONG, PIECE = 4096, 512  # texts of more tokens than LONG go through in pieces
TOGETHER = 1 << 20  # tokens of the texts that go through step by step together
KAPPA = 5.0
HEAVY = 1 << 20


def word_class(h: np.ndarray) -> np.ndarray:
    return np.minimum(h >> U(49), U(END - 1)).astype(np.int64)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, size=12 << 20):
        block = Block(batch.column("text"), lower=True)
        h, c = np.unique(block.hashes(), return_counts=True)
        yield pa.RecordBatch.from_arrays([signed(h), pa.array(c.astype(np.int64))], ["h", "c"])


def encode(heavy, class_total):
    """Each document as (rid, doc_id, held_out, n_tokens, known, log_c, log_class, classes), and its rare words as (rid, h, tf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, end_count = heavy.value
        totals = class_total.value
        rid = TaskContext.get().partitionId() << 33
        names = ["rid", "doc_id", "held_out", "n_tokens", "known", "log_c", "log_class", "classes", "h", "tf"]
        for batch in blocks(batches, size=6 << 20):
            block = Block(batch.column("text"), lower=True)
            h, n = block.hashes(), block.n_docs
            cls = word_class(h)
            at = np.searchsorted(words, h)
            at[at == len(words)] = 0
            hit = words[at] == h if len(words) else np.zeros(len(h), bool)
            known = np.bincount(block.doc[hit], minlength=n)
            log_c = np.bincount(block.doc[hit], weights=np.log10(counts[at[hit]] + 1.0), minlength=n)
            log_class = np.bincount(block.doc, weights=-totals[cls], minlength=n)
            small = cls.astype(np.uint16)
            cells = [small[block.word_off[d] : block.word_off[d + 1]].tobytes() for d in range(n)]
            ids = rid + np.arange(n)
            rid += n
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(np.diff(block.word_off) + 1), pa.array(known + int(end_count > 0)), pa.array(log_c), pa.array(log_class), pa.array(cells, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names)
            doc, rare = block.doc[~hit], h[~hit]
            order = np.lexsort((rare, doc))
            doc, rare = doc[order], rare[order]
            first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(rare, prepend=U(0)) != 0))
            tf = np.diff(np.append(first, len(doc))).astype(np.int32)
            m = len(first)
            for a in range(0, m, 100_000):
                f = first[a : a + 100_000]
                k = len(f)
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[f]]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.binary()), signed(rare[f]), pa.array(tf[a : a + 100_000])], names)

    return run


ENCODED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, log_c double, log_class double, classes binary, h long, tf int"


def sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.append(np.frombuffer(x.as_buffer(), np.uint16), np.uint16(END)) for x in batch.column("classes")]


def laid(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences longest first, side by side: their order, ids by step, each step's first cell, and how many reach each step."""
    size = np.array([len(s) for s in seqs], np.int64)
    order = np.argsort(-size, kind="stable")
    steps = int(size.max(initial=0))
    live = len(seqs) - np.cumsum(np.bincount(size, minlength=steps + 1))[:steps]
    at = np.concatenate([[0], np.cumsum(live)])
    ids = np.empty(at[-1], np.uint16)
    for j, i in enumerate(order):
        ids[at[: size[i]] + j] = seqs[i]
    return order, ids, at, live


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """emit has a row of STATES probabilities for each class."""
        self.start, self.move, self.emit = (x.astype(np.float32) for x in (start, move, emit))

    @staticmethod
    def first(unigram: np.ndarray) -> Hmm:
        rng = np.random.default_rng(5)
        emit = unigram[:, None] * np.exp(rng.normal(0, 0.7, (CLASSES, STATES)))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        return Hmm(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    def run(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the likelihood and the last forward vector of each sequence, by the scaled forward recursion."""
        order, ids, at, live = laid(seqs)
        total, product, last = np.zeros(len(seqs)), np.ones(len(seqs)), np.zeros((len(seqs), STATES))
        ones, a = np.ones(STATES, np.float32), np.zeros((0, STATES), np.float32)
        for t, n in enumerate(live):
            e = self.emit[ids[at[t] : at[t + 1]]]
            a = (a[:n] @ self.move) * e if t else self.start * e
            c = np.maximum(a @ ones, np.float32(1e-37))
            a /= c[:, None]
            product[:n] *= c
            if t % 8 == 7:  # 8 scales of 1e-37 at least don't leave the range of doubles
                total[:n] += np.log10(product[:n])
                product[:n] = 1.0
            below = live[t + 1] if t + 1 < len(live) else 0
            if below < n:
                last[below:n] = a[below:]
        total += np.log10(product)
        back = np.empty(len(seqs), np.int64)
        back[order] = np.arange(len(seqs))
        return total[back], last[back]

    def transfer(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece the matrix whose row j is the forward vector after it when the state before it was j, scaled, and log10 of the scale."""
        order, ids, at, live = laid(pieces)
        m, logs = np.broadcast_to(np.eye(STATES, dtype=np.float32), (len(pieces), STATES, STATES)).copy(), np.zeros(len(pieces))
        for t, n in enumerate(live):
            new = (m[:n].reshape(-1, STATES) @ self.move).reshape(n, STATES, STATES) * self.emit[ids[at[t] : at[t + 1]]][:, None, :]
            c = np.maximum(new.max(axis=(1, 2)), np.float32(1e-37))
            m[:n] = new / c[:, None, None]
            logs[:n] += np.log10(c)
        mats, scales = np.empty((len(pieces), STATES, STATES)), np.empty(len(pieces))
        mats[order], scales[order] = m, logs
        return mats, scales

    def pieces(self, seqs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sequences of more than LONG tokens cut in pieces: pieces, whose they are, forward vector before each (0 before a first one),
        backward vector after each, and log10 of the likelihood of each long sequence (0 of others)."""
        owner = [i for i, s in enumerate(seqs) for _ in range(1 if len(s) <= LONG else -(-len(s) // PIECE))]
        parts = [p for s in seqs for p in ([s] if len(s) <= LONG else [s[k : k + PIECE] for k in range(0, len(s), PIECE)])]
        enter, leave, logs = np.zeros((len(parts), STATES)), np.ones((len(parts), STATES)), np.zeros(len(seqs))
        own = np.array(owner, np.int64)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        long = [(a, b) for a, b in zip(first, np.append(first[1:], len(parts)), strict=True) if b - a > 1]
        if long:
            opened, vector = self.run([parts[a] for a, _ in long])
            rest = [k for a, b in long for k in range(a + 1, b)]
            mats, scales = self.transfer([parts[k] for k in rest])
            place = dict(zip(rest, range(len(rest)), strict=True))
            for (a, b), total, state in zip(long, opened, vector, strict=True):
                for k in range(a + 1, b):
                    enter[k] = state
                    state = state @ mats[place[k]]
                    c = max(state.sum(), 1e-300)
                    state, total = state / c, total + scales[place[k]] + np.log10(c)
                logs[own[a]] = total
                for k in range(b - 1, a, -1):
                    after = mats[place[k]] @ leave[k]
                    leave[k - 1] = after / max(after.max(), 1e-300)
        return parts, own, enter, leave, logs

    def log10(self, seqs: list[np.ndarray]) -> np.ndarray:
        """log10 of the exact likelihood of each whole sequence."""
        short = [i for i, s in enumerate(seqs) if len(s) <= LONG]
        out = self.pieces([s if len(s) > LONG else s[:0] for s in seqs])[4]
        out[short] = self.run([seqs[i] for i in short])[0]
        return out

    def expected(self, seqs: list[np.ndarray], cells: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions over whole sequences.

        Steps are taken in blocks of about so many cells. Forwards only the state at each block's border is kept; backwards each
        block's forward vectors are computed again from it, so memory is bounded and no move over a border is lost.
        """
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
        parts, own, enter, leave, _ = self.pieces(seqs)
        order, ids, at, live = laid(parts)
        enter, opens = enter[order].astype(np.float32), np.diff(own, prepend=-1)[order] != 0
        beta = leave[order].astype(np.float32)
        steps = len(live)
        borders = [0]
        while borders[-1] < steps:
            t = borders[-1]
            borders.append(max(t + 1, int(np.searchsorted(at, at[t] + cells, "right")) - 1))
        ones, flip = np.ones(STATES, np.float32), self.move.T.copy()

        def forward(t0: int, t1: int, a: np.ndarray | None, keep: bool) -> tuple[np.ndarray, ...]:
            """The last vectors of steps t0 to t1 - 1, and if keep, emissions, vectors, those of the step before, and scales."""
            e = self.emit[ids[at[t0] : at[t1]]]
            alpha, before, scale = (np.empty(e.shape, np.float32), np.empty(e.shape, np.float32), np.empty(len(e), np.float32)) if keep else (None, None, None)
            for t in range(t0, t1):
                x, y = at[t] - at[t0], at[t + 1] - at[t0]
                a = a[: live[t]] if t else enter
                if keep:
                    before[x:y] = a
                a = a @ self.move
                if not t:
                    a = np.where(opens[:, None], self.start, a)
                a *= e[x:y]
                c = np.maximum(a @ ones, np.float32(1e-30))
                a /= c[:, None]
                if keep:
                    alpha[x:y], scale[x:y] = a, c
            return a, e, alpha, before, scale

        states: list[np.ndarray | None] = [None]
        for t0, t1 in zip(borders[:-2], borders[1:-1], strict=True):
            states.append(forward(t0, t1, states[-1], False)[0])
        for k in range(len(borders) - 2, -1, -1):
            t0, t1 = borders[k], borders[k + 1]
            _, e, alpha, before, scale = forward(t0, t1, states[k], True)
            e /= scale[:, None]
            for t in range(t1 - 1, t0 - 1, -1):
                x, y = at[t] - at[t0], at[t + 1] - at[t0]
                alpha[x:y] *= beta[: live[t]]
                e[x:y] *= beta[: live[t]]  # e * beta / scale
                beta[: live[t]] = e[x:y] @ flip
            sums = np.maximum(alpha @ ones, np.float32(1e-30))[:, None]
            alpha /= sums
            e /= sums  # pieces end in vectors of any scale
            move += self.move * (before.T @ e)  # before is 0 at the first step of a sequence
            part = ids[at[t0] : at[t1]]
            by = np.argsort(part, kind="stable")
            some = part[by]
            heads = np.flatnonzero(np.diff(some.astype(np.int64), prepend=-1))
            emit[some[heads]] += np.add.reduceat(alpha[by], heads, axis=0)
            if t0 == 0:
                start += alpha[: len(parts)][opens].sum(axis=0)
        return start, move, emit


def train(encoded: DataFrame, unigram: np.ndarray, class_n: np.ndarray, rounds: int = 6) -> Hmm:
    """encoded: classes of the training documents, all of which enter each round; class_n: their tokens by class.

    A class takes KAPPA further tokens spread over the states as all tokens are, so the states of a rare class stay open and
    those of a frequent one are the data's; then its emissions are scaled to its own number of tokens."""
    spark = encoded.sparkSession
    model = Hmm.first(unigram)
    tasks = encoded.rdd.getNumPartitions()  # of a scan: its files' splits
    share = class_n[:, None] + 0.5
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(STATES + STATES * STATES + CLASSES * STATES)
            held: list[np.ndarray] = []

            def add() -> None:
                parts = sent.value.expected(held)
                np.add(total, np.concatenate([x.ravel() for x in parts]), out=total)
                held.clear()

            tokens = 0
            for batch in batches:
                for s in sequences(batch):
                    held.append(s)
                    tokens += len(s)
                    if tokens >= TOGETHER:
                        add()
                        tokens = 0
            if held:
                add()
            yield from array_rows(total.astype(np.float32))  # a task's counts; their sums are doubles

        total = sum_arrays(encoded.select("classes").mapInArrow(run, ARRAY_SCHEMA), "float32", STATES + STATES * STATES + CLASSES * STATES, tasks)
        sent.unpersist()
        start, move, emit = total[:STATES] + 1, total[STATES : STATES + STATES**2].reshape(STATES, STATES) + 0.1, total[STATES + STATES**2 :].reshape(CLASSES, STATES)
        use = (emit.sum(axis=0) + 1) / (emit.sum() + STATES)
        emit = share * (emit + KAPPA * use) / (class_n[:, None] + KAPPA)
        model = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def lm_scores(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text", F.coalesce(crc_mod(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"))
    learn = docs.filter(~F.col("held_out"))
    with Scratch(spark) as scratch:
        counts = scratch.table(learn.select("text").mapInArrow(count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        ends = learn.count()
        n, v = total["n"] + ends, total["v"] + (1 if ends else 0)
        k = F.least(F.shiftrightunsigned("h", 49), F.lit(END - 1)).cast("int")  # word_class
        per = counts.groupBy(k.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
        class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        class_n[per["k"].to_numpy()], class_v[per["k"].to_numpy()] = per["n"].to_numpy(), per["v"].to_numpy()
        class_n[END] = ends
        unigram = (class_n + 0.5) / (class_n.sum() + 0.5 * CLASSES)
        log_class = np.log10(class_n + class_v + 1)
        frequent = counts.filter(F.col("c") * HEAVY >= n).toArrow()
        words = frequent["h"].to_numpy().view(U)
        order = np.argsort(words)
        heavy = spark.sparkContext.broadcast((words[order], frequent["c"].to_numpy()[order], ends))
        rows = docs.mapInArrow(encode(heavy, spark.sparkContext.broadcast(log_class)), ENCODED)
        rows = rows.withColumn("kind", F.when(F.col("h").isNotNull(), 2).otherwise(F.col("held_out").cast("int")))
        encoded = scratch.table(rows, by="kind")  # training texts, others and rare words apart, so each round reads only what it needs
        whole = encoded.filter("kind < 2")
        model = spark.sparkContext.broadcast(train(encoded.filter("kind = 0").select("classes"), unigram, class_n))
        rare = encoded.filter("kind = 2").select("rid", "h", "tf").join(counts.filter(F.col("c") * HEAVY < n), "h")
        rare = rare.groupBy("rid").agg(F.sum("tf").alias("rare"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("rare_log"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches, column="classes", size=2 * TOGETHER):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "doc_id", "held_out", "n_tokens", "known", "log_c", "log_class")), pa.array(model.value.log10(sequences(batch)))], ["rid", "doc_id", "held_out", "n_tokens", "known", "log_c", "log_class", "log_hmm"])

        scored = whole.select("rid", "doc_id", "held_out", "n_tokens", "known", "log_c", "log_class", "classes").mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, known long, log_c double, log_class double, log_hmm double")
        out = scored.join(rare, "rid", "left")
        log_c = F.col("log_c") + F.coalesce("rare_log", F.lit(0.0))
        base = log_c + float(np.log10(ends + 1)) - F.col("n_tokens") * float(np.log10(n + v + 1))
        return cut(out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("log_hmm") + log_c + F.col("log_class")).alias("score")))
