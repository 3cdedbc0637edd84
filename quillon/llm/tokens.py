"""Token counts of a unigram segmentation, with the forward scores of distinct pre-tokens shared along a trie.

Pieces and their order come from a public vocabulary file (a path is a parameter); a piece of rank r scores
-round(10^6 * ln(r + 3)). The pre-tokens of a text are its words, each with one space before it. A pre-token's count is
the number of pieces of its best-scoring segmentation, on equal scores the smallest number.

The distinct pre-tokens of a block are inserted in a trie. The walk over them in sorted order visits each node of that trie
once: the scores along the path that a word shares with the one before it are kept, and only the nodes below are computed. A
word's terminal count is stored in a table that the task keeps (cleared when it holds more than `keep` words, which costs
time, never results). Bytes are pieces themselves in such vocabularies; a byte without a piece costs as the last rank + 1000.

Defined results: null and empty texts have 0 tokens; repeated rows, null ids and other columns don't matter; an empty table
gives an empty result. Very long words are segmented whole.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import ship
from .textkit import blocks

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_pieces(path: str) -> dict[bytes, int]:
    """Score of each piece of a file with a base64 piece and a rank in each line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pieces = {k: -round(1e6 * math.log(r + 3)) for k, r in ranks.items()}
    other = -round(1e6 * math.log(max(ranks.values()) + 1003))
    return {bytes([b]): other for b in range(256)} | pieces


def trie_counts(words: Iterable[bytes], pieces: dict[bytes, int], longest: int) -> dict[bytes, int]:
    """Terminal counts; words are visited as a trie, in sorted order."""
    out: dict[bytes, int] = {}
    before = b""
    score, count = [0], [0]  # forward state of the current path: best score and its number of pieces after each byte
    get = pieces.get
    for word in sorted(words):
        full = b" " + word
        top, shared = min(len(before), len(full)), 0
        while shared < top and before[shared] == full[shared]:
            shared += 1
        del score[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(full) + 1):
            best, fewest = -(1 << 62), 0
            for start in range(max(0, end - longest), end):
                s = get(full[start:end])
                if s is not None:
                    s += score[start]
                    if s > best or s == best and count[start] + 1 < fewest:
                        best, fewest = s, count[start] + 1
            score.append(best)
            count.append(fewest)
        out[word] = count[-1]
        before = full
    return out


def token_counts(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, keep: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_tokens for every row of docs."""
    ship(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))  # a vocabulary file: tens of thousands of entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = pieces.value, {}
        longest = max(map(len, table))
        for batch in blocks(batches, size=16 << 20):
            texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            fresh = set().union(*texts).difference(known)
            if len(known) + len(fresh) > keep:
                known, fresh = {}, set().union(*texts)
            known.update(trie_counts(fresh, table, longest))
            look = known.__getitem__
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(map(look, t)) for t in texts], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
