"""Token counts under a unigram model, by a trie shared between pre-tokens.

Each distinct pre-token is inserted in a trie; a node holds the best log
probability of any segmentation of its prefix (the forward score) and that
segmentation's number of tokens.  A prefix that pre-tokens share is computed
once; the node where a pre-token ends gives its count, and a document's count is
the sum over its pre-tokens.  Trie and counts live in one task and start anew
beyond ``MAX_NODES`` nodes, looked at before each pre-token; one of more than
``MAX_INSERTED`` bytes never enters the trie: its forward scores are kept for the
bytes of the longest token alone.  So memory is bounded beyond the text itself, and
nothing is shuffled.

The vocabulary is a public one; its order of ranks gives Zipf's probabilities
1 / ((rank + 1) H).  It holds every single byte, so any text has a segmentation.
Of equal scores the one with fewer tokens counts.

Cases: a null or empty text has no tokens; rows are counted one by one, so
repeated rows repeat; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.common import text_documents
from lakeloom.llm.textkernels import text_blocks

VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_NODES = 1_000_000
#: Bytes of a pre-token that the trie takes; a longer one is scored in a window of its last bytes.
MAX_INSERTED = 4096
COUNTS = "doc_id long, n_bytes long, n_pretokens long, n_tokens long"


def read_vocabulary(path: str) -> dict[bytes, float]:
    """Log probability of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    total = math.log(math.fsum(1 / (r + 1) for r in ranks.values()))
    return {t: -math.log(r + 1) - total for t, r in ranks.items()}


class Trie:
    """Forward scores of all prefixes of the pre-tokens inserted so far."""

    def __init__(self, log_probs: dict[bytes, float]):
        # Every end of a token, with the log probability of those that are tokens themselves:
        # the tokens that end at a node are met by lengthening the end while it is known.
        self.ends = {t[i:]: -math.inf for t in log_probs for i in range(1, len(t))}
        self.ends.update(log_probs)
        self.longest = max(map(len, log_probs))
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}  # node * 256 + byte: the node below
        self.score = array("d", [0.0])
        self.count = array("l", [0])

    def insert(self, word: bytes) -> int:
        """The word's node: its score and token count stand there."""
        children, score, count, end = self.children, self.score, self.count, self.ends.get
        path, node = [0], 0
        for byte in word:
            key = node << 8 | byte
            node = children.get(key)
            if node is None:
                i = len(path)
                best, tokens = -math.inf, 0
                for j in range(i - 1, -1, -1):
                    p = end(word[j:i])
                    if p is None:
                        break
                    before = path[j]
                    p += score[before]
                    if p >= best:
                        k = count[before] + 1
                        if p > best or k < tokens:
                            best, tokens = p, k
                node = children[key] = len(score)
                score.append(best)
                count.append(tokens)
            path.append(node)
        return node


    def tokens(self, word: bytes) -> int:
        """The word's token count."""
        if len(word) > MAX_INSERTED:
            return self._alone(word)
        if len(self.score) > MAX_NODES:
            self.clear()
        return self.count[self.insert(word)]

    def _alone(self, word: bytes) -> int:
        """The same of a long word, with the scores of its last bytes alone."""
        size, end = self.longest + 1, self.ends.get
        score, count = [0.0] * size, [0] * size
        for i in range(1, len(word) + 1):
            best, tokens = -math.inf, 0
            for j in range(i - 1, max(i - size, -1), -1):
                p = end(word[j:i])
                if p is None:
                    break
                p += score[j % size]
                if p >= best:
                    k = count[j % size] + 1
                    if p > best or k < tokens:
                        best, tokens = p, k
            score[i % size], count[i % size] = best, tokens
        return count[len(word) % size]


def count_tokens(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_pretokens, n_tokens of every document."""
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    pattern = pattern or public_tokenizers.PATTERN

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(pattern).findall
        trie = Trie(read_vocabulary(vocabulary))
        counts: dict[str, int] = {}  # of the pre-tokens that the trie has met
        for batch in batches:
            for block in text_blocks(batch, "text"):
                out = []
                for doc_id, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist()):
                    words = cut(text) if text else []
                    distinct = set(words)
                    own = {w: counts[w] for w in distinct if w in counts}
                    for w in distinct.difference(own):
                        own[w] = trie.tokens(w.encode())
                        if len(w) <= MAX_INSERTED:
                            counts[w] = own[w]
                    out.append((doc_id, len(text.encode()) if text else 0, len(words), sum(map(own.__getitem__, words))))
                    if len(counts) > MAX_NODES // 4:
                        counts.clear()
                ids, sizes, words, tokens = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                    ["doc_id", "n_bytes", "n_pretokens", "n_tokens"],
                )

    return text_documents(docs).mapInArrow(count, COUNTS)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
