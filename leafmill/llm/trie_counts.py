"""Token counts by a unigram model whose forward scores are shared in a trie.

The distinct pre-tokens of a batch enter a trie.  A node stands for a prefix and holds the best log probability of
any segmentation of that prefix into vocabulary pieces and its number of pieces; it is computed once, from the nodes
above it, for all pre-tokens that share the prefix.  A pre-token's count is its last node's; a document's is the sum.

A pre-token is a run of characters that are no white space, with a word mark before it.  Piece i of the vocabulary
has the probability of rank i by Zipf's law (rank files keep no frequencies); a character outside the vocabulary falls
back to one piece per byte, each as rare as the last rank.  Equal scores prefer fewer pieces.

Defined cases: a null text, an empty one or one of white space only has no tokens; repeated rows are counted each;
other columns are ignored.  A worker's trie holds ``MAX_NODES`` nodes and starts anew beyond them; a pre-token of more
than ``LONG`` characters is scored by itself, whole; neither changes a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import sliced

MARK = "▁"
MAX_NODES = 700_000
LONG = 128
COUNTS = "doc_id long, n_pretokens long, n_tokens long, log_prob double"


class Vocabulary:
    """Log probabilities of pieces by rank, and all their suffixes, which tell how far back a piece can begin."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size())
               if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        norm = math.log(sum(1 / rank for rank in range(1, len(ids) + 1)))
        self.scores = {model.id_to_piece(i): -math.log(rank) - norm for rank, i in enumerate(ids, 1)}
        self.byte_score = -math.log(len(ids)) - norm
        self.suffixes = {piece[k:] for piece in self.scores for k in range(len(piece))}

    def best(self, text: str, end: int, scores: list[float], counts: list[int], at: list[int]) -> tuple[float, int]:
        """Best score and count of ``text[:end]``; those of ``text[:i]`` are at index ``at[i]``."""
        best, count = -math.inf, 0
        for start in range(end - 1, -1, -1):
            piece = text[start:end]
            if piece not in self.suffixes:
                break
            own = self.scores.get(piece)
            if own is not None:
                score, n = scores[at[start]] + own, counts[at[start]] + 1
                if score > best or score == best and n < count:
                    best, count = score, n
        if text[end - 1] not in self.scores:
            n = len(text[end - 1].encode("utf-8", "surrogatepass"))
            score, n = scores[at[end - 1]] + n * self.byte_score, counts[at[end - 1]] + n
            if score > best or score == best and n < count:
                best, count = score, n
        return best, count


class Trie:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.scores, self.counts = [0.0], [0]

    def terminals(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and scores of distinct pre-tokens; walked in sorted order, each from the prefix it shares with the
        one before."""
        counts, scores = np.zeros(len(words), np.int64), np.zeros(len(words))
        path, before = [0], ""
        for i in sorted(range(len(words)), key=words.__getitem__):
            word = MARK + words[i]
            if len(word) > LONG:
                counts[i], scores[i] = self._alone(word)
                continue
            if len(self.scores) > MAX_NODES:
                self.clear()
                path, before = [0], ""
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del path[shared + 1:]
            node = path[-1]
            for k in range(shared, len(word)):
                key = node << 21 | ord(word[k])
                node = self.child.get(key)
                if node is None:
                    score, count = self.vocabulary.best(word, k + 1, self.scores, self.counts, path)
                    node = self.child[key] = len(self.scores)
                    self.scores.append(score)
                    self.counts.append(count)
                path.append(node)
            before = word
            counts[i], scores[i] = self.counts[node], self.scores[node]
        return counts, scores

    def _alone(self, word: str) -> tuple[int, float]:
        scores, counts = [0.0], [0]
        at = range(len(word) + 1)
        for end in range(1, len(word) + 1):
            score, count = self.vocabulary.best(word, end, scores, counts, at)
            scores.append(score)
            counts.append(count)
        return counts[-1], scores[-1]


_TRIES: dict[str, Trie] = {}


def trie(path: str) -> Trie:
    """The worker's trie for a vocabulary; it outlives a task and stays within its bound."""
    if path not in _TRIES:
        _TRIES[path] = Trie(Vocabulary(path))
    return _TRIES[path]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: pre-tokens, tokens, and the log probability of the best segmentation."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie(vocabulary)
        for batch in sliced(batches):
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
            bounds = lists.offsets.to_numpy()
            flat = lists.flatten()
            coded = flat.dictionary_encode()
            words = coded.dictionary.to_pylist()
            index = coded.indices.to_numpy()
            counts, scores = own.terminals(words)
            filled = np.array([bool(w) for w in words], bool)
            counts, scores = counts * filled, scores * filled  # an empty text is split into one empty word
            sums = [np.concatenate([[0], np.cumsum(filled[index])]), np.concatenate([[0], np.cumsum(counts[index])])]
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            score = np.bincount(doc, scores[index], batch.num_rows) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array((s[bounds[1:]] - s[bounds[:-1]]).astype(np.int64)) for s in sums),
                 pa.array(score.astype(np.float64))], names=["doc_id", "n_pretokens", "n_tokens", "log_prob"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, COUNTS)
