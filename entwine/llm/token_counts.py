"""Token counts under a unigram model, by dynamic programming over a trie.

The distinct pre-tokens (words between white space, each led by the word mark)
are inserted in a trie.  A node holds the best forward score of its prefix and
the number of tokens of that best segmentation.  Both depend on the prefix only,
so prefixes that words share are computed once.  The terminal counts are stored
by pre-token and a document's count is the sum over its pre-tokens.

Scores: a piece of rank r weighs ``-log(r + 10)``.  A character that is no piece
weighs ten less than the least piece and counts as its UTF-8 bytes.  Of equally
good segmentations the one with fewer tokens counts.

A null text is empty and has no tokens.  Texts of any length are counted whole.
Repeated rows give repeated results and an empty table an empty one.  Only the
id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entwine.llm.common import task

MARK = "▁"
#: Bounds of a worker's trie (nodes), and length over which a word is scored without being stored.
NODES, LONG = 1_500_000, 200


def piece_scores(model_path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file in rank order, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): -math.log(r + 10) for r, i in enumerate(plain)}


class PrefixTrie:
    """Forward scores by prefix; children in one dict keyed by (node, character)."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores))
        self.unknown = min(scores.values()) - 10.0
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]
        self.terminal: dict[str, tuple[int, float]] = {}

    def _extend(self, word: str, d: int, score: list[float], count: list[int]) -> tuple[float, int]:
        """Best score and count of ``word[:d]``; ``score`` and ``count`` are those of the shorter prefixes."""
        best, tokens = -math.inf, 0
        for start in range(max(0, d - self.longest), d):
            s = self.scores.get(word[start:d])
            if s is None:
                if start < d - 1:
                    continue
                s, n = self.unknown, count[start] + len(word[start:d].encode())
            else:
                n = count[start] + 1
            s += score[start]
            if s > best or (s == best and n < tokens):
                best, tokens = s, n
        return best, tokens

    def add(self, word: str) -> tuple[int, float]:
        """(tokens, score) of a pre-token; stored unless it is very long."""
        store = len(word) <= LONG
        node, score, count = 0, [0.0], [0]
        for d in range(1, len(word) + 1):
            key = (node, word[d - 1])
            nxt = self.child.get(key) if node >= 0 else None
            if nxt is not None:
                score.append(self.score[nxt])
                count.append(self.count[nxt])
                node = nxt
                continue
            s, n = self._extend(word, d, score, count)
            score.append(s)
            count.append(n)
            if store:
                node = self.child[key] = len(self.score)
                self.score.append(s)
                self.count.append(n)
            else:
                node = -1
        got = (count[-1], score[-1])
        if store:
            self.terminal[word] = got
        return got

    def document(self, text: str) -> tuple[int, int, float]:
        """(pre-tokens, tokens, score) of a text."""
        words = text.split()
        if len(self.score) > NODES:
            self.clear()
        known = self.terminal
        tokens, total = 0, 0.0
        for w in words:
            got = known.get(MARK + w) or self.add(MARK + w)
            tokens += got[0]
            total += got[1]
        return len(words), tokens, total


def count_tokens(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_pretokens``, ``n_tokens`` and ``unigram_score`` (log weight of the best segmentation)."""
    shared = documents.sparkSession.sparkContext.broadcast(piece_scores(model_path))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PrefixTrie(shared.value)
        for b in batches:
            rows = [trie.document(t.as_py() or "") for t in b.column(1)]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["doc_id", "n_pretokens", "n_tokens", "unigram_score"])

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task(run), "doc_id long, n_pretokens long, n_tokens long, unigram_score double")
