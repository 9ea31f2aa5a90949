"""Token counts without tokens: count-only Viterbi over Aho-Corasick matches.

An automaton of the vocabulary reads a part of a text once and names every piece that
ends at each character; the best score up to there is carried with the number of pieces
on its path, and nothing is kept to trace the path back.  Ties and unknown characters
follow the encoder: the longer last piece wins, an unknown character stands for its bytes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelwright.llm.common import Rows, WordMemo, fields, kept, over_texts, sums, with_results
from panelwright.llm.vocabulary import Vocabulary, load, segments


class Counter:
    def __init__(self, v: Vocabulary, limit: int = 500_000):
        import ahocorasick

        self.v, self.counts = v, Rows(dtype=np.int64)
        self.memo = WordMemo(lambda parts: self.counts.add(np.array([self.count_part(p) for p in parts])), self.counts.keep, limit)
        self.automaton = ahocorasick.Automaton()
        for i in v.matched:
            self.automaton.add_word(v.pieces[i], (len(v.pieces[i]), v.scores[i]))
        self.automaton.make_automaton()

    def count_part(self, part: str) -> int:
        n, unknown = len(part), self.v.unknown_score
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        open_at, score, longest, many, single, new_unknown = 0, None, 0, 0, False, [False] * (n + 1)

        def close(upto: int):
            """Fixes the state of every end from open_at + 1 to ``upto``."""
            nonlocal open_at, score, longest, many, single
            while open_at < upto:
                e = open_at + 1
                if not single:
                    c = best[e - 1] + unknown
                    if score is None or c > score:
                        width = len(part[e - 1].encode("utf-8", "surrogatepass")) if self.v.bytes_ else (0 if new_unknown[e - 1] else 1)
                        score, many, new_unknown[e] = c, pieces[e - 1] + width, True
                best[e], pieces[e] = score, many
                open_at, score, longest, many, single = e, None, 0, 0, False

        for last, (size, s) in self.automaton.iter(part):
            close(last)
            c = best[last + 1 - size] + s
            if score is None or c > score or (c == score and size > longest):
                score, longest, many = c, size, pieces[last + 1 - size] + 1
            single = single or size == 1
        close(n)
        return pieces[n]

    def count_all(self, texts: list[str]) -> np.ndarray:
        split = [segments(t, self.v.by_word) for t in texts]
        at = self.memo.rows([p for x in split for p in x])
        many = np.fromiter(map(len, split), np.int64, len(split))
        return sums(self.counts.data[at], np.cumsum(many) - many).astype(np.int64)

    def count(self, text: str) -> int:
        return int(self.count_all([text])[0])


def token_counts(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with n_tokens; 0 for null and empty texts."""
    with open(model_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, load(f.read())))
    results = {"n_tokens": "bigint"}

    def start():
        key, v = shared.value
        c = kept(("counts", key), lambda: Counter(v))
        return lambda rows, texts: with_results(
            rows, {"n_tokens": pa.array(c.count_all([(t or b"").decode("utf-8", "replace") for t in texts]))}, (text,))
    return over_texts(docs, fields(docs, results, (text,)), start, text)
