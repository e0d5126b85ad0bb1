"""Token counts: count-only Viterbi over a unigram vocabulary.

Texts are cut as a metaspace pre-tokenizer cuts them: blanks become U+2581, one
is put before the text unless it starts with one, and each starts a new word.
In a word an Aho-Corasick automaton lists every vocabulary piece with its end;
for each end the best path's score and number of pieces are carried, never the
path.  Ties keep the path whose last piece starts first, as the tokenizer scans
starts from left to right and only a better score replaces one.  A character
that no piece of its length covers is an unknown one at the vocabulary's least
score minus ten; neighbouring unknown ones are fused into one piece.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_columns

MARK = "▁"
_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, control pieces left out."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class UnigramCounter:
    """Counts of pieces and best scores of words; results of short words are kept, within ``limit``."""

    def __init__(self, pieces: Sequence[tuple[str, float]], limit: int = 300_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - _PENALTY
        self.some = len(self.automaton) > 0
        self.limit = limit
        self.young: dict[str, tuple[float, int]] = {}
        self.old: dict[str, tuple[float, int]] = {}

    def word(self, word: str) -> tuple[float, int]:
        """Best score and number of pieces of one word."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = [False] * n
        if self.some:
            for end, (length, score) in self.automaton.iter(word):
                ends[end + 1].append((end + 1 - length, score))
                if length == 1:
                    single[end] = True
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            # The longest piece starts first: it comes first among equals.
            found = sorted(ends[end])
            if not single[end - 1]:
                found.append((end - 1, None))
            start, score = found[0]
            top = best[start] + (self.unknown if score is None else score)
            at = 0
            for k in range(1, len(found)):
                s, x = found[k]
                value = best[s] + (self.unknown if x is None else x)
                if value > top:
                    top, at = value, k
            start, score = found[at]
            best[end] = top
            unknown[end] = score is None
            count[end] = count[start] + (0 if score is None and unknown[start] and start else 1)
        return best[n], count[n]

    def text(self, text: str) -> tuple[float, int]:
        """Best score and number of pieces of a text."""
        if not text:
            return 0.0, 0
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        total, pieces, young = 0.0, 0, self.young
        for rest in marked.split(MARK)[1:]:
            got = young.get(rest)
            if got is None:
                got = self.old.get(rest) or self.word(MARK + rest)
                if len(rest) <= 64:
                    young[rest] = got
            total += got[0]
            pieces += got[1]
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return total, pieces


_HELD: dict[str, UnigramCounter] = {}


def count_tokens(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, score of each row by the vocabulary at ``path``.

    Null and empty texts have 0 tokens and score 0; each input row gives one row
    and null ids are passed on.  Words of any length are handled, in memory that
    grows with the longest one.  Other columns are not read.
    """
    check_columns(documents, "doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _HELD:
            _HELD[path] = UnigramCounter(vocabulary(path))
        counter = _HELD[path]
        for batch in batches:
            found = [counter.text(t or "") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [c for _, c in found], "score": [s for s, _ in found]})

    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, n_tokens long, score double")
    return rows.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))
