"""Count-only Viterbi for unigram vocabularies.

An Aho-Corasick automaton over the vocabulary enumerates every piece inside a word; dynamic
programming over end positions carries only the best score and its piece count, so no path is kept.
The rules are those of the public ``tokenizers`` Unigram model behind a Metaspace splitter: a piece
replaces the best so far only if its score is strictly higher, longer pieces come first at an end;
a character without a piece of its own gets the lowest score less 10, neighbouring ones fuse into
one piece, and with byte fallback they count as their bytes. Words are scored once per worker and
kept in a bounded table.

Defined results: a null or empty text has no word, no piece and score 0; equal texts give equal rows;
words of any length are scored whole; columns with the names of the added ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN_PENALTY = 10.0
_counters: dict[tuple, UnigramCounter] = {}


class UnigramCounter:
    """Pieces and best score of texts under (piece, score) pairs."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]], byte_fallback: bool = True, max_words: int = 600_000):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self._bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        self._unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self._max = max_words
        self._words: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of a word that has its space mark already."""
        best, count, unknown = [0.0], [0], [False]  # by end; unknown: the best path ends in an unknown character
        top, pieces, single, found = 0.0, 0, False, False

        def close(end: int) -> None:
            """Settle the best path to ``end``, an unknown character included."""
            last, t, c = False, top, pieces
            if not single:
                value = self._unknown + best[end]
                if not found or value > top:
                    last, t = True, value
                    c = count[end] + (len(word[end].encode()) if self._bytes else int(not unknown[end]))
            best.append(t)
            count.append(c)
            unknown.append(last)

        at = 0
        for end, (length, score) in self._automaton.iter(word):  # by end, the longest first: ties keep the earliest start
            while at < end:
                close(at)
                at += 1
                top, pieces, single, found = 0.0, 0, False, False
            start = end + 1 - length
            value = score + best[start]
            if not found or value > top:
                top, pieces, found = value, count[start] + 1, True
            if length == 1:
                single = True
        while at < len(word):
            close(at)
            at += 1
            top, pieces, single, found = 0.0, 0, False, False
        return count[-1], best[-1]

    def text(self, text: str | None) -> tuple[int, int, float]:
        """(words, pieces, score) of a whole text; words begin at a space or space mark, and at the start."""
        if not text:
            return 0, 0, 0.0
        marked = text.replace(" ", "▁")
        words, known, pieces, score = (marked[1:] if marked[0] == "▁" else marked).split("▁"), self._words, 0, 0.0
        if len(known) > self._max:
            known.clear()
        for w in words:
            got = known.get(w)
            if got is None:
                got = self.word("▁" + w)
                if len(w) <= 64:
                    known[w] = got
            pieces += got[0]
            score += got[1]
        return len(words), pieces, score


def vocabulary_from_pieces(path: str) -> list[tuple[str, float]]:
    """A unigram vocabulary from the pieces of a public sentencepiece model, most frequent first.

    The scores are a stated rule, not training: piece number r (from 0, merges in their order) gets
    -log(r + 2); single characters and bytes follow in the file's order.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [(p, -math.log(i + 2)) for i, p in enumerate(names)]


def tokenizer(vocabulary: Sequence[tuple[str, float]], byte_fallback: bool = True):
    """The public tokenizer whose counts this module reproduces."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram([tuple(v) for v in vocabulary], unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, *, pieces: str | None = None, byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_words, n_tokens and score (of the best segmentation) of every whole text of ``docs``."""
    path = pieces or default_pieces()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, byte_fallback)
        if key not in _counters:
            _counters[key] = UnigramCounter(vocabulary_from_pieces(path), byte_fallback)
        counter = _counters[key]
        for batch in batches:
            rows = [counter.text(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long, score double")
