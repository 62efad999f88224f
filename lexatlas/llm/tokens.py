"""Token counts of a unigram tokenizer without building its tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Where the public vocabulary lies; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def load_pieces(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces of a vocabulary file with unigram scores, by id: minus the logarithm of the piece's rank, and -30 for
    control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    return [(model.id_to_piece(i), -30.0 if special(i) else -math.log(2 - model.get_score(i))) for i in range(model.vocab_size())]


class UnigramCounter:
    """Piece count and score of the best segmentation of single words.

    An automaton enumerates the vocabulary's matches; of the pieces that end at a place the first to reach the largest
    score wins, longest piece first, and a character without a piece of its own may be unknown, at the lowest score
    less a penalty: the order and ties of the tokenizer's own search. An unknown character counts as its UTF-8 bytes
    if the vocabulary has all byte pieces, else a run of them as one.
    """

    def __init__(self, pieces: list[tuple[str, float]], memo: int = 1 << 19):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in pieces), default=1)
        known = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.memo: dict[str, tuple[int, float]] = {}
        self.most = memo

    def word(self, word: str) -> tuple[int, float]:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= self.most:
                self.memo.clear()
            found = self.search(word)
            if len(word) <= 64:
                self.memo[word] = found
        return found

    def search(self, word: str) -> tuple[int, float]:
        """Best segmentation of a word of any length. Places further back than the longest piece are forgotten."""
        width = self.longest + 1
        best, count, run = [0.0] * width, [0] * width, [False] * width
        matches = self.automaton.iter(word)
        last, match = next(matches, (-1, None))
        before = 0
        for e, char in enumerate(word, 1):
            ends = []
            while last + 1 == e:
                ends.append(match)
                last, match = next(matches, (-1, None))
            top, own, unknown, single = None, 0, False, False
            for length, score in sorted(ends, reverse=True) if len(ends) > 1 else ends:
                start = (e - length) % width
                value = best[start] + score
                if top is None or value > top:
                    top, own = value, count[start] + 1
                single = single or length == 1
            if not single:
                value = self.unknown + best[before]
                if top is None or value > top:
                    top, unknown = value, True
                    own = count[before] + (len(char.encode("utf-8", "replace")) if self.bytes else int(not run[before]))
            before = e % width
            best[before], count[before], run[before] = top, own, unknown
        return count[before], best[before]

    def text(self, text: str | None) -> tuple[int, int, float]:
        """Words, pieces and score of a text: a word is the space mark and what follows up to the next space."""
        if not text:
            return 0, 0, 0.0
        words = text.replace(SPACE, " ").split(" ")
        if words[0] == "":
            words = words[1:]
        pieces, score = 0, 0.0
        for w in words:
            n, s = self.word(SPACE + w)
            pieces += n
            score += s
        return len(words), pieces, score


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts of ``docs`` (doc_id, text, ...) under the unigram tokenizer of a vocabulary file.

    The vocabulary is read on the driver and broadcast (some hundred thousand short strings at most, whatever the
    documents); each document is counted in one pass, with the counts of repeated words remembered, up to a bounded
    number of them.

    Returns one row per input row: doc_id, n_words, n_tokens, score (log score of the best segmentation). Null and
    empty texts have none; other white space than blanks is part of words; a very long word is searched in time in
    proportion to its length and, beside a copy of the word, in memory
    of the longest piece; repeated rows are counted each; an empty table gives an empty result; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = UnigramCounter(shared.value)
        for pdf in batches:
            found = [counter.text(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": [f[0] for f in found], "n_tokens": [f[1] for f in found], "score": [f[2] for f in found]})

    return docs.select("doc_id", F.col("text")).mapInPandas(count, "doc_id long, n_words long, n_tokens long, score double")
