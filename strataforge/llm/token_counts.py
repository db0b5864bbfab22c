"""Token counts without tokens: a pass over a text that carries only the best way's end and number of pieces.

An Aho-Corasick automaton over the vocabulary gives all pieces that end at each place of a text, and
dynamic programming from left to right keeps, for each place, how many pieces the tokenizer makes of
the text up to it. Which of the pieces that end there counts, the tokenizer's own rule says:

* unigram vocabularies: the way with the best sum of scores (Viterbi); of equal ones that whose last
  piece begins first; a character that is no piece costs the least score less 10.
* BPE vocabularies, in which scores only order the merges: the tokens of a text's beginning are the
  tokens of the whole up to there, and a row of tokens is the tokenizer's if each two neighbours are
  what it makes of the two. So exactly one piece that ends at a place fits the last piece before it.

Pieces that stand for bytes, control or unknown text are never matched. Characters that are no piece
fall back to their bytes if the vocabulary has them, and else neighbours make one unknown piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of segments, and pairs of pieces, whose counts a worker remembers; then it begins anew.
REMEMBERED_BYTES, REMEMBERED_PAIRS = 64 << 20, 500_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that can be matched with their scores, whether characters fall back to bytes, and the tokenizer's rule."""

    pieces: dict[str, float]
    bytes: bool
    merges: bool


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file. Only a BPE model's scores, which are ranks, are all whole numbers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = {model.id_to_piece(k): model.get_score(k) for k in ids if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))}
    merges = all(score.is_integer() for score in pieces.values())
    return Vocabulary(pieces, any(model.is_byte(k) for k in ids), merges)


class Counter:
    """Counts the pieces of texts; built once for each task."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        self.vocabulary, self.pieces = vocabulary, vocabulary.pieces
        self.names = ["", *filter(None, self.pieces)]
        for k, piece in enumerate(self.names[1:], 1):
            self.automaton.add_word(piece, (len(piece), self.pieces[piece], k))
        self.automaton.make_automaton()
        self.unknown = min(self.pieces.values(), default=0.0) - UNKNOWN_PENALTY
        # texts are cut before spaces, if no piece goes on from other text into a space
        self.cuts = not any(SPACE in piece.lstrip(SPACE) for piece in self.pieces)
        self.segment: Callable[[str], int] = self.by_merges if vocabulary.merges else self.by_scores
        self.known: dict[str, int] = {}
        self.held = 0
        self.fitting: dict[int, bool] = {}

    def fallback(self, char: str, joined: bool) -> int:
        """Pieces of a character that is none; joined if the one before it is none either."""
        return len(char.encode("utf-8", "surrogatepass")) if self.vocabulary.bytes else 1 - joined

    def by_scores(self, text: str) -> int:
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count, single, unknown = [0] * (n + 1), bytearray(n + 1), bytearray(n + 1)
        settled = 0

        def settle(end: int) -> None:
            """Up to a place: an unknown character comes last of what ends with it, as it begins last."""
            nonlocal settled
            while settled < end:
                if not single[settled + 1]:
                    way = best[settled] + self.unknown
                    if best[settled + 1] is None or way > best[settled + 1]:
                        count[settled + 1] = count[settled] + self.fallback(text[settled], bool(unknown[settled]))
                        best[settled + 1], unknown[settled + 1] = way, 1
                settled += 1

        # by end, and of those with the same end the longest first
        for k, (length, score, _) in self.automaton.iter(text):
            end, start = k + 1, k + 1 - length
            settle(k)
            way = best[start] + score
            if best[end] is None or way > best[end]:
                best[end], count[end] = way, count[start] + 1
            single[end] |= length == 1
        settle(n)
        return count[n]

    def by_merges(self, text: str) -> int:
        n = len(text)
        # the last piece of the text up to each place, by its number; 0 at the start and where a character is none
        last: list[int | None] = [0] + [None] * n
        count, unknown = [0] * (n + 1), bytearray(n + 1)
        settled, fitting, many = 0, self.fitting, len(self.names)
        for k, (length, _, piece) in self.automaton.iter(text):
            while settled < k:
                settled += 1
                if last[settled] is None:
                    last[settled], unknown[settled] = 0, 1
                    count[settled] = count[settled - 1] + self.fallback(text[settled - 1], bool(unknown[settled - 1]))
            if last[k + 1] is None:
                start = k + 1 - length
                pair = last[start] * many + piece
                fits = fitting.get(pair)
                if fits if fits is not None else self.fits(pair):
                    last[k + 1], count[k + 1] = piece, count[start] + 1
        for k in range(settled + 1, n + 1):
            if last[k] is None:
                last[k], unknown[k] = 0, 1
                count[k] = count[k - 1] + self.fallback(text[k - 1], bool(unknown[k - 1]))
        return count[n]

    def fits(self, pair: int) -> bool:
        """Whether the tokenizer makes just these two pieces (the left one may be none) of the text that they make up."""
        left, right = self.names[pair // len(self.names)], self.names[pair % len(self.names)]
        if len(self.fitting) >= REMEMBERED_PAIRS:
            self.fitting.clear()
        found = self.fitting[pair] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def merged(self, text: str) -> list[str]:
        """The pieces of two pieces' text, by merging: of all neighbours that make up a piece those with the best score first, of equal ones the first."""
        parts, scores = list(text), self.pieces
        while True:
            best, at = None, 0
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def count(self, text: str) -> int:
        """Pieces of a whole text, which begins with a space for the tokenizer."""
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE) if self.vocabulary.merges or not text.startswith((" ", SPACE)) else text.replace(" ", SPACE)
        if not self.cuts:
            return self.segment(marked)
        total, at, spaces = 0, 0, ""
        # of a run of spaces the BPE keeps all with the word behind them, as they may merge; a unigram word has one
        for word in marked.split(SPACE)[1:]:
            if self.vocabulary.merges and not word:
                spaces += SPACE
                continue
            total += self.remembered(spaces + SPACE + word)
            spaces = ""
        return total + (self.remembered(spaces) if spaces else 0)

    def remembered(self, segment: str) -> int:
        n = self.known.get(segment)
        if n is None:
            n = self.segment(segment)
            if self.held >= REMEMBERED_BYTES:
                self.known.clear()
                self.held = 0
            size = 100 + 4 * len(segment)
            if size < REMEMBERED_BYTES:
                self.known[segment] = n
                self.held += size
        return n


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_chars and n_tokens for each row of docs (doc_id, text); other columns are ignored.

    n_tokens is what the tokenizer of the vocabulary file makes of the whole text, without special tokens.
    The vocabulary has a fixed size; the driver reads it and sends it to each task once. A null or empty
    text has no tokens, a null doc_id stays null, rows that repeat are counted each. Texts of any length
    are counted whole, in time in proportion to it. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            counts = [counter.count(text.as_py() or "") for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text").mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
