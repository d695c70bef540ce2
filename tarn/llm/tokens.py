"""Operator 2: token counts by a count-only Viterbi.

The vocabulary and scores of a public piece model are read as a unigram model: the segmentation of a text is the one with
the highest sum of scores. The given models are BPE models, whose scores are ranks of merges, so that these are the counts of a
unigram tokenizer with that vocabulary and these scores, not of the BPE tokenizer itself; a unigram model can be given as path. An Aho-Corasick automaton enumerates the vocabulary entries that end at each character, and
dynamic programming carries the best score and the number of pieces alone, with no path. The tie rule is the tokenizer's:
candidates for one end come in order of their starts and a later one must be strictly better, so the longest piece wins.
A character that is no piece gets the lowest score less 10, and counts as its UTF-8 bytes. Words (a space mark and what
follows) are segmented one by one, as the tokenizer's own pre-tokenizer does, and equal words of a task are done once.

Null and empty texts have 0 tokens. Rows may repeat; only the key and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import CACHED_BYTES, ship, tokenizer_path

MARK = "▁"
PENALTY = 10.0
#: Words kept by a worker; the memory then starts anew.
CACHE = 400_000
VOCABULARY = "piece_bpe_32k.model"


class UnigramCounter:
    def __init__(self, pieces: dict[str, float]):
        import ahocorasick

        self.pieces, self.unknown = pieces, min(pieces.values()) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.cache: dict[str, int] = {}

    def word(self, w: str) -> int:
        """Pieces of one word."""
        n = len(w)
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, hit in self.automaton.iter(w):
            ends[end + 1].append(hit)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            top, pieces, single = None, 0, False
            for length, score in sorted(ends[e], reverse=True):  # longest first: the earliest start
                single |= length == 1
                s = best[e - length] + score
                if top is None or s > top:
                    top, pieces = s, count[e - length] + 1
            if not single:
                s = best[e - 1] + self.unknown
                if top is None or s > top:
                    top, pieces = s, count[e - 1] + len(w[e - 1].encode("utf-8", "surrogatepass"))
            best[e], count[e] = top, pieces
        return count[n]

    def count(self, text: str | None) -> int:
        """Tokens of a text: each space starts a word, as does the text."""
        if not text:
            return 0
        if len(self.cache) > CACHE:
            self.cache.clear()
        total, cache = 0, self.cache
        text = text.replace(MARK, " ")  # one and the same to the tokenizer
        if text[0] == " ":
            text = text[1:]
        for w in text.split(" "):
            n = cache.get(w)
            if n is None:
                n = self.word(MARK + w)
                if len(w) <= CACHED_BYTES:
                    cache[w] = n
            total += n
        return total


def load(path: str) -> UnigramCounter:
    """From a sentencepiece file: normal pieces with their scores; control, unknown and byte entries are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return UnigramCounter({sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})


_LOADED: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    if path not in _LOADED:
        _LOADED[path] = load(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_tokens and n_chars of every row. path: a sentencepiece file that all workers can read; by default the public one that is installed with them."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path or tokenizer_path(VOCABULARY))
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.count(t) for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], names=[key, "n_tokens", "n_chars"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, n_chars bigint")
