"""Token counts by longest match over a public vocabulary, in one pass over each word's characters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Marks the begin of a word in the vocabulary.
WORD = "▁"
WORDS_KEPT = 500_000


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """The pieces of a sentencepiece vocabulary, without control and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


class Automaton:
    """A trie of pieces with failure links, along which the number of pieces that are cut off is known beforehand.

    Reading a word, a character without a child follows the link: what has been read splits into whole pieces, greedily from its
    left end, and the rest that the link's node spells; their number is added. So greedy longest-match is counted in time linear
    in the word, without going back and without building pieces. A node whose text does not split so has no link.
    """

    def __init__(self, pieces: Iterable[str]) -> None:
        self.child: list[dict[str, int]] = [{}]
        whole, parent = [False], [(0, "")]
        for piece in pieces:
            at = 0
            for c in piece:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    whole.append(False)
                    self.child.append({})
                    parent.append((at, c))
                at = self.child[at][c]
            whole[at] = at > 0
        self.whole = whole
        self.link: list[int] = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        level = [0]
        while level:
            level = [n for at in level for n in self.child[at].values()]
            for n in level:
                at, c = parent[n]
                if whole[n]:
                    self.link[n], self.popped[n] = 0, 1
                    continue
                z, cut = self.link[at], self.popped[at]
                while z >= 0 and c not in self.child[z]:
                    cut += self.popped[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[n], self.popped[n] = self.child[z][c], cut

    def count(self, word: str) -> int:
        """Pieces of ``word`` by greedy longest match; a character where no piece fits counts as its UTF-8 bytes."""
        total, at = 0, 0
        for c in word:
            while c not in self.child[at]:
                if at == 0:
                    total += len(c.encode())  # no piece begins so: its bytes
                    break
                if self.link[at] < 0:
                    return self._slowly(word)
                total += self.popped[at]
                at = self.link[at]
            else:
                at = self.child[at][c]
        while at:
            if self.link[at] < 0:
                return self._slowly(word)
            total += self.popped[at]
            at = self.link[at]
        return total

    def _slowly(self, word: str) -> int:
        """The same count piece by piece, for the rare word of which a stretch is not whole pieces."""
        total, begin = 0, 0
        while begin < len(word):
            at, i, end = 0, begin, 0
            while i < len(word) and word[i] in self.child[at]:
                at, i = self.child[at][word[i]], i + 1
                if self.whole[at]:
                    end = i
            total += 1 if end else len(word[begin].encode())
            begin = end or begin + 1
        return total


class _Counts(dict):
    """Counts of the words met lately."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        n = self.automaton.count(WORD + word.decode())
        if len(word) <= 64:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, pieces: list[str] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_tokens.

    Words are what ASCII white space parts; each is cut, with a mark of its begin, into the longest pieces that fit from
    left to right, and characters of no piece count as their UTF-8 bytes. The automaton is built of ``pieces`` (by default
    those of VOCABULARY) once on the driver and broadcast: its size is the vocabulary's. Null and empty texts have no tokens.
    Rows without a doc_id keep null; repeated rows give repeated results; an empty table gives none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(read_pieces() if pieces is None else pieces))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(shared.value)
        for b in batches:
            words = [(t or b"").split() for t in b.column("text").cast(pa.binary()).to_pylist()]
            tokens = [sum(map(counts.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(map(len, words)), pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_words long, n_tokens long")
