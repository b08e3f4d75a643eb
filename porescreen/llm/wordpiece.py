"""Token counts by greedy longest match over a trie with failure links, in time linear in the text."""

from __future__ import annotations

import json

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porescreen.llm.common import text_of

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: How this vocabulary writes the end of a word.
WORD_END = "</w>"
#: Words that a task remembers before it forgets them all.
REMEMBERED = 400_000


def read_vocabulary(path: str = VOCABULARY) -> list[str]:
    with open(path, encoding="utf-8") as file:
        return sorted(json.load(file)["model"]["vocab"])


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Automaton:
    """Trie of the pieces with failure links; each link knows how many pieces following it completes.

    A word's bytes are followed by END, which is also the last symbol of pieces that end a word. At a node, the bytes
    read since the last completed piece spell the node. If no child has the next symbol, the longest piece that the
    node's string begins with is popped, and so on with what is left, until a node is reached from which reading can
    go on: that node is the failure link, and the number of pieces popped on the way is stored with it.
    """

    END = 256

    def __init__(self, pieces: list[str]):
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.child: list[dict[int, int]] = [{}]
        terminal, parent, symbol = [False], [0], [-1]
        for piece in pieces:
            ends = piece.endswith(WORD_END)
            letters = piece[: -len(WORD_END)] if ends else piece
            if not letters or any(c not in byte for c in letters):
                continue
            node = 0
            for s in [*(byte[c] for c in letters), *([self.END] if ends else [])]:
                if s not in self.child[node]:
                    self.child[node][s] = len(self.child)
                    self.child.append({})
                    terminal.append(False)
                    parent.append(node)
                    symbol.append(s)
                node = self.child[node][s]
            terminal[node] = True
        n = len(self.child)
        self.fail, self.pops = [-1] * n, [0] * n
        wave = [0]
        while wave:  # by depth: links lead to nodes of smaller depth
            following = []
            for node in wave:
                following += self.child[node].values()
                if node == 0:
                    continue
                if terminal[node]:
                    self.fail[node], self.pops[node] = 0, 1
                    continue
                at, popped = self.fail[parent[node]], self.pops[parent[node]]
                while at >= 0 and symbol[node] not in self.child[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.pops[node] = self.child[at][symbol[node]], popped
            wave = following

    def count(self, word: bytes) -> int:
        """Pieces of a word; a byte that no piece can begin with counts as one unknown piece."""
        child, fail, pops, node, total = self.child, self.fail, self.pops, 0, 0
        for s in (*word, self.END):
            while s not in child[node]:
                if node == 0 or fail[node] < 0:
                    return self._careful(word)
                total += pops[node]
                node = fail[node]
                if node == 0 and s == self.END and s not in child[0]:
                    return total
            node = child[node][s]
        while node:
            if fail[node] < 0:
                return self._careful(word)
            total += pops[node]
            node = fail[node]
        return total

    def _careful(self, word: bytes) -> int:
        """Plain greedy match, for words that hold a byte without a piece of its own."""
        symbols, at, total = [*word, self.END], 0, 0
        while at < len(word):
            node, best = 0, at + 1
            for i in range(at, len(symbols)):
                node = self.child[node].get(symbols[i])
                if node is None:
                    break
                if self.fail[node] == 0 and self.pops[node] == 1:
                    best = i + 1
            total, at = total + 1, best
        return total


def count_tokens(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row: words between white space in lower case, and their greedy pieces.

    Null and empty texts have none. Repeated rows and rows without an id come back like any others; other columns are
    ignored; an empty table gives no rows. A word is read symbol by symbol, so its length does not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))  # the vocabulary alone
    built = {}

    def run(batches):
        if "automaton" not in built:
            built["automaton"] = Automaton(shared.value)
        count, held = built["automaton"].count, {}
        for batch in batches:
            n_words, n_tokens = [], []
            for text in text_of(batch):
                words, total = text.lower().split(), 0
                for word in words:
                    n = held.get(word)
                    if n is None:
                        n = count(word.encode("utf-8", "replace"))
                        if len(held) > REMEMBERED:
                            held.clear()
                        held[word] = n
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                                             ["doc_id", "n_words", "n_tokens"])

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
