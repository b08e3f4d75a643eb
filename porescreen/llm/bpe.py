"""Byte-level BPE: ranked merges folded over the bytes of distinct words by Spark's higher-order functions."""

from __future__ import annotations

import base64
import hashlib
import heapq
import pickle
import re
import zlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from porescreen.llm.common import small, text_of
from porescreen.session import cut_lineage

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Words that are folded and shipped to all tasks: so many of the most frequent, up to so many bytes each. Others are
#: merged where they stand, in ``merge_word``, so this bounds what is broadcast and changes no result.
COMMON_WORDS, COMMON_BYTES = 1 << 18, 32
#: Bytes of a word up to which a list of pairs is quicker than a heap.
SHORT = 64
BYTES = [bytes([b]) for b in range(256)]
#: Tasks that fold the frequent words.
FOLD_TASKS = 64
#: Entries of a task's own memory of chunks before it is emptied.
REMEMBERED = 300_000
BUCKETS = 8192


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    """The rank of each piece of a tokenizer file; its size is the vocabulary's."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def _rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """The ranks as one row: maps by the CRC of the piece, as Spark searches a map entry by entry.

    It is a table and no literal, which the driver would hold in each plan and in each description of one.
    A byte of a piece is a character of its key."""
    buckets = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        buckets[zlib.crc32(piece) % BUCKETS][piece.decode("latin-1")] = rank
    return spark.createDataFrame([(buckets,)], "table array<map<string,int>>")


def _rank(table: Column, piece: Column) -> Column:
    bucket = F.element_at(table, (F.crc32(piece) % BUCKETS + 1).cast("int"))
    return F.try_element_at(bucket, F.decode(piece, "ISO-8859-1"))


def encode_word(word: Column, table: Column) -> Column:
    """Ids of a word (binary): the adjacent pair of least rank merges, leftmost first, until no pair has a rank."""
    size = F.octet_length(word)
    single = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, F.lit(1)))

    def merge(pieces, _):
        # Every pair once: its rank with its place, then the least.
        pairs = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda right, i: F.struct(
            _rank(table, F.concat(F.element_at(pieces, i + 1), right)).alias("rank"), i.alias("at")))
        best = F.array_min(F.filter(pairs, lambda p: p["rank"].isNotNull()))
        joined = lambda b: F.concat(
            F.slice(pieces, F.lit(1), b["at"]),
            F.array(F.concat(F.element_at(pieces, b["at"] + 1), F.element_at(pieces, b["at"] + 2))),
            F.slice(pieces, b["at"] + 3, F.size(pieces)))
        # The least pair is bound once, as the only element of an array.
        return F.when(F.size(pieces) < 2, pieces).otherwise(F.coalesce(
            F.element_at(F.transform(F.array(best), lambda b: F.when(b.isNotNull(), joined(b))), 1), pieces))

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), single, merge)
    return F.transform(folded, lambda p: _rank(table, p))


def decode_ids(ids: list[int], pieces: dict[int, bytes]) -> bytes:
    """The bytes of ids: their pieces, one after the other."""
    return b"".join([pieces[i] for i in ids])


def merge_word(word: bytes, ranks: dict[bytes, int], pieces: dict[int, bytes]) -> list[int]:
    """The same merges for words that are not folded: short ones by a list of the ranks of their pairs."""
    if len(word) > SHORT:
        return _merge_long(word, ranks)
    none, get = len(ranks) + 1, ranks.get
    parts = [BYTES[b] for b in word]
    pairs = [get(word[i:i + 2], none) for i in range(len(word) - 1)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        merged = parts[i] = pieces[least]
        del parts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(merged + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + merged, none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """A heap over a linked list: n log n steps for any length."""
    n = len(word)
    start, end = list(range(n)), list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    alive, heap = [True] * n, []

    def push(i):
        j = after[i]
        if j >= 0 and (rank := ranks.get(word[start[i]:end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or end[i] != mid or j < 0 or end[j] != stop:
            continue
        end[i], alive[j], after[i] = stop, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[word[start[i]:end[i]]] for i in range(n) if alive[i]]


class Splitter:
    """Cuts a text into chunks that the pattern never joins, and a chunk into words."""

    def __init__(self, pattern: str):
        self.words = regex.compile(pattern).findall
        # Letters that any version of Unicode has, and marks; the pattern cuts such a chunk between the two.
        self.simple = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)").fullmatch if pattern == public_tokenizers.PATTERN else lambda part: None
        # Python's white space holds all of the pattern's; a text that is odd by more of it has the same words.
        self.spaces = re.compile(r" \s").search

    def odd(self, text: str) -> bool:
        """Whether a space stands before white space, or behind it at the end."""
        return bool(self.spaces(text)) or (text[-1:] == " " and text[-2:-1].isspace())

    def words_after_space(self, part: str) -> list[str]:
        """The words of a chunk, given without the space before it."""
        if found := self.simple(part):
            word, marks = found.groups()
            return [" " + word, marks] if marks else [" " + word]
        return self.words(" " + part)

    def chunks(self, text: str) -> tuple[str, list[str]]:
        """(first chunk, others without the space before them): at a single space before a character that is none, a
        word always begins. A text with other spaces is one chunk."""
        if self.odd(text):
            return text, []
        first, *others = text.split(" ")
        return first, others


def distinct_words(docs: DataFrame, text_column: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(word, n) of all words of all texts, as binary; counted in each task before they are shuffled."""
    def run(batches):
        split, first, others = Splitter(pattern), Counter(), Counter()

        def words():
            out = Counter()
            for held, cut in ((first, split.words), (others, split.words_after_space)):
                for chunk, n in held.items():
                    for w in cut(chunk):
                        out[w] += n
                held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([w.encode("utf-8", "replace") for w in out], pa.binary()), pa.array(list(out.values()), pa.int64())],
                ["word", "n"])

        for batch in small(batches):
            for text in text_of(batch):
                one, more = split.chunks(text)
                first[one] += 1
                others.update(more)
            if len(first) + len(others) > REMEMBERED:
                yield words()
        yield words()

    counted = docs.select(F.col(text_column).alias("text")).mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(words: DataFrame) -> DataFrame:
    """At most COMMON_WORDS of the most frequent words: all of the classes of frequency that fit, by a histogram of these."""
    words = cut_lineage(words.where(F.octet_length("word") <= COMMON_BYTES).withColumn("class", F.floor(F.log2("n") * 8).cast("int")))
    cut, room = None, COMMON_WORDS
    for row in words.groupBy("class").count().orderBy(F.desc("class")).collect():  # some hundred classes
        room -= row["count"]
        if room < 0:
            break
        cut = row["class"]
    return words.where(F.col("class") >= cut if cut is not None else F.lit(False)).select("word")


def _encoded(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(words, ids) of parts of the words; a part is one row, so that the ranks join a few rows and not each word."""
    part = F.pmod(F.xxhash64("word"), F.lit(4 * FOLD_TASKS))
    parts = words.withColumn("part", part).repartition(FOLD_TASKS, "part").groupBy("part").agg(F.collect_list("word").alias("words"))
    parts = parts.crossJoin(F.broadcast(_rank_table(words.sparkSession, ranks)))
    return parts.select("words", F.transform("words", lambda w: encode_word(w, F.col("table"))).alias("ids"))


def _pack_words(batches):
    for batch in batches:
        words = {}
        for part, ids in zip(batch.column("words").to_pylist(), batch.column("ids").to_pylist()):
            words.update(zip(part, map(tuple, ids)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(words)], pa.binary())], ["words"])


_UNPACKED: dict[int, tuple] = {}


def _told(ids, pieces: dict[int, bytes]) -> tuple[str, bytes]:
    """Ids as decimals joined by spaces, and the bytes they decode to."""
    return " ".join(map(str, ids)), decode_ids(ids, pieces)


def _unpacked(shared: tuple) -> tuple[dict[bytes, tuple[str, bytes]], dict[int, bytes]]:
    """The frequent words, encoded and decoded, and the pieces by id, made once in each worker."""
    if id(shared) not in _UNPACKED:
        _UNPACKED.clear()
        known, pieces = {}, {r: p for p, r in shared[1].items()}
        for words in shared[0]:
            known.update((word, _told(ids, pieces)) for word, ids in pickle.loads(words).items())
        _UNPACKED[id(shared)] = shared, known, pieces
    return _UNPACKED[id(shared)][1:]


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = RANKS,
           pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]).

    Null texts are empty: no tokens, the digests of nothing. Rows come back as often as they are given, also those
    without an id; other columns are ignored; an empty table gives no rows. A character that no text can hold
    (a lone surrogate) is encoded as a question mark.

    The most frequent distinct words are folded once and shipped; what a text holds besides is merged in its row.
    """
    spark, ranks = docs.sparkSession, read_ranks(path)
    coded = _encoded(_frequent(distinct_words(docs, text_column, pattern)), ranks)
    packed = [bytes(r[0]) for r in coded.mapInArrow(_pack_words, "words binary").collect()]
    shared = spark.sparkContext.broadcast((packed, ranks))  # COMMON_WORDS and the vocabulary at most

    def run(batches):
        ranks = shared.value[1]
        known, pieces = _unpacked(shared.value)
        split, held = Splitter(pattern), {}

        def of_word(w):
            raw = w.encode("utf-8", "replace")
            return known.get(raw) or _told(merge_word(raw, ranks, pieces), pieces)

        def coded(words):
            if len(words) == 1:
                return of_word(words[0])
            told = [of_word(w) for w in words]
            return " ".join([t[0] for t in told]), b"".join([t[1] for t in told])

        def later(part):
            # A frequent word that begins with a space is a chunk as it is.
            hit = held[part] = known.get((" " + part).encode("utf-8", "replace")) or coded(split.words_after_space(part))
            return hit

        for batch in small(batches):
            out = [[], [], [], [], []]
            for text in text_of(batch):
                if len(held) > REMEMBERED:
                    held.clear()
                first, others = split.chunks(text)
                hits = [held.get(part) or later(part) for part in others]
                if first:
                    hits.insert(0, coded(split.words(first)))
                ids, decoded = " ".join([h[0] for h in hits]), b"".join([h[1] for h in hits])
                values = (ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(),
                          ids if with_ids else None, decoded if with_ids else None)
                for o, v in zip(out, values):
                    o.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(o, k) for o, k in zip(out, kinds))],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    done = narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids string, decoded binary")
    return done if with_ids else done.drop("ids", "decoded")
