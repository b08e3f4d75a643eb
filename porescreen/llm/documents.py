"""Near-duplicate documents: MinHash over five-word shingles, verified by exact Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porescreen.llm import simhash
from porescreen.llm.common import LOWER, small, text_of
from porescreen.llm.lines import FEW_PAIRS, SIMILARITY, _mixed, alike, sets_of, similar_sets, verified_links
from porescreen.session import cut_lineage

SHINGLE = 5
#: A pair of similarity 0.8 meets in a band with probability 1 - (1 - 0.8^ROWS)^BANDS, 99.998 %.
BANDS, ROWS, SEED = 21, 4, 27
#: Shingle sets that a task remembers, by their hashes together.
HELD_HASHES = 4_000_000


def words_of(text: str) -> list[bytes]:
    """Words as the fingerprints of ``simhash`` have them: A-Z in lower case, separated by white space."""
    return text.encode("utf-8", "replace").translate(LOWER).split()


def key_of(text: str) -> int:
    """64-bit identity of the words of a text as a signed long."""
    h = xxhash.xxh3_64_intdigest(b" ".join(words_of(text)))
    return h - (1 << 64) if h >> 63 else h


def shingle_hashes(text: str) -> np.ndarray:
    """Distinct hashes of the five-word shingles, sorted; a shorter text is one shingle."""
    words = words_of(text)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    codes = np.array([known[w] for w in words], np.uint64)
    rolled = np.zeros(len(codes) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        rolled = _mixed(rolled) + codes[i:len(codes) - SHINGLE + 1 + i]
    return np.unique(_mixed(rolled))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)


def band_hashes(hashes: np.ndarray) -> list[int]:
    """Hashes of the bands of a set of shingles, as signed longs; the number of the band is mixed in."""
    low, bands = (hashes >> np.uint64(32)).astype(np.uint32), np.zeros(BANDS, np.uint64)
    for j, (a, b) in enumerate(zip(*_factors())):
        at = j // ROWS
        bands[at:at + 1] = _mixed(bands[at:at + 1] * np.uint64(31) + np.uint64((low * a + b).min()) + np.uint64(at + 1))
    return bands.view(np.int64).tolist()


def keys(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the key of the words of its text. Null texts are empty texts."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([key_of(t) for t in text_of(batch)], pa.int64())],
                                             ["doc_id", "fp"])

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _banded(batches):
    for batch in small(batches):
        found, bands, seen = [], [], set()
        for text in text_of(batch):
            key = key_of(text)
            if key not in seen:
                seen.add(key)
                found.append(key)
                bands.append(band_hashes(shingle_hashes(text)))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["key", "bands"])


def _keyed_texts(batches):
    for batch in small(batches):
        texts = text_of(batch)
        yield pa.RecordBatch.from_arrays([pa.array([key_of(t) for t in texts], pa.int64()), pa.array(texts, pa.string())], ["key", "line"])


def _similar(batches):
    held, size, last, y = {}, 0, None, None
    for batch in batches:
        found = []
        for a, b, one, other in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "line_a", "line_b"))):
            if b != last:
                last, y = b, shingle_hashes(other)
            x = held.get(a)
            if x is None:
                if size > HELD_HASHES:
                    held.clear()
                    size = 0
                x = held[a] = shingle_hashes(one)
                size += len(x)
            if min(len(x), len(y)) >= SIMILARITY * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both / (len(x) + len(y) - both) >= SIMILARITY:
                    found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def similar_of(left: list[str], right: list[str], asked: np.ndarray | None = None) -> np.ndarray:
    """Matrix that tells which texts of two blocks are similar, at least where it is asked."""
    if asked is not None and np.count_nonzero(asked) <= FEW_PAIRS * (len(left) + len(right)):
        sets, near = [[shingle_hashes(t) for t in texts] for texts in (left, right)], np.zeros(asked.shape, bool)
        for i, j in np.argwhere(asked).tolist():
            near[i, j] = alike(sets[0][i], sets[1][j])
        return near
    sides = []
    for texts in (left, right):
        sets = [shingle_hashes(t) for t in texts]
        starts = np.cumsum([0, *map(len, sets)])[:-1]
        sides.append(sets_of(np.concatenate(sets), starts))
    return similar_sets(*sides)


def similar_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Verified links (a, b) between keys of texts; they connect whatever similar pairs that share a band connect."""
    texts = docs.select(F.col(text_column).alias("text"))
    spots = cut_lineage(texts.mapInArrow(_banded, "key long, bands array<long>")).select(F.explode("bands").alias("band"), "key")

    def wanted_texts(wanted):
        found = texts.mapInArrow(_keyed_texts, "key long, line string").join(wanted, "key", "left_semi")
        return found.groupBy("key").agg(F.min("line").alias("line"))

    return verified_links(spots, wanted_texts, _similar, similar_of)


def kept_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: five-word Jaccard similarity of 0.8 or more, counted exactly.

    Texts of the same words are copies, also those without words. What stays of a group, and rows without an id, are
    as in ``simhash.kept_documents``.
    """
    return simhash.kept_of_groups(docs, lambda d, i: keys(d, i, text_column), lambda fps: similar_documents(docs, text_column),
                                  id_column, text_column)
