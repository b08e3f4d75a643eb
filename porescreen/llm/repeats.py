"""Removal of long repeated byte strings across documents, by anchors and suffix ranks."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porescreen.llm.common import gathered_bits, small
from porescreen.session import cut_lineage

#: Bytes of a repeated string, and of the gram by which its copies find each other.
LENGTH, GRAM = 50, 20
#: Starts of a gram within a string of LENGTH, and bytes that such strings reach beyond a gram on each side.
WINDOW, REACH = LENGTH - GRAM + 1, LENGTH - GRAM
CONTEXT = 2 * REACH + GRAM
#: Bytes of text per shuffle partition, about, and documents that come together again at the end, about.
PARTITION_BYTES, CHUNK = 24 << 20, 256
#: Bytes of text whose anchors a task computes at once.
SLICE = 1 << 20
#: Places whose hashes are computed together, so that they stay in the cache of a core.
BLOCK = 1 << 14
#: Contexts that are compared together, about; those of one gram always are.
SHARD = 8192
#: Words of 64 bits of the filter that picks contexts to read; wrong hits only cost time.
FILTER_WORDS = 1 << 21
#: Stands for what lies outside a document; no UTF-8 text holds it.
OUTSIDE = 0xFF


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    eight = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    four = np.ndarray((len(data) - 3,), "<u4", data.tobytes(), strides=(1,))
    out = np.empty(max(n, 0), np.uint64)
    for i in range(0, n, BLOCK):
        j = min(i + BLOCK, n)
        h = _mixed(eight[i:j] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        h = _mixed(h + eight[i + 8:j + 8])
        out[i:j] = _mixed(h + four[i + 16:j + 16].astype(np.uint64))
    return out


def _sliding(x: np.ndarray, best: np.ufunc) -> np.ndarray:
    """The best of WINDOW values from each place on (of fewer at the end), by doubling."""
    out, span = x.copy(), 1
    while span * 2 <= WINDOW:
        out[:-span] = best(out[:-span], out[span:])
        span *= 2
    rest = WINDOW - span
    if rest:
        out[:-rest] = best(out[:-rest], out[rest:])
    return out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(document number, place, gram hash of 48 bits, context hash) of the anchors, and the padded bytes.

    Of the grams of every string of LENGTH bytes those of least hash are its anchors, so equal strings have the same. The context is what all strings that hold the gram can reach; what is outside the text counts.
    """
    pad = bytes([OUTSIDE]) * REACH
    whole = pad + b"".join(t + pad for t in texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = REACH + np.concatenate([[0], np.cumsum(sizes + REACH)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    none = np.zeros(0, np.int64)
    if not (sizes >= LENGTH).any():
        return none, none, none.view(np.uint64), none.view(np.uint64), whole
    data = np.frombuffer(whole, np.uint8)
    h = _gram_hashes(data)
    delta = np.zeros(len(h) + 1, np.int32)
    long = sizes >= LENGTH
    np.add.at(delta, starts[long], 1)
    np.add.at(delta, starts[long] + sizes[long] - LENGTH + 1, -1)
    valid = np.cumsum(delta[:-1]) > 0  # where a string inside a document starts
    rank = (h >> np.uint64(32)).astype(np.uint32)
    least = _sliding(rank, np.minimum)
    # A gram is an anchor if it has the least hash, by its first half, of some string that holds it.
    most = _sliding(np.where(valid, least, np.uint32(0))[::-1], np.maximum)[::-1]
    at = np.nonzero((most == rank) & (rank > 0))[0]
    owner = np.searchsorted(starts, at, side="right") - 1
    context = np.zeros(len(at), np.uint64)
    for shift in range(-REACH, REACH + 1, GRAM // 2):
        context = _mixed(context * np.uint64(31) + h[np.minimum(at + shift, len(h) - 1)] + np.uint64(shift + 99))
    return owner, at - starts[owner], h[at] >> np.uint64(16), context, whole


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(rid, doc, bytes) of every row; what happens to a row follows from its id and text, whose hash is ``rid``."""
    doc, text = F.col(id_column).cast("long"), F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.xxhash64(doc, text).alias("rid"), F.coalesce(doc, F.lit((1 << 63) - 1)).alias("doc"),
                       F.encode(text, "utf-8").alias("bytes"))


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each number, all first bytes first: what is small or sorted then shrinks in a shuffle."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _numbers(raw: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").ravel()


def _blobs(parts: int):
    """Anchors as packed rows, one for each batch and partition, in the order of the texts."""
    def run(batches):
        for batch in small(batches, "bytes", SLICE):
            texts = batch.column("bytes").to_pylist()
            rid, doc = (np.asarray(batch.column(c)) for c in ("rid", "doc"))
            owner, place, h, context, _ = anchors(texts)
            part = (h >> np.uint64(8)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            present, cuts = np.unique(part[order], return_index=True)
            rows = []
            for p, i in zip(present.tolist(), np.split(order, cuts[1:])):
                used, number = np.unique(owner[i], return_inverse=True)
                sizes = np.bincount(number)
                rows.append((p, _planes(h[i], 6), context[i].tobytes(), _planes(sizes, 4), _planes(place[i], 4),
                             rid[used].tobytes(), _planes(doc[used], 8)))
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                                             ["part", "h", "context", "sizes", "place", "rids", "docs"])
    return run


def _joined(pdf: pd.DataFrame):
    """The packed anchors of a partition as arrays."""
    h = np.concatenate([_numbers(x, 6) for x in pdf["h"]])
    context = np.frombuffer(b"".join(pdf["context"]), np.uint64)
    place = np.concatenate([_numbers(x, 4) for x in pdf["place"]]).astype(np.int64)
    sizes = np.concatenate([_numbers(x, 4) for x in pdf["sizes"]]).astype(np.int64)
    rid = np.repeat(np.frombuffer(b"".join(pdf["rids"]), np.int64), sizes)
    doc = np.repeat(np.concatenate([_numbers(x, 8) for x in pdf["docs"]]).view(np.int64), sizes)
    return h, context, place, rid, doc


def _pack(chunks: int, rid: np.ndarray, place: np.ndarray) -> list[tuple]:
    """Rows (chunk, rids, sizes, places): the places of each document of a chunk."""
    order = np.lexsort((place, rid, rid % chunks))
    rid, place = rid[order], place[order]
    chunk = rid % chunks
    present, cuts = np.unique(chunk, return_index=True)
    out = []
    for c, r, p in zip(present.tolist(), np.split(rid, cuts[1:]), np.split(place, cuts[1:])):
        used, first = np.unique(r, return_index=True)
        out.append((c, used.tobytes(), _planes(np.diff(np.append(first, len(r))), 3), _planes(p, 4)))
    return out


def _asks(h: np.ndarray, context: np.ndarray, rid: np.ndarray) -> np.ndarray:
    """Hash by which an anchor is asked for."""
    return _mixed(_mixed(h + context * np.uint64(3)) + rid.astype(np.int64).view(np.uint64))


def _judge(pdf: pd.DataFrame, chunks: int) -> pd.DataFrame:
    """Whole contexts that repeat are decided here; grams with several contexts are passed on.

    Rows: (chunk, rids, sizes, places) of contexts that stand in a smaller document too, and (asked): the anchors in
    the smallest document of each context, of those grams of which another context stands in a smaller document.
    """
    h, context, place, rid, doc = _joined(pdf)
    order = np.lexsort((doc, context, h))
    sh, sc, sd, sr = h[order], context[order], doc[order], rid[order]
    new_gram = np.concatenate([[True], sh[1:] != sh[:-1]])
    new_context = new_gram | np.concatenate([[True], sc[1:] != sc[:-1]])
    first = sd[new_context]  # the smallest document of each context
    later = sd > first[np.cumsum(new_context) - 1]
    rows = [(*r, b"") for r in _pack(chunks, rid[order[later]], place[order[later]])]
    grams = np.nonzero(new_gram[new_context])[0]
    spread = np.maximum.reduceat(first, grams) > np.minimum.reduceat(first, grams)
    asked = ~later & spread[np.cumsum(new_gram) - 1]
    rows.append((None, b"", b"", b"", _asks(sh[asked], sc[asked], sr[asked]).tobytes()))
    return pd.DataFrame(rows, columns=["chunk", "rids", "sizes", "places", "asked"]).astype({"chunk": "Int64"})


def _sorted_prefixes(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and for each but the first in it how many bytes it shares with the one before."""
    n, size = texts.shape
    words = np.zeros((n, -(-size // 8) * 8), np.uint8)
    words[:, :size] = texts
    order = np.lexsort(words.view(">u8").astype(np.uint64).T[::-1])
    differ = texts[order[1:]] != texts[order[:-1]]
    return order, np.where(differ.any(axis=1), differ.argmax(axis=1), size)


def _classes(order: np.ndarray, shared: np.ndarray, size: int) -> np.ndarray:
    """For each row a number that is equal exactly where the first ``size`` bytes are."""
    out = np.zeros(len(order), np.int64)
    out[order[1:]] = np.cumsum(shared < size)
    return out


def _mark(pdf: pd.DataFrame, chunks: int) -> pd.DataFrame:
    """Which strings of each context start in a smaller document too: rows (chunk, rids, sizes, places of starts).

    Equal strings have the same anchor, so they stand in the same column of contexts of one gram, and are equal where gram and
    right side agree so far as the string reaches, and the left side, read backwards, does. Both are sorted once, with the
    bytes that neighbours share; the ranks of all lengths follow from these."""
    data = np.frombuffer(b"".join(pdf["context"]), np.uint8).reshape(len(pdf), CONTEXT)
    doc, rid, place = (pdf[c].to_numpy() for c in ("doc", "rid", "place"))
    right, left = _sorted_prefixes(data[:, REACH:]), _sorted_prefixes(data[:, REACH - 1::-1])
    outside = np.zeros((CONTEXT + 1, len(pdf)), np.uint8)
    np.cumsum((data == OUTSIDE).T, axis=0, out=outside[1:])
    rows, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for column in range(REACH + 1):
        inside = np.flatnonzero(outside[column + LENGTH] == outside[column])
        if len(inside) < 2:
            continue
        found = (_classes(*left, REACH - column) * len(pdf) + _classes(*right, GRAM + column))[inside]
        order = np.argsort(found)
        new = np.append(True, found[order][1:] != found[order][:-1])
        at = inside[order]
        least = np.minimum.reduceat(doc[at], np.flatnonzero(new))[np.cumsum(new) - 1]
        rows.append(at[least < doc[at]])
        starts.append(place[rows[-1]] - REACH + column)
    packed = _pack(chunks, rid[np.concatenate(rows)], np.concatenate(starts))
    return pd.DataFrame(packed, columns=["chunk", "rids", "sizes", "places"])


def _spot(asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of a hash in the filter."""
    return ((asks >> np.uint64(6)) & np.uint64(FILTER_WORDS - 1)).astype(np.int64), asks & np.uint64(63)


def _bits(asked: DataFrame) -> np.ndarray:
    """A filter of what is asked for, of fixed size whatever its number."""
    def run(batches):
        for batch in batches:
            words = np.zeros(FILTER_WORDS, np.uint64)
            for blob in batch.column("asked").to_pylist():
                word, bit = _spot(np.frombuffer(blob, np.uint64))
                np.bitwise_or.at(words, word, np.uint64(1) << bit)
            at = np.nonzero(words)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], ["word", "bits"])

    return gathered_bits(asked.mapInArrow(run, "word long, bits long"), FILTER_WORDS).view(np.uint64)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of ``docs``.

    Each byte of the UTF-8 text that is covered by a string of 50 bytes which also starts in a document with a smaller
    id is removed, judged on the input. Null texts are empty. A document without an id comes after all others; rows
    that share an id are one document in this sense and do not remove each other's bytes. Other columns are ignored;
    an empty table gives no rows. Rows are told apart by a hash of 64 bits of id and text.

    Anchors (see ``anchors``) meet by the hash of their gram. A context that repeats as a whole is decided by its
    smallest document; where a gram has several contexts, one copy of each is read again and its strings are compared
    by ranks of sorted sides (see ``_mark``). The intervals then come together with the texts, a chunk of documents at a time.
    """
    rows = _rows(docs, id_column, text_column)
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length(text_column))).first()
    parts, chunks = max(1, -(-(size or 0) // PARTITION_BYTES)), max(1, -(-count // CHUNK))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        return _judge(pdf, chunks)

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        return _mark(pdf, chunks)

    packed = rows.mapInArrow(_blobs(parts), "part int, h binary, context binary, sizes binary, place binary, rids binary, docs binary")
    judged = cut_lineage(packed.groupBy("part").applyInPandas(
        judge, "chunk long, rids binary, sizes binary, places binary, asked binary"))
    asked = judged.where("chunk is null").select("asked")
    shared = docs.sparkSession.sparkContext.broadcast(_bits(asked))

    def contexts(batches):
        for batch in small(batches, "bytes", SLICE):
            texts = batch.column("bytes").to_pylist()
            owner, place, h, context, whole = anchors(texts)
            rid, doc = (np.asarray(batch.column(c)) for c in ("rid", "doc"))
            word, bit = _spot(_asks(h, context, rid[owner]))
            hit = np.nonzero(shared.value[word] >> bit & np.uint64(1))[0]
            owner, place = owner[hit], place[hit]
            sizes = np.array([len(t) for t in texts], np.int64)
            starts = REACH + np.concatenate([[0], np.cumsum(sizes + REACH)[:-1]])
            at = starts[owner] + place - REACH
            yield pa.RecordBatch.from_arrays(
                [pa.array([whole[a:a + CONTEXT] for a in at.tolist()], pa.binary()),
                 pa.array(doc[owner]), pa.array(rid[owner]), pa.array(place.astype(np.int64))], ["context", "doc", "rid", "place"])

    number = asked.agg(F.sum(F.octet_length("asked") / 8)).first()[0] or 0
    shards = max(1, -(-int(number) // SHARD))
    read = rows.mapInArrow(contexts, "context binary, doc long, rid long, place long")
    gram = F.substring("context", REACH + 1, GRAM)
    marked = read.groupBy(F.pmod(F.xxhash64(gram), F.lit(shards)).alias("shard")).applyInPandas(
        mark, "chunk long, rids binary, sizes binary, places binary")
    removed = judged.where("chunk is not null").select("chunk", F.lit(0).alias("kind"), "rids", "sizes", "places").unionAll(
        marked.select("chunk", F.lit(1).alias("kind"), "rids", "sizes", "places"))
    chunked = rows.withColumn("chunk", F.pmod("rid", F.lit(chunks)))

    def apply(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rid, rows_, inverse = np.unique(texts["rid"].to_numpy(), return_index=True, return_inverse=True)
        sizes = np.array([len(texts["bytes"].iloc[r]) for r in rows_], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        delta = np.zeros(at[-1] + 1, np.int64)
        for kind, rids, counts, places in zip(found["kind"], found["rids"], found["sizes"], found["places"]):
            i = np.repeat(np.searchsorted(rid, np.frombuffer(rids, np.int64)), _numbers(counts, 3).astype(np.int64))
            place = _numbers(places, 4).astype(np.int64)
            low = np.maximum(place - REACH, 0) if kind == 0 else place
            high = np.minimum(place + GRAM + REACH, sizes[i]) if kind == 0 else place + LENGTH
            np.add.at(delta, at[i] + low, 1)
            np.add.at(delta, at[i] + high, -1)
        gone = np.cumsum(delta) > 0
        out = []
        for k, doc, raw in zip(inverse.tolist(), texts["doc"].tolist(), texts["bytes"]):
            mask = gone[at[k]:at[k] + sizes[k]]
            spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
            kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
            out.append((doc if doc < (1 << 63) - 1 else None, len(raw), int(mask.sum()), spans,
                        hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        return frame.astype({"doc_id": "Int64"})

    done = chunked.groupBy("chunk").cogroup(removed.groupBy("chunk")).applyInPandas(
        apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if with_text else done.drop("kept")
