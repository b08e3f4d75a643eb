"""Line dedup: MinHash over character shingles, verified by exact Jaccard similarity, one line kept per component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porescreen.llm.common import components, cut_round, gathered_bits, small, text_of
from porescreen.llm.simhash import forest
from porescreen.session import cut_lineage

#: Characters of a shingle and similarity of near-duplicate lines.
SHINGLE, SIMILARITY = 8, 0.8
#: A pair of similarity s meets in a band with probability 1 - (1 - s^ROWS)^BANDS: 99.1 % at 0.8, 99.99 % at 0.9.
BANDS, ROWS, SEED = 9, 4, 20
#: Hashes of shingles that a task remembers, about, before it forgets them all.
HELD_HASHES = 1 << 21
#: Characters that are hashed at once, about: what is computed of them stays in a processor's cache.
HASHED_CHARS = 1 << 16
#: Lines and characters of a block, about, and shingles that two blocks count at once; parameters of speed and memory alone.
BLOCK, BLOCK_CHARS, COLUMNS = 512, 1 << 20, 4096
#: Pairs for each line of two blocks up to which they are compared one by one, which changes no result.
FEW_PAIRS = 4
#: Words of 64 bits of the filter that picks the lines to verify; what passes it wrongly is dropped by the join after it.
FILTER_WORDS = 1 << 20
#: Lines that a task remembers as signed already, before it forgets them all.
REMEMBERED = 1_000_000


def normal(line: str) -> str:
    """What is compared of a line: lower case, single spaces. Lines that are equal in this form are copies."""
    # Characters that part words are not printable, but for the space; most lines have single ones alone.
    if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":
        return line.lower()
    return " ".join(line.lower().split())


def key_of(line: str) -> int:
    """64-bit identity of a normal line as a signed long."""
    h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def lines_of(text: str) -> list[str]:
    return text.split("\n") if text else []


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32) | np.uint32(1), \
        rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of each line, one after the other, and where each line starts.

    A line shorter than a shingle is one shingle, filled up with zeros.
    """
    filled = [line.ljust(SHINGLE, "\0") for line in lines]
    codes = np.frombuffer("".join(filled).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.array([len(f) for f in filled], np.int64)
    # Each step doubles the characters of a hash.
    rolled, factor, width = codes, 0x100000001B3, 1
    while width < SHINGLE:
        rolled, factor, width = rolled[:-width] * np.uint64(factor) + rolled[width:], factor * factor % (1 << 64), 2 * width
    inside = np.ones(len(rolled), bool)
    # Shingles that would reach into the next line.
    inside[(np.cumsum(sizes)[:-1, None] - np.arange(1, SHINGLE)).ravel()] = False
    starts = np.concatenate([[0], np.cumsum(sizes - SHINGLE + 1)[:-1]])
    return _mixed(rolled[inside]), starts


def band_hashes(lines: list[str]) -> np.ndarray:
    """One row per line: the hashes of its bands, as signed longs; the number of the band is mixed in."""
    hashes, starts = shingle_hashes(lines)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    factors, offsets = _multipliers()
    least, held = np.empty((len(lines), BANDS * ROWS), np.uint32), np.empty_like(low)
    for j, (a, b) in enumerate(zip(factors, offsets)):
        np.multiply(low, a, out=held)
        np.add(held, b, out=held)
        least[:, j] = np.minimum.reduceat(held, starts)
    bands, numbers = np.zeros((len(lines), BANDS), np.uint64), np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        bands = _mixed(bands * np.uint64(31) + least[:, row::ROWS].astype(np.uint64) + numbers)
    return bands.view(np.int64)


def _parts(lines: list[str]):
    """The lines in parts of about ``HASHED_CHARS`` characters."""
    at = 0
    while at < len(lines):
        stop, size = at, 0
        while stop < len(lines) and (stop == at or size + len(lines[stop]) <= HASHED_CHARS):
            size += max(SHINGLE, len(lines[stop]))
            stop += 1
        yield lines[at:stop]
        at = stop


def _keys_and_bands(batches):
    signed = set()
    for batch in small(batches):
        keys, fresh, hashes, todo = [], [], [], []
        for text in text_of(batch):
            own, new = [], []
            for line in lines_of(text):
                line = normal(line)
                key = key_of(line) if line else None
                own.append(key)
                if line and key not in signed:
                    if len(signed) > REMEMBERED:
                        signed.clear()
                    signed.add(key)
                    new.append(key)
                    todo.append(line)
            keys.append(own)
            fresh.append(new)
        rows = [band_hashes(part) for part in _parts(todo)]
        flat = np.concatenate(rows).ravel() if rows else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum([len(f) * BANDS for f in fresh])]).astype(np.int32)
        hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, kind), pa.array(fresh, kind), hashes],
                                         ["doc_id", "keys", "fresh", "hashes"])


def line_keys(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, keys, fresh, hashes): the key of every line (null: blank), and the bands of lines new to the task."""
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return narrow.mapInArrow(_keys_and_bands, "doc_id long, keys array<long>, fresh array<long>, hashes array<long>")


def _filter_of(wanted: DataFrame):
    """A broadcast filter of fixed size, which holds the hashes of the only column and few others."""
    (name,) = wanted.columns
    bits = wanted.select(F.shiftrightunsigned(name, 6).bitwiseAND(F.lit(FILTER_WORDS - 1)).alias("word"),
                         F.expr(f"shiftleft(1L, cast({name} & 63 as int))").alias("bits"))
    return wanted.sparkSession.sparkContext.broadcast(gathered_bits(bits, FILTER_WORDS))


def _passing(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of the hashes that a filter holds."""
    return np.nonzero(words[(hashes.view(np.uint64) >> np.uint64(6)).astype(np.int64) & (FILTER_WORDS - 1)] >> (hashes & 63) & 1)[0]


def _shared_spots(keyed: DataFrame, heads: DataFrame) -> DataFrame:
    """(band, key) of the bands of ``heads``. A filter of fixed size drops most others before they are rows."""
    shared = _filter_of(heads.select("band"))

    def run(batches):
        for batch in batches:
            bands, keys = (np.asarray(batch.column(c).flatten()) for c in ("hashes", "fresh"))
            at = _passing(bands, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(bands[at]), pa.array(keys[at // BANDS])], ["band", "key"])

    return keyed.select("fresh", "hashes").mapInArrow(run, "band long, key long")


def _texts(docs: DataFrame, text_column: str, wanted: DataFrame) -> DataFrame:
    """(key, line) of the wanted keys. A filter of fixed size drops most other lines before the shuffle."""
    shared = _filter_of(wanted)

    def run(batches):
        sent = set()
        for batch in small(batches):
            lines = [line for text in text_of(batch) for line in map(normal, lines_of(text)) if line]
            keys = np.array([key_of(line) for line in lines], np.int64)
            out = {}
            for i in _passing(keys, shared.value).tolist():
                key = int(keys[i])
                if key not in sent:
                    if len(sent) > REMEMBERED:
                        sent.clear()
                    sent.add(key)
                    out[key] = lines[i]
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.string())],
                                             ["key", "line"])

    found = docs.select(F.col(text_column).alias("text")).mapInArrow(run, "key long, line string")
    return found.groupBy("key").agg(F.min("line").alias("line")).join(wanted, "key", "left_semi")


def shingles_of(line: str) -> frozenset[str]:
    return frozenset([line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))])


def jaccard(x: frozenset, y: frozenset) -> float:
    """Exact similarity of two sets of character shingles."""
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _hash_sets(lines: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashes of each line's shingles; a line shorter than a shingle has none, as it shares none with others."""
    out = []
    for part in _parts(lines):
        hashes, starts = shingle_hashes(part)
        for line, i, j in zip(part, starts.tolist(), [*starts[1:].tolist(), len(hashes)]):
            own = np.sort(hashes[i:j] if len(line) >= SHINGLE else hashes[:0])
            out.append(own[np.append(own[1:] != own[:-1], True)] if len(own) else own)
    return out


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of hashes, as sorted arrays, are similar, by an exact count; empty sets are like none."""
    # Sets whose sizes differ by more than the similarity allows need no comparison.
    if not len(x) or min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    merged = np.sort(np.concatenate((x, y)))
    both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return both / (len(x) + len(y) - both) >= SIMILARITY


def _similar(batches):
    held, size = {}, 0
    for batch in small(small(batches, "line_a", 1 << 20), "line_b", 1 << 20):
        found = []
        a, b, one, other = (batch.column(c).to_pylist() for c in ("a", "b", "line_a", "line_b"))
        if size > HELD_HASHES:
            held, size = {}, 0
        todo = {key: line for key, line in (*zip(a, one), *zip(b, other)) if key not in held}
        sets = _hash_sets(list(todo.values()))
        held.update(zip(todo, sets))
        size += sum(map(len, sets))
        for i, j in zip(a, b):
            x, y = held[i], held[j]
            if alike(x, y):
                found.append((i, j))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, similar) -> DataFrame:
    """The pairs (a, b) whose lines are similar."""
    pairs = cut_round(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sides = pairs.join(texts.select(F.col("key").alias("a"), F.col("line").alias("line_a")), "a")
    sides = sides.join(texts.select(F.col("key").alias("b"), F.col("line").alias("line_b")), "b")
    return cut_round(sides.mapInArrow(similar, "a long, b long"))


def _sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return sets_of(*shingle_hashes(lines))


def sets_of(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each line, sorted by hash, the line of each, and the number of them in each line."""
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, owner, np.bincount(owner, minlength=len(starts))


def similar_sets(left: tuple, right: tuple) -> np.ndarray:
    """Matrix that tells which sets of two blocks are similar, by exact counts of shared hashes; blocks as from ``_sets``."""
    (x, at_x, size_x), (y, at_y, size_y) = left, right
    shared = np.intersect1d(x, y)
    kept_x, kept_y = np.isin(x, shared), np.isin(y, shared)
    x, at_x, y, at_y = np.searchsorted(shared, x[kept_x]), at_x[kept_x], np.searchsorted(shared, y[kept_y]), at_y[kept_y]
    both = np.zeros((len(size_x), len(size_y)))
    for low in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - low)
        sides = []
        for ids, at, n in ((x, at_x, len(size_x)), (y, at_y, len(size_y))):
            i, j = np.searchsorted(ids, (low, low + width))
            side = np.zeros((n, width), np.float32)
            side[at[i:j], ids[i:j] - low] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    return both / (size_x[:, None] + size_y[None, :] - both) >= SIMILARITY


def similar_of(left: list[str], right: list[str], asked: np.ndarray | None = None) -> np.ndarray:
    """Matrix that tells which lines of two blocks are similar, at least where it is asked.

    Different lines of which one is shorter than a shingle share none.
    """
    if asked is not None and np.count_nonzero(asked) <= FEW_PAIRS * (len(left) + len(right)):
        known = list({*left, *right})
        sets, near = dict(zip(known, _hash_sets(known))), np.zeros(asked.shape, bool)
        for i, j in np.argwhere(asked).tolist():
            near[i, j] = alike(sets[left[i]], sets[right[j]])
        return near
    near = similar_sets(_sets(left), _sets(right))
    near[[len(line) < SHINGLE for line in left]] = False
    near[:, [len(line) < SHINGLE for line in right]] = False
    return near


def _crossing(compare):
    def run(batches):
        for batch in batches:
            found, blocks = [], batch.column("blocks")
            members = blocks.flatten().field("members")
            rows = members.flatten()
            roots, lines = np.asarray(rows.field("root")), rows.field("line")
            sides = pc.list_value_length(blocks).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(members).to_numpy(zero_copy_only=False), dtype=np.int64)
            spans = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
            for stop, n in zip(np.cumsum(sides).tolist(), sides.tolist()):  # one block with itself, or two
                (i, j), (k, m) = spans[stop - n], spans[stop - 1]
                apart = roots[i:j, None] != roots[None, k:m]
                if n == 1:
                    apart = np.triu(apart)
                if apart.any():
                    left, right = lines.slice(i, j - i).to_pylist(), lines.slice(k, m - k).to_pylist()
                    near = compare(left, right, apart) & apart
                    if near.any():
                        found += [(int(roots[i + x]), int(roots[k + y])) for x, y in forest(near)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])
    return run


def _crossing_links(placed: DataFrame, texts: DataFrame, compare) -> DataFrame:
    """Links between the roots of different components with similar members in a band, (band, key, root, chars) given.

    In each band the members outside its largest component are compared with all members of other components: both
    are dealt to blocks, and each pair of blocks is one row with a key of its own. Its links are a spanning forest.
    """
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    top = F.max_by(F.struct("root", "n", "chars"), F.struct("n", "root")).alias("top")
    sizes = sizes.groupBy("band").agg(top, F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.count("*").alias("roots"))

    def blocks(n, chars):
        return F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(chars / F.lit(BLOCK_CHARS)), F.lit(1)).cast("long")

    mixed = cut_round(sizes.where("roots > 1").select(
        "band", F.col("top.root").alias("top"), blocks(F.col("n") - F.col("top.n"), F.col("chars") - F.col("top.chars")).alias("p"),
        blocks(F.col("top.n"), F.col("top.chars")).alias("q")))
    salt = F.xxhash64("key")
    dealt = cut_round(placed.join(mixed, "band").select(
        "band", "key", "root", "p", "q", F.when(F.col("root") == F.col("top"), F.col("p") + F.pmod(salt, "q"))
        .otherwise(F.pmod(salt, "p")).alias("block")))
    held = dealt.join(texts, "key").groupBy("band", "block", "p", "q").agg(F.collect_list(F.struct("key", "root", "line")).alias("members"))
    # A block outside the largest component meets all blocks, one inside only those outside.
    met = F.expr("sequence(0L, IF(block < p, p + q, p) - 1)")
    pairs = held.select("band", "block", "members", F.explode(met).alias("other"))
    pairs = pairs.groupBy("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).agg(
        F.collect_list(F.struct("members")).alias("blocks"), F.count("*").alias("sides"))
    # A number to which no member was dealt leaves the other block of the pair alone.
    pairs = pairs.where("sides = 2 or low = high").select("blocks")
    return cut_round(pairs.mapInArrow(_crossing(compare), "a long, b long"))


def similar_lines(docs: DataFrame, keyed: DataFrame, text_column: str = "text") -> DataFrame:
    """(a, b): the key of each line that resembles others, and the least key of its component; links are between lines
    that share a band."""
    spots = keyed.select("fresh", F.posexplode("hashes").alias("pos", "band")).select(
        "band", F.get("fresh", (F.col("pos") / BANDS).cast("int")).alias("key"))
    return verified_links(spots, lambda wanted: _texts(docs, text_column, wanted), _similar, similar_of,
                          lambda heads: _shared_spots(keyed, heads))


def verified_links(spots: DataFrame, texts_of, similar, compare, spots_of=None) -> DataFrame:
    """``verified_roots`` as links (a, b) of each key to the least one of its component."""
    return verified_roots(spots, texts_of, similar, compare, spots_of).toDF("a", "b")


def verified_roots(spots: DataFrame, texts_of, similar, compare, spots_of=None) -> DataFrame:
    """(node, root): the least key that each other key of (band, key) is connected to by similar pairs that share a band.

    The members of a band are compared with its least key. What is connected then needs no comparison; all other pairs
    of a band without this key are compared, in blocks, so a group of copies takes one comparison each. ``texts_of`` gives
    (key, line) of the wanted keys, ``similar`` filters rows of pairs with their lines, ``compare`` gives the matrix of two
    blocks. ``spots_of``, if given, has all rows of ``spots`` with the bands of (band, head), and may have others.
    """
    heads = cut_round(spots.groupBy("band").agg(F.min("key").alias("head"), F.max("key").alias("other"))
                      .where("head <> other").select("band", "head"))
    met = spots_of(heads) if spots_of else spots
    members = cut_round(met.join(heads, "band").select("band", "head", "key").distinct())
    texts = cut_lineage(texts_of(cut_round(members.select("key").distinct())))
    links = _verified(members.where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b")), texts, similar)
    roots = cut_round(components(links).withColumnRenamed("node", "key"))
    lengths = texts.select("key", F.length("line").cast("long").alias("chars"))
    # All pairs with a least key were compared above, so most bands, which have two members, are done.
    placed = cut_round(members.where("key <> head").join(roots, "key", "left").join(lengths, "key").select(
        "band", "key", F.coalesce("root", "key").alias("root"), "chars"))
    # The second search runs between the components of the first, so it has only what is new.
    above = cut_round(components(_crossing_links(placed, texts, compare)))
    lifted = roots.join(above.toDF("root", "top"), "root", "left").select(F.col("key").alias("node"), F.coalesce("top", "root").alias("root"))
    return cut_round(lifted.unionAll(above))


def decisions(docs: DataFrame, keyed: DataFrame, text_column: str = "text") -> DataFrame:
    """(doc_id, found): for each document the lines that occur elsewhere too, as (key, root, own).

    root is the component of the line; own tells whether this is the document that keeps it, the one with the least
    id among those that hold a line of the component (null only if no other has an id).
    """
    once = keyed.select("doc_id", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("key"))
    roots = similar_lines(docs, keyed, text_column).toDF("key", "root")
    roots = roots.unionAll(roots.select(F.col("root").alias("key"), "root").distinct())
    held = once.groupBy("key").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"))
    # Lines of one document that resemble no other need no decision.
    rooted = cut_lineage(held.join(roots, "key", "left").where("n > 1 or root is not null").select(
        "key", "owner", "n", F.coalesce("root", "key").alias("root")))
    owners = cut_lineage(rooted.groupBy("root").agg(F.min("owner").alias("owner"), F.sum("n").alias("n")).where("n > 1"))
    chosen = cut_lineage(rooted.select("key", "root").join(owners, "root").select("key", "root", "owner"))
    return once.join(chosen, "key").groupBy("doc_id").agg(
        F.collect_list(F.struct("key", "root", F.col("doc_id").eqNullSafe(F.col("owner")).alias("own"))).alias("found"))


def kept_lines(keys: list[int | None], found: list | None) -> list[int]:
    """Numbers of the lines of a document that stay: blank ones, lone ones, and the first of each own component."""
    known = {f["key"]: (f["root"], f["own"]) for f in found or ()}
    kept, seen = [], set()
    for i, key in enumerate(keys):
        root, own = known.get(key, (key, True))
        if key is None or (own and root not in seen):
            kept.append(i)
            seen.add(root)
    return kept


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_kept, kept) of every row of ``docs``; kept are the numbers of the lines that stay, from 0.

    Lines are what line feeds separate; an empty or null text has none. Lines that are copies but for case and white
    space, or whose shingles are similar, are linked; of each component of links one line stays, the first in the
    document with the least id. Blank lines always stay. Repeated rows count as one document, so each keeps what the
    document keeps; so do rows without an id together, which keep only lines that no document with an id has. Other
    columns are ignored; an empty table gives no rows. Lines are told apart by a hash of 64 bits.
    """
    keyed = cut_lineage(line_keys(docs, id_column, text_column))
    found = decisions(docs, keyed, text_column)
    own = keyed.select("doc_id", "keys")
    joined = own.join(found.withColumnRenamed("doc_id", "at"), own["doc_id"].eqNullSafe(F.col("at")), "left")

    def run(batches):
        for batch in batches:
            keys = batch.column("keys").to_pylist()
            kept = [kept_lines(k, f) for k, f in zip(keys, batch.column("found").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(k) for k in keys], pa.int64()),
                 pa.array([len(k) for k in kept], pa.int64()), pa.array(kept, pa.list_(pa.int32()))],
                ["doc_id", "n_lines", "n_kept", "kept"])

    return joined.select("doc_id", "keys", "found").mapInArrow(run, "doc_id long, n_lines long, n_kept long, kept array<int>")


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the lines that ``scan`` removes taken out of their texts; rows and other columns stay as they are."""
    keyed = cut_lineage(line_keys(docs, id_column, text_column))
    found = decisions(docs, keyed, text_column).select(F.col("doc_id").alias("__at"), F.col("found").alias("__found"))
    joined = docs.join(found, F.col(id_column).cast("long").eqNullSafe(F.col("__at")), "left").drop("__at")

    def run(batches):
        for batch in small(batches, text_column):
            texts = []
            for text, decided in zip(batch.column(text_column).to_pylist(), batch.column("__found").to_pylist()):
                if decided:
                    lines = lines_of(text or "")
                    keys = [key_of(n) if n else None for n in map(normal, lines)]
                    text = "\n".join(lines[i] for i in kept_lines(keys, decided))
                texts.append(text)
            at = batch.schema.get_field_index(text_column)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            keep = [i for i, n in enumerate(batch.schema.names) if n != "__found"]
            yield pa.RecordBatch.from_arrays([columns[i] for i in keep], [batch.schema.names[i] for i in keep])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(run, kinds)
