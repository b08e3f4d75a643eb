"""Language identification: interpolated Kneser-Ney models of characters, one per language, in sorted hash arrays.

Counts are taken over all documents to learn from, in Spark: the grams of order four, and from them the continuation counts
of the orders below. All grams and languages stay. Models of up to ``MODEL_ENTRIES`` grams are shipped to the tasks; larger ones
stay in Spark, where the grams of the texts are joined to them.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from porescreen.llm.common import small, text_of
from porescreen.session import cut_lineage

ORDER = 4
#: Grams of all models together and languages up to which models are shipped; beyond, texts are joined to them (``Joined``).
MODEL_ENTRIES, MOST_LANGUAGES = 1 << 21, 512
#: One of so many documents to learn from is kept for the calibration, which is fitted on all of these.
CALIBRATION_SHARE = 16
#: Intervals of the distance by which calibration rows are counted, a unit, and digits of the entropies that cutoffs are taken of.
DISTANCE_BINS, NATS_DIGITS = 1000, 4
#: Characters that are looked at together; a longer text is read in pieces, each of which begins like a text.
PIECE = 1 << 20
#: Grams that a task counts before it hands them on, and grams whose probabilities it remembers.
REMEMBERED = 300_000
FOLDS = 5
UNDETERMINED = "und"
#: Share of a language's own texts that its cutoff of cross-entropy keeps.
KEPT_SHARE = 0.995
#: Odd multipliers of the symbols of a gram from its end, and one number per order.
_TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_PLUS = np.array([0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], np.uint64)
_CLASSES: list[np.ndarray] = []


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each code point (letters and marks are themselves, all else is a space), and which are letters."""
    if not _CLASSES:
        kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
        letters = kinds == "L"
        _CLASSES[:] = np.where(letters | (kinds == "M"), np.arange(0x110000), 32).astype(np.uint32), letters
    return _CLASSES[0], _CLASSES[1]


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, owner, letters): the last ORDER symbols at each place of the texts, the text of each, letters per text.

    A run of characters that are no letters is one space; a text begins with ORDER - 1 zeros."""
    symbols, is_letter = _classes()
    lowered = [t.lower() for t in texts]
    flat = np.frombuffer("".join(["\0\0\0" + t for t in lowered]).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + ORDER - 1 for t in lowered])
    letters = np.bincount(owner, is_letter[flat], len(texts))
    starts = np.cumsum([0, *(len(t) + ORDER - 1 for t in lowered)])[:-1]
    flat = symbols[flat]
    for k in range(ORDER - 1):
        flat[starts + k] = 0
    space = (flat == 32)
    keep = np.ones(len(flat), bool)
    keep[1:] = ~(space[1:] & (space[:-1] | (flat[:-1] == 0)))
    flat, owner = flat[keep], owner[keep]
    grams = np.lib.stride_tricks.sliding_window_view(flat, ORDER) if len(flat) >= ORDER else np.zeros((0, ORDER), np.uint32)
    real = grams[:, -1] != 0
    return grams[real], owner[ORDER - 1:][real], letters


def keys_of(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of the grams of one length (rows of symbols); no symbols have a hash too."""
    n = grams.shape[1]
    out = np.full(len(grams), _PLUS[n])
    for j in range(n):
        out += grams[:, n - 1 - j].astype(np.uint64) * _TIMES[j]
    return out ^ (out >> np.uint64(29))


def _pieces(batches, *columns: str):
    """(texts, rows, batch): pieces of texts up to PIECE characters in all, with the row of each; batches stay small."""
    for batch in small(batches, most=PIECE):
        texts, rows = [], []
        for k, text in enumerate(text_of(batch)):
            for at in range(0, max(len(text), 1), PIECE):
                texts.append(text[at:at + PIECE])
                rows.append(k)
        yield texts, np.array(rows, int), batch


def _groups(texts: list[str], rows: np.ndarray):
    """Pieces in groups of about PIECE characters."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= PIECE):
            size += len(texts[stop])
            stop += 1
        yield texts[at:stop], rows[at:stop]
        at = stop


def count_grams(learned: DataFrame) -> DataFrame:
    """(lang, gram, n) of the grams of ORDER symbols of all texts (text, lang); counted in each task before the shuffle."""
    def run(batches):
        held = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()),
                                              pa.array(list(held.values()), pa.int64())], ["lang", "gram", "n"])
            held.clear()
            return out

        for texts, at, batch in _pieces(batches):
            names = batch.column("lang").to_pylist()
            for some, own in _groups(texts, at):
                kinds = sorted({names[k] for k in own})
                code = {name: k for k, name in enumerate(kinds)}
                grams, owner, _ = grams_of(some)
                lang = np.array([code[names[k]] for k in own], np.uint64)[owner]
                _, first, n = np.unique(keys_of(grams) + lang * _TIMES[0], return_index=True, return_counts=True)
                spelled = np.ascontiguousarray(grams[first]).tobytes().decode("utf-32-le")
                for k, (c, m) in enumerate(zip(lang[first].tolist(), n.tolist())):
                    held[kinds[c], spelled[ORDER * k:ORDER * k + ORDER]] += m
            if len(held) > REMEMBERED:
                yield rows()
        yield rows()

    counted = learned.select("text", "lang").mapInArrow(run, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _entries(grams: DataFrame, order: int) -> DataFrame:
    """(lang, is_context, gram, value): discounted shares of the grams of an order after their context, and, with
    ``is_context``, the share that each context leaves to the order below."""
    cuts = grams.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
    cuts = cuts.withColumn("discount", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5))
    cuts = cuts.withColumn("discount", F.least("discount", F.lit(0.95)))
    context = F.substring("gram", 1, order - 1)
    # The grams after a context are as many as there are symbols at most.
    known = grams.withColumn("context", context).withColumn("total", F.sum("n").over(W.partitionBy("lang", "context")))
    kept = known.join(cuts, "lang").select("lang", "gram", "context", ((F.col("n") - F.col("discount")) / F.col("total")).alias("value"))
    left = kept.groupBy("lang", "context").agg((1 - F.sum("value")).alias("value"))
    return (kept.select("lang", F.lit(False).alias("is_context"), "gram", "value")
            .unionAll(left.select("lang", F.lit(True), F.col("context"), "value")))


def _packed(batches):
    """Entries as arrays of hashes and values, a row per language and kind."""
    for batch in batches:
        lang, kind = batch.column("lang").to_pylist(), batch.column("is_context").to_pylist()
        gram, value = batch.column("gram").to_pylist(), np.asarray(batch.column("value"))
        by = {}
        for k, x in enumerate(zip(lang, kind, map(len, gram))):
            by.setdefault(x, []).append(k)
        for (name, context, n), rows in by.items():
            symbols = np.frombuffer("".join([gram[k] for k in rows]).encode("utf-32-le"), np.uint32).reshape(len(rows), n)
            yield pa.RecordBatch.from_pydict({"lang": [name], "is_context": [context], "keys": [keys_of(symbols).tobytes()],
                                              "shares": [value[rows].astype(np.float64).tobytes()]})


@dataclass
class Models:
    """Per language the sorted hashes of grams and contexts with their shares; how sure a distance makes; cutoffs."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    n_symbols: int
    slope: float = 1.0
    offset: float = 0.0
    cutoffs: dict[str, float] = field(default_factory=dict)

    @property
    def entries(self) -> int:
        return sum(len(k) for k, _ in self.grams)

    def log_shares(self, grams: np.ndarray) -> np.ndarray:
        """Log probabilities (language, gram) of the last symbol of each gram after the others."""
        out = np.empty((len(self.languages), len(grams)))
        keys = [keys_of(grams[:, ORDER - n:]) for n in range(1, ORDER + 1)]
        before = [keys_of(grams[:, ORDER - n:ORDER - 1]) for n in range(1, ORDER + 1)]
        for k in range(len(self.languages)):
            p = np.full(len(grams), 1.0 / self.n_symbols)
            for own, context in zip(keys, before):
                p = _find(self.grams[k], own, 0.0) + _find(self.contexts[k], context, 1.0) * p
            out[k] = np.log(np.maximum(p, 1e-300))
        return out


@dataclass
class Joined:
    """Models that are too large to be shipped: entries (lang, is_context, gram, value), languages (lang), cutoffs (lang, cutoff)."""

    entries: DataFrame
    languages: DataFrame
    n_symbols: int
    slope: float = 1.0
    offset: float = 0.0
    cutoffs: DataFrame | None = None

    def log_shares(self, grams: DataFrame) -> DataFrame:
        """(gram, lang, log): log probabilities of the last symbol of each gram (of ORDER symbols) after the others."""
        out = grams.select("gram").distinct().crossJoin(self.languages).withColumn("p", F.lit(1.0 / self.n_symbols))
        for n in range(1, ORDER + 1):
            for context, length in ((False, n), (True, n - 1)):
                some = self.entries.where((F.col("is_context") == context) & (F.length("gram") == length)).select(
                    "lang", F.col("gram").alias("part"), F.col("value").alias("left" if context else "own"))
                out = out.withColumn("part", F.substring("gram", ORDER + 1 - n, length)).join(some, ["lang", "part"], "left").drop("part")
            out = out.withColumn("p", F.coalesce("own", F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * F.col("p")).drop("own", "left")
        return out.select("gram", "lang", F.log(F.greatest("p", F.lit(1e-300))).alias("log"))


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    known, values = table
    if not len(known):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], missing)


def learn(learned: DataFrame) -> Models | Joined:
    """The models of the texts (text, lang), not calibrated yet."""
    named = cut_lineage(learned.select("lang").distinct())
    languages = sorted(r["lang"] for r in named.limit(MOST_LANGUAGES + 1).collect())  # all, if they are shipped
    if not languages:
        return Models([], [], [], 1)
    grams = cut_lineage(count_grams(learned))
    entries, symbols = None, 0
    for order in range(ORDER, 0, -1):
        some = _entries(grams, order)
        entries = some if entries is None else entries.unionAll(some)
        if order > 1:  # in how many ways a shorter gram is continued to the left
            grams = cut_lineage(grams.groupBy("lang", F.substring("gram", 2, order - 1).alias("gram")).agg(F.count("*").alias("n")))
        else:
            symbols = grams.agg(F.count_distinct("gram")).first()[0]
    entries = cut_lineage(entries)
    if len(languages) > MOST_LANGUAGES or entries.where("NOT is_context").count() > MODEL_ENTRIES:
        return Joined(entries, named, symbols + 1)
    found = {}
    for row in entries.mapInArrow(_packed, "lang string, is_context boolean, keys binary, shares binary").collect():
        found.setdefault((row["lang"], row["is_context"]), []).append(
            (np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["shares"], np.float64)))

    def table(name, context):
        parts = found.get((name, context), [])
        keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        return keys[order], (np.concatenate([v for _, v in parts]) if parts else np.zeros(0))[order]

    return Models(languages, [table(x, False) for x in languages], [table(x, True) for x in languages], symbols + 1)


def entropies(docs: DataFrame, models: Models | Joined, columns: list[str]) -> DataFrame:
    """``columns`` and (best, nats, second, n_symbols): the language of least cross-entropy per symbol, its nats, those of
    the next one (null if there is none), and how many symbols; all null for a text without letters."""
    if isinstance(models, Joined):
        return _joined_entropies(docs, models, columns)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # MODEL_ENTRIES at most
    schema = docs.select(*columns).schema

    def run(batches):
        models = shared.value
        keys, shares = np.zeros(0, np.uint64), np.zeros((len(models.languages), 0))
        for texts, at, batch in _pieces(batches):
            sums = np.zeros((len(models.languages), batch.num_rows))
            size, letters = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for some, own in _groups(texts, at):
                grams, owner, seen = grams_of(some)
                key, first, inverse = np.unique(keys_of(grams), return_index=True, return_inverse=True)
                new = ~np.isin(key, keys, assume_unique=True)
                if new.any():
                    if len(keys) > REMEMBERED:
                        keys, shares, new = keys[:0], shares[:, :0], np.ones(len(key), bool)
                    keys = np.concatenate([keys, key[new]])
                    shares = np.concatenate([shares, models.log_shares(grams[first[new]])], axis=1)
                    order = np.argsort(keys)
                    keys, shares = keys[order], shares[:, order]
                place = np.searchsorted(keys, key)[inverse]
                row = own[owner]
                for k in range(len(models.languages)):
                    sums[k] += np.bincount(row, shares[k][place], batch.num_rows)
                size += np.bincount(row, minlength=batch.num_rows)
                letters += np.bincount(own, seen, batch.num_rows)
            yield _ranked_languages(batch, columns, models, sums, size, letters)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select(*columns, "text").mapInArrow(run, f"{kinds}, best string, nats double, second double, n_symbols long")


def _ranked_languages(batch, columns, models, sums, size, letters):
    told = (letters > 0) & bool(models.languages)
    nats = -sums / np.maximum(size, 1)
    if len(models.languages):
        best = nats.argmin(axis=0)
        least = nats.min(axis=0)
        rest = nats.copy()
        rest[best, np.arange(len(best))] = np.inf
        second = rest.min(axis=0)
    else:
        best, least, second = np.zeros(len(size), int), np.zeros(len(size)), np.zeros(len(size))
    names = pa.array([models.languages[b] if t else None for b, t in zip(best, told)], pa.string())
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in columns), names, pa.array(least, mask=~told), pa.array(second, mask=~(told & np.isfinite(second))),
         pa.array(size.astype(np.int64), mask=~told)],
        [*columns, "best", "nats", "second", "n_symbols"])


def _counted(batches):
    """(key, gram, n): how often each gram stands in each text that has letters."""
    for texts, at, batch in _pieces(batches):
        keys, letters = np.asarray(batch.column("key")), np.zeros(batch.num_rows)
        held = Counter()
        for some, own in _groups(texts, at):
            grams, owner, seen = grams_of(some)
            letters += np.bincount(own, seen, batch.num_rows)
            row = own[owner]
            _, first, n = np.unique(keys_of(grams) + row.astype(np.uint64) * _TIMES[0], return_index=True, return_counts=True)
            spelled = np.ascontiguousarray(grams[first]).tobytes().decode("utf-32-le")
            for k, (r, m) in enumerate(zip(row[first].tolist(), n.tolist())):
                held[r, spelled[ORDER * k:ORDER * k + ORDER]] += m
        told = [(r, g, m) for (r, g), m in held.items() if letters[r] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(keys[[r for r, _, _ in told]], pa.int64()), pa.array([g for _, g, _ in told], pa.string()),
                                          pa.array([m for _, _, m in told], pa.int64())], ["key", "gram", "n"])


def _joined_entropies(docs: DataFrame, models: Joined, columns: list[str]) -> DataFrame:
    """What ``entropies`` returns, by joins alone: grams of distinct texts (told apart by a hash of 64 bits) meet the logs of
    their probabilities in all languages."""
    keyed = docs.select(*columns, "text").withColumn("key", F.xxhash64("text"))
    texts = keyed.where("text IS NOT NULL").select("key", "text").dropDuplicates(["key"])
    counted = cut_lineage(texts.mapInArrow(_counted, "key long, gram string, n long"))
    sums = counted.join(models.log_shares(counted), "gram").groupBy("key", F.col("lang").alias("best")).agg(
        (-F.sum(F.col("n") * F.col("log")) / F.sum("n")).alias("nats"), F.sum("n").alias("n_symbols"))
    ranked = sums.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("nats", "best"))).where("rank <= 2")
    first = F.col("rank") == 1
    ranked = ranked.groupBy("key").agg(F.max(F.when(first, F.col("best"))).alias("best"), F.max(F.when(first, F.col("nats"))).alias("nats"),
                                       F.max(F.when(~first, F.col("nats"))).alias("second"), F.max("n_symbols").alias("n_symbols"))
    return keyed.drop("text").join(ranked, "key", "left").select(*columns, "best", "nats", "second", "n_symbols")


def _distance(nats: Column, second: Column, n_symbols: Column) -> Column:
    """The log of one plus how many nats the whole text is nearer to the best language than to the next."""
    return F.when(nats.isNotNull(), F.log1p(F.least((F.coalesce(second, nats + 10.0) - nats) * n_symbols, F.lit(1e6))))


def calibrate(models: Models | Joined, sample: DataFrame) -> Models | Joined:
    """Fit how sure a distance makes, and the cutoff of each language, on documents (text, lang, order) not counted before."""
    told = entropies(sample, models, ["lang", "turn"]).where("best IS NOT NULL")
    rows = cut_lineage(told.select((F.col("best") == F.col("lang")).alias("right"), "lang", F.round("nats", NATS_DIGITS).alias("nats"),
                                   _distance(F.col("nats"), F.col("second"), F.col("n_symbols")).alias("d")))
    # All documents of the calibration, counted by narrow intervals of the distance: as many rows however many documents.
    bins = rows.groupBy("right", F.floor(F.col("d") * DISTANCE_BINS).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("d").alias("d")).where("d IS NOT NULL").orderBy("right", "bin").collect()
    if not bins:
        return models
    d, right, n = np.array([r["d"] for r in bins]), np.array([r["right"] for r in bins]), np.array([r["n"] for r in bins], float)
    # Platt's targets keep the fit finite where all are right.
    good, bad = n[right].sum(), n[~right].sum()
    target = np.where(right, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([d, np.ones(len(d))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * (p * (1 - p) + 1e-9))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (n * (target - p)) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
    models.slope, models.offset = float(max(w[0], 0.0)), float(w[1])
    values = rows.where("right").groupBy("lang", "nats").agg(F.count("*").alias("n"))
    cutoff = [F.sum("n").alias("n"), F.percentile("nats", KEPT_SHARE, F.col("n")).alias("cutoff")]
    pooled = values.groupBy("nats").agg(F.sum("n").alias("n")).agg(*cutoff).first()
    if isinstance(models, Joined):
        enough = F.when(F.col("n") >= 20, F.col("cutoff")).otherwise(F.lit(pooled["cutoff"]))
        models.cutoffs = cut_lineage(models.languages.join(values.groupBy("lang").agg(*cutoff), "lang", "left").select(
            "lang", (enough + 0.05).cast("double").alias("cutoff")))
        return models
    own = {r["lang"]: r for r in values.groupBy("lang").agg(*cutoff).collect()}
    for name in models.languages:
        told = own[name] if name in own and own[name]["n"] >= 20 else pooled  # too few for a cutoff of its own
        if told["cutoff"] is not None:
            models.cutoffs[name] = float(told["cutoff"]) + 0.05
    return models


def fold(id_column: str, of: int = FOLDS) -> Column:
    return F.crc32(F.col(id_column).cast("string")) % of


def fit(docs: DataFrame) -> Models | Joined:
    """Models learnt from the documents with a language whose CRC-32 of the id leaves a remainder mod FOLDS other than 0."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id") != 0)).select(
        "text", "lang", F.xxhash64("doc_id").alias("turn"), F.floor(F.crc32(F.col("doc_id").cast("string")) / FOLDS).alias("part"))
    sample = known.where(F.col("part") % CALIBRATION_SHARE == 0)
    return calibrate(learn(known.where(F.col("part") % CALIBRATION_SHARE != 0)), sample)


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, held_out, lang_pred, score, cross_entropy, rejected).

    ``und`` with score 0 is told of null texts, texts without letters, and where nothing could be learnt. ``score`` is the
    chance that the prediction is right, by the calibration; ``rejected`` marks predictions less likely than not and texts
    unlike those of their language (cross-entropy in nats a symbol beyond the cutoff). Rows without an id are
    predicted, never learnt from, and held out; rows with one id are told one by one; other columns are ignored; an empty
    table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    models = fit(narrow)
    told = entropies(narrow, models, ["doc_id"])
    sure = 1 / (1 + F.exp(-(models.slope * _distance(F.col("nats"), F.col("second"), F.col("n_symbols")) + models.offset)))
    cutoff = F.lit(None).cast("double")
    if isinstance(models, Joined):
        if models.cutoffs is not None:
            told, cutoff = told.join(models.cutoffs.withColumnRenamed("lang", "best"), "best", "left"), F.col("cutoff")
    else:
        for name, most in models.cutoffs.items():
            cutoff = F.when(F.col("best") == name, most).otherwise(cutoff)
    return told.select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(True)).alias("held_out"), F.coalesce("best", F.lit(UNDETERMINED)).alias("lang_pred"),
        F.coalesce(sure, F.lit(0.0)).alias("score"), F.col("nats").alias("cross_entropy"),
        F.coalesce((sure < 0.5) | (F.col("nats") > F.coalesce(cutoff, F.lit(float("inf")))), F.lit(True)).alias("rejected"))
