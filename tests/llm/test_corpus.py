"""Line dedup, decontamination, top-k search and the pipeline against plain versions, with odd rows."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from porescreen.llm import common, decontaminate, lines, topk
from porescreen.llm.common import components
from tests.llm.cases import empty, frame, prose, texts


def groups_of(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (230, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(5001, 5100)]
    ids = sorted({x for p in pairs for x in p})
    at = {x: k for k, x in enumerate(ids)}
    found = groups_of(len(ids), [(at[a], at[b]) for a, b in pairs])
    least = {}
    for x, g in zip(ids, found):
        least.setdefault(g, x)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in ids} == {x: least[g] for x, g in zip(ids, found)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_run_no_round_that_changes_nothing(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(common, "cut_round", lambda df, cut=common.cut_round: cuts.append(1) or cut(df))
    for pairs, rounds in ([(1, 2), (1, 3), (9, 8)], 0), ([(1, 2), (2, 3)], 1):
        cuts.clear()
        got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
        assert sorted(tuple(r) for r in got) == ([(2, 1), (3, 1)] + ([(9, 8)] if not rounds else []))
        assert len(cuts) == 2 * rounds


def test_rounds_of_components_do_not_multiply_estimates(spark, capsys):
    found = components(spark.range(60).selectExpr("id AS a", "id + 1 AS b"))
    assert {r["root"] for r in found.collect()} == {0}
    found.explain(mode="cost")
    sizes = re.findall(r"sizeInBytes=([^,)]*)", capsys.readouterr().out)
    assert sizes and all(re.fullmatch(r"[\d.]+ (B|KiB)", size) for size in sizes), sizes


def plain_lines(rows):
    """What stays of each row, by all pairs of lines."""
    docs = {}
    for i, t in rows:
        docs.setdefault(i, []).append(t)
    known = sorted({lines.normal(x) for _, t in rows for x in lines.lines_of(t or "")} - {""})
    sets = [lines.shingles_of(k) for k in known]
    linked = [(a, b) for a in range(len(known)) for b in range(a) if lines.jaccard(sets[a], sets[b]) >= 0.8]
    root = dict(zip(known, groups_of(len(known), linked)))
    owner = {}
    for i, t in rows:
        for x in lines.lines_of(t or ""):
            if lines.normal(x):
                g, key = root[lines.normal(x)], (i is None, i)
                owner[g] = min(owner.get(g, key), key)
    out = []
    for i, t in rows:
        kept, seen = [], set()
        for k, x in enumerate(lines.lines_of(t or "")):
            g = root.get(lines.normal(x))
            if g is None or (owner[g] == (i is None, i) and g not in seen):
                kept.append(k)
                seen.add(g)
        out.append((i, t, kept))
    return out


@pytest.fixture(scope="module")
def line_rows():
    rng = np.random.default_rng(2)
    rows = texts()
    base = prose(1000, 60)
    for k in range(30):  # a group of near copies, and a chain in which only neighbours are similar
        words = base.split()
        words[int(rng.integers(60))] = f"edit{k}"
        rows.append((200 + k, prose(2000 + k, 20) + "\n" + " ".join(words)))
    chain = prose(1001, 60).split()
    for k in range(12):
        chain[k * 5] = f"link{k}"
        rows.append((300 + k, " ".join(chain)))
    return rows


def test_line_dedup(spark, line_rows):
    want = Counter((i, len(lines.lines_of(t or "")), len(k), tuple(k)) for i, t, k in plain_lines(line_rows))
    got = lines.scan(frame(spark, line_rows))
    assert Counter((r["doc_id"], r["n_lines"], r["n_kept"], tuple(r["kept"])) for r in got.collect()) == want
    cleaned = lines.without_repeats(frame(spark, line_rows))
    assert cleaned.columns == frame(spark).columns
    kept = Counter((i, t if t is None or len(k) == len(lines.lines_of(t)) else "\n".join(lines.lines_of(t)[x] for x in k))
                   for i, t, k in plain_lines(line_rows))
    assert Counter((r["doc_id"], r["text"]) for r in cleaned.collect()) == kept
    assert lines.scan(empty(spark)).count() == 0


def test_variants_that_are_like_some_of_their_group_only(spark):
    rng, known = np.random.default_rng(11), []
    for group in range(3):
        words = prose(1100 + group, 60).split()
        for _ in range(150):
            own = list(words)
            for at in rng.choice(60, int(rng.integers(1, 5)), replace=False):
                own[at] = f"edit{int(rng.integers(1000))}"
            known.append(" ".join(own))
    known = sorted(set(map(lines.normal, known)))
    sets, bands = [lines.shingles_of(k) for k in known], lines.band_hashes(known)
    linked = [(a, b) for a in range(len(known)) for b in range(a)
              if (bands[a] == bands[b]).any() and lines.jaccard(sets[a], sets[b]) >= 0.8]
    want = groups_of(len(known), linked)
    docs = frame(spark, list(enumerate(known)))
    links = lines.similar_lines(docs, lines.line_keys(docs))
    at = {lines.key_of(k): i for i, k in enumerate(known)}
    got = groups_of(len(known), [(at[r["a"]], at[r["b"]]) for r in links.collect()])
    assert len(set(want)) > 20 and len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_blocks_compare_as_pairs_do():
    some = [prose(9000 + i % 7, 30) + f" tail{i}" for i in range(20)] + ["short", "short\0", "exactly8", "exactly9!", ""]
    want = [[min(len(a), len(b)) >= 8 and lines.jaccard(lines.shingles_of(a), lines.shingles_of(b)) >= 0.8 for b in some] for a in some]
    assert lines.similar_of(some, some).tolist() == want and sum(map(sum, want)) > len(some)


def test_few_pairs_of_blocks_are_compared_one_by_one():
    some = [prose(9000 + i % 7, 30) + f" tail{i}" for i in range(20)] + ["short", "short\0", "exactly8", "exactly9!", ""]
    every, asked = lines.similar_of(some, some), np.triu(np.ones((len(some), len(some)), bool), 1) & (np.arange(len(some)) % 3 == 0)
    assert (lines.similar_of(some, some, asked) & asked).tolist() == (every & asked).tolist() and (every & asked).any()


def test_pairs_with_the_least_key_of_a_band_are_compared_once(spark):
    def refuse(*blocks):
        raise AssertionError("compared again")

    known = [prose(9100 + i, 30) for i in range(6)] + [prose(9100, 30) + " tail"]
    spots = spark.createDataFrame([(band, key) for band, pair in enumerate([(0, 1), (2, 3), (4, 5), (0, 6)]) for key in pair],
                                  "band long, key long")
    texts = spark.createDataFrame(list(enumerate(known)), "key long, line string")
    got = lines.verified_roots(spots, lambda wanted: texts.join(wanted, "key", "left_semi"), lines._similar, refuse)
    assert [(r["node"], r["root"]) for r in got.collect()] == [(6, 0)]


def test_normal_lines():
    for line in ("a b", " a b", "a b ", "a  b", "A\tB", "a\u00a0b", "a\u3000b", "a\x85b", "\u0130 \u0391\u03a3", "a\u200bb", "", " "):
        assert lines.normal(line) == " ".join(line.lower().split())


def test_bands_find_most_pairs_at_the_threshold():
    rng, found, all_ = np.random.default_rng(4), 0, 0
    for k in range(800):
        words = prose(5000 + k, 80).split()
        other = list(words)
        for at in rng.integers(0, 80, 2):
            other[at] = f"new{at}"
        a, b = " ".join(words), " ".join(other)
        if 0.8 <= lines.jaccard(lines.shingles_of(a), lines.shingles_of(b)) <= 0.9:
            hashes = lines.band_hashes([a, b])
            all_, found = all_ + 1, found + bool((hashes[0] == hashes[1]).any())
    assert all_ > 100 and found / all_ >= 0.98


def plain_leaks(rows, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shingles = lambda w: Counter(tuple(w[p:p + 5]) for p in range(len(w) - 4))
    best = {}
    for i, t in rows:
        w = words(t)
        for item, text in items:
            x = words(text)
            if item is None or len(x) < 5:
                continue
            b = shingles(x)
            starts = {p - q for p in range(len(w) - 4) for q in range(len(x) - 4) if w[p:p + 5] == x[q:q + 5]}
            for s in starts:
                a = shingles(w[max(s, 0):max(s + len(x), 0)])
                both = sum((a & b).values())
                similarity = both / (sum(a.values()) + sum(b.values()) - both)
                if similarity >= 0.8:
                    key = (i, t, item)
                    best[key] = max(best.get(key, (0, 0)), (similarity, -s))
    return Counter((i, item, -s, v) for (i, _, item), (v, s) in best.items())


def test_decontamination(spark):
    items = [(1, prose(3000, 40)), (2, prose(3001, 60)), (3, "too short here"), (None, prose(3002, 30)), (4, None), (5, "la la la la la la la la"),
             (6, prose(3003, 12)), (7, prose(3000, 40))]
    long = items[1][1].split()
    edited = long[:30] + ["changed"] + long[31:]
    rows = [(1, prose(1, 50) + " " + items[0][1].upper() + ". " + prose(2, 9)), (2, " ".join(edited)), (3, " ".join(long[:40])),
            (4, "La, la la... la la la; la la la la"), (5, None), (6, ""), (None, items[6][1]), (None, "none " * 30), (1, "other row of one"),
            (7, " ".join(long[1:]) + " end"), (8, (items[0][1] + "\n") * 3), (9, items[2][1]), (10, prose(10, 20000)), (8, (items[0][1] + "\n") * 3),
            (11, " ".join(items[6][1].split()[1:]))]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, n int")
    got = decontaminate.leaks(frame(spark, rows), bench).collect()
    want = plain_leaks(rows, items)
    assert Counter((r["doc_id"], r["item_id"], r["start_word"], r["similarity"]) for r in got) == want and len(want) > 6
    dirty = {(r["doc_id"], r["text_hash"]) for r in got}
    stays = decontaminate.clean_documents(frame(spark, rows), bench)
    assert stays.columns == frame(spark).columns
    hashed = frame(spark, rows).selectExpr("doc_id", "xxhash64(text) as h").collect()
    assert stays.count() == sum((r["doc_id"], r["h"]) not in dirty for r in hashed)
    assert decontaminate.leaks(empty(spark), bench).count() == 0 and decontaminate.leaks(frame(spark, rows), bench.limit(0)).count() == 0


def test_leaks_at_the_threshold_are_all_found(spark):
    rng, items, rows = np.random.default_rng(13), [], []
    for n in (22, 31, 40, 49, 58):
        for _ in range(40):
            item = prose(20000 + len(items), n).split()[:n]
            items.append((len(items), " ".join(item)))
            for _ in range(10):  # of n - 4 shingles, as many go at the end as leave a similarity of 0.8
                new = [f"w{int(x)}" for x in rng.integers(0, 100_000, (n - 4) // 9)]
                rows.append((len(rows), " ".join(item[: n - len(new)] + new)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame(spark, rows), bench).collect()}
    assert got >= {(i, i // 10) for i, _ in rows}


def test_top_k(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(0, 1, 16).tolist()) for i in range(260)]
    vectors += [(300 + i, vectors[7][1]) for i in range(15)]  # ties
    vectors += [(400, None), (401, [1.0, None] + [0.0] * 14), (402, [float("nan")] * 16), (None, [1.0] * 16), (403, [float("inf")] * 16),
                (404, [2.0, 1.0]), (405, []), (0, vectors[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in vectors], "vec_id long, embedding array<float>, v int, rank int, score int")
    usable = topk.integer_vectors(df)
    whole = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in vectors
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q in (0, 100, 200, 300, 404 - 4):
        own = [v for i, v in whole if i == q]
        if not own:
            continue
        scored = sorted((-sum(a * b for a, b in zip(own[0], v)), i) for i, v in whole if i != q)[:10]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    got = topk.top_k(usable, usable.where("vec_id % 100 = 0"), block=64, together=2)
    assert {tuple(r) for r in got.collect()} == want
    few = usable.where("vec_id < 4")
    assert topk.top_k(few, few).groupBy("query_id").count().where("count <> 4 and count <> 3").count() == 0
    assert topk.top_k(usable.limit(0), usable).count() == 0 and topk.top_k(usable, usable.limit(0)).count() == 0


def test_reading_stops_early_with_the_same_result():
    rng = np.random.default_rng(9)
    rows = np.floor(rng.pareto(0.6, (3000, 8)) * 50).clip(0, 1e6)
    queries = rows[:20].copy()
    ids = np.arange(3000)
    got = topk.block_top(queries, ids[:20], ids, rows, 10)
    for q in range(20):
        scores = rows @ queries[q]
        best = [i for i in np.lexsort((ids, -scores)) if i != q][:10]
        assert sorted(i for a, i, _ in got if a == q) == sorted(best)


def test_near_duplicate_stage(spark):
    from porescreen.llm import documents

    rows, rng = [(500, None), (501, " "), (502, "few words"), (503, "Few  words"), (None, prose(9500, 90)), (504, prose(9600, 400))], np.random.default_rng(12)
    for k in range(12):
        words = prose(9700 + k, 200).split()
        rows.append((k, " ".join(words)))
        for n, at in ((100 + k, 2), (200 + k, 4), (300 + k, 12)):
            own = list(words)
            for x in rng.choice(40, at, replace=False) * 5:
                own[x] = f"new{n}"
            rows.append((n, " ".join(own)))
    sets = [set(documents.shingle_hashes(t or "").tolist()) for _, t in rows]
    similar = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = groups_of(len(rows), similar)
    want = {min(i for (i, _), h in zip(rows, groups) if h == g and i is not None) for (i, _), g in zip(rows, groups) if i is not None}
    got = corpus_pipeline.simhash_stage(spark, frame(spark, rows), "")
    kept = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got.collect())
    assert kept == [-1, *sorted(want)] and len(similar) > 20


def test_pipeline(spark, tmp_path):
    rows = [(i, prose(7000 + i, 49) + ("\nPlease read all of this notice before you go on." if i % 3 == 0 else "")) for i in range(120)]
    rows += [(400 + i, rows[i][1]) for i in range(5)] + [(200, prose(8000, 30) + " " + prose(8001, 45)), (201, None), (202, ""), (None, prose(8002, 50))]
    toxic = [(300 + i, prose(8100 + i, 40) + " vilest scoundrel " + prose(8300 + i, 9)) for i in range(15)]
    labels = [(i, 1, 0) for i, _ in rows if i is not None] + [(i, 1, 1) for i, _ in toxic]
    frame(spark, rows + toxic).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(8001, 45))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in docs.collect())
    # copies go with their originals' lines, of the texts without words one stays, the leak and the toxic ones go
    assert [i for i in ids if i < 200] == list(range(-1, 120)) and 200 not in ids and not any(300 <= i < 400 for i in ids)
    assert [i for i in ids if i >= 200] == [201]
    assert docs.count() == corpus_pipeline.run(spark, str(tmp_path)).count()
