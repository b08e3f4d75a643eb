"""Language identification, the Merkle manifest and the prefix trie against plain versions, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from porescreen.llm import langid, manifest, trie
from tests.llm.cases import KINDS, empty, frame, prose, texts


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- manifest ----------------------------------------------------------------------------------

def plain_manifest(rows):
    def record(values):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, j):
        out = []
        for h in levels[:-1]:
            a = j - j % 3
            out.append((h[a:j], h[j + 1:a + 3]))
            j //= 3
        return out

    sources = {}
    for i, s, lang, n, t in rows:
        leaf = alt = record((i, s, lang, n, t))
        if i is not None and t is not None and zlib.crc32(str(i).encode()) % 2 == 0:
            alt = record((i, s, lang, n, t.replace("\n", "")))
        sources.setdefault((s is not None, (s or "").encode()), []).append((i is not None, i or 0, leaf, alt, i))
    order = sorted(sources)
    trees = [tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order]
    top, out = tree([t[-1][0] for t in trees]), []
    for k, s in enumerate(order):
        for j, (_, _, leaf, alt, i) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            steps, folded = path(trees[k], j) + path(top, k), alt
            for a, b in steps:
                folded = digest("".join(a) + folded + "".join(b))
            proof = digest("".join(x for a, b in steps for x in a + b))
            out.append((i, leaf, trees[k][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return Counter(out)


def manifest_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for name in ("leaf", "root", "pos", "n", "hash", "tree"):  # names that the operator uses itself
        df = df.withColumn(name, F.lit("x"))
    got = manifest.verify(df.repartition(3)).drop("proof")
    return Counter(tuple(r) for r in got.collect())


def test_manifest(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"line {i}\nnext") for i in range(40)]
    rows += [(100 + i, f"lone{i:02d}", None, None, "a\nb") for i in range(7)] + [(200, None, "en", 1, "no source\n"), (201, None, None, None, None)]
    rows += [(None, "s1", "en", 2, "no id\n"), (None, "s1", "en", 2, "no id\n"), (3, "s0", "en", 3, "line 3\nnext"), (3, "s0", "en", 3, "other\n"), (7, "s0", "", 0, ""),
             (8, "é\n", "é", 4, "é中🙂\n\n"), (9, "", "en", 1, None)]
    assert manifest_rows(spark, rows) == plain_manifest(rows)


def test_manifest_over_several_hops(spark):
    rows = [(i, "big", "en", 1, f"{i}\n") for i in range(6600)] + [(9000 + i, f"t{i:03d}", "en", 1, "\n") for i in range(90)]
    assert manifest_rows(spark, rows) == plain_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "one\n")], [(None, None, None, None, None)]])
def test_manifest_of_few_rows(spark, rows):
    assert manifest_rows(spark, rows) == plain_manifest(rows)


# -- trie --------------------------------------------------------------------------------------

def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members, ends = {}, {}
    for c, turns in made.items():
        ends.setdefault(tuple(turns), []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    saved, leaves, children = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(own) - 1) * (len(node[-1][1].encode()) if node else 0)
            leaves[node[:d]] += children[node] == 0
    return Counter((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
                    digest(",".join(map(str, sorted(ends.get(n, [])))))) for n, m in members.items())


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(7)).withColumn("p1", F.lit("x"))
    return Counter(tuple(r) for r in trie.prefix_trie(df.repartition(3)).drop("n_bytes").collect())


def conversations():
    rng, rows = random.Random(3), []
    for c in range(-7, 60):
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, "user" if turn % 2 else "assistant", rng.choice(["hi", "é中", "", "more\nlines"])))
    same = [("user", "start"), ("assistant", "go on"), ("user", "end")]
    rows += [(c, k, r, t) for c in range(100, 160) for k, (r, t) in enumerate(same)]  # a large group of copies
    rows += [(200 + c, k, "user", f"turn {k}") for c in (0, 1, 5) for k in range(25)]  # long ones that share their beginning
    rows += [(5, None, None, None), (5, 2, "user", "again"), (5, 2, "user", "again"), (None, 1, "user", "nobody"), (300, 1, None, "x")]
    return rows


def test_trie(spark, monkeypatch):
    rows = conversations()
    want = plain_trie(rows)
    assert trie_rows(spark, rows) == want
    # Blocks of four turns and chunks of four ids: nothing is gathered beyond that.
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "PARTS", 2)
    assert trie_rows(spark, rows) == want


def test_trie_of_few_rows(spark):
    assert trie_rows(spark, []) == Counter()
    assert trie_rows(spark, [(None, 1, "a", "b")]) == Counter()
    for rows in ([(1, 1, "a", "b")], [(5, None, None, None)]):
        assert trie_rows(spark, rows) == plain_trie(rows)


# -- languages ---------------------------------------------------------------------------------

def plain_symbols(text):
    out = []
    for c in text.lower():
        x = c if c.isalpha() else " "
        if x != " " or (out and out[-1] != " "):
            out.append(x)
    return out


def plain_model(docs):
    """Interpolated Kneser-Ney by dictionaries: the shares of a symbol after a context of any length up to three."""
    counts = [None, Counter(), Counter(), Counter(), Counter()]
    for t in docs:
        s = ["\0"] * 3 + plain_symbols(t)
        for i in range(3, len(s)):
            counts[4][tuple(s[i - 3:i + 1])] += 1
    for n in (3, 2, 1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    discount, totals = {}, {}
    for n in range(1, 5):
        n1, n2 = sum(c == 1 for c in counts[n].values()), sum(c == 2 for c in counts[n].values())
        discount[n] = min(0.95, n1 / (n1 + 2 * n2)) if n1 else 0.5
        totals[n] = Counter()
        for g, c in counts[n].items():
            totals[n][g[:-1]] += c
    kinds = {n: Counter(g[:-1] for g in counts[n]) for n in range(1, 5)}

    def share(gram, n_symbols):
        p = 1 / n_symbols
        for n in range(1, 5):
            g = gram[4 - n:]
            if totals[n][g[:-1]]:
                t = totals[n][g[:-1]]
                p = max(counts[n][g] - discount[n], 0) / t * (g in counts[n]) + discount[n] * kinds[n][g[:-1]] / t * p
        return p

    return share, {g[0] for g in counts[1]}


def test_shares_are_those_of_the_plain_model(spark):
    some = {"aa": [prose(i, 30) for i in range(12)], "bb": ["Und Ärger, 12 über\n\nalles! " * 3 + prose(50 + i, 9).replace("a", "ü") for i in range(9)]}
    docs = spark.createDataFrame([(t, name) for name, ts in some.items() for t in ts], "text string, lang string").repartition(3)
    models = langid.learn(docs)
    assert models.languages == ["aa", "bb"] and 0 < models.entries <= langid.MODEL_ENTRIES
    plain = [plain_model(ts) for ts in some.values()]
    n_symbols = len(plain[0][1] | plain[1][1]) + 1
    assert models.n_symbols == n_symbols
    for text in ("Über kaban 7 ü", prose(3, 12), "zzzz qq", "x"):
        grams, _, _ = langid.grams_of([text])
        s = ["\0"] * 3 + plain_symbols(text)
        want = [[math.log(share(tuple(s[i - 3:i + 1]), n_symbols)) for i in range(3, len(s))] for share, _ in plain]
        got = models.log_shares(grams)
        for k in range(2):
            assert got[k].tolist() == pytest.approx(want[k])


def test_languages_of_held_out_texts(spark):
    rng, rows = random.Random(4), []
    words = {"xx": "lorem ipsum dolor sit amet consectetur".split(), "yy": "zwölf boxkämpfer jagen viktor über den".split(), "zz": "съешь ещё этих мягких французских булок".split()}
    for i in range(600):
        lang = rng.choice(sorted(words))
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(2, 30))), lang))
    rows += [(700, None, "xx"), (701, "", "xx"), (702, "12 345 --", "yy"), (703, "lorem", None), (None, "ipsum dolor", "xx"), (704, "中文", "zz"),
             (705, "amet " * 40000, "xx"), (5, "ipsum", "xx"), (5, "ipsum", "xx"), (706, "\0\0", None)]
    df = spark.createDataFrame([(i, t, g, 0.5, "n", 3) for i, t, g in rows], "doc_id long, text string, lang string, score double, best string, nats int").repartition(3)
    got = langid.identify(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows)
    by = {r["doc_id"]: r for r in got}
    held = [(by[i], g) for i, _, g in rows[:600] if by[i]["held_out"]]
    assert sum(r["lang_pred"] == g for r, g in held) / len(held) > 0.99 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert [by[i]["lang_pred"] for i in (700, 701, 702, 706)] == ["und"] * 4 and by[700]["score"] == 0
    assert by[703]["lang_pred"] == by[705]["lang_pred"] == by[None]["lang_pred"] == "xx" and by[704]["lang_pred"] in words
    assert by[704]["rejected"] and not by[705]["rejected"]


def test_languages_without_anything_to_learn(spark):
    assert langid.identify(empty(spark)).count() == 0
    alone = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(alone).collect()] == [("und", 0.0)]
    odd = langid.identify(frame(spark, texts(), KINDS)).collect()
    assert len(odd) == len(texts()) and {r["lang_pred"] for r in odd} == {"en", "und"}


@pytest.mark.parametrize("limit", [("MODEL_ENTRIES", 40), ("MOST_LANGUAGES", 1)])
def test_models_beyond_the_shipped_size_are_whole(spark, monkeypatch, limit):
    """Rare grams and languages beyond a limit were left out; the texts are joined to the whole models now."""
    words = {"xx": "lorem ipsum dolor sit amet", "yy": "zwölf boxkämpfer jagen viktor", "zz": "съешь ещё этих мягких"}
    rng, data = random.Random(8), []
    for i in range(240):
        lang = rng.choice(sorted(words))
        data.append((i, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(1, 9))), lang))
    data += [(300, None, "xx"), (301, "12 -", "yy"), (None, "ipsum", "xx"), (5, "dolor", "xx"), (5, "dolor", "xx"), (302, "", None), (303, "\0\0q", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)

    def told():
        rows = langid.identify(df).collect()
        order = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], str(r["cross_entropy"])[:6]))
        return [(r["doc_id"], r["held_out"], r["lang_pred"], r["rejected"]) for r in order], [(r["score"], r["cross_entropy"] or 0.0) for r in order]

    exact, near = told()
    monkeypatch.setattr(langid, *limit)
    assert isinstance(langid.fit(df.where("doc_id IS NOT NULL")), langid.Joined)
    again, close = told()
    assert again == exact and {"xx", "yy", "zz"} <= {r[2] for r in again}
    assert np.allclose(near, close, atol=1e-6)


def test_calibration_counts_every_row(spark, monkeypatch):
    """Cutoffs and the fit are those of all rows of the calibration, counted by intervals."""
    rng = np.random.default_rng(6)
    rows = [("aa", bool(x), float(n), float(m), 50) for x, n, m in zip(rng.random(9000) < 0.9, rng.gamma(4, 0.5, 9000), rng.gamma(3, 0.1, 9000))]
    told = spark.createDataFrame([(lang, lang if ok else "bb", n, n + m, k) for lang, ok, n, m, k in rows],
                                 "lang string, best string, nats double, second double, n_symbols int")
    monkeypatch.setattr(langid, "entropies", lambda sample, models, carried: told)

    class Plain:
        languages, cutoffs, slope, offset = ["aa", "bb"], {}, 1.0, 0.0

    found = langid.calibrate(Plain(), told)
    good = [n for _, ok, n, _, _ in rows if ok]
    assert found.cutoffs == {lang: pytest.approx(np.quantile(good, langid.KEPT_SHARE) + 0.05, abs=1e-3) for lang in ("aa", "bb")}
    assert 1 / (1 + np.exp(-found.offset - found.slope * np.mean([np.log1p(m * 50) for *_, m, _ in rows]))) == pytest.approx(0.9, abs=0.02)
