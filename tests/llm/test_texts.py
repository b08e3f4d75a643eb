"""Operators on texts against plain versions, with odd rows."""

import hashlib
import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest
import regex
import tiktoken
import xxhash
from public_tokenizers import PATTERN

from porescreen.llm import bpe, html, licenses, repeats, simhash, toxicity, wordpiece
from tests.llm.cases import empty, frame, texts


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rows, fps = texts(), [plain_fingerprint(t) for _, t in texts()]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = {}
    for r, (i, _) in zip(root, rows):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = Counter((i, format(f, "016x"), least[r]) for (i, _), f, r in zip(rows, fps, root))
    assert rows_of(simhash.near_duplicates(frame(spark))) == want
    kept = simhash.kept_documents(frame(spark))
    assert kept.columns == frame(spark).columns
    alone = {r for r, x in least.items() if x is None}  # groups of rows without an id
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({x: 1 for x in least.values() if x is not None} | {None: len(alone)})
    assert len(alone) >= 1
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_tiles_give_the_same_links(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    values = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 60, np.uint64)) for _ in range(9))]))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    label = np.arange(len(values))
    for _ in range(len(values)):
        label = np.array([label[n].min() for n in near])
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.fingerprint_links(fps, tile=7)).collect()}
    got = {}
    for v, k in zip(values.view(np.int64).tolist(), label.tolist()):
        got.setdefault(k, set()).add(roots.get(v, v))
    assert all(len(g) == 1 for g in got.values()) and len({min(g) for g in got.values()}) == len(set(label.tolist()))


def test_byte_bpe(spark):
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    rows = texts() + [(70, " a  b\n \n c \t d "), (71, "it's  I'll\r\n\r\n  x "), (72, "q" * 200 + "zxqj" * 60), (73, "<|endoftext|> 1234567 ½²")]
    want = Counter()
    for i, t in rows:
        ids = coder.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert rows_of(bpe.encode(frame(spark, rows))) == want
    assert bpe.encode(empty(spark)).count() == 0


def test_no_plan_holds_the_ranks(spark, monkeypatch):
    sizes, kind = [], type(empty(spark))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString())) or collect(df))
    bpe.encode(frame(spark))
    assert sizes and max(sizes) < 20_000


def test_words_that_are_not_frequent_are_merged_where_they_stand(spark, monkeypatch):
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    monkeypatch.setattr(bpe, "COMMON_WORDS", 3)
    done = bpe.encode(frame(spark), with_ids=True).collect()
    known = dict((i, t or "") for i, t in texts() if i not in (None, 20, 60))
    for r in done:
        if r["doc_id"] in known:
            assert r["ids"] == " ".join(map(str, coder.encode_ordinary(known[r["doc_id"]])))
            assert bytes(r["decoded"]).decode() == known[r["doc_id"]]


def test_frequent_words_are_told_once_in_a_worker():
    ranks = bpe.read_ranks()
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = [w for _, t in texts() for w in re.findall(r"\S+", t or "") if len(w) < 200][:300] + ["zxqj" * 12, "é½²"]
    ids = {w.encode(): tuple(coder.encode_single_token(p) for p in coder.decode_tokens_bytes(coder.encode_ordinary(w))) for w in words}
    known, pieces = bpe._unpacked(([pickle.dumps(ids)], ranks))
    assert known == {w: (" ".join(map(str, i)), w) for w, i in ids.items()}
    for raw in (p for w in words for p in regex.findall(PATTERN, w)):
        assert bpe.merge_word(raw.encode(), ranks, pieces) == bpe._merge_long(raw.encode(), ranks) == coder.encode_ordinary(raw)


def test_simple_chunks_are_cut_without_the_pattern():
    split, words = bpe.Splitter(PATTERN), regex.compile(PATTERN).findall
    parts = ["word", "Wörter,", "fin?!", "a.b", "it's", "x1", "", ".", "é½", "ª", "×", "q…", "\u0130x.", "a\nb", "end.\n", "...a"]
    assert [split.words_after_space(p) for p in parts] == [words(" " + p) for p in parts]
    for text in ("a  b", "a \tb", "a\t ", "a ", " a", "  ", " ", "a \x1cb", "a\n\nb c", " \n", "a b"):
        first, others = split.chunks(text)
        assert words(first) + [w for p in others for w in split.words_after_space(p)] == words(text)

    def refuse(chunk):
        raise AssertionError("cut by the pattern")

    split.words = refuse
    assert split.words_after_space("wörd.") == [" wörd", "."]


def test_token_counts(spark):
    vocabulary, letters = set(wordpiece.read_vocabulary()), wordpiece.byte_letters()

    def greedy(word):
        symbols, at, n = [letters[b] for b in word.encode()], 0, 0
        while at < len(symbols):
            for end in range(len(symbols), at, -1):
                piece = "".join(symbols[at:end])
                if (end == len(symbols) and piece + "</w>" in vocabulary) or piece in vocabulary:
                    break
            n, at = n + 1, end
        return n

    want = Counter()
    for i, t in texts():
        words = (t or "").lower().split()
        want[i, len(words), sum(greedy(w) if len(w) < 300 else wordpiece.Automaton(sorted(vocabulary)).count(w.encode()) for w in words)] += 1
    assert rows_of(wordpiece.count_tokens(frame(spark))) == want
    assert wordpiece.count_tokens(empty(spark)).count() == 0


def test_automaton_on_a_small_vocabulary():
    machine = wordpiece.Automaton(["a", "ab", "abcd", "b", "bc", "c", "d", "cd</w>", "d</w>", "a</w>"])
    # greedy: ab|cd</w>, abcd|a</w>, ab|c|a</w>, an unknown byte is one piece
    assert [machine.count(w) for w in (b"abcd", b"abcda", b"abca", b"xabc", b"")] == [1, 2, 3, 3, 0]


@pytest.fixture(scope="module")
def license_rows():
    return [(1, "Released under the MIT License."), (2, "Apache License, and the mit\nLICENSE; MIT license"), (3, "gnu general public license v3"),
            (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its associated "
                "documentation files to deal in the software without restriction"), (5, None), (6, ""), (7, "mitlicense license mit"),
            (1, "Released under the MIT License."), (None, "éapache apache license"), (8, "Licensed under CC BY-NC 4.0."),
            (9, "Kmit license mit İlicense")]


def test_licenses(spark, license_rows):
    word = re.compile(licenses.WORD)
    got = licenses.scan(frame(spark, license_rows)).collect()
    want = Counter()
    for i, t in license_rows:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        want[i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in at}))] += 1
    assert len(got) == len(license_rows)
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[4]["labels"] == "mit" and by[4]["n_base"] == 0 and 0.8 < by[4]["score"] < 1 and by[8]["labels"] == "cc"
    assert by[7]["labels"] == "" and by[7]["score"] == 0 and by[2]["labels"] == "apache,mit" and by[2]["score"] == 1
    assert licenses.scan(empty(spark)).count() == 0


def test_license_texts_are_split_once(spark, license_rows):
    word = re.compile(licenses.WORD)
    for _, t in [*license_rows, *texts(), (0, "".join(map(chr, range(0x250))) + "\u3000a\u2028b\U0001f600c")]:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        assert licenses.words_of((t or "").encode()) == [w.encode() for w in word.findall(lower)]
    plan = licenses.scan(frame(spark, license_rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "text" not in plan


@pytest.mark.parametrize("many_parts", [False, True])
def test_repeats(spark, monkeypatch, many_parts):
    if many_parts:
        for name, value in (("PARTITION_BYTES", 9000), ("CHUNK", 5), ("SHARD", 20)):
            monkeypatch.setattr(repeats, name, value)
    rows = texts() + [(80, "ab" * 40), (81, "cab" + "ab" * 60 + "x" * 51), (82, prose_tail := "é" * 49), (83, "é" * 24), (84, "q" + prose_tail)]
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            first.setdefault(raw[k:k + 50], set()).add(1 << 70 if i is None else i)
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if min(first[raw[k:k + 50]]) < (1 << 70 if i is None else i):
                gone[k:k + 50] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(raw)))
        want[i, len(raw), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest()] += 1
    assert rows_of(repeats.without_repeats(frame(spark, rows))) == want
    assert repeats.without_repeats(empty(spark)).count() == 0


def test_marks_of_contexts_by_sorted_sides():
    """Strings of contexts of one gram, against all pairs; ranks are told of sides of every length, zero bytes and ends of texts."""
    import pandas as pd

    rng = random.Random(3)
    gram, held = bytes(range(repeats.GRAM)), []
    for n in range(60):
        sides = [bytes(rng.choice([0, 1]) if rng.random() < 0.06 else 0 for _ in range(repeats.REACH)) for _ in range(2)]
        left, right = (bytearray(x) for x in sides)
        left[:n % 9], right[repeats.REACH - n % 7:] = b"\xff" * (n % 9), b"\xff" * (n % 7)
        held.append((bytes(left) + gram + bytes(right), rng.randrange(5), n, 100 + n))
    want = set()
    for context, doc, rid, place in held:
        for k in range(repeats.REACH + 1):
            string = context[k:k + repeats.LENGTH]
            if b"\xff" not in string and any(string == c[k:k + repeats.LENGTH] and d < doc for c, d, _, _ in held):
                want.add((rid, place - repeats.REACH + k))
    got = set()
    order, shared = repeats._sorted_prefixes(np.frombuffer(b"".join(c for c, *_ in held), np.uint8).reshape(60, -1))
    assert [held[i][0] for i in order] == sorted(c for c, *_ in held) and shared.max() <= repeats.CONTEXT
    for row in repeats._mark(pd.DataFrame(held, columns=["context", "doc", "rid", "place"]), 4).itertuples():
        rids = np.repeat(np.frombuffer(row.rids, np.int64), repeats._numbers(row.sizes, 3).astype(int))
        got |= set(zip(rids.tolist(), repeats._numbers(row.places, 4).astype(int).tolist()))
    assert got == want and len(want) > 100


def test_main_text(spark):
    long = "the quick fox and the dog of the house ran to the river with a bone in the mouth. " * 3
    pages = [
        (1, "u", f"<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{long}</p><p>Short&nbsp;end"
                 f" &lt;b&gt;.</p><div class='comments'><p>{long}</p></div></article><footer>{long}</footer></body>"),
        (2, "u", None), (3, None, ""), (4, "u", "<p"), (5, "u", "<!-- open " + long), (None, "u", f"<div><p>{long}<p>tail of it</div>"),
        (6, "u", f"<div id=sidebar>{long}</div><form>{long}</form><p>{long}<script>var x='<p>no</p>'</script><br>a  b</p>"),
        (7, "u", "<ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul>"), (1, "u", "<article><p>again</p></article>"),
        (8, "u", "<b>" * 5000 + long), (9, "u", f"<main><p>{long}</p><aside>{long}</aside></main><p>{long}</p>"),
    ]
    clean = " ".join(long.split())
    want = {1: {f"Head {clean} Short end <b>.", "again"}, 2: {""}, 3: {""}, 4: {""}, 5: {""}, None: {f"{clean} tail of it"},
            6: {f"{clean} a b"}, 7: {""}, 8: {clean}, 9: {clean}}
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    got = html.extract(df).collect()
    found = {}
    for r in got:
        found.setdefault(r["page_id"], set()).add(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert found == want and len(got) == len(pages)


def test_names_do_not_reject_what_holds_the_article():
    long = "the quick fox and the dog of the house ran to the river with a bone in the mouth."
    for page, want in (
            (f"<div class='layout with-sidebar'><article><h1>Head</h1><p>{long}</p></article><div class=sidebar>{long}</div></div>", f"Head {long}"),
            (f"<main id='search-results'><p>{long}</p></main>", long), (f"<div class='social-history'><p>{long}</p><p>{long}</p></div>", f"{long} {long}"),
            (f"<article><div class='article-header'><h1>Headline</h1></div><p>{long}</p></article>", f"Headline {long}"),
            (f"<article>teaser</article><p>{long}</p><p>{long}</p>", f"teaser {long} {long}"),
            (f"<article><p>{long}</p></article><div class=comments><article><p>{long} {long}</p></article></div>", long),
            (f"<p>{long}</p><div class='comments'><p>{long} {long} {long}</p></div>", long),
            (f"<div class='ad'>{long} {long}</div><article><p>short one</p></article>", "short one"),
            (f"<article><p>{long}</p><div class='ad'>{long}</div></article>", long)):
        assert html.main_text(page) == want, page


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    plain, bad, groups = [f"w{i}" for i in range(60)], ["idiots", "idiotic"], ["norther", "southerner"]
    rows, labels = [], []
    for i in range(1200):
        words = list(rng.choice(plain, 12))
        kind = i % 4
        words += [bad[i % 2]] if kind in (0, 1) else []
        words += [groups[i % 2]] if kind in (0, 2) else []
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(kind == 0)))  # toxic only where both occur
    rows += [(None, "idiots norther"), (5000, None), (5001, ""), (5002, "x " * 20000), (7, rows[7][1])]
    labels += [(None, 1, 1), (8, 1, None), (9, 1, 5), (0, 1, 1)]
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(frame(spark, rows), tags).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1200]
    right = sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert len(held) > 200 and right / len(held) > 0.97
    stays = toxicity.accepted(frame(spark, rows), tags)
    assert stays.columns == frame(spark).columns and stays.count() == sum(r["predicted"] == 0 for r in got)
    assert {r["score"] for r in toxicity.score_documents(frame(spark, rows[:9]), tags.limit(0)).collect()} == {
        1 / (1 + np.exp(-toxicity._log_odds(0.0)))}
    assert toxicity.score_documents(empty(spark), tags).count() == 0
