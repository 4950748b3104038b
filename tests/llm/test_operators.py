"""The training-data operators against brute-force versions, on small tables with awkward rows."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, embedding_dedup, imatch, language_id, line_dedup, mixing, ngram_join, packing, suffix_dedup, url_filters
from tessera.llm.common import tidy
from tessera.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, _text string, fp long"


def make(spark, texts, langs=None):
    """Documents with further columns whose names the operators use themselves."""
    rows = [(i, t, langs[k] if langs else "en", f"s{k % 3}", None, k, "x", k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(seed=0, n=60):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    base = " ".join(rnd.choice(words) for _ in range(120))
    texts = [base, base, base.replace(" ", "\n", 3), base + " tail", "", None, " \t\n", "one", "one two three", "One two THREE", "é" * 300, "日本語 " * 40, base[: len(base) // 2]]
    for _ in range(n):
        w = base.split(" ")
        for _ in range(rnd.randint(0, 12)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        texts.append(" ".join(w[: rnd.randint(20, 120)]) if rnd.random() < 0.5 else " ".join(w))
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(n)]
    texts.append(" ".join(rnd.choice(words) for _ in range(30_000)))
    rnd.shuffle(texts)
    return list(enumerate(texts))


def groups(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(70)] + [(None, 3), (5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = groups({x for e in real for x in e}, real)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 --------------------------------------------------------------------------------------------


def shingles(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80), (3, 40)])
def test_ngram_join(spark, n, num):
    rows = awkward(n)
    sets = {i: shingles(t, n) for i, t in rows}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = {(i, len(sets[i]), c) for i, c in groups(ids, links).items()}
    docs = make(spark, [*rows, rows[3], (None, "no id")])
    got = [tuple(r) for r in ngram_join.ngram_jaccard_components(docs, n=n, num=num).collect()]
    assert set(got) == want and len(got) == len(rows) + 1
    assert ngram_join.ngram_jaccard_components(docs.limit(0), n=n, num=num).count() == 0


@pytest.mark.parametrize("closest", [(1, None), (1, 2)])
def test_ngram_join_closest_rounds_lose_nothing(spark, monkeypatch, closest):
    monkeypatch.setattr(ngram_join, "CLOSEST", closest)
    monkeypatch.setattr(ngram_join, "BLOCK", (20, 20))
    rnd = random.Random(2)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(40)] = f"x{rnd.randrange(6)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t, 4) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_components(make(spark, rows), n=4, num=85).collect()}
    assert got == groups(sets, links)


def blocks_of_subsets(subsets, each, seed=4):
    """Rows of blocks as _cross gets them, and the sets by fingerprint."""
    rnd = np.random.default_rng(seed)
    sets, rows = {}, []
    for s in range(subsets):
        base = rnd.integers(0, 1 << 62, 300).astype(np.uint64)
        for _ in range(each):
            h = base.copy()
            h[rnd.integers(0, 300, rnd.integers(0, 60))] = rnd.integers(0, 1 << 62)
            h, fp = np.unique(h[: rnd.integers(200, 301)]), len(sets)
            sets[fp] = h
            rows.append((s, 0, 0, ngram_join.BOTH, fp, fp, len(h), ngram_join.bitmap(h)))
    names = ["sig", "i", "j", "role", "fp", "comp", "n", "bits"]
    return sets, pa.table([pa.array([r[k] for r in rows], pa.binary() if k == 7 else pa.int64()) for k in range(8)], names=names)


def test_ngram_join_blocks_pair_by_bitmaps():
    sets, t = blocks_of_subsets(4, 40)
    got = {p for b in ngram_join._cross(85, 100, None)(iter(t.to_batches(max_chunksize=7))) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    size = {f: len(h) for f, h in sets.items()}
    bits = {f: ngram_join.bitmap(h) for f, h in sets.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and a // 40 == b // 40 and 85 * max(size[a], size[b]) <= 100 * min(size[a], size[b])]
    low = ngram_join.least_difference([bits[a] for a, _ in pairs], [bits[b] for _, b in pairs])
    assert got == {(a, b) for (a, b), d in zip(pairs, low.tolist(), strict=True) if d <= (size[a] + size[b]) * 15 // 185} and got


def test_ngram_join_blocks_in_many_batches():
    """A task's time follows from its rows, not from its subsets times its bytes."""
    rows = [(k // 2, 0, 0, ngram_join.ASKS if k % 2 else ngram_join.ANSWERS, k, k, 20 if k % 2 else 10, bytes(4096)) for k in range(4000)]
    names = ["sig", "i", "j", "role", "fp", "comp", "n", "bits"]
    t = pa.table([pa.array([r[k] for r in rows], pa.binary() if k == 7 else pa.int64()) for k in range(8)], names=names)

    def took(batches):
        start = time.process_time()
        assert sum(b.num_rows for b in ngram_join._cross(85, 100, None)(iter(batches))) == 0
        return time.process_time() - start

    one = took(t.combine_chunks().to_batches())
    assert took(t.to_batches(max_chunksize=50)) < 2.5 * one + 0.5


# --- 2 --------------------------------------------------------------------------------------------


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_cases(spark):
    texts = [(1, "the cat sat on the mat"), (2, "der hund und die katze"), (3, None), (4, ""), (5, "123 !?"), (6, "日本"), (7, "the the und"), (None, "the mat")]
    docs = make(spark, texts, ["en", "de", "en", None, "de", None, None, "en"])
    model = language_id.train(docs)
    out = {r["doc_id"]: r for r in language_id.predict_languages(docs, model).collect()}
    assert out[1]["lang_pred"] == "en" and out[2]["lang_pred"] == "de" and out[7]["lang_pred"] in ("en", "de")
    assert [out[k]["lang_pred"] for k in (3, 4, 5)] == ["und"] * 3 and [out[k]["score"] for k in (3, 4, 5)] == [0.0] * 3
    assert out[6]["score"] == 0.5 and out[1]["_text"] == "x" and out[None]["lang_pred"] == "en"
    assert language_id.languages(docs.limit(0)).count() == 0


def test_language_id_by_definition(spark):
    """Scores of the model against plain counts of words and n-grams."""
    rnd = random.Random(11)
    stems = {"en": ["the", "cat", "sat", "thing", "over"], "de": ["der", "hund", "über", "ding", "katze"], "fr": ["le", "chat", "été", "chose", "sur"]}
    text = lambda lang, n: " ".join(rnd.choice(stems[lang]) + rnd.choice(["", "", "s", "en", "é", "q1z"]) for _ in range(n))
    langs = [rnd.choice(list(stems)) for _ in range(120)]
    rows = [(i, text(lang, rnd.randint(1, 30))) for i, lang in enumerate(langs)]
    rows.append((200, text("en", 60_000)))
    docs = make(spark, [*rows, rows[0], rows[0]], [*langs, "en", langs[0], langs[0]]).withColumn("score", F.lit("mine"))
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    counts = defaultdict(Counter)
    for (_, t), lang in zip([*rows, rows[0], rows[0]], [*langs, "en", langs[0], langs[0]], strict=True):
        for w in words(t):
            counts[0][lang, w] += 1
            for n in range(1, 6):
                m = f"<{w}>" if n > 1 else w
                for k in range(len(m) - n + 1):
                    counts[n][lang, m[k : k + n]] += 1
    names = sorted(stems)
    known = {n: {e for _, e in c} for n, c in counts.items()}
    sums = {n: {lang: sum(v for (x, _), v in c.items() if x == lang) for lang in names} for n, c in counts.items()}
    log = lambda n, lang, e: np.log((counts[n][lang, e] + 0.5) / (sums[n][lang] + 0.5 * len(known[n])))

    def score(t):
        vectors = []
        for w in words(t):
            if w in known[0]:
                vectors.append([log(0, lang, w) for lang in names])
                continue
            for n in (5, 4, 3, 2, 1):
                m = f"<{w}>" if n > 1 else w
                hits = [m[k : k + n] for k in range(len(m) - n + 1) if m[k : k + n] in known[n]]
                if hits:
                    vectors.append([np.mean([log(n, lang, g) for g in hits]) for lang in names])
                    break
        if not words(t):
            return "und", 0.0
        total = np.sum(vectors, axis=0) if vectors else np.zeros(len(names))
        mean = total / max(len(vectors), 1)
        return names[int(np.argmax(np.round(total, 9)))], 1 / np.exp(mean - mean.max()).sum()

    model = language_id.train(docs, sample_rows=10_000)
    new = [(300 + k, t) for k, t in enumerate(["hundcat überding", "xyz the", "ж", "", None, "chatsur katzen's 12", "q " * 500])]
    for r in language_id.predict_languages(make(spark, [*rows, *new]), model).collect():
        want = score(r["text"])
        assert r["lang_pred"] == want[0] and r["score"] == pytest.approx(want[1], abs=1e-9)
    out = language_id.languages(docs).collect()
    assert len(out) == len(rows) + 2 and all(isinstance(r["score"], float) for r in out)


def test_language_id_backs_off(spark):
    docs = make(spark, [(1, "abcde"), (2, "vwxyz")], ["en", "de"])
    model = language_id.train(docs)
    assert model.predict(["zabcd", "bxyz", "v"])[0] == ["en", "de", "de"]


def test_language_id_learns_every_label(spark):
    texts = [(k, "the cat sat on the mat") for k in range(400)] + [(1000, "zzyx qwvk jjpq")] + [(2000 + k, f"w{chr(97 + k % 26)}{chr(97 + k // 26)}q") for k in range(230)] + [(3000 + k, "der hund und die katze") for k in range(50)]
    docs = make(spark, texts, ["en"] * 400 + ["aa-rare"] + [f"l{k:03}" for k in range(230)] + ["zz"] * 50)
    model = language_id.train(docs, sample_rows=20)
    assert model.predict(["zzyx jjpq", "der hund", "the mat", "waaq"])[0] == ["aa-rare", "zz", "en", "l000"]


# --- 3 --------------------------------------------------------------------------------------------


def test_best_fit_decreasing():
    rnd = random.Random(1)
    for _ in range(100):
        cap = rnd.choice([7, 20, 50])
        lengths = sorted((rnd.randint(1, cap) for _ in range(rnd.randint(1, 100))), reverse=True)
        room = []
        for x in lengths:
            fits = [i for i, r in enumerate(room) if r >= x]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= x
            else:
                room.append(cap - x)
        counts = Counter(lengths)
        plan = packing.best_fit_decreasing(counts, cap)
        size = np.array([x for x in counts for _ in range(counts[x])])
        bins, offset = plan.place(size, np.array([k for x in counts for k in range(counts[x])]))
        assert sorted(cap - np.bincount(bins, weights=size)) == sorted(room)
        for b in set(bins):
            at = sorted(np.flatnonzero(bins == b), key=lambda i: offset[i])
            assert [offset[i] for i in at] == list(np.cumsum([size[i] for i in at]) - [size[i] for i in at])


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_word_tokenizer():
    path, t = tokenizer()
    own = packing.WordTokenizer(path)
    texts = ["", "Hello  World's it's 123\n\tx", "É́ <|endoftext|> z<|startoftext|>q <|ENDOFTEXT|>. ΑΣ.", "a\x1cb\x85c d", "J̌. J̌ don't, U.S.A.. ....  .a 3. İ? ﬁ!", "日本語 😀"]
    import pyarrow as pa

    data, off = packing.text_bytes(pa.array(texts))
    for _ in range(2):
        ids, n = own.encode(data, off)
        at = np.append(0, np.cumsum(n))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_packing(spark):
    path, t = tokenizer()
    rows = awkward(3, 20)
    got = packing.pack_documents(make(spark, [*rows, (None, "x")]), path, capacity=256, with_ids=True).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    whole = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(whole[r["doc_id"]]) and r["length"] == len(r["ids"]) <= 256
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        whole[r["doc_id"]] += r["ids"]
    assert dict(whole) == ids
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([n for _, n in parts]) - [n for _, n in parts]) and sum(n for _, n in parts) <= 256
    assert len(by) <= sum(map(len, ids.values())) / 256 * 1.1 + 1
    assert packing.pack_documents(make(spark, rows).limit(0), path).count() == 0


def test_packing_repeated_rows_and_long_texts(spark):
    """Repeated rows are packed as often as they come; a length that nearly all pieces have is ranked over many tasks."""
    path, t = tokenizer()
    rows = [(1, "one two"), (1, "one two"), (1, "three"), (2, None), (2, None), (3, "word " * 20_000), *[(10 + k, "same length here") for k in range(300)]]
    docs = make(spark, rows).repartition(7).withColumn("k", F.lit("x")).withColumn("task", F.lit(1))
    got = packing.pack_documents(docs, path, capacity=64).collect()
    count = Counter((r["doc_id"], r["start"], r["length"]) for r in got)
    size = lambda x: len(t.encode(x or "", add_special_tokens=False).ids) + 1
    want = Counter()
    for i, x in rows:
        n = size(x)
        want.update((i, s, min(64, n - s)) for s in range(0, n, 64))
    assert count == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([n for _, n in parts]) - [n for _, n in parts]) and sum(n for _, n in parts) <= 64


# --- 4 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 2, 3])
def test_line_dedup(spark, k):
    rnd = random.Random(k)
    rows = [(i, "\n".join(rnd.choice(["a", "b", "c", "", f"u{i}"]) for _ in range(rnd.randint(1, 12)))) for i in range(80)] + [(200, None), (201, "")]
    seen, want = set(), {}
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        gone = set()
        for p in range(len(lines) - k + 1):
            w = tuple(lines[p : p + k])
            if w in seen:
                gone |= set(range(p, p + k))
            seen.add(w)
        kept = None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone)
        want[i] = (kept, len(lines), len(gone), sum(p in gone and p - 1 not in gone for p in range(len(lines))))
    docs = make(spark, [*rows, (None, "a\nb\nc\na")])
    out = line_dedup.remove_repeated_lines(docs, min_lines=k).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"], r["n_runs"]) for r in out} == want
    assert all(r["_text"] == "x" for r in out)
    assert line_dedup.remove_repeated_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("k", [4, 7, 40])
def test_line_dedup_longer_runs(spark, k):
    """Runs of 2 to 60 lines that occur again, taken from k lines on; a very common line and a long text among them."""
    rnd = random.Random(k)
    source = [[f"s{s} {p}" for p in range(80)] for s in range(4)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            n, s = rnd.randint(2, 60), rnd.choice(source)
            at = rnd.randrange(80 - n)
            lines += [f"own {i} {rnd.random()}"] * rnd.randint(0, 2) + s[at : at + n] + [""] * rnd.randint(0, 50)
        rows.append((i, "\n".join(lines)))
    rows.append((100, "\n".join(f"l{p % 3000}" for p in range(9000))))
    seen, want = set(), {}
    for i, t in rows:
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - k + 1):
            w = tuple(lines[p : p + k])
            if w in seen:
                gone |= set(range(p, p + k))
            seen.add(w)
        want[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone)
    out = line_dedup.remove_repeated_lines(make(spark, rows).withColumn("n_runs", F.lit("x")), min_lines=k).collect()
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in out} == want and all(isinstance(r["n_runs"], int) for r in out)


def test_line_dedup_versions(spark):
    """One id with several texts: documents of their own, in the order of the texts' hashes."""
    texts = ["a\nb\nc", "x\na\nb", "b\nc\nd\ne"]
    order = sorted(spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t) as h", "t").collect())
    rows = [(1, r["t"]) for r in order] + [(2, "d\ne\na\nb")]
    seen, want = set(), []
    for i, t in rows:
        lines = t.split("\n")
        gone = {q for p in range(len(lines) - 1) if tuple(lines[p : p + 2]) in seen for q in (p, p + 1)}
        seen |= {tuple(lines[p : p + 2]) for p in range(len(lines) - 1)}
        want.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    out = line_dedup.remove_repeated_lines(make(spark, [(1, texts[0]), (1, texts[1]), (1, texts[2]), (1, texts[1]), (2, rows[-1][1])])).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(want) + Counter([next(w for w, r in zip(want, rows, strict=True) if r[1] == texts[1])])


def test_line_dedup_repeated_rows(spark):
    docs = make(spark, [(1, "a\nb"), (1, "a\nb"), (2, "a\nb")])
    assert sorted((r["doc_id"], r["n_removed"]) for r in line_dedup.line_report(docs).collect()) == [(1, 0), (1, 0), (2, 2)]


def test_line_dedup_long_lines(spark):
    long_, edge = " ".join(f"w{k}" for k in range(51)), " ".join(f"v{k}" for k in range(50))
    rows = [(1, f"a\n{long_}\n{edge}\nb"), (2, long_), (3, f"c\n{long_}\nd"), (4, edge), (5, f"e\n\n{long_}\n{edge}\nb\nf\n{long_}"), (6, "")]
    out = {r["doc_id"]: (r["text"], r["n_removed"], r["n_runs"]) for r in line_dedup.remove_repeated_lines(make(spark, rows), long_words=50).collect()}
    assert out == {1: (rows[0][1], 0, 0), 2: ("", 1, 1), 3: ("c\nd", 1, 1), 4: (edge, 0, 0), 5: ("e\n\nf", 4, 2), 6: ("", 0, 0)}
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.remove_repeated_lines(make(spark, rows)).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 3, 6: 0}


# --- 5 --------------------------------------------------------------------------------------------


def test_rake():
    table = np.random.default_rng(0).random((4, 3, 2)) * 100
    goals = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]), np.array([0.6, 0.4])]
    x = mixing.rake(table, goals).shares
    for axis, g in enumerate(goals):
        assert np.allclose(x.sum(axis=tuple(k for k in range(3) if k != axis)), g)
    # raking keeps the odds ratios of what it started from
    odds = lambda t: t[0, 0, 0] * t[1, 1, 0] / (t[0, 1, 0] * t[1, 0, 0])
    assert np.isclose(odds(x), odds(table))
    p, w = mixing.probabilities(table, x, 0.4)
    assert np.isclose((table * p).sum(), 0.4 * table.sum()) and p.max() <= 1
    assert np.allclose(table * p * w / (table * p * w).sum(), x)


def test_mix_sources(spark):
    rnd = random.Random(0)
    rows = [(k, "x " * rnd.randint(1, 40) + "y", rnd.choice(["en", "de", None]), "hot" if k % 3 else f"s{k % 4}", None, k, "x", k) for k in range(6000)] + [(None, None, None, None, None, 0, "x", 0), (9000, "", "en", "hot", None, 0, "x", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = {"source": {"hot": 0.4, "s0": 0.3, "s1": 0.1, "s2": 0.1, "s3": 0.1}, "lang": {"en": 0.5, "de": 0.5}}
    out = mixing.mix_sources(docs, targets, keep=0.3).collect()
    tokens = Counter()
    for r in out:
        tokens[r["source"]] += r["n_tokens"] * r["weight"]
    total = sum(tokens.values())
    assert all(abs(tokens[s] / total - t) < 0.05 for s, t in targets["source"].items())
    assert sum(r["n_tokens"] for r in out) == pytest.approx(0.3 * sum(len((r[1] or "").split(" ")) if r[1] else 0 for r in rows), rel=0.06)
    assert {tuple(r) for r in out} == {tuple(r) for r in mixing.mix_sources(docs, targets, keep=0.3).collect()}
    assert mixing.mix_documents(docs.limit(0)).count() == 0 and mixing.mix_documents(docs).count() > 0
    assert mixing.mix_sources(docs.limit(0), targets).count() == 0


def test_mix_sources_fits_only_what_occurs(spark):
    """20,000 sources by 500 languages would be a table of ten million cells; 60 occur."""
    rows = [(k, "x " * (1 + k % 5), f"l{k % 20}", f"s{k % 30}", None, k, "x", k) for k in range(6000)]
    targets = {"source": {f"s{i}": 1.0 + (i % 3) for i in range(20_000)}, "lang": {f"l{i}": 1.0 for i in range(500)}}
    out = mixing.mix_sources(spark.createDataFrame(rows, DOCS), targets, keep=0.4).collect()
    want = Counter()
    for r in rows:
        want[r[3], r[2]] += len(r[1].split())
    assert len(want) == 60
    share = Counter()
    cells = {(r["source"], r["lang"]): r["probability"] * r["weight"] * want[r["source"], r["lang"]] for r in out}
    for (s, _), x in cells.items():
        share[int(s[1:]) % 3] += x / sum(cells.values())
    assert len(cells) == 60 and [share[i] for i in range(3)] == pytest.approx([1 / 6, 2 / 6, 3 / 6], rel=1e-6)


@pytest.mark.parametrize("most", [200_000, 0])
def test_mix_documents_fits_every_source(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", most)
    rows = [(1000 * s + k, "x " * (s % 7) + "y", "en", f"s{s}", None, 0, "x", 0) for s in range(300) for k in range(8 + s % 11)]
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    out = mixing.mix_documents(spark.createDataFrame(rows, DOCS)).collect()
    rate = {r["source"]: r["probability"] * r["weight"] * size[r["source"]] ** 0.5 for r in out}
    assert len(rate) > 290 and max(rate.values()) == pytest.approx(min(rate.values()), rel=1e-6)
    assert sum(r["n_tokens"] for r in out) == pytest.approx(0.5 * sum(size.values()), rel=0.1)


def test_mix_documents_same_on_driver_and_cluster(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(k, "x " * int(rnd.choice([3, 300, 1500]) * rnd.random()) + "y", rnd.choice(["en", "en", "de", None]), rnd.choice(["a", "a", "a", "b", "c", None]), None, 0, "x", 0) for k in range(600)]
    docs = spark.createDataFrame([*rows, (9000, "", "fr", "d", None, 0, "x", 0)], DOCS)
    here = {r["doc_id"]: (r["probability"], r["weight"]) for r in mixing.mix_documents(docs, keep=0.7).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    there = {r["doc_id"]: (r["probability"], r["weight"]) for r in mixing.mix_documents(docs, keep=0.7).collect()}
    assert set(here) == set(there) and all(there[k] == pytest.approx(v, rel=1e-5) for k, v in here.items())
    assert any(w > 1 for _, w in here.values()) or any(p < 1 for p, _ in here.values())


def test_mix_documents_by_definition(spark):
    """Cells raked to the roots of the margins' tokens by plain loops, the rate by bisection, the draw by the hash of the id."""
    rnd = random.Random(7)
    rows = [(k, rnd.choice([" ", "\n", "\t "]).join(["wörd"] * int(rnd.choice([3, 300, 1500]) * rnd.random())), rnd.choice(["en", "en", "de", None]), rnd.choice(["hot", "hot", "a", "b", None]), None, 0, "x", 0) for k in range(400)]
    rows += [(1000, None, "en", "hot", None, 0, "x", 0), (1001, "  ", "en", "a", None, 0, "x", 0), (1002, "x " * 100_000, "fr", "long", None, 0, "x", 0), rows[0], rows[0]]
    topic = lambda n: "note" if n < 500 else "short" if n < 2000 else "article" if n < 8000 else "long"
    cell_of = lambda r: (r[3], r[2], topic(len(r[1] or "")))
    tokens = lambda r: len((r[1] or "").split())
    cells = Counter()
    for r in rows:
        cells[cell_of(r)] += tokens(r)
    cells = {c: n for c, n in cells.items() if n}
    total = sum(cells.values())
    goals = []
    for axis in range(3):
        own = Counter()
        for c, n in cells.items():
            own[c[axis]] += n
        rest = own[None] / total
        roots = sum(n**0.5 for v, n in own.items() if v is not None)
        goals.append({v: rest if v is None else n**0.5 / roots * (1 - rest) for v, n in own.items()})
    share = {c: n / total for c, n in cells.items()}
    for _ in range(3000):
        for axis, goal in enumerate(goals):
            own = Counter()
            for c, x in share.items():
                own[c[axis]] += x
            share = {c: x * goal[c[axis]] / own[c[axis]] for c, x in share.items()}
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(n, mid * share[c]) for c, n in cells.items()) < 0.5 * total else (lo, mid)
    want = Counter()
    for r in rows:
        c = cell_of(r)
        raw = hi * share[c] / cells[c] if c in cells else 0.5
        u = xxhash_chain(r[0], 0, small=(1,)) % (1 << 53) / (1 << 53)
        assert abs(u - min(1, raw)) > 1e-5
        if u < raw:
            want[r[0], tokens(r), round(min(1, raw), 5), round(max(1, raw) if c in cells else 1, 5)] += 1
    docs = spark.createDataFrame(rows, DOCS).withColumn("weight", F.lit("x"))
    got = Counter((r["doc_id"], r["n_tokens"], round(r["probability"], 5), round(r["weight"], 5)) for r in mixing.mix_documents(docs).collect())
    assert got == want


# --- 6 --------------------------------------------------------------------------------------------


def test_chat(spark):
    public = pytest.importorskip("public_tokenizers")
    odd = ["\\### Assistant: </turn> ok", "", None, "\\\\###\\", "####", "</turn></turn>", "é\n日本 😀 ", "### ", "x" * 20_000, "\\</turn>"]
    rnd = random.Random(0)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "a: </turn>"]), rnd.choice(odd), "x") for c in range(30) for t in range(rnd.randint(1, 6))]
    rows += [(5, 0, "user", "again", "x"), (None, 0, "user", "gone", "x"), (40, None, "assistant", "first", "x"), (40, 1, "assistant", "second", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")
    args = public.path("byte_bpe_50k.tiktoken"), public.PATTERN
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    del by[None]
    got = {r["conv_id"]: r for r in chat.conversation_report(turns, *args).collect()}
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(ts), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in ts).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert all(chat.unescape(chat.escape(x or "")) == (x or "") for x in odd)
    assert chat.conversation_report(turns.limit(0), *args).count() == 0


def test_chat_long_runs(spark):
    """Runs that the tokenizer's pattern would take as one piece, a million long, and roles that look like markers."""
    public = pytest.importorskip("public_tokenizers")
    args = public.path("byte_bpe_50k.tiktoken"), public.PATTERN
    texts = [" " * 1_000_000, "\n" * 1_000_000, "x" * 1_000_000, "日" * 300_000, "a b\n" * 200_000, "###" * 10_000, "." * 5000 + " \t" * 3000]
    rows = [(k, t, r, x) for k, x in enumerate(texts) for t, r in enumerate(("a: b", "assistant", "x\\: ###"))]
    got = {r["conv_id"]: r for r in chat.conversation_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), *args).collect()}
    for k, x in enumerate(texts):
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for c, _, r, _ in rows if c == k).encode()).hexdigest()
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(x), hashlib.sha256(x.encode()).hexdigest())
    t = chat.ByteTokenizer(*args)
    words = " ".join(f"word{k}  {k}\n" for k in range(5000))
    assert t.encode(words) == t.encoding.encode_ordinary(words)
    assert all(not re.search(r"(?<!\\)(\\\\)*:", chat.escape(r, True)) and chat.unescape(chat.escape(r, True)) == r for r in ("a: b", "x\\: ###", ":", "\\:"))


# --- 7 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rules", [500_000, 0])
def test_url_filters(spark, monkeypatch, rules):
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", rules)
    entries = [("bad.org", "spam", True, 10), ("bad.org", "spam", False, 20), ("bad.org", "spam", True, 30), ("x.bad.org", "adult", True, 5), ("BAD.org", "adult", True, 15), ("eq.org", "spam", True, 10), ("eq.org", "spam", False, 10), (None, "spam", True, 1), ("y.org", None, True, 1), ("y.org", "spam", True, None)]
    urls = ["http://bad.org/a", "https://u:p@X.Bad.org.:80/b?c#d", "http://notbad.org", "ftp://eq.org", "nonsense", "", None, "http://y.org", "http://a.x.bad.org"]
    caps = [(i * 100 + t, u, t, "x") for i, u in enumerate(urls) for t in (4, 5, 10, 19, 20, 31)] + [(9999, "http://bad.org/a", None, "x"), (None, "http://bad.org", 10, "x"), (0, "http://bad.org", 10, "x")]
    got = url_filters.filter_urls(spark.createDataFrame(caps, "page_id long, url string, fetched int, rule string"), spark.createDataFrame(entries, "rule string, category string, listed boolean, at int")).collect()

    def active(u, t):
        m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", u or "")
        host = (m[1] if m else "").rstrip(".").lower()
        if not host or t is None:
            return []
        out = []
        for rule, cat, last in {(e[0], e[1], None) for e in entries if None not in e}:
            if host == rule.lower() or host.endswith("." + rule.lower()):
                then = [e for e in entries if e[:2] == (rule, cat) and e[3] <= t]
                if then and all(e[2] for e in then if e[3] == max(x[3] for x in then)):
                    out.append(cat)
        return out

    want = Counter((i, t, len(active(u, t)), ",".join(sorted(set(active(u, t))))) for i, u, t, _ in caps)
    assert Counter((r["page_id"], r["fetched"], r["n_rules"], r["categories"]) for r in got) == want
    assert all(r["blocked"] == (r["n_rules"] > 0) for r in got)


def test_url_filters_hosts_and_rules(spark):
    """A rule's case and final dot are no part of it; users, ports and brackets no part of a host; empty tables and long URLs."""
    entries = spark.createDataFrame([("BAD.org.", "spam", True, 10), ("bad.org", "spam", False, 20), ("[::1]", "adult", True, 1), ("", "spam", True, 1)], "rule string, category string, listed boolean, at int")
    urls = ["http://a@b@bad.org/", "http://[::1]:80/x", "http://bad.org/" + "x" * 1_000_000, "http://u:p@x.BAD.org:8080?q@r", "http://ok.org/@bad.org"]
    caps = spark.createDataFrame([(10 * k + i, u, t) for k, u in enumerate(urls) for i, t in enumerate((12, 25))], "page_id long, url string, fetched int")
    got = {r["page_id"]: (r["host"], r["categories"]) for r in url_filters.filter_urls(caps, entries).collect()}
    assert got == {0: ("bad.org", "spam"), 1: ("bad.org", ""), 10: ("[::1]", "adult"), 11: ("[::1]", "adult"), 20: ("bad.org", "spam"), 21: ("bad.org", ""), 30: ("x.bad.org", "spam"), 31: ("x.bad.org", ""), 40: ("ok.org", ""), 41: ("ok.org", "")}
    assert url_filters.filter_urls(caps.limit(0), entries).count() == 0
    assert not any(r["blocked"] for r in url_filters.filter_urls(caps, entries.limit(0)).collect())


def test_tasks_give_freed_memory_back():
    anon = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    kept = []

    def run(batches):
        held = [np.ones(12_000) for _ in range(1000)]  # 96 MB, in pieces that stand on the heap
        kept.append(np.ones(12_000))
        yield from batches
        assert len(held) == 1000

    before = anon()
    assert list(tidy(run)(iter([]))) == [] and anon() - before < 40


# --- 8 --------------------------------------------------------------------------------------------


def test_expansion_finds_repeats():
    rnd = random.Random(5)
    for _ in range(60):
        length = rnd.choice([3, 5, 8])
        parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(length, 30))) for _ in range(rnd.randint(1, 8))]
        seen, want = set(), set()
        for i, p in enumerate(parts):
            for s in range(len(p) - length + 1):
                if p[s : s + length] in seen:
                    want.add((i, s))
                seen.add(p[s : s + length])
        ids, start = suffix_dedup.repeated_starts(parts, np.arange(len(parts)), np.zeros(len(parts), int), length)
        assert set(zip(ids.tolist(), start.tolist(), strict=True)) == want


@pytest.mark.parametrize("length", [40, 100])
def test_suffix_dedup(spark, length):
    rows = awkward(8, 30) + [(500, "a" * 700), (501, "ab" * 300), (502, "a" * 99), (503, "\0" * 250)]
    seen, want = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(b[s : s + length])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    docs = make(spark, [*rows, (None, "a" * 300)])
    assert {r[0]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, length=length).collect()} == want
    full = suffix_dedup.remove_repeats(docs, length=length, with_text=True).collect()
    assert all(len(r["removed"]) == 2 * r["n_spans"] for r in full)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def brute_repeats(rows, length):
    """(n_bytes, n_removed, n_spans, digest) of each (id, text), which are in order."""
    seen, out = set(), []
    for _, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(b[s : s + length])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_dedup_repeated_rows(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    a, b, c = text(490), text(300), text(150)
    got = suffix_dedup.remove_repeats(make(spark, [(1, a), (1, a), (1, a), (2, b + a[:200])])).collect()
    one, two = brute_repeats([(1, a), (2, b + a[:200])], 100)
    assert sorted(tuple(r)[1:] for r in got if r[0] == 1) == [one] * 3 and [tuple(r)[1:] for r in got if r[0] == 2] == [two]
    # one id with different texts: documents of their own, in the order of the texts' hashes
    odd = [(5, a + b), (5, c + b), (5, c + b), (5, None), (5, "")]
    order = {t: h for t, h in [(r["text"], r["h"]) for r in spark.createDataFrame(odd, "id long, text string").selectExpr("text", "xxhash64(text) as h").collect()]}
    rows = [(4, c), *[(5, t) for t in sorted(order, key=order.get)], (6, b)]
    want = Counter(zip([i for i, _ in rows], brute_repeats(rows, 100), strict=True))
    want[5, brute_repeats(rows, 100)[[t for _, t in rows].index(c + b)]] += 1
    got = suffix_dedup.remove_repeats(make(spark, [*odd, (4, c), (6, b)]), with_text=True).collect()
    assert Counter((r[0], tuple(r)[1:5]) for r in got) == want
    assert all(len(r["kept_text"].encode()) == r["n_bytes"] - r["n_removed"] for r in got)


def test_suffix_dedup_hot_anchors_and_windows(spark, monkeypatch):
    """One passage that every document continues in its own way, dealt on over many blocks; long texts in windows."""
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 900)
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(0, 60))) + passage + " ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    want = brute_repeats(rows, 100)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(make(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == want
    monkeypatch.setattr(suffix_dedup, "WINDOW", 150)
    pieces = [x[2:] for x in suffix_dedup._windows(np.arange(400, dtype=np.int64).astype(np.uint8), np.array([0, 400]), 100)]
    assert [(p[0], len(p), o.tolist(), at) for p, o, at in pieces] == [(0, 249, [0, 249], 0), (150, 249, [0, 249], 150), (44, 100, [0, 100], 300)]


def test_suffix_dedup_hot_anchors_blocks_are_bounded(spark, monkeypatch, tmp_path):
    """Strings dealt on come to more bytes than their stretches; one that all share comes many times."""
    bound = 20_000
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", bound)
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = text(120)
    rows = [(i, text(50) + passage + text(50)) for i in range(400)]
    expander, plain = suffix_dedup._expander, suffix_dedup.repeated_starts

    def watched(length):
        run = expander(length, 1)

        def seen(parts, *rest):
            with open(f"{tmp_path}/{os.getpid()}", "a") as f:
                f.write(f"{sum(map(len, parts))}\n")
            return plain(parts, *rest)

        def task(batches):
            run.__globals__["repeated_starts"] = seen
            yield from run(batches)

        return task

    monkeypatch.setattr(suffix_dedup, "_expander", watched)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(make(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == brute_repeats(rows, 100)
    sizes = [int(x) for f in tmp_path.iterdir() for x in f.read_text().split()]
    assert len(sizes) > 1 and max(sizes) < 2 * bound


@pytest.mark.parametrize("length", [64, 256, 290, 400])
def test_suffix_dedup_any_length(spark, length):
    rnd = random.Random(length)
    base = ["".join(rnd.choice("abcdef") for _ in range(1500)) for _ in range(3)]
    rows = list(enumerate([*base, *[b[100:1300] for b in base], *["".join(rnd.choice("abcdef") for _ in range(40)) + b[50:900] for b in base]]))
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(make(spark, rows), length=length).collect()}
    assert [got[i] for i, _ in rows] == brute_repeats(rows, length)


def test_suffix_dedup_long_lengths(spark):
    rnd = random.Random(12)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(3000)) for _ in range(6)]
    length = 700
    rows = list(enumerate([*texts, *[t[200:2600] for t in texts], *["".join(rnd.choice("abcdefgh") for _ in range(50)) + t[100:1500] for t in texts]]))
    seen, want = set(), {}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if t[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(t[s : s + length])
        want[i] = int(gone.sum())
    got = suffix_dedup.remove_repeats(make(spark, rows), length=length)
    column = next(c for c in got.columns if c in ("n_removed", "removed_bytes", "n_removed_bytes"))
    assert {r["doc_id"]: r[column] for r in got.collect()} == want and sum(want.values()) > 0


# --- 9 --------------------------------------------------------------------------------------------


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 3)
    monkeypatch.setattr(imatch, "RANGES", 4)
    rows = awkward(9, 30)
    rows = [(i * 3 - 50 if i < 40 else 10**18 + i * i if i < 100 else 2**63 - 1000 + i, t) for i, t in rows]
    docs = make(spark, [*rows, (None, "no id")])
    got = {r["doc_id"]: r for r in imatch.edit_report(docs, idf=(0.0, 9.0)).collect()}
    assert len(got) == len(rows)
    by_text = defaultdict(set)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        by_text[t].add(got[i]["fingerprint"])
        by_text[edited].add(got[i]["edited_fingerprint"])
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert t != edited or got[i]["near_edited"] == 1
    assert all(len(f) == 1 for f in by_text.values())
    assert imatch.edit_report(docs.limit(0)).count() == 0
    one = imatch.edit_report(make(spark, [(1, "alone here")])).first()
    assert one["near_next"] == 1.0


def xxhash(data):
    import xxhash as x

    h = x.xxh64_intdigest(data, seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def brute_slots(texts, idf):
    """{text: {(tier, subset): digest}} by the definition of the fingerprint."""
    words = [{w for w in re.split(r"[\s!-/:-@\[-`{-~]+", t.lower(), flags=re.ASCII) if w} for t in texts]
    df = Counter(w for ws in words for w in ws)
    n = len(texts)
    band = {w for w, c in df.items() if n * np.exp(-idf[1]) <= c <= n * np.exp(-idf[0])}
    number = {w: xxhash_chain(xxhash(w.encode()), 7, small=(1,)) for w in band}
    out = {}

    def slots(text):
        if text not in out:
            ws = {w for w in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower(), flags=re.ASCII) if w} & band
            by = defaultdict(list)
            for x in sorted(number[w] for w in ws):
                u = x % (1 << 64)
                for tier in range(4):
                    if (u >> (59 - 2 * tier)) % 4**tier == 0:
                        by[tier, u >> 59].append(x)
            out[text] = {}
            for key, xs in by.items():
                h = 0
                for x in xs:
                    h = xxhash_chain(h, x)
                out[text][key] = h % 4095 + 1
        return out[text]

    return slots


def xxhash_chain(*values, small=()):
    """The hash of several numbers: each one's with the hash so far as the seed; small: the places of those of 4 bytes."""
    import xxhash as x

    seed = 42
    for k, v in enumerate(values):
        seed = x.xxh64_intdigest(int(v).to_bytes(4 if k in small else 8, "little", signed=True), seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def test_fingerprints_by_definition(spark):
    rows = [(i, (t or "").replace("é", "e")) for i, t in awkward(10, 40)] + [(1000, "Only-once, and: {braces} [w1] w2 w3!"), (1001, "w5 w6 w7 ~ w8")]
    idf = (0.3, 4.0)
    slots = brute_slots([t for _, t in rows], idf)
    got = {r["doc_id"]: r for r in imatch.edit_report(make(spark, rows), idf=idf).collect()}

    def name(t):
        s = slots(t)
        if not s:
            return "t:" + hashlib.sha256(t.encode()).hexdigest()
        signed = lambda k: k - 32 if k >= 16 else k
        return "/".join("".join(f"{k * 4096 + s[tier, k]:05x}" for k in sorted((k for t2, k in s if t2 == tier), key=signed)) for tier in range(4))

    def like(a, b):
        if a == b:
            return 1.0
        a, b = slots(a), slots(b)
        tiers = [({k for k in {*a, *b} if k[0] == t}, t) for t in range(4)]
        for most in (21, 32):
            some = [k for ks, _ in tiers if len(ks) <= most for k in ks]
            if some:
                return sum(a.get(k) == b.get(k) for k in some) / len(some)
        return 0.0

    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (name(t), name(edited))
        assert r["near_edited"] == pytest.approx(like(t, edited)) and r["near_next"] == pytest.approx(like(t, after))
    own = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(make(spark, rows), idf=idf).collect()}
    assert own == {i: got[i]["fingerprint"] for i, _ in rows}


def test_fingerprints_repeated_ids(spark):
    rows = [(1, "b one two"), (1, "a one"), (1, "b one two"), (2, "c"), (2, None)]
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in imatch.edit_report(make(spark, rows)).collect())
    order = sorted((i, t or "") for i, t in rows)
    want = Counter()
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + order[(k + 1) % 5][1][:half]).encode()).hexdigest()] += 1
    assert got == want


# --- 10 -------------------------------------------------------------------------------------------


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 32))
    v = np.concatenate([base, *[base + rng.standard_normal(base.shape) * s for s in (0.1, 0.3, 0.42, 0.45)], base[:20], np.repeat(base[:1], 40, axis=0), base[:1] + rng.standard_normal((200, 32)) * 0.02]).astype(np.float32)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    odd = [(9001, None, 0), (9002, [0.0] * 32, 0), (9003, [float("nan")] + [1.0] * 31, 0), (9004, [None] + [1.0] * 31, 0), (9005, [1.0], 0), (9006, [2.0], 0), (9007, [], 0), (None, [1.0] * 32, 0)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    x = v.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    found = np.array([got[i]["n_links"] for i in range(len(v))])
    assert (found <= links.sum(axis=1)).all() and found.sum() >= 0.9 * links.sum()
    want = groups(range(len(v)), zip(*np.nonzero(links), strict=True))
    assert np.mean([got[i]["component_id"] == want[i] for i in range(len(v))]) > 0.98
    assert [got[i]["n_links"] for i in (9001, 9002, 9003, 9004, 9007)] == [0] * 5 and got[9006]["component_id"] == 9005
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_near_vectors_exact_and_blocks(spark, monkeypatch):
    """All pairs by one-bit substrings, in blocks; doubles that floats can't tell apart; repeated ids; a hot vector."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 8))
    v = np.concatenate([base, base + rng.standard_normal(base.shape) * 0.3, base[:30] * (1 + 1e-12), np.repeat(base[:1], 250, axis=0)])
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    rows = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(v)], "vec_id long, embedding array<double>")
    for args in ({"exact": True}, {"width": 6}):
        got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(rows, **args).collect()}
        found = np.array([got[i]["n_links"] for i in range(len(v))])
        assert (found == links.sum(axis=1)).all() if "exact" in args else ((found <= links.sum(axis=1)).all() and found.sum() >= 0.98 * links.sum())
        if "exact" in args:
            want = groups(range(len(v)), zip(*np.nonzero(links), strict=True))
            assert {i: r["component_id"] for i, r in got.items()} == want
    two = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.0, -1.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in embedding_dedup.near_vectors(two, exact=True).collect()} == {(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)}


@pytest.mark.parametrize("width,mean", [(12, 0.6), (16, 0.6), (16, 0.75)])
def test_near_vectors_off_centre_at_any_width(spark, width, mean):
    rng = np.random.default_rng(width)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    m = np.zeros(64)
    m[0] = mean
    a = unit(m + np.sqrt(1 - mean**2) * unit(rng.standard_normal((600, 64))))
    cos = rng.uniform(0.902, 0.93, 600)[:, None]
    u = rng.standard_normal(a.shape)
    u = unit(u - (u * a).sum(axis=1, keepdims=True) * a)
    v = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * u]).astype(np.float32)
    x = unit(v.astype(float))
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    rows = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(v)], "vec_id long, embedding array<float>")
    found = np.array([r["n_links"] for r in embedding_dedup.near_vectors(rows, width=width).orderBy("vec_id").collect()])
    assert (found <= links.sum(axis=1)).all() and found.sum() >= 0.98 * links.sum() > 0


def test_near_vectors_of_the_table_drawn_to_neighbours(spark, sf_dir):
    """The table's vectors, which have no links, and each drawn towards the next one of its label, so far that it has one or just has none."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("label", "vec_id").toPandas()
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(np.stack(t["embedding"]).astype(float))
    after = np.roll(np.arange(len(a)), -1)
    u = unit(a[after] - (a[after] * a).sum(axis=1, keepdims=True) * a)
    cos = np.random.default_rng(1).uniform(0.89, 0.93, len(a))[:, None]
    x = unit(np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * u]).astype(np.float32).astype(float))
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    rows = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "vec_id long, embedding array<double>")
    found = np.array([r["n_links"] for r in embedding_dedup.near_vectors(rows).orderBy("vec_id").collect()])
    assert (found <= links.sum(axis=1)).all() and found.sum() >= 0.97 * links.sum() > 0
