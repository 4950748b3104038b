"""The corpus pipeline, stage by stage against brute-force versions, and as a whole."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import queries

from .test_operators import groups, shingles, tokenizer

LANGS = {"en": "the of and to in is that for with was", "de": "der die und das nicht ein mit auch sich von", "fr": "le la et les des une est que pour dans"}


def corpus():
    rnd = random.Random(4)
    rows = []
    for i in range(150):
        lang = rnd.choice(list(LANGS))
        words = LANGS[lang].split() + [w + w[::-1] for w in LANGS[lang].split()]
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 15))) for _ in range(rnd.randint(1, 8))]
        rows.append([i, "\n".join(lines), lang if rnd.random() < 0.9 else None, f"src{min(i % 7, 2)}", len("\n".join(lines))])
    for i in range(20):  # near copies on one line, copies, copies of runs of lines
        rows.append([200 + i, rows[i][1].replace("\n", " ") + (" extra" if i % 2 else ""), rows[i][2], "src0", 0])
        rows.append([300 + i, rows[i][1], rows[i][2], "src1", 0])
        rows.append([400 + i, rows[i][1] + "\nlast line of its own " + str(i), rows[i][2], "src1", 0])
    return [*rows, [900, "!!! ??? 123", "en", "src0", 0], [901, None, "en", "src0", 0], [902, "", None, None, None]]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, spark.read.parquet(f"{path}/documents.parquet")


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: r[0])


def test_stages(spark, docs):
    path, frame = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "source_mix", "best_fit_packing"]
    before, steps = frame, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, path)
        assert after.columns == frame.columns
        steps.append(rows(after))
        before = spark.createDataFrame(steps[-1], frame.schema)
    given = rows(frame)

    one = {r[0]: r for r in steps[0]}
    assert set(one) == {r[0] for r in given} - {900, 901, 902}
    assert all(r[1] == one[r[0]][1] and r[2] in (None, one[r[0]][2]) for r in given if r[0] in one)
    assert np.mean([one[r[0]][2] in LANGS and set(r[1].split()) & set(LANGS[one[r[0]][2]].split()) != set() for r in given if r[0] in one]) > 0.98

    seen, want = set(), {}
    for i, text, *_ in steps[0]:
        lines, gone = text.split("\n"), set()
        for p in range(len(lines) - 1):
            if tuple(lines[p : p + 2]) in seen:
                gone |= {p, p + 1}
            seen.add(tuple(lines[p : p + 2]))
        if len(gone) < len(lines):
            want[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    assert {r[0]: r[1] for r in steps[1]} == want

    sets = {r[0]: shingles(r[1], 5) for r in steps[1]}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links and [r[0] for r in steps[2]] == sorted(i for i, c in groups(sets, links).items() if i == c)
    assert {r[0]: r for r in steps[1]}.items() >= {r[0]: r for r in steps[2]}.items()

    assert {r[0]: r for r in steps[2]}.items() >= {r[0]: r for r in steps[3]}.items()
    size = lambda rs: sum(len(r[1].split()) for r in rs)
    assert 0.6 * size(steps[2]) < size(steps[3]) < size(steps[2])

    _, t = tokenizer()
    packed = corpus_pipeline.STAGES[-1][1](spark, before, path).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in packed if r["length"] < 4096 and r["start"] == 0} == {r[0]: zlib.crc32(np.array([*t.encode(r[1], add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in steps[3]}
    room = defaultdict(int)
    for r in packed:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 4096 and len(room) == -(-sum(room.values()) // 4096)

    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["ids_crc32"]) for r in packed)


def test_stages_take_empty_tables(spark, docs):
    path, frame = docs
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), path).count() == 0


def test_stages_take_odd_rows(spark, docs):
    """Repeated rows, very long texts, nulls in any column and further columns with the operators' own names."""
    path, frame = docs
    given = [tuple(r) for r in frame.collect()][:60]
    long_ = " ".join(LANGS["en"].split()[k % 10] + "x" * (k % 7) for k in range(60_000)), "\n".join(f"the {k} of and" for k in range(5000))
    given += [given[0], given[0], (950, long_[0], "en", "src0", None), (951, long_[1], None, None, 7), (None, "the of and to", "en", None, None), (952, "the of and in", None, None, None)]
    names = ["score", "lang_pred", "n_lines", "n_removed", "n_tokens", "weight", "base", "_text", "id", "row"]
    now = spark.createDataFrame([(*r, *[f"{n} of {r[0]}" for n in names]) for r in given], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{n} string' for n in names)}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, path)
        assert now.columns == before.columns
        kept = [tuple(r) for r in now.collect()]
        assert kept and all(r[5:] == tuple(f"{n} of {r[0]}" for n in names) for r in kept) and {r[0] for r in kept} <= {r[0] for r in given}
        now = spark.createDataFrame(kept, now.schema)
    ids = [r["doc_id"] for r in now.collect()]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, path).collect()
    assert sorted(r["doc_id"] for r in packed if r["start"] == 0) == sorted(ids)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(queries.ORACLE_SQL[name]).fetchdf()[columns]
    assert sorted(map(tuple, got.select(columns).toPandas().astype(object).values.tolist()), key=str) == sorted(map(tuple, want.astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
