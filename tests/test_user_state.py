"""Interests and phrases together: reaction by reaction, shown and refilled, in batches and as a stream."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.wordpiece import ByteEncoder
from tessera.operators import interests as it
from tessera.operators import keyphrase as kp
from tessera.operators import user_state as us
from tessera.operators.phrase_book import HELD, SHOWN, STALE, Phrase, PhraseBook
from tessera.plans.ranker import Ranker
from tessera.streaming.user_state import user_state_stream

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
CONFIG = it.Config(threshold=0.9)


def encode(words):
    """A point that follows from the words alone."""
    rnd = random.Random(words)
    return np.array([rnd.uniform(-1, 1) for _ in range(3)])


def events(seed, n=60, users=3):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        kind = rnd.choice(["like"] * 6 + ["dislike", "view", "show", "show"])
        a = rnd.uniform(0, 2 * math.pi)
        point = [math.cos(a), math.sin(a), rnd.uniform(-0.2, 0.2)]
        words = [rnd.choice(["tea", "green tea", "mud!", "rain  ", "a b c", "x", "snow"]) for _ in range(rnd.randint(0, 4))]
        out.append((rnd.randrange(users), k, f"e{k}", kind, point, words, float(rnd.randint(0, 50)), rnd.randint(1, 4), START + timedelta(hours=7 * k)))
    return out


EVENTS = "user_id long, seq long, event_id string, kind string, embedding array<double>, candidates array<string>, seconds double, top int, at timestamp"


class Twin:
    """The fold by plain dictionaries: relevances an interest knows, phrases by relevance, phrases shown."""

    def __init__(self):
        self.pos, self.neg, self.knows, self.by, self.shown = [], [], {}, defaultdict(list), defaultdict(list)

    def add(self, coi, own, r, words):
        if own and self.knows.get(coi, (False, set()))[0]:
            self.knows[coi][1].add(r)
        else:
            self.knows[coi] = (own, {r})
        self.by[own, r, coi].append(words)

    def learn(self, coi, candidates):
        own, rs = self.knows.pop(coi["id"], (True, set()))
        self.shown.pop(coi["id"], None)
        known = sorted({w for r in rs for w in self.by.pop((own, r, coi["id"]), [])})
        phrases = kp.unify({w: encode(w) for w in known}, candidates, encode)
        for w, r in kp.select_phrases(phrases, coi["point"], CONFIG.max_key_phrases, CONFIG.gamma):
            self.add(coi["id"], True, r, w)

    def closest(self, cois, point):
        cos = [float(c["point"] @ point / (np.linalg.norm(c["point"]) * np.linalg.norm(point))) for c in cois]
        return (cois[int(np.argmax(cos))], max(cos)) if cois else (None, -9)

    def event(self, user, e):
        _, _, name, kind, point, words, seconds, top, at = e
        point = np.array(point)
        if kind in ("like", "dislike"):
            cois = self.pos if kind == "like" else self.neg
            coi, cos = self.closest(cois, point)
            if cos >= CONFIG.threshold:
                coi["point"] = 0.9 * coi["point"] + 0.1 * point
                coi["n"] += 1
                coi["at"] = at
            else:
                coi = {"id": f"{user}/{name}", "point": point, "n": 1, "t": 0.0, "at": at}
                cois.append(coi)
            if kind == "like":
                self.learn(coi, words)
        elif kind == "view" and self.pos:
            self.closest(self.pos, point)[0]["t"] += seconds
        elif kind == "show":
            return self.show(top, at)
        return []

    def show(self, top, at):
        if not any(self.by.values()):
            back, self.shown = self.shown, defaultdict(list)
            for coi, rows in back.items():
                for own, r, w in reversed(rows):
                    self.add(coi, own, r, w)
        n, t = sum(c["n"] for c in self.pos) + 2.0**-23, sum(c["t"] for c in self.pos) + 2.0**-23
        for c in self.pos:
            h, d = math.exp(-3), math.exp(-0.1 * (at - c["at"]).total_seconds() / 86400)
            r = max((c["n"] / n + c["t"] / t) * max((h - d) / (h - 1 - 2.0**-23), 0), 0)
            own, rs = self.knows.get(c["id"], (False, set()))
            moved = [w for x in sorted(rs) for w in self.by.pop((own, x, c["id"]), [])]
            self.knows[c["id"]] = (False, {r})
            self.by[False, r, c["id"]] += moved
        rows = [(r * p, own, r, coi, w) for own, r, coi in sorted(self.by) if any(c["id"] == coi for c in self.pos) for p, w in zip(CONFIG.penalty, self.by[own, r, coi][::-1], strict=False)]
        chosen = sorted(rows, key=lambda x: -x[0])[:top]
        for _, own, r, coi, w in chosen:
            self.by[own, r, coi].remove(w)
            self.shown[coi].append((own, r, w))
            if self.knows.get(coi, (None, set()))[0] == own:
                self.knows[coi][1].discard(r)
                if not self.knows[coi][1]:
                    del self.knows[coi]
        return [(w, round(s, 9)) for s, _, _, _, w in chosen]


def twin(rows):
    twins, shown = defaultdict(Twin), defaultdict(list)
    for e in rows:
        shown[e[0]] += [(e[2], *x) for x in twins[e[0]].event(e[0], e)]
    return twins, shown


def seen(row):
    return [(s["event_id"], s["words"], round(s["score"], 9)) for s in row["shown"]]


def same(row, t):
    """A state row and the twin's state: interests, live phrases by relevance, shown phrases."""
    for side, cois in (("pos", t.pos), ("neg", t.neg)):
        assert [(c["view_count"], c["view_time"]) for c in row[side]] == [(c["n"], c["t"]) for c in cois]
        assert np.allclose([list(c["point"]) for c in row[side]], [c["point"] for c in cois]) if cois else not row[side]
    ids = {c["coi_id"]: w["id"] for c, w in zip(row["pos"], t.pos, strict=True)}
    live = defaultdict(list)
    for p in row["phrases"]:
        if p["standing"] != SHOWN:
            live[p["own"], round(p["relevance"], 9), ids[p["coi_id"]]].append(p["words"])
    want = defaultdict(list)
    for (own, r, coi), words in t.by.items():
        want[own, round(r, 9), coi] += words
    assert live == {k: v for k, v in want.items() if v}
    gone = defaultdict(list)
    for p in row["phrases"]:
        if p["standing"] == SHOWN:
            gone[ids[p["coi_id"]]].append(p["words"])
    assert gone == {k: [w for _, _, w in v] for k, v in t.shown.items() if v}


@pytest.mark.parametrize("seed", range(3))
def test_reactions_in_order(spark, seed):
    """Interests move and are founded between reactions, phrases go where a reaction found the interest."""
    rows = events(seed)
    got = {r["user_id"]: r for r in us.advance(us.no_states(spark), spark.createDataFrame(rows, EVENTS), encode, CONFIG).collect()}
    twins, shown = twin(rows)
    assert set(got) == set(twins)
    for u, t in twins.items():
        same(got[u], t)
        assert seen(got[u]) == shown[u]
    assert any(shown.values()) and any(len(t.pos) > 2 for t in twins.values())


def test_states_go_on(spark):
    rows = events(7)
    once = us.advance(us.no_states(spark), spark.createDataFrame(rows, EVENTS), encode, CONFIG)
    first = us.advance(us.no_states(spark), spark.createDataFrame(rows[:25], EVENTS), encode, CONFIG)
    kept = spark.createDataFrame(first.drop("shown").collect(), us.STATES)
    second = us.advance(kept, spark.createDataFrame(rows[25:], EVENTS), encode, CONFIG)
    key = lambda f: sorted((r["user_id"], str(r["pos"]), str(r["neg"]), str(r["phrases"])) for r in f.collect())
    assert key(once) == key(second)
    idle = us.advance(kept, spark.createDataFrame([], EVENTS), encode, CONFIG)
    assert key(idle) == key(kept)
    interests, phrases = us.interests_of(kept), us.phrases_of(kept)
    again = us.states_of(interests, phrases)
    order = lambda f: sorted((r["user_id"], r["polarity"], r["coi_pos"], r["coi_id"], r["view_count"]) for r in f.collect())
    assert order(us.interests_of(again)) == order(interests) and us.phrases_of(again).count() == phrases.count()


def book(keep_stale):
    b = PhraseBook(keep_stale=keep_stale)
    for w, r in (("low", 0.2), ("mid", 0.5), ("top", 1.0)):
        b.put(Phrase("c", w, np.ones(1), True, r))
    return b


def test_a_leftover_keeps_its_relevance():
    b = book(True)
    assert [(p.words, s) for p, s in b.show({"c": 0.8}, 1, (1.0, 0.5))] == [("top", 0.8)]
    assert {p.words: (p.relevance, p.standing) for p in b.phrases} == {"top": (0.8, SHOWN), "low": (0.8, STALE), "mid": (0.8, STALE)}
    # the interest is worth less now; what is left of it isn't
    assert [(p.words, s) for p, s in b.show({"c": 0.1}, 1, (1.0, 0.5))] == [("mid", 0.8)]
    # a reaction takes what the interest knows and what was shown; the leftover stays
    b.learn("c", np.ones(1), ["new"], lambda w: np.ones(1), CONFIG)
    assert [(p.words, p.standing) for p in b.phrases] == [("low", STALE), ("new", HELD)]
    present = book(False)
    present.show({"c": 0.8}, 1, (1.0, 0.5))
    assert [(p.words, s) for p, s in present.show({"c": 0.1}, 1, (1.0, 0.5))] == [("mid", 0.1)]


def test_shown_phrases_come_back_in_their_order():
    b = book(True)
    first = [p.words for p, _ in b.show({"c": 0.8}, 3, (1.0, 0.75, 0.5))]
    assert first == ["top", "mid", "low"] and all(p.standing == SHOWN for p in b.phrases)
    assert [p.words for p, _ in b.show({"c": 0.8}, 3, (1.0, 0.75, 0.5))] == first
    assert PhraseBook().show({}, 5, (1.0,)) == []
    assert [p.words for p, _ in b.show({"other": 1.0}, 3, (1.0,))] == []


def test_ranker_state_is_written(spark):
    r = Ranker.empty(spark, ByteEncoder(3), CONFIG)
    rows = [e for e in events(5) if e[3] in ("like", "dislike")]
    frame = spark.createDataFrame(rows, EVENTS).withColumn("feedback", F.when(F.col("kind") == "like", 0).otherwise(1))
    for part in range(4):
        r.log_reactions(frame.filter(F.col("seq") % 4 == part))
        plan = r.state._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == 1 and "MapInArrow" not in plan
    assert r.select_top_key_phrases(2, F.lit("2024-03-01").cast("timestamp")).count() > 0


def write(rows, spark, folder):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_stream_of_states_equals_batch(spark, tmp_path):
    """Reactions and showings as a stream, stopped and started again, end as the batch does."""
    rows = events(3, 40)
    folder, latest, shown = f"{tmp_path}/in", {}, defaultdict(list)

    def keep(batch, _):
        for r in batch.collect():
            latest[r["user_id"]] = r
            shown[r["user_id"]] += seen(r)

    for part in (rows[:15], rows[15:28], rows[28:]):
        write(part, spark, folder)
        stream = user_state_stream(spark.readStream.schema(EVENTS).parquet(folder), encode, CONFIG)
        q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
        q.processAllAvailable()
        q.stop()
    twins, want = twin(rows)
    assert set(latest) == set(twins)
    for u, t in twins.items():
        same(latest[u], t)
        assert shown[u] == want[u]
