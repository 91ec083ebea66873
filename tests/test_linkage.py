"""Fuzzy linkage against comparing everything with everything."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from fairground.operators import linkage

WORDS = ["abc", "abd", "xyz", "gala", "galas", "gale", "jazz night", "jazz nights", "jazz nite", "rock", "rocks", "rock festival",
         "aaa", "aaaa", "aaaaa", "ab", "ba", "a", "b"]


def rows(n=300, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = rng.choice(WORDS) + rng.choice(["", " " + rng.choice(WORDS), f" {rng.choice(WORDS)}{rng.randint(0, 3)}"])
        out.append((i, t.upper() if rng.random() < 0.1 else t, rng.choice("xy")))
    return out


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(rows(), "uuid long, title string, city string")


@pytest.mark.parametrize("threshold", [0.85, 0.7])
@pytest.mark.parametrize("hot", [2_000, 3])
def test_links_equal_brute_force(spark, events, threshold, hot, monkeypatch):
    monkeypatch.setattr(linkage, "HOT", hot)
    first = {}
    for i, t, c in rows():
        first.setdefault((c, t.lower()), i)
    reps = sorted((i, c, t) for (c, t), i in first.items())
    want = {(i, j, round(ratio(s, t), 9)) for i, c, s in reps for j, d, t in reps if i < j and c == d and ratio(s, t) >= threshold}
    want |= {(first[(c, t.lower())], i, 1.0) for i, t, c in rows() if first[(c, t.lower())] != i}
    got = {(r.uuid_a, r.uuid_b, round(r.score, 9)) for r in linkage.link_similar(events, [F.col("city")], threshold).collect()}
    assert got == want


def test_greedy_pairs_equal_sequential_pass(spark, events):
    want, done = set(), set()
    for city in "xy":
        group = [(i, t.lower()) for i, t, c in rows() if c == city]
        for a, (i, t) in enumerate(group):
            if i in done:
                continue
            for j, u in group[a + 1 :]:
                if j not in done and ratio(t, u) > 0.8:
                    want.add((i, j, round(ratio(t, u), 9)))
                    done.add(j)
    pairs = linkage.duplicate_pairs(events, [F.col("city")], 0.8)
    assert {(r.uuid_a, r.uuid_b, round(r.similarity, 9)) for r in pairs.collect()} == want
    totals = linkage.duplicate_totals(pairs).first()
    assert totals.total == len(want) and totals.high_confidence == sum(s > 0.95 for _, _, s in want)


def test_missing_keys_and_titles_are_left_out(spark):
    df = spark.createDataFrame([(1, "same", None), (2, "same", None), (3, "", "x"), (4, "", "x")], "uuid long, title string, city string")
    assert linkage.link_similar(df, [F.col("city")]).count() == 0
    assert linkage.duplicate_pairs(df, [F.col("city")]).count() == 0
