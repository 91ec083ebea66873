"""Conversation repair, spelling variants and exact top-k against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairground.llm import conversation_repair as repair, spelling, topk

CONV = "conv_id long, turn long, role string, text string"


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """All edit sequences within a cost, by exhaustion: (initial, must go, truncated) per row."""
    kept = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    new = {"": "u", "s": "u", "u": "a", "a": "u"}
    paths = {("", ""): 0}  # (state, audit): cost; by rows done
    def inserts(p):
        out = dict(p)
        for _ in range(3):
            for (state, audit), cost in list(out.items()):
                key = (new[state], audit + "I")
                out[key] = min(out.get(key, 10**9), cost + 3)
        return out
    for initial, gone, truncated in rows:
        after = {}
        for (state, audit), cost in inserts(paths).items():
            options = [("D", 4, state)]
            if not gone:
                extra = 3 * truncated
                if (state, initial) in kept:
                    options.append(("K", extra, kept[state, initial]))
                options.append(("R", 3 + extra, new[state]))
            for letter, more, then in options:
                key = (then, audit + letter)
                after[key] = min(after.get(key, 10**9), cost + more)
        least = min(after.values())
        paths = {k: c for k, c in after.items() if c <= least + 12}
    return min((cost, audit) for (state, audit), cost in inserts(paths).items() if state in ("", "a"))


def test_repair_is_the_cheapest_and_least():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice("suaox"[:4]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 6))]
        runs = repair._Runs()
        for turn, (initial, gone, truncated) in enumerate(rows):
            runs.add(turn, initial, 1 if gone else 3 if truncated else 0, 1)
        assert runs.solve() == cheapest(rows), rows


def test_runs_of_any_length_agree_with_single_rows():
    rng = random.Random(4)
    for _ in range(30):
        runs = [(rng.choice("suao"), rng.choice((0, 0, 1, 3)), rng.randint(1, 40)) for _ in range(5)]
        long, single = repair._Runs(), repair._Runs()
        for initial, fault, length in runs:
            for _ in range(length):
                long.add(1, initial, fault, 1)
            symbol = 0 if fault == 1 else repair._Runs.numbers[initial if initial in "sua" else "o", fault == 3]
            for _ in range(length):  # runs of one row each, never joined
                single.kind.append(symbol), single.length.append(1)
        assert long.solve() == single.solve()
    many = repair._Runs()
    many.kind.append(repair._Runs.numbers["u", False]), many.length.append(200_000)
    cost, audit = many.solve()
    assert cost == 3 * 100_000 * 2 - 3 * 100_000 and len(audit) - audit.count("I") == 200_000


def test_repair_defined_cases(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 3, "tool", "x!"),
        (2, None, None, None), (2, 5, "user", ""), (None, 0, "user", "A."), (None, 1, "user", "B"),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], CONV + ", audit int").withColumn("conv", F.lit("clash"))
    got = {r.conv_id: r for r in repair.audit_conversations(df).collect()}
    one = got[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal) == (1, 0, 1, 0, 2)
    assert (one.cost, one.audit) == (8, "KKDD")
    assert one.repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    assert (got[2].blank, got[2].audit, got[2].gaps, got[2].repaired_sha256) == (2, "DD", 0, hashlib.sha256(b"").hexdigest())
    assert got[None].audit == "KD" + "I" or got[None].cost == cheapest([("u", False, False), ("u", False, True)])[0]
    out = repair.repair_conversations(df).where("conv_id = 1").orderBy("position").collect()
    assert [(r.role, r.text) for r in out] == [("user", "Hi."), ("assistant", "Yes.")]
    assert repair.audit_conversations(df.limit(0)).count() == 0


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(("user", "assistant")), rng.choice(("Same.", "", f"No {t}", f"Yes {t}."))) for t in range(3000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", "x" * 200_000 + ".") for c in range(3) for t in range(2)]
    df = spark.createDataFrame(rows, CONV)
    got = {r.conv_id: r for r in repair.audit_conversations(df.repartition(5)).collect()}
    assert [got[c].audit for c in range(3)] == ["KK"] * 3
    runs, seen, kept = repair._Runs(), set(), []
    for _, turn, role, text in rows[:3000]:
        fault = 1 if not text else 2 if (role, text) in seen else 0 if text[-1] == "." else 3
        seen.add((role, text))
        runs.add(turn, role[0], fault, 1)
        kept.append((role, text))
    cost, audit = runs.solve()
    assert (got[7].cost, got[7].audit) == (cost, audit)
    replay, pieces = repair._Replay(audit), []
    for role, text in kept:
        pieces += list(replay.row(role, text))
    pieces += list(replay.inserted())
    assert got[7].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in pieces).encode()).hexdigest()
    initials = "".join(r[0] for r, _ in pieces)
    assert initials.strip() == "" or initials.lstrip("s") == "ua" * (len(initials.lstrip("s")) // 2)


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return len(t) - len(s) == 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def grouped(words: dict[str, int]) -> set[tuple]:
    out, forms = {}, {}
    for w, n in words.items():
        around = sorted(((-words[o], o) for o in words if o != w and near(w, o)))
        best = around[0] if around and -around[0][0] >= 2 * n else None
        forms[w] = best[1] if best else None
        out[w] = (w, n, len(around), forms[w], -best[0] if best else None)
    def root(w):
        return root(forms[w]) if forms[w] else w
    return {(*row, root(w)) for w, row in out.items()}


def variants(df) -> set[tuple]:
    return {tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()}


def test_variants_against_all_pairs(spark):
    rng = random.Random(6)
    letters = "abcéèz÷"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 7))): 2 ** rng.randint(2, 9) for _ in range(500)}
    base = "colour" * 5000  # 30,000 letters
    words |= {base: 40, base + "s": 3, base[:-1] + "z": 9, "aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaaaaaaa": 48}
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("other", F.lit(1)).withColumn("h", F.lit("x"))
    assert variants(spelling.group_variants(df)) == grouped(words)


@pytest.mark.parametrize("k", [4, 9, 32])
def test_neighbourhoods_meet_every_pair(spark, monkeypatch, k):
    monkeypatch.setattr(spelling, "symbols_for", lambda n: k)
    monkeypatch.setattr(spelling, "PIECE", 64)  # pieces of rows and of places
    words = {"".join(p): 3 for p in itertools.islice(itertools.product("abcd", repeat=5), 0, 1024, 7)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(r.word, r.other) for r in spelling.near_pairs(df).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def test_word_counts(spark):
    docs = [(1, "Straße STRASSE strasse", 1), (2, None, 1), (3, "", 1), (None, "naïve naïve NAÏVE", 1), (4, "abc-defgh defgh DEFGH", 1)]
    docs += [(d, "wonderful", 1) for d in range(100, 700)]
    df = spark.createDataFrame(docs, "doc_id long, text string, run int")
    got = {r.word: r.n for r in spelling.count_words(df, least_n=1, damage=97).collect()}
    want: dict[str, int] = {}
    for d, text, _ in docs:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                want[w] = want.get(w, 0) + 1
    assert got == want and len([w for w in got if near(w, "wonderful")]) > 2
    empty = spelling.group_variants(spelling.count_words(df.limit(0)))
    assert empty.count() == 0 and empty.columns == ["word", "n", "n_near", "form", "form_n", "root"]


def brute(rows, k):
    """query id to (rank, id, score), by row."""
    fine = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [max(-topk.LARGEST, min(topk.LARGEST, int(np.floor(64.0 * x)))) for x in v]) for i, v in fine]
    out = []
    for a, (q, qv) in enumerate(whole):
        if q is None or q % 20:
            continue
        scored = [(-sum(x * y for x, y in zip(qv, v)), i is None, i or 0, b, i) for b, (i, v) in enumerate(whole) if b != a]
        out += [(q, rank, s[4], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [10, 4096])
def test_top_k_against_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(topk, "LEAST_ROWS", least)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(4, 40))
    rows = [(i, (centres[i % 4] + rng.normal(size=40) / 2).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, [0.0] * 40) for i in range(400, 460)]  # ties
    rows += [(20, rows[20][1]), (20, rows[20][1]), (None, rows[40][1]), (480, None), (500, [1.0, None]), (520, [float("nan")]),
             (540, [float("inf")] * 40), (560, [2.0, -1.0]), (580, []), (600, [3e30] * 40), (601, [2e6] * 40), (602, [0.5] * 90)]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "vec_id long, embedding array<float>, row int, part string").repartition(6)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=20).collect()
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 20)


def test_top_k_of_little(spark):
    kind = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0]), (20, [2.0]), (3, [-1.0])], kind)
    got = [tuple(r) for r in topk.top_k(few, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 8192), (0, 2, 3, -4096), (20, 1, 0, 8192), (20, 2, 3, -8192)]
    assert topk.top_k(few.limit(1), F.lit(True)).count() == 0
    assert topk.top_k(few.limit(0), F.lit(True)).columns == ["query_id", "rank", "vec_id", "score"]
    assert topk.top_k(few.limit(0), F.lit(True)).count() == 0


def test_a_part_compacts_its_candidates():
    """Bounds must rule out most candidates before their last block, and lose none."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(50, 64)) * 40
    vectors = [(centres[i % 50] + rng.normal(size=64) * 8).astype(np.int64) for i in range(5000)]
    part = topk.Part(np.arange(5000), list(range(5000)), vectors)
    touched = []
    lines = part.floats

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple) and isinstance(key[1], np.ndarray):
                touched.append(len(key[1]))
            return np.asarray(super().__getitem__(key))

    part.floats = lines.view(Counted)
    for i, at, scores in part.search(np.arange(50), vectors[:50], 20):
        exact = np.array([int(vectors[i] @ v) for v in vectors])
        exact[i] = -(1 << 60)
        assert list(at) == list(np.argsort(-exact, kind="stable")[:20]) and list(scores) == list(exact[at])
    assert np.mean(touched) < 5000 / 4
