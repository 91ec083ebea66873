"""Repeated passages of lines against a plain search over all texts, and the share of planted ones that is found."""

from __future__ import annotations

import hashlib
import random

import pytest

from fairground.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string"


def md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def plain(texts: dict[int, str | None]) -> dict[int, tuple[str | None, int]]:
    """Text left and number of lines cut, by a scan in order of ids; no rolling windows over hashes of lines but for pairs."""
    seen: set[tuple[str, ...]] = set()
    out: dict[int, tuple[str | None, int]] = {}
    for key in sorted(texts):
        text = texts[key]
        if text is None:
            out[key] = (None, 0)
            continue
        lines = text.split("\n")
        places = [i for i, y in enumerate(lines) if y.strip(SPACE)]
        bare = [lines[i].rstrip(SPACE) for i in places]
        rolled = [md5(md5(a) + md5(b)) for a, b in zip(bare, bare[1:])]
        gone: set[int] = set()
        for j in range(len(bare)):
            pair, three = tuple(bare[j : j + 2]), tuple(bare[j : j + 3])
            if len(pair) == 2:
                beside = ([rolled[j] < rolled[j - 1]] if j else []) + ([rolled[j] <= rolled[j + 1]] if j + 1 < len(rolled) else [])
                if not beside or any(beside):
                    gone |= {j, j + 1} if pair in seen else set()
                    seen.add(pair)
            if len(three) == 3:
                gone |= {j, j + 1, j + 2} if three in seen else set()
                seen.add(three)
        ends = places[1:] + [len(lines)]
        cut = {i for j in gone for i in range(places[j], ends[j])}
        out[key] = ("\n".join(y for i, y in enumerate(lines) if i not in cut), len(cut))
    return out


def dedup(spark, rows):
    return {r["doc_id"]: (r["text"], r["n_cut_lines"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_search(spark, seed):
    draw = random.Random(seed)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", "\t", "line 1 ", "line 2\r"]
    texts: dict[int, str | None] = {i: "\n".join(draw.choice(pool) for _ in range(draw.randint(0, 14))) for i in range(300)}
    texts |= {300: None, 301: "", 302: "\n\n", 303: "\n \nline 1\nline 2\nline 3", 304: "same\nsame\nsame\nsame"}
    assert dedup(spark, list(texts.items())) == plain(texts)


@pytest.mark.parametrize("length", [2, 3, 4, 5, 6, 8, 12, 20])
def test_recall_of_planted_passages(spark, length):
    """From three lines on every repeated line goes and every other line stays; of pairs, those with boundaries at both places."""
    rows, own, shared = [], {}, {}
    for p in range(100):
        shared[p] = [f"shared {p} {length} {j}" for j in range(length)]
        for copy in range(2):
            key = 2 * p + copy
            own[key] = [f"own {key} {j}" for j in range(3 + key % 4)]
            at = key % 3
            rows.append((key, "\n".join(own[key][:at] + shared[p] + own[key][at:])))
    got = dedup(spark, rows)
    assert all(got[2 * p] == (rows[2 * p][1], 0) for p in shared)
    cut = sum(got[2 * p + 1][1] for p in shared) / (100 * length)
    assert cut == 1 if length > 2 else 0.3 < cut < 0.7
    assert all(set(own[k]) <= set(got[k][0].split("\n")) for k in got)


def test_copies_stay_once(spark):
    """Every distinct line stays at its first place; rows that repeat an id and a text are one document."""
    text = "\n".join(f"line {j}" for j in range(50))
    rows = [(i, text) for i in range(200)] + [(None, "a\nb\nc")] * 40 + [(7, text)] * 3
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    assert sorted({(r["doc_id"], r["text"]) for r in out if r["text"]}, key=str) == [(0, text), (None, "a\nb\nc")]
    assert all(r["n_cut_lines"] == 50 for r in out if r["doc_id"])


def test_ambiguous_hashes_cut_nothing(spark):
    """Chunks with a line whose hash stands for other bytes too are left alone; no line of these texts has such a hash."""
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (3, "x\ny\nz"), (4, "x\ny\nz")], SCHEMA)
    assert line_dedup.ambiguous_hashes(docs, "text").count() == 0
    doubtful = spark.sql("SELECT xxhash64('b') AS lh")
    cuts = {r["v_k"]: set(r["cut"]) for r in line_dedup.repeated_lines(docs, "doc_id", "text", doubtful).collect()}
    assert cuts[4] == {0, 1, 2} and 1 not in cuts.get(2, set())
