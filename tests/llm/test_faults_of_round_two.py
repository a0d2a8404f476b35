"""Broken markup, long runs, unequal vectors and fixed fractions."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.llm import extraction, secret_scan, sketches, vectors
from spectrafold.llm.common import read

SF = "/root/testdata/sf0.001"
LINE = "Some words of a plain sentence. " * 4


@pytest.mark.parametrize("page, want", [
    ("<p>x</p><a " + 'x="y" ' * 10_000, "x"), ("<div>" * 20_000 + "</section>" * 20_000 + "<p>x y z", "x y z"), ("<p>x</p>" + "<a <a " * 20_000, "x"),
    ("<p>x</p>" + "<script>" * 20_000, "x"), ("<p>x</p>" + "<!--" * 50_000, "x"), ("<p>a < b > c</p>" * 5000, "\n".join(["a < b > c"] * 5000)),
])
def test_broken_pages_take_linear_time(page, want):
    start = time.time()
    assert extraction.main_text(page) == want
    assert time.time() - start < 3


@pytest.mark.parametrize("page, keeps", [
    (f'<div class="content has-sidebar"><p>{LINE}</p></div>', True), (f'<div class="post tags-travel"><p>{LINE}</p></div>', True),
    (f'<div style="overflow:hidden" title="the hidden truth"><p>{LINE}</p></div>', True), (f'<div class="no-sidebar"><p>{LINE}</p></div>', True),
    (f'<div class="sidebar"><main><p>{LINE}</p></main></div>', True), ("<p>No</p><p>Yes.</p>", True),
    (f"<div hidden><p>{LINE}</p></div>", False), (f'<div style="display: none"><p>{LINE}</p></div>', False), (f'<div class="comment-list"><p>{LINE}</p></div>', False),
    (f'<div aria-hidden=true><p>{LINE}</p></div>', False), (f"<nav><main><p>{LINE}</p></main></nav>", False), ('<ul><li><a href="/">Home</a><li><a href="/b">More</a></ul>', False),
])
def test_marks_of_boilerplate(page, keeps):
    assert bool(extraction.main_text(page)) == keeps


def test_the_cut_keeps_short_blocks_of_unmarked_pages():
    page = f"<div><p>{LINE}</p><p>Indeed</p><p>{LINE}</p><p>And so on</p><p>{LINE}</p></div><ul><li><a href='/'>One link</a></li><li><a href='/x'>Two</a></li></ul>"
    whole = [LINE.strip(), "Indeed", LINE.strip(), "And so on", LINE.strip()]
    assert extraction.main_text(page).split("\n") == whole
    assert extraction.main_text(page, smooth=0).split("\n") == [LINE.strip()] * 3


def test_pages_of_all_kinds_in_a_table(spark):
    read(spark, SF, "pages")
    rows = [(1, "u", None, "t"), (None, None, "", "t"), (2, "u", f"<p>{LINE}", "t"), (2, "u", f"<p>{LINE}", "t"), (3, "u", f"<p>{'a ' * 500_000}</p>", "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.n_chars) for r in extraction.extract(frame).collect())
    assert got == [(0, 0), (1, 0), (2, len(LINE) - 1), (2, len(LINE) - 1), (3, 999_999)]
    assert extraction.extract(frame.limit(0)).collect() == []


def plain_entropy_spans(text):
    out = set()
    for alphabet, pattern, bits in secret_scan.CLASSES:
        for m in re.finditer(pattern, text):
            run = m[0]
            if any(re.search(a, run) for a in secret_scan.ALLOWED):
                continue
            marked = run
            for word in secret_scan.ALLOWED_WORDS:
                marked = re.sub(re.escape(word), "\x01" * len(word), marked, flags=re.I | re.A)
            spot = 0
            for part in marked.split("\x01"):
                hot = []
                for k in range(len(part) - 19):
                    window = part[k:k + 20]
                    size = -sum(window.count(c) / 20 * math.log2(window.count(c) / 20) for c in set(window))
                    if size >= bits - 1e-9:
                        hot.append(k)
                if hot:
                    out.add((m.start() + spot + hot[0], m.start() + spot + hot[-1] + 20))
                spot += len(part) + 1
    return out


def test_entropy_spans_equal_plain_windows(spark):
    rng = random.Random(8)
    signs = secret_scan.CLASSES[1][0]
    texts = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.randrange(6)
            size = rng.randrange(5, 70)
            parts.append("".join(rng.choice(signs if kind < 3 else "0123456789abcdef" if kind == 3 else "ab") for _ in range(size)) if kind < 5 else "docs/example/" + "".join(rng.choice(signs) for _ in range(40)) + "xxxxx")
        texts.append((k, rng.choice([" ", ", ", "é "]).join(parts)))
    frame = spark.createDataFrame([(k, t, "c", 1) for k, t in texts] + [(99, None, "c", 1)], "doc_id long, text string, _text string, _hits_x int")
    got = {r.doc_id: r for r in secret_scan.find_secrets(frame).collect()}
    assert list(got[0].asDict()) == ["doc_id", "text", "_text", "_hits_x", "base_spans", "secret_spans"] and got[99].secret_spans == []
    for k, text in texts:
        base = [(s.start, s.end) for s in got[k].base_spans]
        want = {s for s in plain_entropy_spans(text) if not any(a <= s[0] and b >= s[1] for a, b in base)}
        assert {(s.start, s.end) for s in got[k].secret_spans if s.kind == "entropy"} == want, text
    assert secret_scan.find_secrets(frame.limit(0)).collect() == []


def test_a_long_run_takes_linear_time(spark):
    rng = random.Random(2)
    run = "".join(rng.choice(secret_scan.CLASSES[1][0]) for _ in range(100_000))
    frame = spark.createDataFrame([(1, f"image {run} end")], "doc_id long, text string")
    start = time.time()
    spans = secret_scan.find_secrets(frame).first().secret_spans
    assert [(s.start, s.end) for s in spans] == [(6, 100_006)] and time.time() - start < 60


def test_vectors_of_two_lengths_of_any_size_and_repeated_rows(spark):
    read(spark, SF, "embeddings")
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(20)]
    rows += [(30, [1.0, 2.0, 3.0, 4.0]), (31, [1.0, 2.0, 3.0, 4.1]), (32, [9e199] * 8), (33, [9e199] * 7 + [8e199]), (34, [1e-200] * 8)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + rows[:3] + [rows[-1]]], "vec_id long, embedding array<double>, list string").repartition(2)
    got = vectors.near_vectors(frame).collect()
    assert len(got) == len(rows) + 4
    links = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert links[30] == links[31] == (1, 30) and links[32] == links[33] == links[34] == (2, 32)
    assert all(links[k] == (0, k) for k in range(20))


def test_sketches_keep_a_fixed_fraction_and_merge():
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    cut = lambda words: sketches.sketch(" ".join(words), sketches.FRACTION)
    whole, half, other = cut(words), cut(words[:2000]), cut(words[1996:])
    every = sketches.sketch(" ".join(words))
    assert np.array_equal(whole, every[every < np.uint64(int(sketches.FRACTION * 2**48))]) and abs(len(whole) / 3996 - sketches.FRACTION) < 0.04
    assert np.array_equal(np.union1d(half, other), whole)
    assert sketches.likeness(half, whole) == 1.0 and sketches.likeness(half, other) == 0.0
    assert abs(sketches.likeness(cut(words[:1500] + [f"v{k}" for k in range(500)]), whole) - 1496 / 1996) < 0.05
    assert sketches.likeness(cut([]), cut([])) == 1.0 and sketches.likeness(half, cut([])) == 0.0
