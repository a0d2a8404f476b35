"""Secret scans by patterns and sliding-window entropy, in DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

#: Kinds with a fixed pattern: name, pattern, group that must be long enough, its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16),
)
#: Character classes of candidate strings: alphabet, pattern of maximal runs, least bits of a window of WINDOW characters.
WINDOW = 20
CLASSES = (
    ("0123456789abcdefABCDEF", r"(?<![0-9a-fA-F])[0-9a-fA-F]{20,}", 3.0),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", 3.7),
)
#: Candidates that are none: words, UUIDs, paths of words.
ALLOWED = (
    r"^[A-Z]?[a-z]+$", r"^[A-Z]+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[/_-]?[A-Za-z]+([/_-][A-Za-z]+)+[/_-]?$",
)
#: Placeholders and counting sequences, in either case: windows that overlap one are none.
ALLOWED_WORDS = ("example", "placeholder", "xxxx", "changeme", "0123456789", "abcdefghij")
#: Stands for a character of an allowed word; no class has it.
GAP = "\x01"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def _positions(text: Column, pattern: str, hits: Column) -> Column:
    """(start, end) of every hit, in code points: the gaps between the hits are what a split leaves."""
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("spans"))

    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda state: state["spans"])


def _spans(places: Column, rank: int, kind: str) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end"), F.lit(kind).alias("kind"))).cast(SPAN)


def _characters(run: Column, words: tuple[str, ...]) -> Column:
    """The characters of a candidate, those of allowed words replaced one by one."""
    for word in words:
        run = F.regexp_replace(run, F.lit(f"(?i){re.escape(word)}"), F.lit(GAP * len(word)))
    return F.split(run, "")


def _bumped(counts: Column, at: Column, by: int, size: int) -> Column:
    """The counts with one of them changed."""
    return F.concat(F.slice(counts, F.lit(1), at), F.array(F.get(counts, at) + by), F.slice(counts, at + 2, size - 1 - at))


def _hot_parts(signs: Column, alphabet: str, bits: float) -> Column:
    """(first, last) of every stretch between allowed words, from its first to its last window with at least `bits` of
    Shannon entropy.

    The counts of the alphabet and the sum of c log2 c follow the window: one character enters, one leaves; an allowed
    word empties the window. The characters are an array that was split once, so a run costs time linear in its length.
    """
    weigh = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    empty = F.array_repeat(F.lit(0), len(alphabet))
    start = F.struct(
        empty.alias("counts"), F.lit(0.0).cast("double").alias("sum"), F.lit(0).alias("held"), F.lit(0).alias("first"), F.lit(0).alias("last"),
        F.array().cast("array<struct<first:int,last:int>>").alias("done"))
    closed = lambda s: F.when(s["last"] > 0, F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"))))).otherwise(s["done"])

    def step(state: Column, at: Column) -> Column:
        new = F.instr(F.lit(alphabet), F.element_at(signs, at)) - 1
        full = state["held"] == WINDOW
        old = F.when(full, F.instr(F.lit(alphabet), F.element_at(signs, F.greatest(at - WINDOW, F.lit(1)))) - 1).otherwise(-1)
        come, gone = F.get(state["counts"], F.greatest(new, F.lit(0))), F.coalesce(F.get(state["counts"], F.greatest(old, F.lit(0))), F.lit(0))
        change = F.when(new == old, 0.0).otherwise(
            weigh(come + 1) - weigh(come) + F.when(full, weigh(gone - 1) - weigh(gone)).otherwise(0.0))
        total, held = state["sum"] + change, F.least(state["held"] + 1, F.lit(WINDOW))
        hot = (held == WINDOW) & (math.log2(WINDOW) - total / WINDOW >= bits)
        entered = F.array(_bumped(state["counts"], new, 1, len(alphabet)))
        left = F.transform(entered, lambda c: F.when(full, _bumped(c, old, -1, len(alphabet))).otherwise(c))
        counts = F.when(new == old, state["counts"]).otherwise(F.get(left, F.lit(0)))
        moved = F.struct(
            counts.alias("counts"), total.alias("sum"), held.alias("held"),
            F.when(hot & (state["last"] == 0), at - WINDOW).otherwise(state["first"]).alias("first"),
            F.when(hot, at).otherwise(state["last"]).alias("last"), state["done"].alias("done"))
        emptied = F.struct(
            empty.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("held"), F.lit(0).alias("first"), F.lit(0).alias("last"), closed(state).alias("done"))
        return F.when(new < 0, emptied).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.size(signs)), start, step, closed)


def _split(words: tuple[str, ...]):
    return lambda p: F.struct(p["place"]["start"].alias("at"), _characters(p["run"], words).alias("signs"))


def _heated(alphabet: str, bits: float):
    return lambda p: F.struct(p["at"].alias("at"), _hot_parts(p["signs"], alphabet, bits).alias("parts"))


def _placed(h: Column) -> Column:
    return F.transform(h["parts"], lambda part: F.struct((h["at"] + part["first"]).alias("start"), (h["at"] + part["last"]).alias("end")))


def find_secrets(
    docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED, allowed_words: tuple[str, ...] = ALLOWED_WORDS
) -> DataFrame:
    """docs with `base_spans` and `secret_spans`, sorted arrays of (start, rank, end, kind) in code points, end exclusive.

    Base kinds come from fixed patterns, leftmost without overlap, short ones dropped. The kind `entropy` is added:
    within maximal runs of one character class, the stretches of windows of 20 characters whose entropy is high enough,
    unless an allow-list pattern fits the run, an allowed word overlaps the window or a base span holds the stretch. Null
    and empty texts have no spans; equal rows have equal ones; texts and runs of any length are scanned whole; an empty
    table stays empty. Columns of docs stay, but for earlier ones of these two names.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    own = [c for c in docs.columns if c not in ("base_spans", "secret_spans")]
    out = docs.select(F.struct(*own).alias("_row"), whole.alias("_text"))
    for kind, pattern, group, _ in BASE:
        out = out.withColumn(f"_hits_{kind}", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        hits = F.col(f"_hits_{kind}")
        places = _positions(F.col("_text"), pattern, hits)
        parts = F.regexp_extract_all("_text", F.lit(pattern), F.lit(group)) if group else hits
        pairs = F.arrays_zip(places.alias("place"), parts.alias("part"))
        good = F.transform(F.filter(pairs, lambda p: F.length(p["part"]) >= least), lambda p: p["place"])
        out = out.withColumn(f"_base_{kind}", F.when(F.size(hits) > 0, _spans(good, rank, kind)).otherwise(_none()))
    base = F.array_sort(F.concat(*[F.col(f"_base_{kind}") for kind, *_ in BASE]))
    out = out.withColumn("base_spans", base)
    for k, (_, pattern, _) in enumerate(CLASSES):
        out = out.withColumn(f"_runs_{k}", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    found = []
    for k, (alphabet, pattern, bits) in enumerate(CLASSES):
        runs = F.col(f"_runs_{k}")
        places = _positions(F.col("_text"), pattern, runs)
        pairs = F.arrays_zip(places.alias("place"), runs.alias("run"))
        suspect = F.filter(pairs, lambda p: ~F.coalesce(*[F.when(p["run"].rlike(a), True) for a in allowed], F.lit(False)))
        # split in a transform of its own: the steps of the next one read the array, they do not make it again
        heated = F.transform(F.transform(suspect, _split(allowed_words)), _heated(alphabet, bits))
        spans = F.flatten(F.transform(heated, _placed))
        found.append(F.when(F.size(runs) > 0, _spans(spans, len(BASE), "entropy")).otherwise(_none()))
    added = F.filter(F.array_distinct(F.concat(*found)), lambda s: ~F.exists("base_spans", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    out = out.withColumn("_added", added).withColumn("secret_spans", F.array_sort(F.concat("base_spans", "_added")))
    return out.select("_row.*", "base_spans", "secret_spans")


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every covered stretch replaced by the mask; overlapping spans become one mask."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        fresh = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(state["parts"], F.array(gap, F.lit(mask)))).otherwise(state["parts"]).alias("parts"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(
        spans, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text)))))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with the secrets in their texts masked; n_chars, where there is one, follows; null texts stay null."""
    found = find_secrets(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    out = found.select("row", F.when(F.col("text").isNotNull(), masked(F.col("text"), F.col("secret_spans"))).alias("clean"))
    fields = {"text": F.col("clean"), "n_chars": F.when(F.col("row.text") == F.col("clean"), F.col("row.n_chars")).otherwise(F.length("clean"))}
    kinds = {f.name: f.dataType for f in docs.schema}
    return out.select(*[fields.get(c, F.col(f"row.`{c}`")).cast(kinds[c]).alias(c) for c in docs.columns])
