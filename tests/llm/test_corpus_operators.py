"""The corpus operators against brute force, on edge cases and on the smallest tables."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spectrafold.llm import bpe, extraction, language, mixing, quality, queries, secret_scan, simhash, sketches, substrings, suffixes, vectors
from spectrafold.llm.common import read

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, component_id int"
WORDS = "the of and tion ing her ent thing other".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def rows():
    base, long = prose(1, 80), prose(2, 4000)
    texts = [None, "", "   \n", "one", "Two words", base, base, base.replace("the", "a", 1), long, long + " tail", "ab " * 300, "é中 " * 90, "123 !!", base + prose(3, 40)]
    out = [(k, t, "en" if k % 2 else None, [None, "s0", "s1"][k % 3], None if t is None else len(t), "x", 0) for k, t in enumerate(texts)]
    return out + [out[5], (None, base, "en", "s0", 3, "x", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    read(spark, SF, "documents")  # tells Python workers where the package is
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def groups(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def test_simhash_groups(docs):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    want = {}
    for doc_id, text, *_ in rows():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lower))
        h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        want[doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows()) and all(r.fp % 2**64 == want[r.doc_id] for r in got)
    ids = [i for i in want if i is not None]
    comp = groups(ids, [(a, b) for a in ids for b in ids if a < b and (want[a] ^ want[b]).bit_count() <= 2])
    assert all(r.component_id == (comp[r.doc_id] if r.doc_id is not None else comp[5]) for r in got)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(comp.values()))


def test_dense_groups_stay_connected():
    rng = np.random.default_rng(1)
    from spectrafold.llm.components import spanning
    for share in (0.001, 0.05, 0.9):
        match = rng.random((60, 50)) < share
        all_pairs, few = list(zip(*np.nonzero(match))), list(zip(*spanning(match)))
        assert all(match[p] for p in few)
        ids = range(110)
        assert groups(ids, [(a, 60 + b) for a, b in all_pairs]) == groups(ids, [(a, 60 + b) for a, b in few])


def test_suffix_order_and_prefixes(monkeypatch):
    rng = random.Random(5)
    for spill in (False, True):
        if spill:
            monkeypatch.setattr(suffixes, "IN_MEMORY", 5)
            monkeypatch.setattr(suffixes, "CHUNK", 3)
            monkeypatch.setattr(suffixes, "BASE", 0)
        for _ in range(40):
            pieces = [bytes(rng.choice(b"aab") for _ in range(rng.randrange(1, 40))) for _ in range(6)] + [b"a" * 120 + b"b", b"a" * 110]
            tails, at = [], 0
            for p in pieces:
                tails += [(p[k:], at + len(p), at + k) for k in range(len(p) + 1)]
                at += len(p) + 1
            tails.sort(key=lambda t: (t[0], t[1]))
            order, prefix = suffixes.sorted_suffixes(pieces)
            assert order.tolist() == [t[2] for t in tails]
            assert prefix[1:].tolist() == [min(100, len(os.path.commonprefix([a[0], b[0]]))) for a, b in zip(tails, tails[1:])]


def test_repeated_strings(docs):
    distinct = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    seen, want = set(), {}
    for doc_id, text in sorted((r[0], r[1]) for r in rows()[:14]):
        raw, gone = (text or "").encode(), np.zeros(len((text or "").encode()), bool)
        for k in range(len(raw) - 99):
            if raw[k:k + 100] in seen:
                gone[k:k + 100] = True
            seen.add(raw[k:k + 100])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        want[doc_id] = (len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.without_repeats(distinct).collect()}
    assert got == want
    assert substrings.without_repeats(docs).count() == len(rows())


def test_language_is_learned_from_other_documents(spark):
    docs = read(spark, SF, "documents")
    got = queries.op3_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_edges(docs):
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert [got[k].lang_pred for k in (0, 1, 2, 12)] == ["und"] * 4 and got[5].lang_pred == "en"
    assert language.with_known_language(docs, model).columns == docs.columns
    assert language.predict(docs, language.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_quality_held_out(spark):
    labels = read(spark, SF, "labels")
    got = queries.op4_quality_score(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    assert quality.features("").shape == quality.features(prose(4, 9000)).shape == (quality.N_FEATURES,)


def test_sketches(docs):
    got = {r.doc_id: r for r in sketches.compare_with_edits(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    texts = [r[1] or "" for r in rows()[:14]]
    for k, text in enumerate(texts):
        after, cut = texts[(k + 1) % len(texts)], len(text) // 4
        assert got[k].edited_sha256 == hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()
        assert got[k].n_chars == len(text) and 0 <= got[k].near_edited <= 1
    assert got[5].near_next == 1.0 and got[5].fingerprint == got[6].fingerprint and got[8].near_next > 0.95
    assert sketches.compare_with_edits(docs).count() == len(rows())


def test_mixing_hits_its_targets(docs):
    plan = mixing.mix_sources(docs, mixing.word_count(F.col("text")), keep=F.struct(*docs.columns)).select("row.source", "size", "source_size", "target", "taken").toPandas()
    assert len(plan) == len(rows()) and (plan.taken <= 2 * plan["size"]).all()
    for _, own in plan.groupby("source", dropna=False):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 1 and own["size"].sum() == own.source_size.iloc[0]
        assert own.target.iloc[0] <= 2 * own.source_size.iloc[0]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == plan.taken.sum()


def test_bpe_is_the_library_encoding(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
    library, own = tokenizers.Tokenizer.from_file(path), bpe.Vocabulary(open(path, encoding="utf-8").read())
    rng = random.Random(2)
    texts = ["".join(rng.choice("aaabcde  \n\t'stré中😀--- .019") for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["a" * 500, " " * 300, "-" * 900, "<|endoftext|><|endoftext|> x", "", prose(9, 500)]
    for text, blocks in zip(texts, own.encode(texts)):
        assert np.frombuffer(b"".join(blocks), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    for r in bpe.encode_documents(docs, path, with_ids=True).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and len(r.ids) == r.n_tokens


def test_main_text():
    page = """<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body><header>Site</header><nav><a href=x>Home</a></nav>
    <div class="ad">Buy now, it is cheap.</div><article><h1>A &amp; B</h1><p>First   words of <b>the</b> text.<br>More.<p>Second one, longer than before.
    <div class="comments"><p>I think so too, said a reader.</p></div></article><aside>Other</aside><form>Name</form><footer>&copy; x</footer>"""
    assert extraction.main_text(page) == "A & B\nFirst words of the text. More.\nSecond one, longer than before."
    assert extraction.main_text("") == extraction.main_text("<nav>a</nav><!-- open") == ""


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 8)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.random()) for _ in range(n)]
        edges = [e for e in edges if e[0] != e[1]]

        def cost(keep):
            return sum(max(0, -g) if k else max(0, g) for g, k in zip(gain, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(extraction.cut(gain, edges)) == pytest.approx(best)


def test_embedding_groups(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    x[300:] = x[:100] + rng.normal(size=(100, 16)) * 0.12
    x[5] = x[6]
    table = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    odd = [(400, None), (401, [0.0] * 16), (402, [None] * 16), (403, [float("nan")] * 16), (None, table[0][1])]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(table + odd, "vec_id long, embedding array<float>")).collect()}
    f = np.asarray(x, np.float32).astype(float)
    unit = f / np.sqrt((f**2).sum(1))[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    found = sum(got[k].n_links for k in range(400))
    assert found >= 0.9 * link.sum() and all(got[k].n_links <= link[k].sum() for k in range(400))
    assert got[6].component_id == got[5].component_id == 5 and all(got[k].n_links == 0 and got[k].kept for k in range(400, 404))
    assert got[None].component_id is None and not got[None].kept


def test_secret_spans(spark):
    text = 'password = "abcdefghijkl" token: short AKIA' + "Q" * 16 + " deadbeef00112233 secret=secret: é sK9x-Qw7zL2mVb8Rt4Yp1Nc6 end"
    frame = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, base_spans string")
    got = {r.doc_id: r for r in secret_scan.find_secrets(frame.drop("base_spans")).collect()}
    want = []
    patterns = (("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))
    for rank, (kind, pattern, group, least) in enumerate(patterns):
        want += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    assert [tuple(s) for s in got[1].base_spans] == sorted(want)
    assert [s.kind for s in got[1].secret_spans if s.kind == "entropy"] == ["entropy"] and got[2].secret_spans == got[3].secret_spans == []
    clean = {r.doc_id: r for r in secret_scan.mask_secrets(frame).collect()}
    assert "abcdefghijkl" not in clean[1].text and clean[1].base_spans == "x" and clean[2].text is None and clean[3].text == ""


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    path = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
    results = (simhash.near_duplicates(none), substrings.without_repeats(none), sketches.compare_with_edits(none), mixing.mixed_documents(none),
               bpe.encode_documents(none, path), secret_scan.find_secrets(none), extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")),
               vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")))
    assert [r.count() for r in results] == [0] * len(results)


def test_pipeline_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = before = read(spark, SF, "documents").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == before.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 60


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_pipeline_near_duplicates_are_exact(spark, docs):
    import corpus_pipeline

    rng = random.Random(8)
    base = prose(11, 200).split()
    texts = []
    for n in range(60):  # copies with 0 to 5 other words, and others with so many that they stay
        words = list(base) if n < 40 else prose(50 + n, 90).split() + base[:60]
        for at in rng.sample(range(len(words)), rng.randrange(6)):
            words[at] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += ["", "  ", "a b", "a  B", "a b c"]
    frame = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (3, texts[3])], "doc_id long, text string").repartition(3)
    own = [shingles(t) for t in texts]
    link = [(a, b) for a in range(len(own)) for b in range(a) if jaccard(own[a], own[b]) >= 0.8]
    kept = [r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, frame, SF).collect()]
    assert kept.count(None) == 1 and sorted(k for k in kept if k is not None) == sorted(set(groups(range(len(own)), link).values()))
    # more than the two bits of op1 apart
    prints = [simhash.simhash(t, 3) for t in texts]
    assert any(((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() > 2 for a, b in link)


def test_forest_over_many_tiles(spark, monkeypatch):
    from spectrafold.llm import near

    monkeypatch.setattr(near, "TILE", 4)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base[k:k + 200]) for k in range(0, 100, 4)]  # each links with its neighbours alone
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [r.doc_id for r in near.representatives(frame).collect()] == [0]


def test_language_does_not_depend_on_the_place_in_a_batch(docs):
    model = language.fit(docs)
    texts = ["a", prose(5, 30), "b c", "x" * 5]
    alone = [language._guess(model, [t]) for t in texts]
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [1, 3, 0, 2]):
        names, sure = language._guess(model, [texts[k] for k in order])
        assert names == [alone[k][0][0] for k in order] and "und" not in names
        assert sure == pytest.approx([alone[k][1][0] for k in order], abs=1e-12)


def test_repeated_lines_of_long_texts():
    lines = [f"line {k}" for k in range(150_000)]
    at = 14 + 7  # after the shares and the word features
    assert quality.features("\n".join(lines + lines[120_000:]))[at] == pytest.approx(30_000 / 180_000)
    assert quality.features("\n".join(["x y " * 30_000] * 3))[at] == pytest.approx(2 / 3)
    assert quality.features("a\na\nb")[at] == pytest.approx(1 / 3)


def test_sketches_of_short_texts_and_passages():
    words = prose(21, 400).split()
    whole = sketches.sketch(" ".join(words))
    for n in (5, 6, 10, 15, 30):
        for at in range(0, 360, 12):
            passage = words[at:at + n]
            assert sketches.likeness(sketches.sketch(" ".join(passage)), whole) == 1.0
            edited = passage[:-1] + ["other"]
            a, b = shingles(" ".join(passage)), shingles(" ".join(edited))
            got = sketches.likeness(sketches.sketch(" ".join(passage)), sketches.sketch(" ".join(edited)))
            assert got == pytest.approx(len(a & b) / min(len(a), len(b)))
