"""Nulls, empty and very long texts, repeats, empty tables and clashing column names, for every operator and stage."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import decontam, htmltext, idfile, langid, ordinal, rules, sampling, simhash, tokencount, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long, fp long, key string, component long, seed string, `__v` int, kept boolean, posterior double"
LONG = "lorem" * 20_000
PROSE = " ".join(f"word{i} and some more of it" for i in range(30))
ROWS = [(1, PROSE), (2, None), (3, ""), (4, " \n\t "), (5, "!!! ... 123"), (6, LONG), (7, PROSE), (7, PROSE), (None, PROSE), (None, None), (8, "naïve 中文 \U0001f600 text"), (7, "another text of the same key")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en" if k != 8 else None, "s", 1, 0.5, 2, 3, "k", 4, "z", 1, True, 0.1) for k, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_op1(docs, none):
    model = langid.fit(docs, PIECES, F.lit(True))
    found = langid.identify(docs, PIECES, model)
    assert found.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"] and found.count() == len(ROWS)
    assert {r.lang_pred for r in found.filter("text IS NULL OR doc_id IN (3, 4, 5)").collect()} == {"und"}
    assert langid.identify(none, PIECES, model).count() == 0
    marks = docs.sparkSession.createDataFrame([(1, "½ ² ① 12 ½"), (2, "½ and more")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(marks, PIECES, model).collect()} == {1: "und", 2: "en"}
    assert {r.lang_pred for r in langid.identify(docs, PIECES, langid.fit(none, PIECES, F.lit(True))).collect()} == {"und"}


def test_op2(docs, none, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = idfile.id_file(docs, path, 2, folder=str(tmp_path / "ids")).orderBy("start").collect()
    assert len(found) == len(ROWS) and [r.doc_id for r in found] == sorted((k for k, _ in ROWS), key=lambda k: (k is not None, k or 0))
    assert [r.n_tokens for r in found if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    assert [b.start for b in found] == np.cumsum([0] + [r.n_tokens for r in found[:-1]]).tolist()
    assert idfile.id_file(none, path, 2).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 15, 16, 30, 60, 64])
def test_simple8b_round_trip(bits):
    rng = np.random.default_rng(bits)
    values = rng.integers(0, 1 << min(bits, 63), 5000, dtype=np.uint64)
    values[rng.integers(0, 5000, 50)] = (1 << bits) - 1
    words, escaped = idfile.pack(values)
    assert (idfile.unpack(words, escaped) == values).all()
    assert (idfile.ids_between(words, idfile.word_offsets(words), escaped, 777, 4321) == values[777:4321]).all()
    assert len(idfile.pack(values[:0])[0]) == 0


def test_op3(docs, none):
    found = sampling.segmentations(docs, PIECES, 3)
    rows = found.collect()
    assert all(r.decodes for r in rows)
    empty = [r for r in rows if r.n_pieces == 0]
    assert len(empty) == 3 and all(r.log_inclusion == 0 and r["sample"] == 1 for r in empty)
    repeats = [tuple(r.ids) for r in rows if r.doc_id == 7 and r["sample"] == 1]
    assert len(repeats) == 3 and len(set(repeats)) == 2
    assert sampling.segmentations(none, PIECES, 3).count() == 0


def test_op3_keeps_runs_that_are_often_met(monkeypatch):
    """Lattices of few runs are learned anew when a worker has held as many as it may, and samples don't depend on that."""
    rng, learned, whole = np.random.default_rng(3), [], sampling.Bank.learn
    monkeypatch.setattr(sampling.Bank, "learn", lambda self, runs: (learned.extend(runs), whole(self, runs))[1])
    letters = list("abcdefghijklmnopqrstuvwxyz\u4e2d\U0001f600")
    usual = " ".join("".join(rng.choice(letters, 9)) for _ in range(20))
    parts = [[f"{usual} {' '.join(''.join(rng.choice(letters, 9)) for _ in range(20))}" for _ in range(3)] for _ in range(30)]
    free, bound = sampling.Sampler(PIECES, 4), sampling.Sampler(PIECES, 4)
    wanted = [free.samples([1, 2, 3], texts) for texts in parts]
    distinct, learned[:] = set(learned), []
    monkeypatch.setattr(sampling, "MOST_EDGES", 6000)
    for texts, expected in zip(parts, wanted):
        found = bound.samples([1, 2, 3], texts)
        for x, y in zip(sum(found, []), sum(expected, []), strict=True):
            assert x[0].tolist() == y[0].tolist() and x[1:] == y[1:] and x[-1]
    assert len(bound.bank.target) < len(free.bank.target) / 3  # some were forgotten
    assert len(learned) < 1.1 * len(distinct)


def test_op3_probabilities():
    """Sampled frequencies and the inclusion-weighted estimate against all segmentations of a word."""
    sampler = sampling.Sampler(PIECES, 2)
    vocab = sampler.vocab
    word = "▁then"
    numbers = {vocab.text[i]: i for i in vocab.plain}

    def paths(i):
        if i == len(word):
            yield (), 0.0
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in numbers:
                for rest, p in paths(j):
                    yield (numbers[word[i:j]], *rest), p - np.log(numbers[word[i:j]] + sampling.OFFSET)

    every = dict(paths(0))
    total = np.logaddexp.reduce(list(every.values()))
    chance = {k: float(np.exp(v - total)) for k, v in every.items()}
    n, second, estimate = 6000, {}, 0.0
    for out in sampler.samples([int(x) for x in np.random.default_rng(0).integers(0, 2**62, n)], ["then"] * n):
        assert len({tuple(o[0].tolist()) for o in out}) == 2 and out[0][2] >= out[1][2]
        second[tuple(out[1][0].tolist())] = second.get(tuple(out[1][0].tolist()), 0) + 1
        estimate += sum(np.exp(o[1] - o[3]) * len(o[0]) for o in out)
    for k in sorted(chance, key=chance.get)[-3:]:
        expected = sum(chance[b] * chance[k] / (1 - chance[b]) for b in chance if b != k)
        assert abs(second.get(k, 0) / n - expected) < 0.03
    assert abs(estimate / n - sum(p * len(k) for k, p in chance.items())) < 0.02


def test_op4_and_op6(docs, none, spark):
    labels = spark.createDataFrame([(1, 2, 0), (7, 1, 1), (7, 0, 0), (5, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, grade int, toxic int")
    model = ordinal.fit(docs, labels)
    found = ordinal.score(docs, model)
    assert found.count() == len(ROWS) and found.filter("tail_probability NOT BETWEEN 0 AND 1 OR tail_probability IS NULL").count() == 0
    assert ordinal.score(none, model).count() == 0
    assert ordinal.score(docs, ordinal.fit(docs, labels.limit(0))).count() == len(ROWS)
    weights = toxicity.fit(docs, labels, F.lit(True))
    scored = toxicity.score(docs, weights)
    assert scored.columns[-1] == "score" and scored.filter("score NOT BETWEEN 0 AND 1 OR score IS NULL").count() == 0
    assert toxicity.score(none, weights).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0), F.lit(True))).collect()} == {0.0}


def test_op5(docs, none):
    found = {(r.key, r.fp, r.component) for r in simhash.components(docs).collect()}
    zero = {c for k, fp, c in found if fp == 0}
    assert zero == {2} and {c for k, fp, c in found if k in (1, 7)} >= {1}
    assert simhash.components(none).count() == 0 and simhash.near_dedup(none).count() == 0
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    rows = kept.select("doc_id", "text").collect()
    assert len([r for r in rows if r.text == PROSE]) == 1 and len([r for r in rows if not (r.text or "").strip()]) == 1
    assert len(rows) == 6


def test_op5_shards_and_long_chains(spark):
    """Every pair over several shards, and a chain that takes rounds to contract, against union by brute force."""
    rng = np.random.default_rng(5)
    chain = [int(rng.integers(0, 2**62))]
    for i in range(60):
        chain.append(chain[-1] ^ (1 << (i % 60)))
    points = np.unique(np.array([*chain, *rng.integers(0, 2**62, 3000).tolist()], np.int64))
    df = spark.createDataFrame([(int(p), int(i)) for i, p in enumerate(points)], "fp long, key long")
    old = simhash.SAMPLE_LEAST
    got = {r.key: r.component for r in simhash.named(df.withColumn("key", F.col("key"))).collect()}
    assert old == simhash.SAMPLE_LEAST
    tied = {(r.node, r.root) for r in simhash.roots(simhash.links(df.select("fp"), 2, shard=200)).collect()}
    at = {int(p): i for i, p in enumerate(points)}
    root = list(range(len(points)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    far = np.bitwise_count(points.view(np.uint64)[:, None] ^ points.view(np.uint64)[None]) <= 2
    for a, b in zip(*np.nonzero(np.triu(far, 1))):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(len(points))}
    assert got == want
    assert {at[n]: at[r] for n, r in tied if n != r} == {i: r for i, r in want.items() if i != r}


def test_op7(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = tokencount.token_counts(docs, path)
    assert found.count() == len(ROWS) and {(r.n_bytes, r.n_tokens) for r in found.filter("coalesce(text, '') = ''").collect()} == {(0, 0)}
    assert tokencount.token_counts(none, path).count() == 0
    merger = tokencount.merger(path)
    from tokenizers import Tokenizer

    texts = ["aaaaaaaaa", "<|endoftext|>x  <|endoftext|>", "  \n\n ", "I'll don't", "\U0001f600" * 9, LONG, "!" * 999, "9" * 50]
    assert merger.text_counts(texts).tolist() == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def page(body, frame="<nav><ul><li>Home</li></ul></nav><div class=x>All rights reserved by us</div>"):
    return f"<html><head><title>t</title></head><body>{frame}{body}</body></html>"


def test_op8(spark):
    rows = [(i, "http://a.example/x", page(f"<div><p>Text {i} &amp; more</p><p>line   two<br>three</p></div>"), "old") for i in range(6)]
    rows += [(10, None, None, None), (11, "", "", None), (12, "no url", "a < b <b>c", None), (13, "http://b.example:80/", page("<article><h1>H</h1><p>P &#233;<aside>no</aside><ul><li>1<li>2</ul></article>"), None), (14, "http://c.example/", "<p>x" + "<div>" * 3000 + "deep", None), (0, "http://a.example/x", rows[0][2], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for most in (htmltext.BROADCAST_MOST, -1):
        found = {r.page_id: r.text for r in htmltext.extract(pages, broadcast_most=most).collect()}
        assert all(found[i] == f"Text {i} & more\nline two three" for i in range(6)), found
        assert [found[i] for i in (10, 11, 12, 13, 14)] == ["", "", "a < b c", "H\nP é\n1\n2", "x\ndeep"]
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_op9(docs, none, spark):
    items = spark.createDataFrame([(1, " ".join(PROSE.split()[:40])), (2, None), (3, ""), (4, "naïve 中文"), (1, "repeated item of other words entirely here")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert found == {(1, 1), (7, 1), (None, 1), (8, 4)}
    assert decontam.contaminated(none, items).count() == 0 and decontam.contaminated(docs, items.limit(0)).count() == 0
    assert {r.doc_id for r in decontam.drop_contaminated(docs, items).filter("doc_id IN (1, 8)").collect()} == set()
    assert decontam.drop_contaminated(docs, items.limit(0)).count() == len(ROWS)


def test_op9_search_against_plain_scores():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(words[int(k)] for k in np.minimum(rng.exponential(20, int(rng.integers(3, 40))), 119))) for i in range(300)]
    index = decontam.Index(items)
    for _ in range(60):
        terms = sorted({index.terms[w] for w in (words[int(k)] for k in rng.integers(0, 120, 25)) if w in index.terms})
        score = np.zeros(len(index.keys))
        for t in terms:
            score[index.items[t]] += index.impact[t]
        for threshold in (0.3, 0.6):
            assert dict(index.search(terms, threshold)).keys() == set(np.flatnonzero(score >= threshold - 1e-9).tolist())


def test_op10(docs, none):
    found = rules.quality(docs)
    assert found.count() == len(ROWS) and found.filter("coalesce(trim(text), '') = '' AND kept" if "text" in found.columns else "n_words = 0 AND (kept OR NOT base_failed)").count() == 0
    assert rules.quality(none).count() == 0
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns and rules.keep_good(none).count() == 0


def test_pipeline_stages_take_what_comes(spark, docs):
    sf_dir = "/root/testdata/sf0.001"
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
            out.count()


def test_op8_counts_alone_find_the_template(spark):
    body = lambda i: f"<div class=x>Our long story about things</div><p>Page {i} says {i * 7} words</p>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<html><body>{body(i)}</body></html>") for i in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in htmltext.extract(pages).collect()} == {i: f"Page {i} says {i * 7} words" for i in range(8)}


def test_op8_section_of_a_large_host(spark):
    side = "<div class=x>Only this section says so</div>"
    rows = [(i, f"http://h/{'news' if i < 6 else 'other'}/{i}", f"<html><body>{side if i < 6 else ''}<p>Page {i}</p></body></html>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in htmltext.extract(pages).collect()} == {i: f"Page {i}" for i in range(60)}


def test_op1_learns_a_rare_language(spark):
    common = spark.range(20_000).selectExpr("id AS doc_id", "concat('the house and the garden ', id) AS text", "'en' AS lang")
    rare = spark.range(3).selectExpr("id + 50000 AS doc_id", "concat('talo ja puutarha ', id) AS text", "'fi' AS lang")
    languages, _ = langid.fit(common.union(rare), PIECES, F.lit(True))
    assert sorted(languages) == ["en", "fi"]


def test_op10_holds_no_rows_of_a_checkpoint(spark):
    """The counts are read from a table, in small row groups."""
    found = rules.quality(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"))
    assert "ExistingRDD" not in found._jdf.queryExecution().toString()
    assert sorted((r.doc_id, r.n_words, r.kept) for r in found.collect()) == [(1, 2, False), (2, 0, False)]
