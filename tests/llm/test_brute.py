"""Operators that SQL cannot express, against brute-force restatements on small inputs."""

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from larkspur.llm import decontam, htmltext, langid, ordinal, rules, simhash, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_op1_forward_sums_over_all_segmentations():
    vocab = langid.vocabulary(PIECES)
    rng = np.random.default_rng(0)
    probability = rng.random((vocab.size, 3)) / vocab.size
    scorer = langid.Scorer(PIECES, ["a", "b", "c"], probability)
    numbers = {vocab.text[i]: i for i in vocab.plain}

    def total(word, k):
        if not word:
            return 1.0
        found = sum(probability[numbers[word[:n]], k] * total(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in numbers)
        return found if word[0] in numbers else found + langid.BYTE ** len(word[0].encode()) * total(word[1:], k)

    words = ["the", "garden", "naïve", "ab\u0dc0d", "x"]
    got = scorer.word_scores(words)
    for i, word in enumerate(words):
        for k in range(3):
            assert math.isclose(got[i, k], math.log(total("\u2581" + word, k)), rel_tol=1e-9)


def test_op1_learns_as_counting_all_segmentations_does():
    vocab = langid.vocabulary(PIECES)
    counts = {"en": {"then": 3, "he": 1}}
    numbers = {vocab.text[i]: i for i in vocab.plain}

    def paths(word):
        if not word:
            yield ()
        for n in range(1, len(word) + 1):
            if word[:n] in numbers:
                yield from ((numbers[word[:n]], *rest) for rest in paths(word[n:]))

    p = np.zeros(vocab.size)
    p[vocab.plain] = 1 / len(vocab.plain)
    for _ in range(langid.ROUNDS):
        got = np.zeros(vocab.size)
        for word, times in counts["en"].items():
            every = [(path, math.prod(p[i] for i in path)) for path in paths("\u2581" + word)]
            whole = sum(x for _, x in every)
            for path, x in every:
                for i in path:
                    got[i] += times * x / whole
        p[vocab.plain] = (got[vocab.plain] + langid.SMOOTH) / (got.sum() + langid.SMOOTH * len(vocab.plain))
    assert np.allclose(langid.learn(vocab, counts)[1][:, 0], p, rtol=1e-9)


def test_op4_likelihood_and_its_slopes():
    rng = np.random.default_rng(1)
    value, cuts, grade, h = rng.normal(0, 2, 60), np.array([-1.0, 0.3, 0.9]), rng.integers(0, 4, 60), 1e-6
    loss, by_value, by_cut = ordinal.likelihood(value, cuts, grade)
    chance = lambda v, g: sum(s / (1 + math.exp(v - c)) for s, c in ((1, cuts[g] if g < 3 else math.inf), (-1, cuts[g - 1] if g else -math.inf)) if math.isfinite(c)) + (g == 3)
    assert np.allclose(loss, [-math.log(chance(v, g)) for v, g in zip(value, grade)])
    assert np.allclose((ordinal.likelihood(value + h, cuts, grade)[0] - ordinal.likelihood(value - h, cuts, grade)[0]) / (2 * h), by_value, atol=1e-5)
    for j in range(3):
        step = np.eye(3)[j] * h
        assert np.allclose((ordinal.likelihood(value, cuts + step, grade)[0] - ordinal.likelihood(value, cuts - step, grade)[0]) / (2 * h), by_cut[:, j], atol=1e-5)


def test_op4_thresholds_rise_and_fit_the_shares():
    rng = np.random.default_rng(2)
    examples = [(np.array([5]), np.array([0.0], np.float32), int(g)) for g in rng.choice(4, 4000, p=[0.1, 0.2, 0.3, 0.4])]
    _, cuts = ordinal.train(examples, 4)
    assert (np.diff(cuts) > 0).all()
    assert np.allclose(1 / (1 + np.exp(-cuts)), [0.1, 0.3, 0.6], atol=0.06)


def test_op6_is_ftrl_by_the_book():
    rng = np.random.default_rng(3)
    examples = [(np.unique(rng.integers(0, 40, 8)), int(rng.random() < 0.4)) for _ in range(300)]
    z, n, size = Counter(), Counter(), 1 << toxicity.BITS
    order = np.random.default_rng(0)

    def weight(i):
        if i != size and abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - (math.copysign(toxicity.L1, z[i]) if i != size and z[i] else 0.0)) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for r in order.permutation(len(examples)):
            slots = [*examples[r][0].tolist(), size]
            w = {i: weight(i) for i in slots}
            g = 1 / (1 + math.exp(-sum(w.values()))) - examples[r][1]
            for i in slots:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    bias, kept, weights = toxicity.train(examples)
    assert math.isclose(bias, weight(size), rel_tol=1e-9)
    assert kept.tolist() == sorted(i for i in z if i != size and abs(z[i]) > toxicity.L1)
    assert np.allclose(weights, [weight(i) for i in kept.tolist()])


def test_pipeline_keeps_all_without_labels(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "doc_id long, text string")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 3


SITE = """<html><body><div><div><a href="/{i}">{w} home</a> <a href="/x">{w} news</a></div></div><div>Advert {w} {i}</div>
<div><h1>Title {i}</h1><p>Story {w} of page {i} goes on</p>{more}</div><div>(c) {w} {i}</div></body></html>"""


def site(hosts=("a", "b")):
    rng = np.random.default_rng(4)
    for host in hosts:
        for i in range(12):
            word = "".join(rng.choice(list("abcdefgh"), 6))
            more = "".join(f"<p>Paragraph {k} by {word}</p>" for k in range(i % 4))
            yield i, f"http://{host}.example/{'news' if i < 6 else 'more'}/{i}", SITE.format(i=i, w=word, more=more), "\n".join([f"Title {i}", f"Story {word} of page {i} goes on", *(f"Paragraph {k} by {word}" for k in range(i % 4))])


def test_op8_plain_divisions_are_told_by_the_counts_alone(spark):
    rows = list(site())
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert sorted((r.url, r.text) for r in htmltext.extract(pages).collect()) == sorted((r[1], r[3]) for r in rows)


def test_op8_templates_are_those_of_a_plain_count(spark):
    rows = [*site(), (99, "http://c.example/", SITE.format(i=1, w="w", more=""), "")]
    rows.append((100, rows[0][1], rows[0][2], ""))  # a copy counts once
    once = set()
    for _, url, source, _ in rows:
        host, section = re.match(r"http://([^/]*)/(?:([^/]+)/)?", url).groups()
        page = htmltext.Page(source, host)
        for part in {None, section}:
            once.add((host, part, page.digest, None))
            once |= {(host, part, page.digest, d) for _, own in page.may for d in own}
    count = Counter((h, s, d) for h, s, _, d in once)
    signed = lambda d: d if d is None or d < 1 << 63 else d - (1 << 64)
    wanted = {(h, signed(d)) for (h, s, d), n in count.items() if count[h, s, None] >= 4 and (d is not None and d & 1 and n >= 2 or n >= 4 and n >= 0.3 * count[h, s, None])}
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {(r.host, r.digest) for r in htmltext.templates(pages).collect()} == wanted and {h for h, _ in wanted} == {"a.example", "b.example"}


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<body><header>Site name</header><div><p>Text one.</p></div></body>", "Text one."),
        ("<article><div class='side-by-side'><p>B</p></div><p class=alert>C</p><section class=related-work><p>R</p></section><menu><li>m<li>n</menu></article>", "B\nC\nR\nm\nn"),
        ("<main><p>intro</p><article>x</article></main>", "intro\nx"),
        ("<div class=cookie-notice>c</div><div class=site-footer>f</div><p>keep</p><div id=reader-comments><p>r</p></div>", "keep"),
        ("<article><header><h1>T</h1></header><p>x &amp;   y</article><div>after</div>", "T\nx & y"),
    ],
)
def test_op8_single_pages(source, text):
    assert htmltext.Page(source, "h").text(lambda digest: False, True) == text


def test_op8_columns_may_have_any_name(spark):
    pages = spark.createDataFrame([(1, "http://h/", "<p>x", 5, 6)], "page_id long, url string, html string, __host int, __html int")
    assert [tuple(r) for r in htmltext.extract(pages).collect()] == [(1, "http://h/", "<p>x", 5, 6, "x")]


def test_op9_parts_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate([*rng.integers(5, 60, 60), 400, 900])]
    texts = [" ".join([*rng.choice(words, 50), *text.split(), *rng.choice(words, 30)]) for _, text in items[::3]]
    texts += [" ".join(rng.choice(words, 200)) for _ in range(20)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.contaminated(docs, table).select("doc_id", "item_id").collect()))
    assert {(i, items[3 * i][0]) for i in range(len(items[::3]))} <= set(whole)
    monkeypatch.setattr(decontam, "ITEMS", 7)
    assert sorted(map(tuple, decontam.contaminated(docs, table).select("doc_id", "item_id").collect())) == whole
    same_name = decontam.contaminated(docs.withColumnRenamed("doc_id", "item_id"), table, key="item_id")
    assert same_name.columns[:2] == ["item_id", "found_item_id"] and same_name.count() == len(whole)


def test_op9_block_bounds_are_the_sums():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(80)]
    index = decontam.Index([(i, " ".join(rng.choice(words, 12))) for i in range(200)])
    terms = [np.unique(rng.integers(0, len(index.terms), int(n))) for n in rng.integers(1, 40, 30)]
    passage = np.repeat(np.arange(30), [len(t) for t in terms])
    got = index.reachable(passage, np.concatenate(terms), 30, 0.6)
    for own, blocks in zip(terms, got):
        bound = np.zeros(index.n_blocks)
        for t in own:
            at = slice(index.block_at[t], index.block_at[t] + index.block_count[t])
            bound[index.blocks[at]] += index.highest[at]
        assert blocks == np.flatnonzero(bound >= 0.6 - 1e-9).tolist()


def plain_em(rows):
    """The estimate text by text, without patterns."""
    good, k, most = [1 / (1 + math.exp(-sum(r))) for r in rows], len(rows[0]), math.log(rules.TRUST)
    for _ in range(rules.ROUNDS):
        total = (sum(1 - g for g in good), sum(good))
        prior, odds = math.log((total[1] + 1) / (total[0] + 1)), []
        for r in range(k):
            own = {}
            for v in (-1, 0, 1):
                usual = (sum(row[r] == v for row in rows) + 1) / (len(rows) + 3)
                seen = (sum(1 - g for row, g in zip(rows, good) if row[r] == v), sum(g for row, g in zip(rows, good) if row[r] == v))
                bad, fine = ((s + (rules.SMOOTH * t + 1e-6) * usual) / (t * (1 + rules.SMOOTH) + 1e-6) for s, t in zip(seen, total))
                own[v] = min(max(math.log(fine / bad), 0.0 if v > 0 else -most), 0.0 if v < 0 else most)
            odds.append(own)
        good = [1 / (1 + math.exp(-prior - sum(o[v] for o, v in zip(odds, row)))) for row in rows]
    return good


def test_op10_estimate_is_that_of_a_plain_loop_and_no_single_vote():
    rng = np.random.default_rng(8)
    truth = rng.random(800) < 0.7
    rows = [tuple(int(rng.choice([1 if t else -1, 0, -1 if t else 1], p=[a, 0.2, 0.8 - a])) for a in (0.75, 0.6, 0.5, 0.45)) for t in truth]
    prior, odds = rules.estimate(list(Counter(rows).items()))
    got = [1 / (1 + math.exp(-prior - sum(o[v] for o, v in zip(odds, row)))) for row in rows]
    assert np.allclose(got, plain_em(rows), rtol=1e-6)
    kept = np.array(got) >= rules.KEEP
    for r in range(4):
        assert any(k != (row[r] >= 0) for k, row in zip(kept, rows)) and any(k != (row[r] > 0) for k, row in zip(kept, rows))
    right = max((np.array([row[r] for row in rows]) > 0).__eq__(truth).mean() for r in range(4))
    assert (kept == truth).mean() > right
    flipped = rules.estimate([(tuple(-v for v in row), n) for row, n in Counter(rows).items()])
    assert all(o[1] >= 0 >= o[-1] for o in flipped[1])


def test_op5_contraction_of_a_long_rising_chain(spark):
    links = spark.range(3000).selectExpr("id AS a", "id + 1 AS b")
    assert {(r.root) for r in simhash.roots(links).collect()} == {0}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from larkspur.llm import common

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(RuntimeError):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
    context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_workers_forget_other_operators_words():
    from larkspur.llm import common

    memo = common.Memo(lambda words: (np.arange(len(words)),))
    common.turn_to("one")
    memo.codes(["a", "b"])
    memo.arrays()
    common.turn_to("one")
    assert memo.known == 2
    common.turn_to("two")
    assert memo.known == 0 and len(memo.index) == 0
