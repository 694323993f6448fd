"""The pipeline's near-copy stage against all pairs of texts."""

import numpy as np

import corpus_pipeline
from larkspur.llm import nearcopies, simhash


def sets_of(texts):
    found = []
    for text in texts:
        words = text.lower().split()
        found.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return found


def kept_by_all_pairs(rows):
    sets, root = sets_of(t for _, t in rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(key, least.get(find(i), key))
    return sorted(least.values())


def texts_with_copies():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    line = " ".join(rng.choice(words, 12))
    texts = []
    for _ in range(40):
        base = list(rng.choice(words, rng.integers(30, 120)))
        texts.append(" ".join(base))
        for _ in range(4):  # copies with a few words changed, so that pairs lie on both sides of 0.8
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(1, 4)):
                copy[at] = str(rng.choice(words))
            texts.append(" ".join(copy))
        texts.append(line + " " + " ".join(rng.choice(words, rng.integers(3, 60))))
    chain = list(rng.choice(words, 100))
    for i in range(0, 100, 10):  # each like the next, the ends unlike
        chain[i] = str(rng.choice(words))
        texts.append(" ".join(chain))
    hot = list(rng.choice(words, 80))
    for _ in range(60):
        hot_copy = list(hot)
        hot_copy[rng.integers(0, 80)] = str(rng.choice(words))
        texts.append(" ".join(hot_copy))
    return [*texts, "", " ", "one two", "ONE  two", "one two three four five"]


def test_stage_equals_all_pairs(spark):
    rows = list(enumerate(texts_with_copies()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert found.columns == docs.columns
    assert sorted(r.doc_id for r in found.collect()) == kept_by_all_pairs(rows)


def test_rounds_and_broadcasts_set_the_order_only(spark, monkeypatch):
    rows = list(enumerate(texts_with_copies()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nearcopies, "STARS", 0)
    monkeypatch.setattr(nearcopies, "BROADCAST_MOST", -1)
    assert sorted(r.doc_id for r in nearcopies.near_dedup(docs).collect()) == kept_by_all_pairs(rows)


def test_copies_of_one_text_are_not_compared_with_each_other(spark, monkeypatch):
    """Copies of one text that are too far from each other are too many for all pairs of them; each has changes of its own."""
    rng, most = np.random.default_rng(11), 600
    words = [f"w{i}" for i in range(100_000)]
    base = list(rng.choice(words, 154))
    texts = [" ".join(base)]
    for i in range(most):
        copy = list(base)
        for at in rng.choice(154, 1 + i % 6, replace=False):
            copy[at] = str(rng.choice(words))
        texts.append(" ".join(copy))
    met, whole = [], nearcopies.verified

    def counted(pairs, *more):
        met.append(pairs.count())
        return whole(pairs, *more)

    monkeypatch.setattr(nearcopies, "verified", counted)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.near_dedup(docs).collect()) == kept_by_all_pairs(rows)
    assert sum(met) < 10 * most


def test_groups_by_rare_shingles_lose_no_pair(spark, monkeypatch):
    rows = list(enumerate(texts_with_copies()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nearcopies, "WIDE", 1)
    for stars, bits in ((0, 20), (1, 6)):
        monkeypatch.setattr(nearcopies, "STARS", stars)
        monkeypatch.setattr(nearcopies, "PLACE_BITS", bits)
        monkeypatch.setattr(nearcopies, "PLACE_SHIFT", np.uint64(64 - bits))
        assert sorted(r.doc_id for r in nearcopies.near_dedup(docs).collect()) == kept_by_all_pairs(rows)


def test_samples_find_pairs_at_the_bar():
    """Pairs of a similarity of 0.8 share a fingerprint but in 1 of 300 cases."""
    rng, missed = np.random.default_rng(2), 0
    for _ in range(500):
        common, own = rng.integers(0, 2**63, 160).astype(np.uint64), rng.integers(0, 2**63, 40).astype(np.uint64)
        a, b = (np.unique(np.r_[common, part]) for part in (own[:20], own[20:]))
        missed += not np.intersect1d(nearcopies.fingerprints(a, a), nearcopies.fingerprints(b, b)).size
    assert missed <= 6


def test_sketches_differ_by_the_similarity():
    rng, far = np.random.default_rng(3), {0.8: [], 0.6: []}
    for s, (common, own) in {0.8: (160, 20), 0.6: (120, 40)}.items():
        for _ in range(60):
            both, rest = rng.integers(0, 2**63, common).astype(np.uint64), rng.integers(0, 2**63, 2 * own).astype(np.uint64)
            a, b = (nearcopies.sketch(np.unique(np.r_[both, part])) for part in (rest[:own], rest[own:]))
            far[s].append(int(np.bitwise_count(a ^ b).sum()))
    assert abs(np.mean(far[0.8]) - 102.4) < 6 and abs(np.mean(far[0.6]) - 204.8) < 8
    assert max(far[0.8]) <= nearcopies.FARTHEST < min(far[0.6])


def test_columns_may_have_any_name(spark):
    rows = [(1, "one two three four five six", 77, 5), (2, "one two three four five six", 78, 6), (3, None, 79, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __a long, fp long")
    for dedup in (nearcopies.near_dedup, simhash.near_dedup):
        assert sorted(map(tuple, dedup(docs).collect())) == [rows[0], rows[2]]


def test_components_of_few_links_take_few_jobs(spark, monkeypatch):
    """The driver holds what each job leaves; in one task or by rounds, components are the same."""
    rng, context = np.random.default_rng(7), spark.sparkContext
    pairs = [(int(a), int(b)) for a, b in rng.integers(-400, 400, (300, 2)) if a != b] + [(i, i + 1) for i in range(1000, 1400)]
    least = {x: x for pair in pairs for x in pair}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if all(least[a] == least[b] for a, b in pairs):
            break
    links = spark.createDataFrame(pairs, "a long, b long")
    for most in (1 << 18, 60, 0):
        monkeypatch.setattr(simhash, "GATHERED", most, raising=False)
        context.setJobGroup(f"roots {most}", "")
        assert {(r.node, r.root) for r in simhash.roots(links).collect()} == set(least.items())
        jobs = len(context.statusTracker().getJobIdsForGroup(f"roots {most}"))
        assert jobs <= 12 or most < len(pairs)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert simhash.roots(links.filter("a IS NULL")).isEmpty()
