"""The registered queries over the smallest tables, against plain restatements of their contracts."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from larkspur.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, query):
    return query(spark, SF).collect()


def test_op1_holds_out_and_predicts(spark, docs):
    found = rows(spark, Q.op1_language)
    assert sorted(r.doc_id for r in found) == sorted(docs)
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_op2_is_what_the_library_gives(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    found = {r.doc_id: r for r in rows(spark, Q.op2_token_ids)}
    for key in sorted(docs):
        ids = [*library.encode(docs[key].text or "", add_special_tokens=False).ids, 2]
        got = found[key]
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op3_samples_are_distinct_ordered_and_decode(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    by: dict = {}
    for r in rows(spark, Q.op3_segmentations):
        by.setdefault(r.doc_id, []).append(r)
        assert r.decodes and r.n_pieces == len(r.ids) and r.log_inclusion <= 0
        assert library.decode(r.ids) == docs[r.doc_id].text
    assert by.keys() == docs.keys()
    for found in by.values():
        found.sort(key=lambda r: r.sample)
        assert len({tuple(r.ids) for r in found}) == len(found)
        assert all(a.perturbed >= b.perturbed for a, b in zip(found, found[1:]))


def test_op5_against_all_pairs(spark, docs):
    prints = {}
    for key, row in docs.items():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), row.text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[key] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = rows(spark, Q.op5_simhash)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {k: (f"{p:016x}", find(k)) for k, p in prints.items()}


def test_op7_is_what_the_library_gives(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows(spark, Q.op7_token_counts):
        text = docs[r.doc_id].text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)


def test_op10_counts(spark, docs):
    for r in rows(spark, Q.op10_quality_rules):
        text = docs[r.doc_id].text or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {w for w in windows if windows.count(w) > 1}
        n_repeat = len({i + k for i, w in enumerate(windows) if w in twice for k in range(3)})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), n_repeat)
        assert r.base_failed == (len(words) < 50 or 100 * n_repeat > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_op9_finds_verbatim_items_and_little_else(spark, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    quoted = {(k, i) for k, d in docs.items() for i, t in items.items() if f" {plain(t)} " in f" {plain(d.text)} "}
    found = {(r.doc_id, r.item_id) for r in rows(spark, Q.op9_decontamination)}
    assert quoted <= found
    for key, item in found:
        words, own = plain(docs[key].text).split(), plain(items[item]).split()
        shingles = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        assert len(shingles & {tuple(words[i : i + 5]) for i in range(len(words) - 4)}) >= 0.8 * len(shingles)
