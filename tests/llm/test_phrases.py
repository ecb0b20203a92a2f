"""Phrases against a plain count, with shortened fingerprints that collide."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fablework.llm import phrases
from fablework.llm.phrases import phrase_collocations
from fablework.llm.wordcodes import Polynomial, byte_kinds, coded_words, word_hashes

SCHEMA = "lang string, text string, key string, fp int, n string"


def plain(rows, least, longest=4, best=2000, covered=80):
    """The same by dictionaries."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    k = (lang, tuple(words[i : i + size]))
                    f[k] = f.get(k, 0) + 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in found.items():
        if any(
            l2 == lang and len(w2) > len(w) and 100 * b >= covered * a and any(w2[i : i + len(w)] == w for i in range(len(w2)))
            for (l2, w2), b in found.items()
        ):
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, left, right, n[lang], score))
    return sorted(
        (lang, i + 1, p.decode(), a, left, right, total, score)
        for lang, kept in out.items()
        for i, (_, _, p, a, left, right, total, score) in enumerate(sorted(kept)[:best])
    )


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocab = ["the", "of", "É", "né", "a1", "x-y", "漢字", "Big", "dog", "cat"]
    rows = []
    for i in range(160):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words) + 1) : 0] = ["New", "York", "city", "hall"]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!? "]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    rows += [("en", None), (None, None), ("xx", ""), ("xx", " \t"), ("de", "the of the of " * 4000)]
    rows += [("en", "copy of a copy of a copy")] * 40
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("options", [{}, {"fingerprint_bits": 5}, {"longest": 2}, {"longest": 5, "best": 3, "covered": 55}])
def test_phrases_equal_plain_counts(spark, corpus, options):
    least = 12
    got = phrase_collocations(frame(spark, corpus).repartition(5), least=least, **options).collect()
    want = plain(corpus, least, **{k: v for k, v in options.items() if k != "fingerprint_bits"})
    assert sorted(tuple(r) for r in got) == want and want


def test_many_small_slices_give_the_same(spark, corpus, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 200)  # the workers are forked from here or read the module anew: either is right
    got = phrase_collocations(frame(spark, corpus).coalesce(2), least=12).collect()
    assert sorted(tuple(r) for r in got) == plain(corpus, 12)


def test_nothing_to_find(spark):
    none = frame(spark, [("en", None), (None, ""), ("en", "too few words here")])
    assert phrase_collocations(none).collect() == [] and phrase_collocations(none.limit(0)).collect() == []


def test_two_phrases_of_one_fingerprint_stop_the_job(spark):
    texts = spark.createDataFrame([("en", "one two", 1), ("en", "six ten", 2)], "lang string, text string, key bigint")
    found = spark.createDataFrame([(5, 6, 30, 1, 7, 2, 7)], "fp int, check int, n bigint, key bigint, place bigint, key2 bigint, place2 bigint")
    with pytest.raises(Exception, match="share both fingerprints"):
        phrases._read_phrases(found, texts).collect()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é漢.\n\t,x", max_size=12)), max_size=8))
def test_words_of_a_column(texts):
    kinds = byte_kinds(b" \t", b".,\n")
    column = pa.array(["pad", *texts, "pad"], pa.string())[1:-1]  # a column that begins inside its buffers
    words = coded_words(column, kinds)
    want, piece = [], -1
    for row, text in enumerate(texts):
        for part in re.split("[.,\n]", text or ""):
            piece += 1
            want += [(row, piece, w.replace("B", "b").encode()) for w in re.findall("[^ \t]+", part)]
    got = list(zip(words.rows.tolist(), words.pieces.tolist(), [words.distinct[c].as_py() for c in words.codes]))
    assert [(r, w) for r, _, w in got] == [(r, w) for r, _, w in want]
    same = lambda rows: [a[1] == b[1] for a, b in zip(rows, rows[1:])]
    assert same(got) == same(want)
    spans = [(texts[r] or "").encode()[a:b].replace(b"B", b"b") for r, a, b in zip(words.rows, words.begins, words.ends)]
    assert spans == [w for _, _, w in want]


def test_fingerprints_depend_on_the_window_alone():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 3, 400).astype(np.uint64)
    at = np.arange(390)
    for variant in (0, 1):
        chain = Polynomial(values, variant)
        for length in (1, 2, 3, 7):
            prints = chain.windows(at, at + length)
            seen = {}
            for i in at:
                seen.setdefault(tuple(values[i : i + length].tolist()), set()).add(int(prints[i]))
            assert all(len(v) == 1 for v in seen.values()) and len(set.union(*seen.values())) == len(seen)
    words = pa.array([b"", b"a", b"aa", b"ab", b"ba", b"\xc3\xa9"], pa.large_binary())
    assert len(set(word_hashes(words).tolist())) == 6
