"""Similar documents and repeated passages against plain loops."""

import random
from collections import defaultdict

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fablework.llm import common, ngram_join, passages
from fablework.llm.components import components
from fablework.llm.ngram_join import similar_groups
from fablework.llm.passages import common_passages, compact_windows, repeated_passages, without_repeats
from fablework.llm.common import remaining, stored
from fablework.session import shared_dir

SCHEMA = "doc_id bigint, text string, n_shingles string, component_id string, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def words(rng, n, pool=100_000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    base, line = words(rng, 120), words(rng, 9)
    rows = []
    for i in range(40):  # variants of one text, most of them similar to some others only
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append(w)
    drift = list(base)
    for i in range(12):  # a chain whose ends are not similar
        drift = list(drift)
        for j in range(2):
            drift[(i * 2 + j) * 4] = f"d{i}-{j}"
        rows.append(drift)
    rows += [words(rng, 60) + line for _ in range(15)]  # share a line only
    texts = [" ".join(w) for w in rows] + ["one two three", "ONE  two\tthree", "one two", "", "  \n", None, " ".join(base), " ".join(base).upper()]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return sorted(zip(ids, texts))


def test_groups_equal_all_pairs(spark, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_groups(frame(spark, corpus)).collect()}
    assert got == plain_groups(corpus)


def test_long_lists_are_compared_in_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_LIST", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_groups(frame(spark, corpus)).collect()}
    assert got == plain_groups(corpus)


def test_groups_of_repeated_rows_null_ids_and_nothing(spark):
    text = "a b c d e f g h"
    rows = [(3, text), (3, text), (None, text), (9, text), (None, None), (4, "")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in similar_groups(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (None, 3), (9, 3), (None, None), (4, 4)], key=str)
    assert similar_groups(frame(spark, [])).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


def plain_windows(h, least):
    out = []

    def split(lo, hi):
        if hi - lo + 1 >= least:
            c = lo + int(np.argmin(h[lo : hi + 1]))
            out.append((lo, c, hi))
            split(lo, c - 1)
            split(c + 1, hi)

    split(0, len(h) - 1)
    return sorted(out)


@pytest.mark.parametrize("n,least,values", [(200, 7, 1000), (200, 7, 5), (46, 46, 100), (30, 46, 9), (1, 1, 3), (120, 5, 1)])
def test_compact_windows_are_the_cartesian_tree(n, least, values):
    h = np.random.default_rng(n + values).integers(1, values + 1, n).astype(np.uint64)
    assert sorted(zip(*(x.tolist() for x in compact_windows(h, least)))) == plain_windows(h, least)


def test_common_passages_bridge_edits_and_split_at_gaps():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 10**9, 300)
    b = np.concatenate([rng.integers(0, 10**9, 40), a[50:120], rng.integers(0, 10**9, 5), a[125:200]])
    (i, j, k, m, same), = common_passages(a, b, 46, 0.75)
    assert (i, j, k, m) == (50, 200, 40, 190) and same >= 0.75
    b = np.concatenate([a[0:60], rng.integers(0, 10**9, 40), a[100:160]])
    found = sorted(x[:4] for x in common_passages(a, b, 46, 0.75))
    assert found == [(0, 60, 0, 60), (100, 160, 100, 160)]
    assert common_passages(a[:40], a[:40], 46, 0.75) == []


@pytest.mark.parametrize("n", [4, 8, 12, 16])
@pytest.mark.parametrize("turned", [False, True])
def test_common_passages_bridge_insertions_and_deletions(n, turned):
    rng = np.random.default_rng(n)
    token = rng.integers(0, 10**9, 200)
    text = lambda w: np.array([hash(tuple(w[i : i + 5].tolist())) for i in range(len(w) - 4)])
    passage, strange = token[:80], token[80 : 80 + n]
    a, b = text(passage), text(np.concatenate([token[150:], passage[:40], strange, passage[40:], token[100:140]]))
    common, union = 72, 76 + 4 + n
    expected = [(0, 76, 50, 50 + 76 + n)] if common / union >= 0.75 else []
    found = common_passages(b, a, 46, 0.75) if turned else common_passages(a, b, 46, 0.75)
    assert [(x[2:4] + x[:2]) if turned else x[:4] for x in found] == expected


def plain_parts(a, b, place, hits, least, similarity):
    """The rows of pieces of a chain, each compared on its own."""
    cuts = [0, *(n for n in range(1, len(hits)) if place[n] - place[n - 1] > 1 or hits[n] - hits[n - 1] > 1), len(hits)]
    out, reached = [], 0
    for n, start in enumerate(cuts[:-1]):
        for e in range(len(cuts) - 1, max(n, reached), -1):
            i, j, k, m, count = place[start], place[cuts[e] - 1] + 1, hits[start], hits[cuts[e] - 1] + 1, cuts[e] - start
            if max(j - i, m - k) < least or count < similarity * least or count < 0.9 * similarity * (j - i + m - k - count):
                continue
            x, y = set(a[i:j].tolist()), set(b[k:m].tolist())
            if len(x & y) / len(x | y) >= similarity:
                out.append((i, j, k, m, len(x & y) / len(x | y)))
                reached = e
                break
    return out


@pytest.mark.parametrize("kinds", [3, 60, 10**9])
def test_rows_of_pieces_equal_plain_comparison(kinds):
    rng = np.random.default_rng(kinds)
    for n in range(40):
        a = rng.integers(0, kinds, 250)
        kept = rng.random(250) > n / 80
        b = np.where(kept, a, rng.integers(kinds, 2 * kinds, 250))
        at = np.flatnonzero(kept)
        assert passages._similar_parts(a, b, at, at, 46, 0.75) == plain_parts(a, b, at, at, 46, 0.75)


def test_many_pieces_are_compared_in_one_pass_from_each(monkeypatch):
    a = np.arange(6000)
    b = np.where(a % 10 < 8, a, a + 10**6)  # two of ten differ: 8 / 12 is below the bound, but not by much
    at, rows = np.flatnonzero(a == b), []
    unique = np.unique
    monkeypatch.setattr(np, "unique", lambda x, *args, **kwargs: rows.append(len(x)) or unique(x, *args, **kwargs))
    assert passages._similar_parts(a, b, at, at, 46, 0.75) == []
    assert sum(rows) <= len(a) + len(b)


def test_repeats_are_found_and_clean_documents_left(spark):
    rng = random.Random(3)
    passage, other = words(rng, 60), words(rng, 80)
    rows = {i: words(rng, 150) for i in range(30)}
    for i in (4, 9, 17, 25):
        rows[i][20:20] = passage
    edited = list(other)
    edited[40] = "changed"
    rows[6][100:100] = other
    rows[21][10:10] = edited
    rows[28] = list(rows[2])  # a copy
    rows[29] = passage[:40] + words(rng, 50)  # too short a repeat
    texts = [(i, " ".join(w)) for i, w in rows.items()] + [(40, None), (41, ""), (42, "few words")]
    df = frame(spark, texts)
    repeats = repeated_passages(df)
    got = {(r["doc_id"], r["first_word"], r["past_word"], r["kept_doc_id"], r["kind"]) for r in repeats.collect()}
    assert got == {(i, 20, 80, 4, "passage") for i in (9, 17, 25)} | {(21, 10, 90, 6, "passage"), (28, 0, 150, 2, "copy")}
    left = {r["doc_id"]: r["text"] for r in without_repeats(df, repeats).collect()}
    changed = {9, 17, 25, 21, 28}
    assert 28 not in left and all(left[i] == t for i, t in texts if i not in changed)
    assert left[9].split() == rows[9][:20] + rows[9][80:]


def test_every_exact_repeat_of_fifty_words_is_covered(spark):
    rng = random.Random(11)
    pool = [words(rng, rng.randrange(50, 90)) for _ in range(6)]
    texts = [(i, " ".join(words(rng, 30) + rng.choice(pool) + words(rng, 20) + rng.choice(pool))) for i in range(40)]
    spans = defaultdict(list)
    for r in repeated_passages(frame(spark, texts)).collect():
        assert r["kept_doc_id"] < r["doc_id"] and r["similarity"] >= 0.75
        spans[r["doc_id"]].append((r["first_word"], r["past_word"]))
    first = {}
    for i, text in texts:
        w = text.split()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                assert any(a <= k and k + 50 <= b for a, b in spans[i]), (i, k)


@pytest.mark.parametrize("small", [64, 2])
def test_edited_repeats_are_found_behind_many_hubs(spark, monkeypatch, small):
    monkeypatch.setattr(passages, "SMALL_GROUP", small)
    monkeypatch.setattr(passages, "BLOCK_REGIONS", 16)
    rng = random.Random(21)
    passage = words(rng, 70)
    # documents with smaller ids have half of the passage, so they agree with it but are not similar
    rows = [words(rng, 10) + passage[k : k + 34] + words(rng, 60) for k in range(0, 37, 2) for _ in range(4)]
    pairs = set()
    for cut in (30, 33):
        edited = list(passage)
        edited[cut] = f"edit{cut}"
        rows.append(words(rng, 30) + edited + words(rng, 30))
    pairs.add((len(rows) - 1, len(rows) - 2))
    got = [r for r in repeated_passages(frame(spark, list(enumerate(map(" ".join, rows))))).collect()]
    assert {(r["doc_id"], r["kept_doc_id"]) for r in got if r["doc_id"] >= len(rows) - 2 and r["past_word"] - r["first_word"] >= 60} == pairs


def kept_tables(spark, since=()):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    return sorted(p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in since and (p / "_SUCCESS").exists())


def kept_shuffles(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = kept_shuffles(spark)
    rows, scratch = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id")), []
    assert len(stored(rows, "sums", scratch).collect()) == 7 and not [b for b in kept_shuffles(spark) - before if b.endswith(".data")]
    assert spark.conf.get(common._REMOVE_SHUFFLES) == "false" and Path(scratch[0].removeprefix("file:")).exists()
    gone = scratch[0]
    common.remove(spark, scratch)
    assert scratch == [] and not Path(gone.removeprefix("file:")).exists()


def test_operators_leave_only_the_tables_that_their_results_read(spark, corpus):
    before = {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}
    found, noted = repeated_passages(frame(spark, corpus)), []
    assert kept_tables(spark, before) == ["passage-members", "passage-pairs"] and found.count()
    before = {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}
    groups = similar_groups(frame(spark, corpus), scratch=noted)
    assert kept_tables(spark, before) == ["ngram-classes", "ngram-groups", "ngram-links", "ngram-members"] and groups.count() == len(corpus)
    common.remove(spark, noted)
    assert kept_tables(spark, before) == []


def test_meetings_in_rounds_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(passages, "SMALL_GROUP", 2)
    monkeypatch.setattr(passages, "BLOCK_REGIONS", 16)
    rng = random.Random(5)
    base = words(rng, 90)
    rows = []
    for i in range(60):  # variants that agree in part with many and are similar to some
        w = list(base)
        for k in rng.sample(range(90), 8):
            w[k] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words(rng, 20) + w + words(rng, 20))))
    got, rounds = {}, {}
    for n in (1000, 1):
        monkeypatch.setattr(passages, "ROUND_BLOCKS", n)
        made = []
        monkeypatch.setattr(passages, "stored", lambda df, label, *a: (made.append(label), stored(df, label, *a))[1])
        got[n] = sorted(map(tuple, repeated_passages(frame(spark, rows)).collect()), key=str)
        rounds[n] = made.count("passage-partners")
    assert got[1] == got[1000] and got[1] and rounds[1000] == 1 < rounds[1]


def test_places_out_of_reach_are_told_from_open_ones():
    a, b = np.arange(60), np.concatenate([np.arange(1000, 1030), np.arange(60)])
    spot = np.where(b < 60, b, -1)
    count = lambda open_: np.append(0, np.cumsum(np.isin(np.arange(90), open_)))
    assert common_passages(a, b, 46, 0.75) == [(0, 60, 30, 90, 1.0)]
    assert passages._may_cover(spot, spot, count([40]), 46, 0.75)
    assert not passages._may_cover(spot, spot, count([3, 29]), 46, 0.75)
    shared = spot >= 0
    shared[2] = True  # a stray hit far before the passage can't be reached, one near it can
    assert np.flatnonzero(passages.coverable(b, shared, 46, 0.75)).tolist() == list(range(30, 90))
    shared[25] = True
    assert passages.coverable(b, shared, 46, 0.75)[25:].all()


def test_passages_of_nothing(spark):
    assert repeated_passages(frame(spark, [])).count() == 0
    assert repeated_passages(frame(spark, [(1, None), (None, " ".join(map(str, range(99)))), (2, "")])).count() == 0


def test_remaining_text_keeps_what_stands_around():
    assert remaining("a  b\nc d", [(1, 2)]) == "a  c d" and remaining("ä b", [(0, 1)]) == "b" and remaining("a b", [(0, 2)]) == ""


def test_a_null_id_never_hides_a_copy_with_one(spark):
    rng = random.Random(5)
    a = words(rng, 80)
    near = list(a)
    near[40] = "other"
    rows = [(None, " ".join(a)), (3, " ".join(a)), (9, " ".join(near))]
    got = {r["doc_id"]: r["component_id"] for r in similar_groups(frame(spark, rows).coalesce(1)).collect()}
    assert got[9] == got[3] == 3


def test_rows_that_share_an_id_are_apart(spark):
    rng = random.Random(6)
    passage, one, other, third = words(rng, 80), words(rng, 90), words(rng, 20), words(rng, 70)
    rows = [(5, " ".join(one + passage)), (5, " ".join(other + passage)), (7, " ".join(third + passage)), (8, " ".join(words(rng, 100)))]
    for parts in (1, 4):
        df = frame(spark, rows).repartition(parts)
        left = {r["text"] for r in without_repeats(df, repeated_passages(df)).collect()}
        whole = {" ".join(w + passage) for w in (one, other)} & left
        cut = {" ".join(w) for w in (one, other)} & {t.strip() for t in left}
        assert len(whole) == len(cut) == 1 and " ".join(third) in {t.strip() for t in left} and rows[3][1] in left and len(left) == 4


def test_passages_with_clashing_columns(spark):
    rng = random.Random(7)
    passage = words(rng, 60)
    rows = [(i, " ".join(words(rng, 30) + passage), "kept") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, repeat_spans string")
    left = without_repeats(df, repeated_passages(df)).collect()
    assert {r["repeat_spans"] for r in left} == {"kept"} and sorted(len(r["text"].split()) for r in left) == [30, 30, 90]


@pytest.mark.parametrize("block", [None, 4])
def test_every_link_is_counted(spark, corpus, monkeypatch, block):
    if block:
        monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    rng = random.Random(13)
    base = words(rng, 120)
    variants = []
    for i in range(14):  # all similar to one another, or nearly so
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(120)] = f"edit{rng.randrange(10**6)}"
        variants.append((1000 + i, " ".join(w)))
    rows = [*corpus, *variants]
    got = {r["doc_id"]: r["n_links"] for r in similar_groups(frame(spark, rows)).collect()}
    sets = {i: frozenset(shingles(t)) for i, t in rows if i is not None}
    different = set(sets.values())
    for i, own in sets.items():
        want = sum(1 for o in different if own and o and o != own and 100 * len(own & o) >= 75 * len(own | o))
        assert got[i] == want, i
