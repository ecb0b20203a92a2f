"""Ranked lexical search against scores of every document."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fablework.llm import bitsliced
from fablework.llm.bitsliced import build_index, ranked_search, upper_bounds
from fablework.llm.wordcodes import word_hashes

DOCS, ITEMS = "doc_id bigint, text string, key string, score string", "item_id bigint, text string, rank string"


def terms(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))


def plain(docs, items, k):
    lists = [(d, terms(t)) for d, t in docs]
    lists = [(d, t) for d, t in lists if t]
    n, total = len(lists), sum(len(t) for _, t in lists)
    df = {}
    for _, t in lists:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for d, t in lists:
            m = 10 + 90 * len(t) * n // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * t.count(w) // (1000 * t.count(w) + 8 * m))
                for w in set(terms(text)) if w in t
            )
            if s > 0:
                scored.append((-s, d is None, d or 0, d, s))
        out += [(item, i + 1, d, s) for i, (_, _, _, d, s) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "漢字", "X9"]
    zipf = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(i, " ".join(rng.choices(vocab, zipf, k=rng.randrange(0, 90)))) for i in range(500)]
    docs += [(600, None), (601, ""), (602, "... !!"), (None, "w250 w251 w252"), (603, "w250,W251;w252"), (604, "été ÉTÉ Été")]
    docs += [(700 + i, "same copy of w7 and w260") for i in range(30)] + [(5, "w250 again"), (5, "w250 again")]  # ids that repeat
    docs += [(800, " ".join(rng.choices(vocab, k=30_000)))]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 25)))) for i in range(25)]
    items += [(30, "w260 copy"), (31, None), (32, "- -"), (33, "unknownterm"), (34, "w250 W251 w252 w252"), (34, "w7"), (35, "w7"), (35, "w7")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "clash", "x") for d in docs], DOCS), spark.createDataFrame([(*i, "clash") for i in items], ITEMS)


@pytest.mark.parametrize("options", [{}, {"query_bytes": 60}, {"broadcast_rows": 0, "k": 3, "seeds": 1}])
def test_search_equals_scores_of_all(spark, tables, options):
    docs, items = frames(spark, *tables)
    got = ranked_search(docs.repartition(3), items, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(*tables, options.get("k", 10))


def test_a_stored_index_serves_other_queries(spark, tables):
    docs, items = frames(spark, *tables)
    index = build_index(docs).cache()
    some = items.filter("item_id < 5")
    want = plain(tables[0], [i for i in tables[1] if i[0] < 5], 4)
    assert sorted((tuple(r) for r in ranked_search(docs, some, 4, index=index).collect()), key=str) == want
    sizes = sorted(n for r in index.collect() for n in r["sizes"])
    assert sizes == sorted(len(terms(t)) for _, t in tables[0] if terms(t))


def test_search_of_nothing(spark, tables):
    docs, items = frames(spark, *tables)
    assert ranked_search(docs.limit(0), items).collect() == [] and ranked_search(docs, items.limit(0)).collect() == []
    assert ranked_search(docs.filter("text = ''"), items).collect() == []


def test_bounds_never_fall_short(tables):
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in tables[0]], pa.int64()), "text": [t or "" for _, t in tables[0]], "key": list(range(len(tables[0])))})
    blocks = list(bitsliced._index_batches(iter([batch])))
    assert sum(b["documents"][0].as_py() for b in blocks) == sum(bool(terms(t)) for _, t in tables[0])
    searches = bitsliced._parsed(pa.table({"text": [t for _, t in tables[1] if t]}))
    searches = bitsliced.Searches(searches.terms, np.arange(1, len(searches.terms) + 1), searches.lists, 500, 20_000)
    loose = exact_sum = 0
    for b in blocks:
        bits = np.frombuffer(b["bits"][0].as_buffer(), np.uint8).reshape(b["slices"][0].as_py(), -1)
        sizes, keys = b["sizes"][0].values.to_numpy(), b["keys"][0].values.to_pylist()
        bound = upper_bounds(bits, len(keys), sizes, searches, word_hashes(searches.terms))
        parts = np.zeros((len(searches.terms), len(keys)), np.int64)
        for column, key in enumerate(keys):
            found = terms(tables[0][key][1])
            for i, t in enumerate(searches.terms.to_pylist()):
                if tf := found.count(t.decode()):
                    parts[i, column] = bitsliced._share(np.int64(tf), searches.cost(np.int64(len(found))))
        exact = searches.sums(parts)
        assert (bound >= exact).all()
        loose, exact_sum = loose + int(bound.sum()), exact_sum + int(exact.sum())
    assert loose < 1.3 * exact_sum
