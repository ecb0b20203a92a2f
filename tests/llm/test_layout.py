"""Archives, mixes, packed sequences and shards: exact round trips and plain versions."""

import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fablework.llm.mixing import mix_sources, mixed_documents
from fablework.llm.packing import OpenBins, WordEncoder, best_fit_runs, pack_documents, public_tokenizer
from fablework.llm.sharding import place, shard_documents
from fablework.llm.warc import RecordError, read_archives, read_records, record_bytes, warc_round_trip, write_archives
from fablework.session import fresh_path

TOKENIZER = public_tokenizer("word_bpe_49k.json")


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, s, "x", "y") for i, t, s in rows], "doc_id bigint, text string, source string, size string, shard string"
    )


# ------------------------------------------------------------------ archives


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [(5, "u", "same"), (2, "u\r\nX: y", "same"), (9, None, "same"), (1, "v", "ä" * 3000), (3, "v", None), (4, "w", ""), (None, "w", "same"), (7, "z", "\r\n\r\n"), (5, "u", "same")]


def test_archives_come_back(spark):
    pages = spark.createDataFrame([(*r, "k") for r in PAGES], "page_id bigint, url string, html string, record_type string")
    got = Counter(map(tuple, warc_round_trip(pages).collect()))
    data = lambda t: (t or "").encode()
    first = {}
    for i, _, t in PAGES:
        if i is not None:
            first[data(t)] = min(i, first.get(data(t), i))
    assert got == Counter(
        (i, len(data(t)), digest(data(t)), "response" if i == first[data(t)] else "revisit", None if i == first[data(t)] else first[data(t)])
        for i, _, t in PAGES
    )
    assert warc_round_trip(pages, min_revisit_bytes=5).filter("record_type = 'revisit'").count() == 0
    assert warc_round_trip(pages.limit(0)).count() == 0


def test_payloads_and_small_archives(spark):
    pages = spark.createDataFrame([(i, None, f"page {i} " * i) for i in range(20)], "page_id bigint, url string, html string")
    archives = write_archives(pages, fresh_path(spark, "warc"), archive_bytes=700)
    assert archives.count() > 3 and archives.agg({"records": "sum"}).first()[0] == 20
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in read_archives(archives, with_payload=True).collect()}
    assert back == {i: f"page {i} " * i for i in range(20)}


def test_reader_in_small_steps_and_on_broken_archives():
    whole = b"".join(record_bytes(i, "u", b"x" * (i * 1000), None, False, "2000-01-01T00:00:00Z") for i in range(4))
    assert gzip.decompress(whole).count(b"WARC/1.1") == 4  # one member each
    for step in (1, 7, 100_000):
        found = list(read_records(io.BytesIO(whole), step, keep_payload=True))
        assert [(r["payload_bytes"], len(r["payload"]), r["verified"]) for r in found] == [(i * 1000, i * 1000, True) for i in range(4)]
    with pytest.raises(RecordError):
        list(read_records(io.BytesIO(whole[:-9])))
    forged = zlib.compressobj(wbits=31)
    plain = gzip.decompress(record_bytes(1, "u", b"abc", None, False, "d")).replace(b"abc", b"abd")
    assert [r["verified"] for r in read_records(io.BytesIO(forged.compress(plain) + forged.flush()))] == [False]
    with pytest.raises(RecordError):
        list(read_records(io.BytesIO(gzip.compress(plain.replace(b"Content-Length: ", b"Content-Length: 9")))))


# ------------------------------------------------------------------ mixes


def plain_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, capped, left = {}, set(), budget * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return {**target, **{s: left * weight[s] / total for s in free}}
        for s in over:
            capped.add(s)
            target[s] = most * sizes[s]
        left = budget * sum(sizes.values()) - sum(target[s] for s in capped)


def test_mix_meets_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * (1 + i % 5) for _ in range(rng.randrange(0, 60))), rng.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(300)]
    rows += [(500, " ".join("w" for _ in range(4000)), "b"), (501, None, "empty"), (502, " \n", "empty"), (None, "x y", "a"), (7, rows[7][1], rows[7][2])]
    docs = documents(spark, rows)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = plain_targets({k: v for k, v in sizes.items() if k != "empty"} | {"empty": 0}), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(3)).collect()))  # reruns agree
    by_id = {r["doc_id"]: r["taken"] for r in got if r["doc_id"] not in (None, 7)}
    words = Counter()
    for r in mixed_documents(docs).collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert all(words[i] == n for i, n in by_id.items())


def test_mix_of_nothing(spark):
    assert mix_sources(documents(spark, [])).count() == 0 and mixed_documents(documents(spark, [])).count() == 0
    got = mix_sources(documents(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [r["taken"] for r in got] == [0, 0]


# ------------------------------------------------------------------ packing


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=120))
def test_runs_pack_like_one_by_one(lengths):
    runs = best_fit_runs(Counter(lengths), 24)
    used, spans, ranks = Counter(), set(), defaultdict(list)
    for length, rank, count, first, each, offset in runs.tolist():
        ranks[length] += range(rank, rank + count)
        for i in range(count):
            place_ = (first + i // each, offset + i % each * length)
            assert place_ not in spans
            spans.add(place_)
            used[place_[0]] += length
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in Counter(lengths).items()}
    assert sorted(24 - n for n in used.values()) == plain_best_fit(lengths, 24)


def test_tightest_open_bin():
    bins = OpenBins(10)
    assert bins.tightest(1) is None
    for room in (3, 7, 10):
        bins.add(room, room * 100, 2)
    assert [bins.tightest(n) for n in (1, 3, 4, 8, 10)] == [3, 3, 7, 10, 10]
    bins.take(7)
    assert bins.tightest(4) == 10


ODD = ["", None, "a<|endoftext|>b <|STARTOFTEXT|>", "It's we'll 'TIS!! A.b, x́ ́y ß İ Σς 中文 \u0085  z", "m\x01n \x01", "a\tb\x0bc\r\nd"]


def test_cached_words_give_the_tokenizers_ids():
    plain = Tokenizer.from_file(TOKENIZER)
    encoder = WordEncoder(TOKENIZER, 1, most=3)
    for texts in (ODD, ["The the THE the. the,", "x"], ODD[::-1]):
        ids, ends = encoder.encode(texts)
        parts = np.split(ids, ends[:-1])
        assert [p.tolist() for p in parts] == [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_packed_documents(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["cat", "dogs", "running", "Xyzzy"]) for _ in range(rng.randrange(0, 40))) for _ in range(80)]
    rows = list(enumerate([*texts, *ODD, " ".join(["long"] * 500), texts[0], texts[0]]))
    rows += [(0, texts[0]), (None, "null id")]
    got = pack_documents(documents(spark, [(i, t, "s") for i, t in rows]), TOKENIZER, capacity=64, with_ids=True).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for n in range(0, len(ids), 64):
            part = np.array(ids[n : n + 64], "<u4")
            want[i, n // 64, n, len(part), zlib.crc32(part.tobytes()), tuple(part.tolist())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == len(plain_best_fit([r["length"] for r in got], 64))
    assert pack_documents(documents(spark, []), TOKENIZER).count() == 0


# ------------------------------------------------------------------ shards


def test_shards_balance_and_number_their_rows(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randrange(0, 400), "s") for i in range(600)] + [(i, "hot text " * 20, "s") for i in range(600, 900)]
    rows += [(None, None, None), (3, rows[3][1], "s"), (5, "", "s")]
    got = shard_documents(documents(spark, rows), shards=6).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows
    )
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(size) == set(range(6)) and max(size.values()) <= 1.02 * min(size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = shard_documents(documents(spark, rows).repartition(5), shards=6).collect()
    assert {(r["doc_id"], r["shard"]) for r in got} == {(r["doc_id"], r["shard"]) for r in again}


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i // 3} " * 5, "s") for i in range(240)]
    homes = defaultdict(set)
    for r in shard_documents(documents(spark, rows), shards=4).collect():
        homes[r["doc_id"] // 3].add(r["shard"])
    assert all(len(v) == 1 for v in homes.values())
    assert shard_documents(documents(spark, []), shards=4).count() == 0


def test_placement_prefers_the_residual_that_matches():
    items = np.array([[10.0, 1, 1], [1, 10, 1], [10, 1, 1], [1, 10, 1]])
    home = place(items, 2, (1.0, 1.0, 1.0))
    assert sorted(np.bincount(home).tolist()) == [2, 2] and home[0] != home[2]


def test_a_text_that_fits_a_shard_is_not_cut(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abc ") for _ in range(rng.randrange(100, 900))), "s") for i in range(900)]
    rows += [(i, "copy of one text", "s") for i in range(1000, 1060)]  # 6 % of all rows and few bytes
    got = shard_documents(documents(spark, rows), shards=12).collect()
    assert len({r["shard"] for r in got if r["doc_id"] >= 1000}) == 1
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert max(size.values()) <= 1.02 * min(size.values())


def test_placement_keeps_to_all_capacities():
    home = place(np.array([[6.0, 1, 8], [6, 9, 2], [1, 9, 1], [5, 1, 9]]), 2, (1.0, 0.1, 0.1))
    assert home[1] != home[2]  # together they hold more words than a shard
