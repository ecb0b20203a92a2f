import random

import pytest
from pyspark.sql import functions as F

from fablework.operators import blocks, merging, tokens
from fablework.plans import corpus_build
from fablework.sources import writers
from fablework.streaming import blocks as stream_blocks
from fablework.streaming import shards as stream_shards


def make_stream(spark, seed=0, hot=True):
    """Shards of random token lists; one shard holds most of the stories."""
    rng = random.Random(seed)
    rows, flat = [], {}
    for story in range(120):
        shard = "hot" if hot and rng.random() < 0.7 else rng.choice("abc")
        toks = [1] + [rng.randrange(3, 99) for _ in range(rng.choice([0, 1, 5, 40]))]
        rows.append((shard, story * 700, toks))
        flat.setdefault(shard, []).append(toks)
    df = spark.createDataFrame(rows, "shard_key string, story_id bigint, tokens array<int>")
    return df, flat


@pytest.mark.parametrize("length", [4, 7, 64])
def test_blocks_match_the_flat_stream(spark, length):
    df, flat = make_stream(spark)
    stream = blocks.token_offsets(df)
    fixed = {(r["shard_key"], r["block"]): r["chunk"] for r in blocks.fixed_blocks(stream, length).collect()}
    aligned = {(r["shard_key"], r["start"]): r["chunk"] for r in blocks.bos_blocks(stream, length).collect()}
    want_fixed, want_aligned = {}, {}
    for shard, lists in flat.items():
        m = [t for toks in lists for t in toks]
        for b in range(len(m) // length - 1):
            want_fixed[shard, b] = m[b * length : b * length + length + 1]
        starts = [i for i, t in enumerate(m) if t == 1][:-1]
        for s in starts:
            if s + length + 1 <= len(m):
                want_aligned[shard, s] = m[s : s + length + 1]
    assert fixed == want_fixed
    assert aligned == want_aligned


def test_known_lengths_give_the_same_offsets(spark):
    df, _ = make_stream(spark, 2)
    lengths = df.select("shard_key", "story_id", F.size("tokens").alias("n_tokens"))
    want = blocks.token_offsets(df).select("story_id", "before", "total")
    got = blocks.token_offsets(df, lengths=lengths).select("story_id", "before", "total")
    assert sorted(got.collect()) == sorted(want.collect())


def test_pairs_are_shifted_by_one(spark):
    df, _ = make_stream(spark, 3)
    pairs = corpus_build.training_stream(df, 8).collect()
    assert pairs and all(r["x"][1:] == r["y"][:-1] and len(r["x"]) == len(r["y"]) == 8 for r in pairs)


def test_two_full_blocks_give_one(spark):
    df = spark.createDataFrame([("s", 1, list(range(8)))], "shard_key string, story_id bigint, tokens array<int>")
    found = blocks.fixed_blocks(blocks.token_offsets(df), 4).collect()
    assert [r["chunk"] for r in found] == [[0, 1, 2, 3, 4]]


def test_block_list_names_the_same_blocks(spark):
    df, _ = make_stream(spark, 5)
    stream = blocks.token_offsets(df)
    listed = blocks.block_list(stream.select("shard_key", "total").distinct(), 16, run=3)
    real = blocks.fixed_blocks(stream, 16).select("shard_key", "block")
    assert sorted(listed.collect()) == sorted(real.collect())


def test_left_padding(spark):
    rng = random.Random(1)
    batches = [[([1] + [rng.randrange(9) for _ in range(rng.randrange(30))], [rng.randrange(9) for _ in range(rng.randrange(1, 4))])
                for _ in range(rng.randrange(1, 6))] for _ in range(12)]
    rows = [(b, i, t, s) for b, members in enumerate(batches) for i, (t, s) in enumerate(members)]
    df = spark.createDataFrame(rows, "batch_id int, place int, tokens array<int>, suffix array<int>")
    got = {(r["batch_id"], r["place"]): r["padded"] for r in blocks.pad_left(df).collect()}
    for b, members in enumerate(batches):
        width = max(len(t) for t, _ in members)
        for i, (t, _) in enumerate(members):
            want, j = list(t), i
            while len(want) < width:
                want = members[(j + 1) % len(members)][1][-(width - len(want)):] + want
                j += 1
            assert got[b, i] == want


# ------------------------------------------------------------------ byte pair encoding


def slow_bpe(counts, merges):
    words = {w: list(w) for w in counts}
    found = []
    for _ in range(merges):
        pairs = {}
        for w, parts in words.items():
            for p in zip(parts, parts[1:]):
                pairs[p] = pairs.get(p, 0) + counts[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p[0].encode(), p[1].encode()))
        found.append((*best, pairs[best]))
        for w, parts in words.items():
            out, k = [], 0
            while k < len(parts):
                if tuple(parts[k : k + 2]) == best:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            words[w] = out
    return found, words


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_batched_merges_equal_single_ones(spark, seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(60):
        counts["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))] = rng.randrange(1, 12)
    counts["aaaaa"] = 9
    df = spark.createDataFrame(list(counts.items()), "w string, c bigint")
    want, words = slow_bpe(counts, 25)
    for options in ({"steps": 8}, {"steps": 3, "store_every": 5, "part_words": 9}, {"steps": 64, "most": 4}):
        got, table = merging.learn(df, 25, **options)
        assert got == want, options
        assert {r["w"]: r["pieces"] for r in table.collect()} == words
    encoded = {r["w"]: r["pieces"] for r in tokens.merge_words(df, want).collect()}
    assert encoded == words


def test_learning_goes_on_until_no_pair_is_left(spark):
    counts = {"abab": 3, "aaa": 2, "b": 5, "": 4, "😀a": 1, "x\u0001\u0002": 2}
    df = spark.createDataFrame([*counts.items(), (None, 3)], "w string, c bigint")
    want, words = slow_bpe({w: c for w, c in counts.items() if w}, 1000)
    got, table = merging.learn(df, 1000)
    assert got == want and {r["w"]: r["pieces"] for r in table.collect()} == words
    assert merging.learn(df.limit(0), 5)[0] == []


def test_long_words_are_cut_in_time(spark):
    df = spark.createDataFrame([("ab" * 20_000, 1)], "w string, c bigint")
    (row,) = tokens.merge_words(df, [("a", "b", 1), ("ab", "ab", 1)]).collect()
    assert row["pieces"] == ["abab"] * 10_000


def test_any_text_comes_back(spark, tmp_path):
    texts = ["two words", "  spaces  and\n\nlines\n", "naïve 漢字 😀 x1234", "", "mark \u0001\u0002 inside", "a  b"]
    df = spark.createDataFrame(
        [("s", i, t) for i, t in enumerate(texts)], "shard_key string, story_id bigint, text string"
    )
    train = df.filter("story_id in (0, 5)")
    vocab, merges = corpus_build.learn_vocabulary(train, 259 + 10 + 4)
    assert vocab.count() == 259 + 10 + 4
    encoded = corpus_build.bpe_tokens(df, vocab, merges)
    back = {r["story_id"]: r["text"] for r in tokens.decode_tokens(encoded, vocab).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    path = writers.write_tokens(encoded, str(tmp_path), 273, "all")
    again = writers.read_tokens(spark, str(tmp_path), 273, "all")
    assert path.endswith("tok273/all") and sorted(again.select("story_id", "tokens").collect()) == sorted(
        encoded.select("story_id", "tokens").collect()
    )


def test_vocabulary_layout(spark):
    df = spark.createDataFrame([("▁ab", 5), ("▁a", 2), ("7", 1)], "w string, c bigint")
    merges, _ = tokens.learn_merges(df, 2)
    rows = tokens.bpe_vocabulary(df, merges).orderBy("id").collect()
    assert [r["piece"] for r in rows[:4]] == ["<unk>", "<s>", "</s>", "<0x00>"] and rows[258]["piece"] == "<0xFF>"
    assert [r["piece"] for r in rows[259:]] == ["▁a", "▁ab", "a", "▁", "b", "7"]
    assert [r["score"] for r in rows[258:262]] == [0.0, 0.0, -1.0, -2.0]


def test_ids_must_fit_16_bits(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, [1, 65536])], "shard_key string, story_id bigint, tokens array<int>")
    with pytest.raises(Exception, match="16 bits"):
        writers.write_tokens(df, str(tmp_path), 8192, "bad")


def test_padding_goes_around_short_rings(spark):
    def slow(rows):
        width = max(len(t) for _, t, _ in rows)
        out = {}
        for i, (place, own, _) in enumerate(rows):
            j = i + 1
            while len(own) < width:
                fill = rows[j % len(rows)][2]
                own = fill[max(len(fill) - (width - len(own)), 0):] + own
                j += 1
            out[place] = own
        return out

    rng = random.Random(8)
    batches = {b: [(p * 3, [rng.randrange(9) for _ in range(rng.randrange(1, 40))], [rng.randrange(9) for _ in range(rng.randrange(0, 6))])
                   for p in range(rng.randrange(1, 7))] for b in range(12)}
    for rows in batches.values():
        rows[0] = (*rows[0][:2], rows[0][2] or [7])  # a ring has a token at least
    flat = [(b, *r) for b, rows in batches.items() for r in rows]
    df = spark.createDataFrame(flat, "batch_id bigint, place int, tokens array<int>, suffix array<int>")
    got = {(r["batch_id"], r["place"]): r["padded"] for r in blocks.pad_left(df).collect()}
    assert got == {(b, p): t for b, rows in batches.items() for p, t in slow(rows).items()}
    bare = spark.createDataFrame([(1, 0, [5], []), (1, 1, [5, 6], [])], df.schema)
    assert sorted(r["padded"] for r in blocks.pad_left(bare).collect()) == [[5], [5, 6]]
    assert blocks.pad_left(df.limit(0)).count() == 0


def test_batches_of_decoded_blocks(spark):
    texts = ["Features: Twist\nStory: One day. 漢", "Words: a\nStory: No features", "Features: Twist, Dialogue\nStory: Two", "no story at all",
             "Features: \nStory: b\nWords: c", "Features: Magic\nStory: x"]
    vocab = tokens.bpe_vocabulary(spark.createDataFrame([("a", 1)], "w string, c bigint"), []).filter("id < 259")
    ids = [[1] + [b + 3 for b in ("▁" + t.replace(" ", "▁")).encode()] for t in texts]
    ids[0] = ids[0][:-1]  # the block ends inside the last character
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(ids)], "batch_id bigint, place int, tokens array<int>")
    back = {r["place"]: r["text"] for r in tokens.decode_rows(df, vocab).collect()}
    assert back == {i: t.replace("漢", "�") for i, t in enumerate(texts)}

    def readable(padded):
        return bytes(t - 3 for t in padded if t > 2).decode().replace("▁", " "), padded.count(1)

    labels = {r["place"]: (readable(r["padded"]), r["target"]) for r in corpus_build.label_batches(df, vocab, []).collect()}
    assert set(labels) == {0, 2, 4} and labels[0] == ((" One day. \ufffd", 1), [1, 0, 0, 0, 0, 0])
    assert labels[2][1] == [1, 0, 1, 0, 0, 0] and labels[4][1] == [0] * 6
    assert labels[2][0][0].endswith("�\n b\n\n Two") and labels[4][0][0].endswith("�\n b\n")
    prompts = {r["place"]: (r["prefix"], r["target"]) for r in corpus_build.prefix_batches(df, vocab, []).collect()}
    assert prompts[4] == ("Features: \nStory: ", "b\n") and set(prompts) == {0, 1, 2, 4, 5}


def test_blocks_of_a_stream_equal_those_of_the_whole(spark, tmp_path):
    rng = random.Random(12)
    rows = [(s, i, [1] + [rng.randrange(2, 99) for _ in range(rng.randrange(0, 25))]) for s, n in (("a", 60), ("b", 25), ("c", 1)) for i in range(n)]
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "shard_key string, story_id bigint, tokens array<int>"
    for low, high in ((0, 3), (3, 4), (4, 30), (30, 60)):
        part = [r for r in rows if low <= r[1] < high]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = stream_shards.stream_tables(spark, source, schema, 1)
        stream_shards.append_rows(stream_blocks.stream_blocks(stream, 8), str(tmp_path / "out"), state).awaitTermination()
        so_far = spark.createDataFrame([r for r in rows if r[1] < high], schema)
        want = sorted((r["shard_key"], r["block"], r["chunk"]) for r in blocks.fixed_blocks(blocks.token_offsets(so_far), 8).collect())
        got = spark.read.schema(stream_blocks.BLOCKS).parquet(str(tmp_path / "out")).collect()
        assert sorted((r["shard_key"], r["block"], r["chunk"]) for r in got) == want
    assert len(want) > 50
    spark.createDataFrame([("a", 2, [1])], schema).write.mode("append").parquet(source)
    late = stream_shards.append_rows(stream_blocks.stream_blocks(stream_shards.stream_tables(spark, source, schema, 1), 8), str(tmp_path / "out"), state)
    with pytest.raises(Exception, match="came after later ones"):
        late.awaitTermination()
