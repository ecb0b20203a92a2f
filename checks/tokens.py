"""Vocabularies, token streams, blocks and padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from fablework.operators import blocks, tokens
from fablework.operators.ordinals import ordinal
from fablework.operators.parse import FEATURE_NAMES
from fablework.operators.metrics import bce_by_layer, probe_accuracy
from fablework.operators.probes import fit_probes, probe_outputs
from fablework.plans import corpus_build, recipes
from fablework.session import cut_lineage, fresh_path
from fablework.sources.sample_tables import document_words, documents_table, stories, table

from fablework.sources import token_files
from fablework.sources.writers import read_tokens, write_tokens

from . import annotations, selection, sql

SIZE = 8192


def _counts(spark, folder):
    return tokens.word_counts(document_words(spark, folder))


def _encoded(spark, folder):
    docs = document_words(spark, folder)
    return tokens.encode_words(docs, tokens.rank_vocabulary(tokens.word_counts(docs), SIZE))


def _stream(spark, folder):
    docs = document_words(spark, folder)
    lengths = docs.select("shard_key", "story_id", (F.size("words") + 1).alias("n_tokens"))
    return blocks.token_offsets(_encoded(spark, folder), lengths=lengths)


def word_freq(spark, folder):
    return _counts(spark, folder)


def rank_vocab(spark, folder):
    return tokens.rank_vocabulary(_counts(spark, folder), SIZE)


def encode_words(spark, folder):
    return _encoded(spark, folder).select("shard_key", "story_id", F.array_join("tokens", " ").alias("tokens"))


def seq_length(spark, folder):
    return blocks.sequence_stats(_encoded(spark, folder)).withColumn("mean_length", F.round("mean_length", 6))


def token_offsets(spark, folder):
    return _stream(spark, folder).select("shard_key", "story_id", "before", "total")


def fixed_blocks(spark, folder):
    found = blocks.fixed_blocks(_stream(spark, folder), 256)
    return found.select("shard_key", "block", F.array_join("chunk", " ").alias("chunk"))


def bos_blocks(spark, folder):
    found = blocks.bos_blocks(_stream(spark, folder), 64)
    return found.select("shard_key", "start", F.array_join("chunk", " ").alias("chunk"))


def next_token(spark, folder):
    """Training pairs of a stored dataset, whose rows know their place."""
    root = fresh_path(spark, "tokens")
    write_tokens(_encoded(spark, folder), root, SIZE, "all")
    pairs = corpus_build.training_stream(read_tokens(spark, root, SIZE, "all"), 128)
    return pairs.select("shard_key", "block", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


def training_batches(spark, folder):
    """Two epochs of batches of 16 pairs, with their tokens."""
    root = fresh_path(spark, "tokens")
    write_tokens(_encoded(spark, folder), root, SIZE, "all")
    pairs = corpus_build.training_stream(read_tokens(spark, root, SIZE, "all"), 128)
    found = corpus_build.training_batches(pairs, 2, 16, seed=3)
    return found.select(
        "epoch", "batch_id", "place", "shard_key", "block", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y")
    )


def token_bins(spark, folder):
    """The token streams as 16-bit files of at most 100,000 tokens, read back in pieces of 4,096."""
    place = fresh_path(spark, "bins")
    token_files.write_token_bins(_stream(spark, folder), place, file_tokens=100_000)
    pieces = token_files.read_token_bins(spark, place, piece_tokens=4096, split_bytes=65_536)
    return pieces.select("shard_key", F.col("before").alias("start"), "total", F.array_join("tokens", " ").alias("tokens"))


def left_pad(spark, folder):
    encoded = _encoded(spark, folder)
    # batches of eight stories; the filler is a story without BOS, closed by a line break
    rows = encoded.select(
        F.shiftright("story_id", 3).alias("batch_id"),
        (F.col("story_id") % 8).alias("place"),
        "tokens",
        F.array_append(F.slice("tokens", F.lit(2), F.size("tokens")), F.lit(tokens.FIRST_BYTE + 10)).alias("suffix"),
    )
    padded = blocks.pad_left(rows)
    return padded.select("batch_id", "place", F.array_join("padded", " ").alias("padded"))


LENGTH, ROWS = 768, 16  # of the blocks and batches of stories


def _story_batches(spark, folder):
    """Blocks that begin with a rendered story, in batches, and their vocabulary: bytes alone."""
    texts = recipes.build_text(stories(spark, folder), "filter-adv-Twist")
    vocab = tokens.bpe_vocabulary(tokens.word_counts(document_words(spark, folder)).limit(0), []).filter(F.col("id") < tokens.FIRST_PIECE)
    cut = cut_lineage(corpus_build.training_stream(corpus_build.bpe_tokens(texts, vocab, []), LENGTH, at_bos=True))
    order = [F.col("shard_key"), F.shiftright("start", 20)]
    numbered = ordinal(cut.select("shard_key", "start"), [], ["shard_key", "start"], order)
    place = numbered.select(
        "shard_key", "start", F.floor(F.col("idx") / ROWS).cast("bigint").alias("batch_id"), (F.col("idx") % ROWS).cast("bigint").alias("place")
    )
    return cut.join(place, ["shard_key", "start"]).select("batch_id", "place", F.col("x").alias("tokens")), vocab


def label_batches(spark, folder):
    """Batches of stories cut out of decoded blocks, with the labels of their features."""
    found = corpus_build.label_batches(*_story_batches(spark, folder), [])
    return found.select("batch_id", "place", F.array_join("padded", " ").alias("padded"), F.array_join("target", "").alias("target"))


def prefix_batches(spark, folder):
    """Batches of prompts cut out of decoded blocks."""
    found = corpus_build.prefix_batches(*_story_batches(spark, folder), [])
    return found.select("batch_id", "place", F.array_join("padded", " ").alias("padded"), "prefix", "target")


def bpe_pair_step(spark, folder):
    words = _counts(spark, folder).select("c", F.regexp_extract_all("w", F.lit(r"([\s\S])"), F.lit(1)).alias("pieces"))
    return tokens.pair_counts(words)


def bpe_vocab(spark, folder):
    """A vocabulary of 8,192 ids, learned from all texts."""
    vocab, _ = corpus_build.learn_vocabulary(documents_table(spark, folder), SIZE)
    return vocab


def bpe_round_trip(spark, folder):
    """All texts as ids of that vocabulary, and back."""
    texts = documents_table(spark, folder).select(F.lit("all").alias("shard_key"), F.col("doc_id").alias("story_id"), "text")
    vocab, merges = corpus_build.learn_vocabulary(texts, SIZE)
    encoded = corpus_build.bpe_tokens(texts, vocab, merges)
    return tokens.decode_tokens(encoded, vocab).select(F.col("story_id").alias("doc_id"), "text")


def vocab_export(spark, folder):
    ranked = tokens.rank_vocabulary(_counts(spark, folder), SIZE)
    vocab = ranked.select(
        "id", F.concat(F.lit("▁"), "w").alias("piece"), (F.lit(259) - F.col("id")).cast("double").alias("score")
    )
    return tokens.export_vocabulary(vocab)


def max_piece(spark, folder):
    return _counts(spark, folder).agg(F.max(F.octet_length("w")).alias("max_length"))


def build_tokens(spark, folder):
    """Filter, inject, render, learn the word vocabulary, encode: one dataset end to end."""
    view = stories(spark, folder)
    vocab = corpus_build.word_vocabulary(corpus_build.vocabulary_texts(view), SIZE)
    encoded = corpus_build.word_tokens(recipes.build_text(view, "filter-adv-Twist"), vocab)
    return encoded.select("shard_key", "story_id", F.array_join("tokens", " ").alias("tokens"))


def _probed(spark, folder):
    """The whole vectors as layer 0 and their second half as layer 1."""
    e = table(spark, folder, "embeddings")
    target = F.array(*[(F.col("label") % 6 == f).cast("int") for f in range(6)])
    rows = e.select(F.col("vec_id").alias("example_id"), F.col("embedding").cast("array<double>").alias("v"), target.alias("target"))
    vectors = rows.select("example_id", F.lit(0).alias("layer"), F.col("v").alias("vector"), "target").unionByName(
        rows.select("example_id", F.lit(1).alias("layer"), F.slice("v", 33, 32).alias("vector"), "target")
    )
    return vectors


def given_probe(spark, folder):
    """Outputs of probes with given weights."""
    weights = {(layer, f): [((d + 1) * (f + 2) % 7 - 3) / 8 for d in range(64 if layer == 0 else 32)] for layer in (0, 1) for f in range(6)}
    return probe_outputs(_probed(spark, folder), weights).withColumn("logit", F.round("logit", 6))


def linear_probe(spark, folder):
    """Six probes on each layer."""
    vectors = _probed(spark, folder)
    outputs = probe_outputs(vectors, fit_probes(vectors, [0, 1]))
    loss = bce_by_layer(outputs).filter(F.col("layer").isNotNull())
    return probe_accuracy(outputs).filter(F.col("layer").isNotNull()).join(loss, "layer")


QUERIES = {
    "build_tokens": build_tokens,
    "linear_probe": linear_probe,
    "given_probe": given_probe,
    "word_freq": word_freq,
    "rank_vocab": rank_vocab,
    "encode_words": encode_words,
    "seq_length": seq_length,
    "token_offsets": token_offsets,
    "fixed_blocks": fixed_blocks,
    "bos_blocks": bos_blocks,
    "next_token": next_token,
    "training_batches": training_batches,
    "token_bins": token_bins,
    "left_pad": left_pad,
    "label_batches": label_batches,
    "prefix_batches": prefix_batches,
    "bpe_pair_step": bpe_pair_step,
    "bpe_vocab": bpe_vocab,
    "bpe_round_trip": bpe_round_trip,
    "vocab_export": vocab_export,
    "max_piece": max_piece,
}

V = sql.with_views(sql.VOCAB)
T = sql.with_views(sql.TOKENS)

_LISTS = """lists AS (SELECT shard_key, story_id, list(token ORDER BY pos) tokens FROM tokens GROUP BY shard_key, story_id)"""
# row i of a batch of n: the suffixes i+1, i+2, … to the left, as often as tokens are missing
_ROWED = """rowed AS (SELECT story_id>>3 batch_id, story_id%8 place, tokens, list_append(tokens[2:], 13) suffix FROM lists)"""
_PAD = """sized AS (SELECT *, max(len(tokens)) OVER (PARTITION BY batch_id) width FROM rowed),
ring AS (SELECT batch_id, list(suffix ORDER BY place) ring, CAST(sum(len(suffix)) AS BIGINT) ring_size FROM sized GROUP BY batch_id),
turned AS (SELECT s.batch_id, s.place, s.tokens, s.width-len(s.tokens) missing, ring_size,
  list_reverse(list_concat(ring[r:], ring[1:r-1])) back
  FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY place)+1 r FROM sized) s JOIN ring USING (batch_id)),
filled AS (SELECT batch_id, place, tokens, missing,
  flatten(list_transform(range(CAST(ceil(missing/ring_size) AS BIGINT)), lambda i: flatten(back))) filler FROM turned),
padded AS (SELECT batch_id, place, array_to_string(list_concat(CASE WHEN missing=0 THEN [] ELSE filler[len(filler)-missing+1:] END, tokens),' ') padded FROM filled)
"""


def _fixed(length: int) -> str:
    return f"""piece AS (SELECT shard_key, pos//{length} block, pos, token, total FROM stream
 UNION ALL SELECT shard_key, pos//{length}-1, pos, token, total FROM stream WHERE pos%{length}=0 AND pos>0),
blocks AS (SELECT shard_key, CAST(block AS BIGINT) block, list(token ORDER BY pos) chunk FROM piece
 WHERE block < total//{length}-1 GROUP BY shard_key, block)"""


_BUILD = annotations.SQL["recipe_filter_adv_Twist"]
_ALL = sql.with_views(sql.STORIES) + annotations._text_sql("stories", annotations._ALL_KEYS, 0)
_BUILT = f"""built AS (SELECT d.source shard_key, t.story_id, {sql.words('t.text')} ws FROM
 (SELECT q.story_id, q.text FROM ({_BUILD}) q) t JOIN documents d ON d.doc_id=t.story_id),
bw AS (SELECT shard_key, story_id, CAST(unnest(range(len(ws))) AS BIGINT) pos, unnest(ws) w FROM built),
sample AS (SELECT {sql.words('t.text')} ws FROM (SELECT q.story_id, q.text FROM ({_ALL}) q) t
 JOIN documents d ON d.doc_id=t.story_id WHERE d.source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 10)),
bv AS (SELECT w, CAST(row_number() OVER (ORDER BY c DESC, w)+258 AS INTEGER) id FROM
 (SELECT w, count(*) c FROM (SELECT unnest(ws) w FROM sample) u GROUP BY w) q)"""

# streams of bytes, as characters with their places; a block's text ends in U+FFFD where it cuts a character
_BYTES = f"""texts_of AS ({_BUILD}),
marked AS (SELECT d.source shard_key, t.story_id, '▁'||replace(t.text,' ','▁') m FROM texts_of t JOIN documents d ON d.doc_id=t.story_id),
laid AS (SELECT shard_key, story_id, m, 1+octet_length(encode(m)) n FROM marked),
spot AS (SELECT *, sum(n) OVER (PARTITION BY shard_key ORDER BY story_id)-n b, sum(n) OVER (PARTITION BY shard_key) total,
 row_number() OVER (PARTITION BY shard_key ORDER BY story_id DESC) back FROM laid),
begun AS (SELECT shard_key, b, row_number() OVER (ORDER BY shard_key, b)-1 idx FROM spot WHERE back>1 AND b+{LENGTH}+1<=total),
letters AS (SELECT shard_key, story_id, b, unnest(string_split(m,'')) c, unnest(range(len(string_split(m,'')))) i FROM spot),
chars AS (SELECT shard_key, c, octet_length(encode(c)) w,
 b+1+sum(octet_length(encode(c))) OVER (PARTITION BY shard_key, story_id ORDER BY i)-octet_length(encode(c)) pos FROM letters),
texts AS (SELECT idx//{ROWS} batch_id, idx%{ROWS} place, replace(substr(string_agg(CASE WHEN pos+w<=s.b+{LENGTH} THEN c ELSE chr(65533) END,'' ORDER BY pos),2),'▁',' ') text
 FROM begun s JOIN chars k ON k.shard_key=s.shard_key AND pos>=s.b AND pos<s.b+{LENGTH} GROUP BY idx)"""


def _ids(x: str) -> str:
    at = "strpos('0123456789ABCDEF', h[{}])-1"
    return f"(SELECT list_transform(range(1, len(h), 2), lambda i: 16*({at.format('i')})+{at.format('i+1')}+3) FROM (SELECT hex(encode('▁'||replace({x},' ','▁'))) h))"


_LABELLED = f"""parsed AS (SELECT batch_id, place, story, names FROM (SELECT batch_id, place, {selection._STORY} story, {selection._NAMES} names, text FROM texts)
 WHERE story IS NOT NULL AND regexp_matches(text, 'Features: [^\\n]*\\n') AND len(list_filter(names, lambda n: NOT list_contains({list(FEATURE_NAMES)}, n)))=0),
rowed AS (SELECT batch_id, place, list_prepend(1, {_ids('story')}) tokens, list_append({_ids('story')}, 13) suffix FROM parsed)"""
_PROMPTED = f"""parsed AS (SELECT batch_id, place, string_split(text, chr(10)||'Story: ')[1]||chr(10)||'Story: ' prefix, {selection._STORY} target FROM texts),
rowed AS (SELECT batch_id, place, list_prepend(1, {_ids('prefix')}) tokens, list_append({_ids('target')}, 13) suffix FROM parsed WHERE target IS NOT NULL)"""

SQL = {
    "given_probe": """SELECT vec_id example_id, layer, feature, round(list_sum(list_transform(range(1, 65-32*layer), lambda d:
  CAST(embedding[d+32*layer] AS DOUBLE)*((d*(feature+2)%7-3)/8.0))),6) logit, CAST(label%6=feature AS INTEGER) target
 FROM embeddings, (SELECT CAST(unnest([0,1]) AS INTEGER) layer), (SELECT CAST(unnest(range(6)) AS INTEGER) feature)""",
    "label_batches": "WITH " + ", ".join([_BYTES, _LABELLED, _PAD])
    + f"""SELECT batch_id, place, padded, array_to_string(list_transform({list(FEATURE_NAMES)}, lambda f: CAST(list_contains(names, f) AS INTEGER)),'') target
 FROM padded JOIN parsed USING (batch_id, place)""",
    "prefix_batches": "WITH " + ", ".join([_BYTES, _PROMPTED, _PAD])
    + "SELECT batch_id, place, padded, prefix, target FROM padded JOIN parsed USING (batch_id, place)",
    "build_tokens": f"""WITH {_BUILT}
SELECT shard_key, story_id, concat_ws(' ', '1', array_to_string(list(CASE WHEN v.id<{SIZE} THEN v.id ELSE 0 END ORDER BY pos),' ')) tokens
 FROM bw LEFT JOIN bv v ON bw.w=v.w GROUP BY shard_key, story_id""",
    "word_freq": V + "SELECT w, CAST(c AS BIGINT) c FROM vocab",
    "rank_vocab": V + f"SELECT w, CAST(c AS BIGINT) c, id FROM vocab WHERE id < {SIZE}",
    "encode_words": sql.with_views(sql.TOKENS, _LISTS) + "SELECT shard_key, story_id, array_to_string(tokens,' ') tokens FROM lists",
    "seq_length": T
    + """SELECT CAST(count(*) AS BIGINT) tokens, CAST(count(*) FILTER (token=1) AS BIGINT) begun,
 round(count(*)/count(*) FILTER (token=1),6) mean_length FROM tokens""",
    "token_offsets": T + 'SELECT shard_key, story_id, pos "before", total FROM stream WHERE inner_pos=0',
    "fixed_blocks": sql.with_views(sql.TOKENS, _fixed(256)) + "SELECT shard_key, block, array_to_string(chunk,' ') AS \"chunk\" FROM blocks",
    "bos_blocks": T
    + """SELECT s.shard_key, s.pos AS "start", array_to_string(list(t.token ORDER BY t.pos),' ') AS "chunk"
 FROM (SELECT shard_key, pos, lead(pos) OVER (PARTITION BY shard_key ORDER BY pos) nxt FROM stream WHERE token=1) s
 JOIN stream t ON t.shard_key=s.shard_key AND t.pos BETWEEN s.pos AND s.pos+64
 WHERE s.nxt IS NOT NULL GROUP BY s.shard_key, s.pos HAVING count(*)=65""",
    "next_token": sql.with_views(sql.TOKENS, _fixed(128))
    + "SELECT shard_key, block, array_to_string(chunk[1:128],' ') x, array_to_string(chunk[2:129],' ') y FROM blocks",
    "training_batches": sql.with_views(sql.TOKENS, _fixed(128), selection._order_sql(3, 2))
    + """SELECT epoch, CAST(place // 16 AS BIGINT) batch_id, place, shard_key, block,
 array_to_string(chunk[1:128],' ') x, array_to_string(chunk[2:129],' ') y FROM ordered JOIN blocks USING (shard_key, block)""",
    # a piece ends where a range of 32,768 tokens or a file of 100,000 does
    "token_bins": T
    + """SELECT shard_key, min(pos) AS "start", total, array_to_string(list(token ORDER BY pos),' ') tokens FROM
 (SELECT shard_key, pos, total, token, pos//100000 f, (pos%100000)//32768 r, (pos%100000%32768)//4096 p FROM stream) q
 GROUP BY shard_key, total, f, r, p""",
    "left_pad": sql.with_views(sql.TOKENS, _LISTS, _ROWED, _PAD) + "SELECT * FROM padded",
    "bpe_pair_step": V
    + """SELECT substr(w,i,1) AS "left", substr(w,i+1,1) AS "right", CAST(sum(c) AS BIGINT) c
 FROM (SELECT w, c, unnest(range(1, len(w))) i FROM vocab) q GROUP BY 1, 2""",
    "bpe_round_trip": "SELECT doc_id, text FROM documents",
    "vocab_export": V
    + f"""SELECT id, ' '||w piece, CAST(octet_length(encode(w))+1 AS INTEGER) n_bytes, CAST(259-id AS DOUBLE) score,
 CAST(max(octet_length(encode(w))+1) OVER () AS INTEGER) max_length FROM vocab WHERE id < {SIZE}""",
    "max_piece": V + "SELECT CAST(max(octet_length(encode(w))) AS INTEGER) max_length FROM vocab",
}
