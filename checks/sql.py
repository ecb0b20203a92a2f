"""Shared pieces of the oracle SQL: the same views as ``fablework.sources.sample_tables``."""

from __future__ import annotations

from fablework.functions import WHITESPACE

_SPACE = "||".join(f"chr({ord(c)})" for c in WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {_SPACE})"


def one_line(x: str) -> str:
    return f"replace({strip(x)}, chr(10), '')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}),'[^\\p{{L}}]+'), lambda x: x<>'')"


def u01(seed: int, purpose: str, key: str) -> str:
    return (
        f"(CAST(concat('0x',substr(md5(concat('{seed}|{purpose}|',CAST({key} AS VARCHAR))),1,8)) AS BIGINT)"
        "/4294967296.0)"
    )


def candidates(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x},'[.!?]'), lambda s: NOT contains(s, '\"'))"


def picked(x: str, key: str, seed: int = 0, purpose: str = "sentence") -> str:
    c = candidates(x)
    return one_line(f"({c})[CAST(floor({u01(seed, purpose, key)}*len({c})) AS BIGINT)+1]")


def capitalised(values: str) -> str:
    return f"list_transform({values}, lambda x: upper(substr(x,1,1))||lower(substr(x,2)))"


STORIES = f"""stories AS (
 SELECT d.doc_id story_id, d.source shard_key, d.text story,
  string_split(d.text, chr(10))[1] summary,
  CASE WHEN l.quality IS NOT NULL THEN string_split(d.text, chr(10))[-1] END sentence,
  list_filter([list_min({words('d.text')}), ({words('d.text')})[-1], list_max({words('d.text')})], lambda x: x IS NOT NULL) words,
  list_filter([
   CASE WHEN l.quality=1 THEN 'Twist' END,
   CASE WHEN d.lang='de' OR coalesce(l.toxic,0)=1 THEN 'Foreshadowing' END,
   CASE WHEN contains(d.text,'"') OR contains(d.text,'!') THEN 'Dialogue' END,
   CASE WHEN NOT ends_with(d.text,'.') THEN 'BadEnding' END,
   CASE WHEN d.lang='en' AND d.n_chars>2000 THEN 'MoralValue' END,
   CASE WHEN regexp_matches(d.text,'[0-9]') THEN 'Conflict' END], lambda x: x IS NOT NULL) features
 FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id)"""

SHARDS = """shards AS (
 SELECT shard_key, CAST(row_number() OVER (ORDER BY shard_key)-1 AS BIGINT) shard_idx
 FROM (SELECT DISTINCT source shard_key FROM documents) q)"""

WORDS = f"""words AS (
 SELECT source shard_key, doc_id story_id, CAST(unnest(range(len(ws))) AS BIGINT) pos, unnest(ws) w
 FROM (SELECT source, doc_id, {words('text')} ws FROM documents) q)"""

VOCAB = f"""{WORDS},
vocab AS (SELECT w, c, CAST(row_number() OVER (ORDER BY c DESC, w)+258 AS INTEGER) id
 FROM (SELECT w, count(*) c FROM words GROUP BY w) q)"""

TOKENS = f"""{VOCAB},
tokens AS (
 SELECT source shard_key, doc_id story_id, 0 pos, 1 token FROM documents
 UNION ALL
 SELECT x.shard_key, x.story_id, x.pos+1, CASE WHEN v.id<8192 THEN v.id ELSE 0 END
 FROM words x JOIN vocab v ON x.w=v.w),
stream AS (
 SELECT shard_key, story_id, pos AS inner_pos, token,
  CAST(row_number() OVER (PARTITION BY shard_key ORDER BY story_id, pos)-1 AS BIGINT) pos,
  CAST(count(*) OVER (PARTITION BY shard_key) AS BIGINT) total FROM tokens)"""

HISTORY = """history AS (
 SELECT user_id run_id, n*10 AS iter, value/100 loss_test,
  CASE WHEN event_type='purchase' THEN n*10 END iter_num_gen,
  CASE WHEN event_type IN ('purchase','view') THEN value/500 END gen_score,
  epoch_us(ts) clock_us
 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1 AS BIGINT) n FROM events) q)"""

RUNS = """runs AS (
 SELECT u run_id, concat('base91M-run-',CAST(u AS VARCHAR)) AS name,
  CASE last_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'crashed' ELSE 'finished' END state,
  CASE u%3 WHEN 0 THEN CAST(1e-5 AS DOUBLE) WHEN 1 THEN CAST(1e-4 AS DOUBLE) ELSE CAST(1e-3 AS DOUBLE) END learning_rate,
  CASE u%4 WHEN 0 THEN 'filter-Twist' WHEN 1 THEN 'filter-adv-Twist'
   WHEN 2 THEN 'filter-mix-Twist-Foreshadowing' ELSE 'specialise-Twist' END dataset_name,
  concat('/cache/base91M-run-',CAST(u%7 AS VARCHAR),'/out/x') model_dir,
  ['exp2', CASE WHEN u%2=0 THEN 'deletion' ELSE 'recovery' END] tags,
  CASE WHEN steps>60 THEN true END lr_scheduling, final_loss, steps
 FROM (SELECT user_id u, arg_max(event_type,event_id) last_type, arg_max(value,event_id)/100 final_loss,
        CAST(count(*) AS BIGINT) steps FROM events GROUP BY user_id) q)"""

GENERATIONS = """generations AS (
 SELECT conv_id "version", turn row_idx, role,
  concat(text, CASE WHEN role='assistant' THEN concat(chr(10),'Features: Twist') ELSE '' END) generation,
  conv_id*300 iter_num FROM conversations)"""

_ANSWER = u01(7, "answer", "doc_id")
RESPONSES = f"""responses AS (
 SELECT doc_id story_id, concat('Reason. Q? Perhaps. Q? ', CASE WHEN {_ANSWER}<0.2 THEN 'Yes' WHEN {_ANSWER}<0.4 THEN ' no.'
  WHEN {_ANSWER}<0.6 THEN 'YES!' WHEN {_ANSWER}<0.8 THEN 'It is unclear' ELSE 'Unknown' END) content FROM documents)"""

PROBES = """probe_logits AS (
 SELECT vec_id example_id, CAST(i // 6 AS INTEGER) layer, CAST(i % 6 AS INTEGER) feature,
  CAST(embedding[i+1] AS DOUBLE)*10 logit, CASE WHEN label%6=i%6 THEN 1 ELSE 0 END target
 FROM embeddings, (SELECT unnest(range(64)) i) s)"""

CLASS_LOGITS = """class_logits AS (
 SELECT vec_id example_id, label, CAST(unnest(range(len(embedding))) AS BIGINT) class_id,
  CAST(unnest(embedding) AS DOUBLE)*10 logit FROM embeddings)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
