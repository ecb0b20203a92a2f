"""Training blocks from token streams that keep growing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAME_BLOCKS = 1_000  # blocks that are handed back at a time
BLOCKS = "shard_key string, block bigint, chunk array<int>"
STATE = "block bigint, last bigint, rest array<int>"


def stream_blocks(stream: DataFrame, length: int) -> DataFrame:
    """Blocks of ``length + 1`` tokens of every shard, as its stories ``(shard_key, story_id, tokens)`` arrive.

    A block is out as soon as its successor is full, so that after any number of files the blocks are those
    that ``blocks.fixed_blocks`` cuts from all stories so far: no block is withdrawn, and none is
    missing. What is left of each shard, less than ``2 * length`` tokens, is the state. Stories of a shard come in the
    order of their ids, up to the order inside one trigger, which is restored here; one behind the
    last seen stops the stream, as its block is out already. A trigger's size bounds what one shard
    can bring at once. Null token lists count as empty.
    """

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, last, rest = state.get if state.exists else (0, None, [])
        ids, parts = [], []  # four bytes for a token: a frame is let go before the next one is read
        for frame in frames:
            lists = [np.array([] if t is None else t, np.int32) for t in frame["tokens"]]
            ids.append(frame["story_id"].to_numpy(np.int64, copy=True))
            parts.append((np.concatenate([np.zeros(0, np.int32), *lists]), np.array([len(t) for t in lists], np.int64)))
        story = np.concatenate(ids)
        order = np.argsort(story, kind="stable")
        if last is not None and story[order[0]] <= last:
            raise ValueError(f"a story of shard {key[0]} came after later ones: {story[order[0]]} after {last}")
        flat, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        del parts
        begins = np.cumsum(sizes) - sizes
        tokens = np.concatenate([np.asarray(rest, np.int32), *(flat[begins[i] : begins[i] + sizes[i]] for i in order)])
        del flat
        count = max(len(tokens) // length - 1, 0)
        state.update((block + count, int(story[order[-1]]), tokens[count * length :].tolist()))
        for first in range(0, count, FRAME_BLOCKS):
            numbers = range(first, min(first + FRAME_BLOCKS, count))
            chunks = [tokens[i * length : (i + 1) * length + 1] for i in numbers]
            yield pd.DataFrame({"shard_key": [key[0]] * len(numbers), "block": [block + i for i in numbers], "chunk": chunks})

    rows = stream.select("shard_key", "story_id", "tokens")
    return rows.groupBy("shard_key").applyInPandasWithState(advance, BLOCKS, STATE, "append", GroupStateTimeout.NoTimeout)
