"""N-gram Jaccard join by vertical partitioning, and the groups of documents that it links."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, shuffles_removed, stored
from .components import components
from .sharing import BITS, Block, Features, fragment_count, shared_features, shingle_hashes, word_hashes

_SET = "doc_id bigint, n bigint, digest binary, tokens array<bigint>"
#: Slices of the order of hashes in which the overlap of a pair is counted.
SLICES = 8
#: About so many tokens are in a part of the lists, which one task reads at once.
PART_TOKENS = 1_000_000
#: Lists up to this length give pairs; longer ones are compared in blocks of so many classes.
SMALL_LIST, BLOCK_CLASSES = 64, 512
PAIR = "a bigint, na bigint, b bigint, nb bigint"


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than a shingle are one shingle, no words none."""
    hashes = word_hashes(text)
    if 0 < len(hashes) < words:
        return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes()) >> (64 - BITS)], np.uint64)
    return np.unique(shingle_hashes(hashes, words))


def _features(words: int):
    def features(texts: list[str | None]) -> Features:
        sets = [shingle_set(t, words) for t in texts]
        size = np.array([len(s) for s in sets], np.int64)
        return Features(
            np.concatenate(sets) if sets else np.empty(0, np.uint64), np.repeat(np.arange(len(sets)), size),
            size, [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
        )

    return features


def _candidates_of(percent: int):
    def finish(block: Block) -> pa.RecordBatch:
        """Every document; tokens only where enough are shared for any link."""
        count = np.bincount(block.doc, minlength=len(block.ids))
        enough = block.holder & (block.size > 0) & (100 * count >= percent * block.size)
        kept = enough[block.doc]
        offsets = np.concatenate([[0], np.cumsum(np.where(enough, count, 0))])
        tokens = pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32(), mask=np.append(~enough, False)), pa.array(block.value[kept].astype(np.int64))
        )
        digest = [d.tobytes() if n else None for d, n in zip(block.digest, block.size)]
        return pa.RecordBatch.from_arrays(
            [block.id_array(), pa.array(block.size), pa.array(digest, pa.binary()), tokens],
            names=["doc_id", "n", "digest", "tokens"],
        )

    return finish


def ngram_join(
    docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Documents with equal or similar sets of word shingles.

    Two documents link when ``100 * common >= percent * union``. Returns ``(members, links)``:
    ``members`` has a row for each document (``doc_id, n_shingles, digest, class_id``), where
    ``class_id`` is the smallest id with an equal set, and ``links`` (``a, b, common``) joins
    classes. Links inside what others already join are left out: ``links`` holds enough of them that
    its components are those of all links.

    1. A document can only link when ``percent`` of its shingles occur in other sets, so the
       first pass (``sharing``) finds shared shingles and drops all other documents.
    2. Of each class left, the order of shingles is (number of classes, hash). Vertical
       fragments of the hash order count classes and give each class its counts back.
    3. By the prefix filter, two linked classes share one of the rarest shingles of either.
       In each such shingle's list, the class with the largest shared part is the hub and all
       others are paired with it, so the pairs grow with the list, not with its square.
    4. The overlap of a pair is counted in ``SLICES`` fragments of the hash order, each on its
       own, and summed (a hub's list is spread over that many keys, and adaptive execution splits
       further).
    5. Pairs of a list that are still in different components after the hubs' links are then
       checked too, so no link between components is lost, whatever the hubs are. Lists of at
       most ``SMALL_LIST`` classes give their pairs. Classes of longer lists, which are variants of
       one text whose similarity is close to the bound, are bundled and compared in blocks
       of ``BLOCK_CLASSES``: overlaps are again counted by fragments of the order and summed,
       and only links leave the task.

    Null texts and texts without words have an empty set, link with nothing and are their own
    class. A null id is in its class but names no group (null if all ids of it are null).
    Repeated rows give a row each. An empty table gives no rows. Other columns are not read.
    """
    members, links, _ = _join(docs, words, percent, id_col, text_col, [])
    return members, links


def _join(
    docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, scratch: list[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``members`` and ``links`` of ``ngram_join``, and the classes ``(id, n, tokens)`` that may have links.

    All three are stored and noted in ``scratch``; what they were made from is removed.
    """
    spark, sent, used = docs.sparkSession, [], []
    fragments = fragment_count(docs, text_col, 1.0)
    sets = stored(
        shared_features(docs, id_col, text_col, _features(words), _candidates_of(percent), _SET, fragments), "ngram-sets", sent
    )
    classes = sets.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    members = sets.join(classes, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "digest", F.coalesce("class_id", "doc_id").alias("class_id")
    )
    members = stored(members, "ngram-members", scratch)
    shared = sets.filter(F.col("tokens").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest").agg(
        F.min(F.struct("doc_id", "n", "tokens")).alias("s")
    ).select(F.col("s.doc_id").alias("id"), "s.n", "s.tokens")
    shared = stored(shared, "ngram-classes", scratch)
    remove(spark, sent)
    with shuffles_removed(spark):
        total = shared.agg(F.sum(F.size("tokens"))).first()[0] or 0
    bits = min(24, max(3, math.ceil(math.log2(max(total, 1) / PART_TOKENS))))
    segments = _cut(shared, SLICES.bit_length() - 1)
    lists = stored(_prefix_lists(shared, bits, percent), "ngram-prefixes", used)

    pairs = lists.groupBy("part").applyInArrow(_hub_pairs(percent), PAIR).distinct()
    links = stored(_overlaps(pairs, segments, percent), "ngram-links", used)
    groups = components(links, used)
    marked = lists.join(groups, F.col("id") == F.col("node"), "left").select(
        "part", "id", "n", "s", "tokens", F.coalesce("component", "id").alias("component")
    )
    crossed = stored(marked.groupBy("part").applyInArrow(_crossings(percent), f"{PAIR}, large boolean").distinct(), "ngram-crossings", used)
    few = _overlaps(crossed.filter(~F.col("large")).drop("large"), segments, percent)
    bundles = components(crossed.filter("large").select("a", "b"), used).select(F.col("node").alias("id"), F.col("component").alias("bundle"))
    many = _block_links(shared, bundles, groups, percent)
    links = stored(links.union(few).union(many), "ngram-links", scratch)
    remove(spark, used)
    return members, links, shared


def similar_groups(
    docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True,
    scratch: list[str] | None = None,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id, n_links``: each document with its group.

    ``component_id`` is the smallest id that links reach. ``n_links`` counts the other classes that the document's
    class links with, all of them (null without ``count_links``): links never leave a group, so every group is
    compared in itself, in blocks of ``BLOCK_CLASSES``, and only counts leave a block. See ``ngram_join`` for empty
    and null values. ``scratch`` gets the folders that the result reads.
    """
    scratch = [] if scratch is None else scratch
    members, links, classes = _join(docs, words, percent, id_col, text_col, scratch)
    rounds: list[str] = []
    groups = stored(components(links, rounds), "ngram-groups", scratch)
    remove(docs.sparkSession, rounds)
    if count_links:
        counts = _link_counts(classes, groups, percent)
    else:
        counts = groups.select(F.col("node").alias("id"), F.lit(None).cast("bigint").alias("n_links"))
    by_class = groups.join(counts, F.col("node") == F.col("id"), "left").select("node", "component", "n_links")
    return members.join(by_class, F.col("class_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id",
        (F.coalesce("n_links", F.lit(0).cast("bigint")) if count_links else F.col("n_links")).alias("n_links"),
    )


def _link_counts(classes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """``id, n_links`` of the classes of all groups (``node, component``).

    Small groups share a bundle, since classes of different groups have no links.
    """
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    total = groups.count()
    bundle = F.when(F.col("size") > BLOCK_CLASSES // 8, F.col("component")).otherwise(
        -1 - F.pmod(F.xxhash64("component"), F.lit(max(1, -(-total // (BLOCK_CLASSES // 2)))))
    )
    bundles = groups.join(sizes, "component").select(F.col("node").alias("id"), (2 * bundle).alias("bundle"))
    blocks = bundles.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_CLASSES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    member = classes.join(bundles, "id").join(blocks, "bundle").select("bundle", "id", "n", "tokens", own.alias("own"), "blocks")
    met = member.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bundle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "n", "own", "tokens"
    )

    def counted(rows: pa.Table) -> pa.Table:
        id_, n, own, low, high = (np.asarray(rows[c], np.int64) for c in ("id", "n", "own", "low", "high"))
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        common = _common_counts(rows, left, right)
        linked = (100 + percent) * common >= percent * (n[left][:, None] + n[right][None, :])
        linked &= id_[left][:, None] != id_[right][None, :]
        found = linked.sum(axis=1)
        ids = id_[left]
        if len(left) and low[0] != high[0]:
            ids, found = np.append(ids, id_[right]), np.append(found, linked.sum(axis=0))
        return pa.table({"id": pa.array(ids, pa.int64()), "n_links": pa.array(found, pa.int64())})

    return met.groupBy("bundle", "low", "high").applyInArrow(counted, "id bigint, n_links bigint").groupBy("id").agg(F.sum("n_links").alias("n_links"))


def _cut(classes: DataFrame, bits: int) -> DataFrame:
    """``part, id, n, tokens``: the tokens of each class by the first ``bits`` bits of their hashes."""

    def cut(batches):
        for batch in batches:
            token, row = _flat(batch)
            part = token >> (BITS - bits)
            starts = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (row[1:] != row[:-1]))[: len(token)])
            of = pa.array(row[starts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[starts].astype(np.int32)), batch["id"].take(of), batch["n"].take(of),
                 pa.ListArray.from_arrays(pa.array(np.append(starts, len(token)), pa.int32()), pa.array(token))],
                names=["part", "id", "n", "tokens"],
            )

    return classes.select("id", "n", "tokens").mapInArrow(cut, "part int, id bigint, n bigint, tokens array<bigint>")


def _prefix_lists(classes: DataFrame, bits: int, percent: int) -> DataFrame:
    """``part, id, n, s, tokens``: the prefix of each class by (number of classes, hash), cut into parts of the hash order.

    Shingles of one class are the rarest and find no partner, so they only use up the prefix.
    ``s`` is the number of shingles that other classes share.
    """
    counted = _cut(classes, bits).groupBy("part").applyInArrow(
        _counted, "id bigint, n bigint, tokens array<bigint>, classes array<bigint>"
    )
    whole = counted.groupBy("id", "n").agg(
        F.flatten(F.collect_list("tokens")).alias("tokens"), F.flatten(F.collect_list("classes")).alias("classes")
    )

    def prefix(batches):
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("part", "id", "n", "s", "tokens")}
            for id_, n, tokens, classes in zip(batch["id"].to_pylist(), batch["n"].to_pylist(), batch["tokens"], batch["classes"]):
                token = np.asarray(tokens.values, np.int64)
                length = n - -(-n * percent // 100) + 1 - (n - len(token))
                if length <= 0 or 100 * len(token) < percent * n:
                    continue
                best = np.sort(token[np.lexsort((token, np.asarray(classes.values, np.int64)))[:length]])
                part = best >> (BITS - bits)
                starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                for first, past in zip(starts, np.append(starts[1:], len(best))):
                    for c, v in zip(rows, (int(part[first]), id_, n, len(token), best[first:past])):
                        rows[c].append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))

    return whole.mapInArrow(prefix, "part int, id bigint, n bigint, s bigint, tokens array<bigint>")


def _flat(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a table, and the row of each."""
    lists = rows["tokens"]
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    return np.asarray(lists.flatten(), np.int64), np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths(), np.int64))


def _counted(rows: pa.Table) -> pa.Table:
    """Tokens of a part that several classes have, with the number of these classes."""
    token, row = _flat(rows)
    _, place, count = np.unique(token, return_inverse=True, return_counts=True)
    classes = count[place]
    kept = classes > 1
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=rows.num_rows))]), pa.int32())
    return pa.table({
        "id": rows["id"], "n": rows["n"],
        "tokens": pa.ListArray.from_arrays(offsets, pa.array(token[kept], pa.int64())),
        "classes": pa.ListArray.from_arrays(offsets, pa.array(classes[kept].astype(np.int64))),
    })


class _Lists:
    """The lists of a part: classes by token, the hub of each list first."""

    def __init__(self, rows: pa.Table):
        token, row = _flat(rows)
        self.id, self.n, self.s = (np.asarray(rows[c], np.int64) for c in ("id", "n", "s"))
        rank = np.empty(rows.num_rows, np.int64)
        rank[np.lexsort((self.id, -self.n, -self.s / self.n))] = np.arange(rows.num_rows)
        order = np.lexsort((rank[row], token))
        token, self.row = token[order], row[order]
        new = np.append(True, token[1:] != token[:-1])[: len(token)]
        self.starts = np.flatnonzero(new)
        self.ends = np.append(self.starts[1:], len(token))
        self.hub = self.row[self.starts][np.cumsum(new) - 1] if len(token) else self.row

    def pairs(self, a: np.ndarray, b: np.ndarray, percent: int) -> pa.Table:
        """Distinct pairs of rows that may link by their numbers of shingles, the smaller id first."""
        na, nb, least = self.n[a], self.n[b], np.minimum(self.s[a], self.s[b])
        may = (self.id[a] != self.id[b]) & ((100 + percent) * least >= percent * (na + nb))
        swap = self.id[a] > self.id[b]
        a, b = np.where(swap, b, a)[may], np.where(swap, a, b)[may]
        one = np.unique(a * len(self.id) + b)
        a, b = one // max(len(self.id), 1), one % max(len(self.id), 1)
        return pa.table({"a": self.id[a], "na": self.n[a], "b": self.id[b], "nb": self.n[b]})


def _hub_pairs(percent: int):
    def pairs(rows: pa.Table) -> pa.Table:
        lists = _Lists(rows)
        return lists.pairs(lists.hub, lists.row, percent)

    return pairs


def _crossings(percent: int):
    def crossings(rows: pa.Table) -> pa.Table:
        """Lists of several components: pairs of components of a short one, all of a long one with its hub."""
        lists = _Lists(rows)
        component = np.asarray(rows["component"], np.int64)
        none = lists.row[:0]
        found = {False: [lists.pairs(none, none, percent)], True: [lists.pairs(none, none, percent)]}
        seen: set[bytes] = set()
        for first, past in zip(lists.starts, lists.ends):
            row = lists.row[first:past]
            of = component[row]
            if (of == of[0]).all() or row.tobytes() in seen:
                continue
            seen.add(row.tobytes())  # lists with equal classes give equal pairs
            long = len(row) > SMALL_LIST
            if long:
                a, b = np.full(len(row) - 1, row[0]), row[1:]
            else:
                a, b = np.triu_indices(len(row), 1)
                a, b = a[of[a] != of[b]], b[of[a] != of[b]]
                a, b = row[a], row[b]
            found[long].append(lists.pairs(a, b, 0 if long else percent))
            if len(found[long]) >= 256:
                found[long] = [_distinct(found[long])]
        parts = [_distinct(t).append_column("large", pa.array([long] * _distinct(t).num_rows, pa.bool_())) for long, t in found.items()]
        return pa.concat_tables(parts)

    return crossings


def _block_links(classes: DataFrame, bundles: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """``a, b, common`` of linked classes of different components in the same bundle.

    A class goes to its block's meetings with all blocks of its bundle; a meeting is a task.
    """
    blocks = bundles.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_CLASSES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    member = (
        classes.join(bundles, "id").join(blocks, "bundle")
        .join(groups.withColumnRenamed("node", "id"), "id", "left")
        .select("bundle", "id", "n", "tokens", F.coalesce("component", "id").alias("component"), own.alias("own"), "blocks")
    )
    met = member.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bundle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "n", "component", "own", "tokens"
    )

    def links(rows: pa.Table) -> pa.Table:
        id_, n, component, own, low, high = (np.asarray(rows[c], np.int64) for c in ("id", "n", "component", "own", "low", "high"))
        left = np.flatnonzero(own == low)
        right = np.flatnonzero(own == high)
        common = _common_counts(rows, left, right)
        a, b = np.nonzero((100 + percent) * common >= percent * (n[left][:, None] + n[right][None, :]))
        a, b, shared = left[a], right[b], common[a, b]
        new = component[a] != component[b]
        a, b, shared = a[new], b[new], shared[new]
        return pa.table({"a": np.minimum(id_[a], id_[b]), "b": np.maximum(id_[a], id_[b]), "common": shared})

    return met.groupBy("bundle", "low", "high").applyInArrow(links, "a bigint, b bigint, common bigint").distinct()


def _common_counts(rows: pa.Table, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Numbers of common tokens of each left and each right row, summed over fragments of the order."""
    token, row = _flat(rows)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    column = np.cumsum(np.append(False, token[1:] != token[:-1])) if len(token) else token
    place_l, place_r = np.full(rows.num_rows, -1), np.full(rows.num_rows, -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s = slice(*np.searchsorted(column, (first, first + width)))
        sides = []
        for place, count in ((place_l[row[s]], len(left)), (place_r[row[s]], len(right))):
            held = np.zeros((count, width), np.float32)
            held[place[place >= 0], column[s][place >= 0] - first] = 1
            sides.append(held)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _distinct(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["a", "na", "b", "nb"]).aggregate([])


def _overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """``a, b, common`` of the pairs that link; each slice of the hash order is counted on its own."""
    side = lambda c: segments.select(F.col("id").alias(c), F.col("part").alias("slice"), F.col("tokens").alias(f"{c}_tokens"))
    common: Column = F.size(F.array_intersect("a_tokens", "b_tokens"))
    counted = (
        pairs.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        .join(side("a"), ["a", "slice"]).join(side("b"), ["b", "slice"])
        .groupBy("a", "na", "b", "nb").agg(F.sum(common).alias("common"))
    )
    return counted.filter(
        F.lit(100 + percent) * F.col("common") >= F.lit(percent) * (F.col("na") + F.col("nb"))
    ).select("a", "b", "common")
