"""Toxicity by weak supervision: voters, a generative model of their votes, a linear classifier.

Voters are word lists, fixed ones and ones mined from labelled rows, stems of words, and patterns. The votes of a
text are the bits of one number, so that all documents shrink to a table of at most
``3 * 2**voters`` counts, and the label model is fitted to that table on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_slices
from .quality import _with
from .wordcodes import Words, byte_kinds, coded_words, flat

#: Words are runs of ASCII letters and of all bytes from 0x80 on.
KINDS = byte_kinds(bytes(b for b in range(128) if not chr(b).isalpha()))

#: Words of abuse by kind, in the languages of the corpus; a voter each.
LEXICONS: dict[str, tuple[str, ...]] = {
    "mind": (
        "idiot", "idiots", "moron", "morons", "stupid", "dumb", "fool", "imbecile", "cretin", "brainless",
        "dumm", "dummkopf", "trottel", "schwachkopf", "crétin", "abruti", "débile", "imbécile", "idiota", "estúpido", "tonto",
    ),
    "worth": (
        "worthless", "pathetic", "loser", "losers", "useless", "failure",
        "wertlos", "erbärmlich", "versager", "minable", "raté", "patético", "fracasado", "inútil",
    ),
    "disgust": (
        "disgusting", "trash", "scum", "garbage", "filth", "vermin",
        "ekelhaft", "abschaum", "dreck", "dégoûtant", "ordure", "racaille", "asqueroso", "basura", "escoria",
    ),
    "mockery": ("clown", "clowns", "coward", "liar", "freak", "feigling", "lügner", "lâche", "menteur", "payaso", "cobarde"),
    "threat": ("kill", "murder", "strangle", "hate", "töten", "hasse", "tuer", "déteste", "matar", "odio"),
    "curse": ("shit", "bitch", "bastard", "crap", "scheiße", "arschloch", "merde", "salaud", "mierda", "cabrón"),
}
ADDRESS = ("you", "your", "youre", "u", "du", "dich", "dein", "ihr", "tu", "toi", "vous", "tú", "usted", "eres")

MINED = 3  # parts of the labelled rows; a list of words and one of stems is mined from all but each of them
STEMS = range(3, 8)  # characters of a stem
STEM_WORDS = 120  # a stem counts where it begins two different words, and one word in this many
PATTERNS = ("addressed", "shouted", "exclaimed", "masked")
VOTERS = (*LEXICONS, *(f"mined{i}" for i in range(MINED)), *(f"stems{i}" for i in range(MINED)), *PATTERNS)

Lists = tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class LabelModel:
    """A class and votes that depend on it and, along a tree, on one another."""

    prior: float
    parents: tuple[int, ...]  # -1: the voter depends on the class only
    votes: np.ndarray = field(compare=False)  # [class, value of the parent, voter]: chance of a vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of a toxic text for each pattern of votes."""
        bits = (patterns[:, None] >> np.arange(len(self.parents))) & 1
        above = np.where(np.array(self.parents) >= 0, bits[:, self.parents], 0)
        logs = []
        for label, prior in ((0, 1 - self.prior), (1, self.prior)):
            chance = self.votes[label][above, np.arange(bits.shape[1])]
            logs.append(np.log(prior) + np.log(np.where(bits == 1, chance, 1 - chance)).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


@dataclass(frozen=True)
class ToxicityModel:
    """Word lists and stems of the mined voters, the label model, and the classifier: weights of the votes, then of its words."""

    mined: Lists  # words of each part, then stems of each part
    labels: LabelModel
    words: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    accuracies: dict[str, float] = field(default_factory=dict, compare=False)
    correlations: dict[tuple[str, str], float] = field(default_factory=dict, compare=False)


# ------------------------------------------------------------------ voters


def _member(words: Words, chosen: tuple[str, ...]) -> np.ndarray:
    """Which of the distinct words are in ``chosen``."""
    if not chosen:
        return np.zeros(len(words.distinct), bool)
    values = pa.array([w.encode() for w in chosen], pa.large_binary())
    return pc.is_in(words.distinct, value_set=values).to_numpy(zero_copy_only=False)


def _stemmed(words: Words, stems: tuple[str, ...]) -> np.ndarray:
    """Which of the distinct words begin with one of ``stems`` and go on after it."""
    out = np.zeros(len(words.distinct), bool)
    spelled = [s.encode() for s in stems]
    lengths = pc.binary_length(words.distinct).to_numpy(zero_copy_only=False)
    for size in sorted({len(s) for s in spelled}):
        begins = pc.binary_slice(words.distinct, 0, size)
        values = pa.array([s for s in spelled if len(s) == size], pa.large_binary())
        out |= pc.is_in(begins, value_set=values).to_numpy(zero_copy_only=False) & (lengths > size)
    return out


def vote_patterns(texts: pa.Array, words: Words, mined: Lists) -> np.ndarray:
    """The votes of each text as bits, in the order of ``VOTERS``."""
    out = np.zeros(len(texts), np.int64)
    abusive = np.zeros(len(words.distinct), bool)
    for i, (name, chosen) in enumerate([*LEXICONS.items(), *((f"mined{i}", m) for i, m in enumerate(mined[:MINED]))]):
        hit = _member(words, chosen)
        abusive |= hit if name in LEXICONS else False
        out[words.rows[hit[words.codes]]] |= 1 << i
    first = len(LEXICONS) + MINED
    sizes = np.bincount(words.rows, minlength=len(texts))
    for i, stems in enumerate(mined[MINED:]):
        hit = _stemmed(words, stems)[words.codes]
        seen = np.unique(words.rows[hit] * max(len(words.distinct), 1) + words.codes[hit])
        different = np.bincount(seen // max(len(words.distinct), 1), minlength=len(texts))
        dense = np.bincount(words.rows[hit], minlength=len(texts)) * STEM_WORDS >= sizes
        out[(different >= 2) & dense] |= 1 << (first + i)
    first += MINED
    you, abuse = _member(words, ADDRESS)[words.codes], abusive[words.codes]
    for gap in (1, 2, 3):  # someone is addressed up to three words before the abuse
        near = you[:-gap] & abuse[gap:] & (words.rows[:-gap] == words.rows[gap:])
        out[words.rows[:-gap][near]] |= 1 << first
    data, offsets = flat(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    letter = upper | lower | (data >= 128)
    capitals = np.bincount(row[upper], minlength=len(texts))
    out[(capitals > 8) & (2 * capitals > capitals + np.bincount(row[lower], minlength=len(texts)))] |= 1 << (first + 1)
    same = row[1:] == row[:-1]
    twice = (data[1:] == 33) & (data[:-1] == 33) & same
    out[row[1:][twice]] |= 1 << (first + 2)
    sign = np.isin(data, np.frombuffer(b"*$@#", np.uint8))
    masked = sign[1:-1] & letter[:-2] & letter[2:] & same[1:] & same[:-1]
    out[row[1:-1][masked]] |= 1 << (first + 3)
    return out


def _slices(batches, text_col):
    """Slices of about 8 MB of text with their words."""
    for batch in batches:
        for first, past in text_slices(batch[text_col]):
            part = batch.slice(first, past - first)
            yield part, coded_words(part[text_col], KINDS)


# ------------------------------------------------------------------ label model


def _pair_counts(bits: np.ndarray, weight: np.ndarray, smooth: float) -> np.ndarray:
    """``[i, j, a, b]``: weight of the patterns where voter i says a and voter j says b."""
    sides = np.stack([1 - bits, bits])
    counts = np.einsum("ani,n,bnj->ijab", sides, weight, sides, optimize=True)
    return counts + smooth


def _information(counts: np.ndarray) -> np.ndarray:
    """Mutual information of each pair of voters."""
    p = counts / counts.sum(axis=(2, 3), keepdims=True)
    return (p * np.log(p / (p.sum(3, keepdims=True) * p.sum(2, keepdims=True)))).sum(axis=(2, 3))


def _tree(information: np.ndarray) -> list[int]:
    """Parents along the spanning tree of most information; the first voter has none."""
    size = len(information)
    parents, best = [-1] * size, information[0].copy()
    link, inside = np.zeros(size, int), {0}
    while len(inside) < size:
        j = max((i for i in range(size) if i not in inside), key=lambda i: best[i])
        parents[j] = int(link[j])
        inside.add(j)
        closer = information[j] > best
        best[closer], link[closer] = information[j][closer], j
    return parents


def fit_label_model(
    patterns: np.ndarray, unknown: np.ndarray, clean: np.ndarray, toxic: np.ndarray, voters: int, rounds: int = 30,
    smooth: float = 0.5, unknown_share: float = 0.25,
) -> tuple[LabelModel, np.ndarray]:
    """Expectation and maximisation over counts of vote patterns; returns the model and its pair information.

    ``unknown`` counts texts without a label; ``clean`` and ``toxic`` those with one, which hold the
    classes in place: however many texts have no label, together they weigh ``unknown_share`` of the
    others at most. Without labels the number of word lists that voted stands for them.
    Correlated voters are joined by the tree that explains most of what they share within a class,
    so that their votes do not count twice.
    """
    bits = (patterns[:, None] >> np.arange(voters)) & 1
    votes = bits[:, : len(LEXICONS)].sum(axis=1)
    start = np.where(votes > 0, 1 - 0.25 ** (votes + 1), 0.02)
    if not (clean + toxic).any():
        clean, toxic = unknown * (1 - start), unknown * start
    known = clean + toxic
    unknown = unknown * min(1.0, unknown_share * known.sum() / max(unknown.sum(), 1.0))
    chance = np.where(known > 0, (toxic + start) / (known + 1), start)
    model, shared = LabelModel(0.5, (-1,) * voters, np.full((2, 2, voters), 0.5)), np.zeros((voters, voters))
    parents: list[int] = []
    for turn in range(rounds):
        weights = (unknown * (1 - chance) + clean, unknown * chance + toxic)
        counts = [_pair_counts(bits, w, smooth) for w in weights]
        if turn < 5:
            shared = sum(w.sum() * _information(c) for w, c in zip(weights, counts)) / max(sum(w.sum() for w in weights), 1)
            parents = _tree(shared)
        above = np.maximum(parents, 0)
        own = np.arange(voters)
        tables = []
        for c in counts:
            alone = c[own, own][:, [0, 1], [0, 1]]  # silent, voted
            given = c[above, own]  # [voter, value of the parent, vote]
            table = given[:, :, 1] / given.sum(axis=2)
            table[np.array(parents) < 0] = (alone[:, 1] / alone.sum(axis=1))[np.array(parents) < 0][:, None]
            tables.append(table.T)
        total = sum(w.sum() for w in weights)
        model = LabelModel(float((weights[1].sum() + smooth) / (total + 2 * smooth)), tuple(parents), np.stack(tables))
        chance = model.posterior(patterns)
    return model, shared


# ------------------------------------------------------------------ fitting


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, labelled_rows: int = 6000, sample_rows: int = 4000, mined_words: int = 40,
    features: int = 256, seed: int = 12,
) -> ToxicityModel:
    """Fit on the texts of ``docs`` (``doc_id, text``); ``labels`` (``doc_id, label``: 1 toxic, 0 clean) marks some.

    Bounded samples: at most ``labelled_rows`` labelled ids of each class, by a hash of the id, for the
    mined word lists and to hold the classes of the label model in place; about ``sample_rows`` different
    texts of each side of the posterior, by a hash of the text, for the classifier with its
    ``features`` words. The label model counts the votes of all documents.

    Labels other than 0 and 1, null ids and null texts are left out of the fit; an id with several
    labels, or a label for several texts, counts each time. Without labels the fixed word lists
    decide; without documents every score is 0.5.
    """
    docs = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    usable = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("label").cast("int").alias("label"), F.xxhash64(F.lit(seed), "doc_id").alias("pick")
    )
    drawn = [usable.filter(F.col("label") == x).orderBy("pick", "doc_id").limit(labelled_rows) for x in (0, 1)]
    marked = stored(drawn[0].union(drawn[1]).withColumn("part", F.pmod("pick", F.lit(MINED)).cast("int")), "toxicity-labels")
    sampled = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    totals = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    scale = [totals.get(x, 0) / max(sampled.get(x, 0), 1) for x in (0, 1)]

    known = docs.join(F.broadcast(marked.select("doc_id", "label", "part")), "doc_id")  # at most 2 * labelled_rows ids
    mined = _mined(known, mined_words)

    ids = F.broadcast(marked.select("doc_id", "label"))
    votes = docs.join(ids, "doc_id", "left").select("text", "label").mapInArrow(partial(_vote, mined), "pattern bigint, label int")
    table = votes.groupBy("pattern", "label").agg(F.count("*").alias("n")).toArrow()  # at most 3 * 2**voters rows
    patterns, place = np.unique(table["pattern"].to_numpy(), return_inverse=True)
    kind = pc.fill_null(table["label"], 2).to_numpy()
    n = table["n"].to_numpy().astype(float)
    clean, toxic, unknown = (np.bincount(place[kind == k], n[kind == k], len(patterns)) for k in (0, 1, 2))
    if not len(patterns):
        return ToxicityModel(mined, LabelModel(0.5, (-1,) * len(VOTERS), np.full((2, 2, len(VOTERS)), 0.5)), (), (0.0,) * len(VOTERS), 0.0)
    model, shared = fit_label_model(patterns, unknown, clean * scale[0], toxic * scale[1], len(VOTERS))

    chance, all_rows = model.posterior(patterns), clean + toxic + unknown
    sides = [float(all_rows[chance < 0.5].sum()), float(all_rows[chance >= 0.5].sum())]
    words, weights, intercept = _linear(docs, mined, model, sides, sample_rows, features)
    bits = (patterns[:, None] >> np.arange(len(VOTERS))) & 1
    agree = np.where(bits == 1, chance[:, None], 1 - chance[:, None])
    accuracy = (agree * all_rows[:, None]).sum(axis=0) / all_rows.sum()
    return ToxicityModel(
        mined, model, words, weights, intercept,
        {v: float(a) for v, a in zip(VOTERS, accuracy)},
        {(VOTERS[p], VOTERS[j]): float(shared[p, j]) for j, p in enumerate(model.parents) if p >= 0},
    )


def _held_words(batches):
    """Counts of the documents of each part and slice that hold a word."""
    for part, words in _slices(batches, "text"):
        seen = np.unique(words.rows * max(len(words.distinct), 1) + words.codes)
        row, code = np.divmod(seen, max(len(words.distinct), 1))
        yield _part_counts(part, row, code, words.distinct)


def _held_stems(batches):
    """The same of stems, for documents in which a stem counts."""
    for part, words in _slices(batches, "text"):
        spelled = words.distinct.cast(pa.large_string())
        sizes = np.bincount(words.rows, minlength=part.num_rows)
        seen, times = np.unique(words.rows * max(len(spelled), 1) + words.codes, return_counts=True)
        row, code = np.divmod(seen, max(len(spelled), 1))
        letters = pc.utf8_length(spelled).to_numpy(zero_copy_only=False)
        for size in STEMS:
            stems = pc.utf8_slice_codeunits(spelled, 0, size).dictionary_encode()
            longer = letters[code] > size
            width = max(len(stems.dictionary), 1)
            at = row[longer] * width + stems.indices.to_numpy(zero_copy_only=False)[code[longer]]
            held, place, different = np.unique(at, return_inverse=True, return_counts=True)
            dense = np.bincount(place, times[longer], len(held)) * STEM_WORDS >= sizes[held // width]
            counted = held[(different >= 2) & dense]
            yield _part_counts(part, counted // width, counted % width, stems.dictionary.cast(pa.large_binary()))


def _part_counts(part, row, code, names) -> pa.RecordBatch:
    width = max(len(names), 1)
    group = part["part"].to_numpy(zero_copy_only=False)[row].astype(np.int64)
    weight = part["label"].to_numpy(zero_copy_only=False)[row].astype(float)
    held, place = np.unique(group * width + code, return_inverse=True)
    group, code = np.divmod(held, width)
    text = names.take(pa.array(code)).cast(pa.large_string()).cast(pa.string())
    sums = [pa.array(np.bincount(place, w, len(held)).astype(float)) for w in (weight, None)]
    return pa.RecordBatch.from_arrays([pa.array(group), text, *sums], names=["part", "word", "toxic", "n"])


_WORD_COUNTS = "part bigint, word string, toxic double, n double"


def _best_words(rows: DataFrame, count: int, held=_held_words, others: bool = False, z: float = 2.5, least: float = 0.4) -> list[tuple[int, str]]:
    """Words of each part that lean most to toxic rows, by the lower end of the share's range (``z`` errors wide), ``least`` of it at least.

    Many words are compared, so the range is a wide one. With ``others`` the words of a part are those of
    the rows in all other parts.
    """
    counts = rows.mapInArrow(held, _WORD_COUNTS).groupBy("part", "word").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    if others:
        given = F.create_map("part", F.struct("toxic", "n"))
        whole = counts.groupBy("word").agg(F.sum("toxic").alias("all_toxic"), F.sum("n").alias("all_n"), F.collect_list(given).alias("own"))
        part = whole.select("word", "all_toxic", "all_n", F.explode(F.array([F.lit(i) for i in range(MINED)])).alias("part"), "own")
        own = lambda name: F.aggregate("own", F.lit(0.0), lambda a, m: a + F.coalesce(m[F.col("part")][name], F.lit(0.0)))
        counts = part.select("part", "word", (F.col("all_toxic") - own("toxic")).alias("toxic"), F.nullif(F.col("all_n") - own("n"), F.lit(0.0)).alias("n"))
    share = F.col("toxic") / F.col("n")
    low = (share + z * z / (2 * F.col("n")) - z * F.sqrt(share * (1 - share) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    order = Window.partitionBy("part").orderBy(F.desc("low"), F.desc("n"), "word")
    best = (
        counts.withColumn("low", low).filter(F.col("low") >= least)
        .withColumn("at", F.row_number().over(order)).filter(F.col("at") <= count)
    )
    return sorted((r["part"], r["word"]) for r in best.select("part", "word").collect())  # ``count`` a part


def _mined(known: DataFrame, count: int) -> Lists:
    """For each part of the labelled rows words mined from the other parts, then stems."""
    rows = known.select("text", "part", "label")
    found = [_best_words(rows, count, held, True) for held in (_held_words, _held_stems)]
    return tuple(tuple(w for p, w in one if p == part) for one in found for part in range(MINED))


def _vote(mined, batches):
    for part, words in _slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(vote_patterns(part["text"], words, mined)), part["label"]], names=["pattern", "label"])


def _labelled_sample(mined, model, shares, batches):
    """Texts below the share of their side, with the posterior of their votes."""
    for part, words in _slices(batches, "text"):
        chance = model.posterior(vote_patterns(part["text"], words, mined))
        pick = (part["pick"].to_numpy(zero_copy_only=False).astype(np.uint64) >> np.uint64(11)).astype(float) / (1 << 53)
        taken = pa.array(pick < np.where(chance >= 0.5, shares[1], shares[0]))
        yield pa.RecordBatch.from_arrays(
            [part["text"].filter(taken), part["pick"].filter(taken), pa.array(chance).filter(taken)], names=["text", "pick", "chance"]
        )


def _feature_rows(mined, chosen, batches):
    for part, words in _slices(batches, "text"):
        rows, held = _features(part["text"], words, mined, chosen)
        ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(held, pa.int32()))
        yield pa.RecordBatch.from_arrays([part["chance"], lists], names=["chance", "held"])


def _features(texts, words: Words, mined, chosen) -> tuple[np.ndarray, np.ndarray]:
    """``row, feature`` in order: the votes of each text, then which of the ``chosen`` words it holds."""
    values = pa.array([w.encode() for w in chosen], pa.large_binary())
    place = pc.fill_null(pc.index_in(words.distinct, value_set=values), -1)
    at = place.to_numpy(zero_copy_only=False).astype(np.int64)[words.codes]
    votes = vote_patterns(texts, words, mined)
    voted, voter = np.nonzero((votes[:, None] >> np.arange(len(VOTERS))) & 1)
    width = len(VOTERS) + len(chosen)
    words_held = words.rows[at >= 0] * width + at[at >= 0] + len(VOTERS)
    return np.divmod(np.unique(np.concatenate([voted * width + voter, words_held])), width)


def _linear(docs, mined, model, sides, sample_rows, features):
    """Logistic regression of the posterior labels on votes and words: words, weights and intercept."""
    shares = [min(1.0, sample_rows / max(s, 1.0)) for s in sides]
    hashed = docs.select("text", F.xxhash64("text").alias("pick"))
    sample = hashed.mapInArrow(partial(_labelled_sample, mined, model, shares), "text string, pick bigint, chance double")
    once = sample.groupBy("pick").agg(F.first("text").alias("text"), F.first("chance").alias("chance"))  # copies count once
    sample = stored(once.select("text", "chance"), "toxicity-sample")
    rows = sample.select("text", F.lit(0).cast("bigint").alias("part"), F.col("chance").alias("label"))
    words = tuple(w for _, w in _best_words(rows, features))
    found = sample.mapInArrow(partial(_feature_rows, mined, words), "chance double, held array<int>").toArrow()
    chance = found["chance"].to_numpy()
    if not len(chance):
        return (), (0.0,) * len(VOTERS), 0.0
    lists = found["held"].combine_chunks()
    x = np.zeros((len(chance), len(VOTERS) + len(words) + 1))
    x[np.repeat(np.arange(len(chance)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = 1
    x[:, -1] = 1
    order = np.lexsort((*x.T, chance))  # the order of rows must not change the sums
    x, chance = x[order], chance[order]
    each = np.where(chance >= 0.5, 1 / shares[1], 1 / shares[0])
    w = logistic(x, chance, each / each.mean())
    return words, tuple(float(v) for v in w[:-1]), float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last column is the intercept."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


# ------------------------------------------------------------------ scoring


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score_col`` (0 to 1, higher is more toxic) from whole texts; all other columns stay.

    A column of that name is replaced. Null and empty texts get the score of a text without votes
    or words of the classifier. Rows keep their partitions; nothing is shuffled.
    """
    schema = docs.withColumn(score_col, F.lit(0.0).cast("double")).schema
    return docs.mapInArrow(partial(_score, model, text_col, score_col), schema)


def _score(model: ToxicityModel, text_col: str, score_col: str, batches):
    weights = np.array(model.weights)
    for part, words in _slices(batches, text_col):
        rows, held = _features(part[text_col], words, model.mined, model.words)
        total = np.bincount(rows, weights[held], part.num_rows) + model.intercept
        yield _with(part, score_col, pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500)))))
