"""Lexicon features: emotion, valence, categories, word classes and sentiment.

Features are made by blocks of posts. The texts are shuffled once into blocks; each block sends its
distinct words, which are joined with the lexicons, and the found words come back to the block, where
the tokens are looked up and summed per post. Tokens never travel, so a frequent word costs one row
per block, and a block bounds what a task holds. A lexicon is a table read from files, so its join
with the words is a broadcast when those files are small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from postsift import fixed_values as fv
from postsift.functions import tokens as tk
from postsift.operators.vectorize import text_partitions

#: Bytes of text in one block of posts.
BLOCK_BYTES = 8 * 2**20


@dataclass
class Lexicons:
    """The word tables. Their word lists are inputs; only their columns are fixed."""

    emotion: DataFrame  # word, one DOUBLE per emotion
    vad: DataFrame  # word, valence, arousal, dominance
    category: DataFrame  # word, category
    tag: DataFrame  # word, tag
    sentiment: DataFrame  # word, valence


def explode_tokens(df: DataFrame, col: str = "post", key: str = "post_id") -> DataFrame:
    """(post_id, word), and one row with a NULL word for a post without tokens."""
    return df.select(key, F.explode_outer(tk.lexicon_tokens(F.col(col))).alias("word"))


def _is_broadcast(lexicon: DataFrame) -> bool:
    """Whether Catalyst broadcasts the table, with all its columns, by its size."""
    probe = lexicon.select("word").join(lexicon, "word", "left")
    return "BroadcastHashJoin" in probe._jdf.queryExecution().executedPlan().toString()


def _met(lexicon: DataFrame) -> DataFrame:
    """The lexicon as tokens are joined with it: tokens pass by a hash table of the lexicon and are never sorted.

    A lexicon too large for a broadcast is hashed by partition, so that a task holds its share of the
    lexicon, however many tokens there are. Adaptive execution splits the tokens of frequent words.
    """
    return lexicon if _is_broadcast(lexicon) else lexicon.hint("shuffle_hash")


def lexicon_join(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Values of each token; a word the lexicon does not have counts 0 everywhere."""
    values = [c for c in lexicon.columns if c != "word"]
    return tokens.join(_met(lexicon), "word", "left").na.fill(0.0, values)


def category_join(tokens: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per token and category it belongs to."""
    return tokens.join(_met(categories), "word")


def emotion_names() -> list[str]:
    return [f"nrc_emo_{e}_std" for e in fv.EMOTIONS]


def vad_names() -> list[str]:
    return [f"nrc_vad_{v}_{s}" for s in fv.VAD_STATISTICS for v in fv.VAD]


def category_names(categories: Sequence[str] = fv.CATEGORIES) -> list[str]:
    return [f"empath_{c}" for c in categories]


def pos_names() -> list[str]:
    return [f"{t.lower()}_ratio" for t in fv.POS_TAGS]


def psych_names(categories: Sequence[str] = fv.CATEGORIES) -> list[str]:
    return [
        *pos_names(), "sentiment_compound", *category_names(categories), *emotion_names(),
        *vad_names(),
    ]


def group_sets(table: DataFrame, group: str) -> DataFrame:
    """(word, groups): the distinct groups of each word, so that a token stays one row."""
    return table.groupBy("word").agg(F.collect_set(group).alias("groups"))


def punctuation_emphasis(text: Column) -> Column:
    """What exclamation and question marks add to the size of a post's sentiment."""
    shouts = F.least(F.regexp_count(text, F.lit("!")), F.lit(fv.EXCLAMATION_MAX)) * fv.EXCLAMATION
    asked = F.regexp_count(text, F.lit(r"\?"))
    asks = (
        F.when(asked <= 1, 0.0).when(asked <= 3, asked * fv.QUESTION).otherwise(fv.QUESTION_LIMIT)
    )
    return shouts + asks


# --- blocks of posts --------------------------------------------------------------------


def _found_words(words: DataFrame, lexicons: dict[str, DataFrame]) -> DataFrame:
    """The words that a lexicon has, with the values of all; more than one row if a lexicon has a word so often."""
    found, known = words, []
    for name, columns in (("emotion", fv.EMOTIONS), ("vad", fv.VAD)):
        if name in lexicons:
            # As in `lexicon_join`: no value is 0. The mark tells a word of the lexicon from another.
            values = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns]
            found = found.join(lexicons[name].select("word", *values, F.lit(True).alias(f"_{name}")), "word", "left")
            known.append(f"_{name}")
    lists = {
        "tag": lambda t: group_sets(t, "tag"),
        "category": lambda t: t.groupBy("word").agg(F.collect_list("category").alias("groups")),
        "sentiment": lambda t: t.groupBy("word").agg(
            F.collect_list(F.coalesce(F.col("valence").cast("double"), F.lit(float("nan")))).alias("groups")
        ),
    }
    for name, gather in lists.items():
        if name in lexicons:
            found = found.join(gather(lexicons[name]).withColumnRenamed("groups", f"_{name}"), "word", "left")
            known.append(f"_{name}")
    any_of = F.lit(False)
    for k in known:
        any_of = any_of | F.col(k).isNotNull()
    marks = [k for k in known if k in ("_emotion", "_vad")]
    return found.filter(any_of).drop(*marks).na.fill(0.0, [c for c in found.columns if c in (*fv.EMOTIONS, *fv.VAD)])


class _Tokens:
    """Tokens of the posts of a block: owner, place within the post, and the found words that they are."""

    def __init__(self, lists: pa.Array, words: pa.Array, blank: bool):
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        self.sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        self.text = pc.list_flatten(lists)
        held = np.maximum(self.sizes, 1) if blank else self.sizes  # a post without tokens has one that is no word
        self.owner = np.repeat(np.arange(len(held)), held)
        self.place = np.arange(len(self.owner)) - np.repeat(np.cumsum(held) - held, held)
        self.word = self.place < self.sizes[self.owner]
        self.code = np.full(len(self.owner), -1, np.int64)
        self.code[self.word] = np.asarray(pc.fill_null(pc.index_in(self.text, value_set=words), -1), np.int64)


def _ragged(column) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """First place, number and values of the lists of a column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    return np.cumsum(sizes) - sizes, sizes, pc.list_flatten(column)


def _spread(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list its index and the places of its values, one entry per value."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class _Block:
    """Posts of one block and the found words; rows of an equal key are one post."""

    def __init__(self, posts: pa.Table, found: pa.Table, key: str):
        keys = pc.dictionary_encode(posts.column(key).combine_chunks(), null_encoding="encode")
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        group = np.asarray(keys.indices, np.int64)
        order = np.argsort(group, kind="stable")
        self.keys, self.group, self.posts = keys.dictionary, group[order], posts.take(pa.array(order))
        self.known_key = ~np.asarray(pc.is_null(self.keys))
        words = pc.dictionary_encode(found.column("word").combine_chunks())
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        code = np.asarray(words.indices, np.int64)
        self.words, self.found = words.dictionary, found.take(pa.array(np.argsort(code, kind="stable")))
        self.rows = np.bincount(code, minlength=len(self.words))  # found rows of each word
        self.first = np.cumsum(self.rows) - self.rows
        if "words" in posts.column_names:
            self.tokens = _Tokens(self.posts.column("words"), self.words, blank=True)

    def _sums(self, groups: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(groups, values, minlength=len(self.keys))

    def _joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, found row (-1: none) and whether it is a word, of each token, once per found row of its word."""
        t = self.tokens
        often = np.where(t.code >= 0, np.append(self.rows, 0)[t.code], 1)
        at, row = _spread(np.where(t.code >= 0, np.append(self.first, 0)[t.code], -1), often)
        return self.group[t.owner[at]], row, t.word[at]

    def statistics(self, columns: Sequence[str], names: dict[str, dict[str, str]], out: dict) -> None:
        """`names` holds, per statistic, the output name of each column."""
        group, row, _ = self._joined()
        n, start = self._sums(group), np.flatnonzero(np.diff(group, prepend=-1))
        for c in columns:
            v = np.append(np.asarray(self.found.column(c).to_numpy(), float), 0.0)[row]
            mean = self._sums(group, v) / n
            if c in names.get("mean", {}):
                out[names["mean"][c]] = mean
            if c in names.get("max", {}):
                out[names["max"][c]] = np.maximum.reduceat(v, start) if len(v) else v
            if c in names.get("std", {}):
                out[names["std"][c]] = np.sqrt(self._sums(group, (v - mean[group]) ** 2) / n)

    def tags(self, values: Sequence[str], names: Sequence[str], out: dict) -> None:
        group, row, word = self._joined()
        total = np.maximum(self._sums(group[word]), 1)
        first, sizes, held = _ragged(self.found.column("_tag"))
        value = np.asarray(pc.fill_null(pc.index_in(held, value_set=pa.array(values, pa.string())), -1), np.int64)
        owner = _spread(first, sizes)[0]
        for i, name in enumerate(names):
            has = np.zeros(len(sizes) + 1, bool)
            has[owner[value == i]] = True
            out[name] = self._sums(group[has[row]]) / total

    def categories(self, values: Sequence[str], total: np.ndarray, out: dict) -> None:
        t = self.tokens
        first, sizes, held = _ragged(self.found.column("_category"))
        value = np.asarray(pc.fill_null(pc.index_in(held, value_set=pa.array(values, pa.string())), -1), np.int64)
        # All found rows of a word have the same categories.
        hit = np.flatnonzero(t.code >= 0)
        row = self.first[t.code[hit]]
        at, place = _spread(first[row], sizes[row])
        value, group = value[place], self.group[t.owner[hit[at]]]
        counts = np.bincount(group[value >= 0] * len(values) + value[value >= 0], minlength=len(self.keys) * len(values))
        shares = counts.reshape(len(self.keys), len(values)) / total[:, None]
        out.update(zip(category_names(values), shares.T))

    def sizes(self) -> np.ndarray:
        """Most tokens of a row of each key."""
        start = np.flatnonzero(np.diff(self.group, prepend=-1))
        return np.maximum.reduceat(self.tokens.sizes, start)

    def word_counts(self) -> np.ndarray:
        group, _, word = self._joined()
        return self._sums(group[word])

    def sentiment(self) -> tuple[np.ndarray, np.ndarray]:
        """Compound score of each key, and whether it has a sentiment word."""
        t = _Tokens(self.posts.column("spoken"), self.words, blank=False)
        first, sizes, valence = _ragged(self.found.column("_sentiment"))
        row = np.append(self.first, len(sizes))[t.code]
        first, sizes = np.append(first, 0), np.append(sizes, 0)
        known = sizes[row]
        boost = np.zeros(len(t.owner))
        for words, value in ((fv.BOOSTERS_DOWN, -fv.BOOST), (fv.BOOSTERS_UP, fv.BOOST)):
            boost[np.asarray(pc.is_in(t.text, value_set=pa.array(words, pa.string())), bool)] = value
        negation = np.asarray(pc.is_in(t.text, value_set=pa.array(fv.NEGATIONS, pa.string())), bool)
        hit = np.flatnonzero(known)
        of, place = _spread(first[row[hit]], known[hit])
        at, v = hit[of], np.asarray(valence, float)[place]
        score, often = v.copy(), np.ones(len(at))
        for i, damping in zip((1, 2, 3), fv.DISTANCE_DAMPING):
            there = t.place[at] >= i
            before = np.where(there, at - i, 0)
            active = there & (known[before] == 0)
            lifted = score + boost[before] * damping * np.where(v < 0, -1.0, 1.0)
            score = np.where(active, lifted * np.where(negation[before], fv.NEGATION_FACTOR, 1.0), score)
            often *= np.where(there, np.maximum(known[before], 1), 1)
        but, here = np.asarray(pc.fill_null(self.posts.column("but"), 0), np.int64)[t.owner[at]], t.place[at] + 1
        score *= np.where((but > 0) & (here < but), fv.BUT_BEFORE, np.where((but > 0) & (here > but), fv.BUT_AFTER, 1.0))
        group, counts = self.group[t.owner[at]], ~np.isnan(v)
        s = self._sums(group[counts], (score * often)[counts])
        emphasis = np.zeros(len(self.keys))
        np.maximum.at(emphasis, group, np.asarray(pc.fill_null(self.posts.column("emphasis"), 0.0), float)[t.owner[at]])
        total = s + np.sign(s) * emphasis
        return total / np.sqrt(total * total + fv.SENTIMENT_ALPHA), self._sums(group) > 0


def _by_block(df: DataFrame, lexicons: dict[str, DataFrame], make, names: Sequence[str], col: str, key: str) -> DataFrame:
    """(key, *names): make(block, out) fills in the values of the posts of a block."""
    n = text_partitions(df, col, size=BLOCK_BYTES)
    block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("_block")
    texts = df.select(block, key, F.col(col).alias("_text")).repartition(n, "_block")
    arrays = {}
    if set(lexicons) - {"sentiment"}:
        arrays["words"] = tk.lexicon_tokens(F.col("_text"))
    if "sentiment" in lexicons:
        arrays["spoken"] = tk.sentiment_tokens(F.col("_text"))
    words = texts.select(F.col("_block").alias("_home"), F.explode(F.concat(*arrays.values())).alias("word")).distinct()
    found = _found_words(words, lexicons).repartition(n, "_home")
    posts = texts.select("_block", key, "_text", *[v.alias(k) for k, v in arrays.items()])
    if "spoken" in arrays:
        posts = posts.select(
            "*", F.array_position("spoken", "but").alias("but"), punctuation_emphasis(F.col("_text")).alias("emphasis")
        )

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: dict[str, np.ndarray] = {}
        whole = _Block(mine, theirs, key)
        picked = make(whole, out)
        table = pa.table([whole.keys, *[pa.array(out[c], pa.float64()) for c in names]], names=[key, *names])
        return table if picked is None else table.filter(pa.array(picked))

    schema = StructType([df.select(key).schema[0], *[StructField(c, DoubleType()) for c in names]])
    return posts.drop("_text").groupBy("_block").cogroup(found.groupBy("_home")).applyInArrow(run, schema)


_EMOTION = {"std": dict(zip(fv.EMOTIONS, emotion_names()))}
_VAD = {s: {v: f"nrc_vad_{v}_{s}" for v in fv.VAD} for s in fv.VAD_STATISTICS}


def _statistics(
    df: DataFrame, lexicon: DataFrame, part: str, columns: Sequence[str], names: dict[str, dict[str, str]],
    col: str, key: str,
) -> DataFrame:
    """A lexicon that is broadcast meets the tokens where they are; a larger one meets the words of blocks."""
    if _is_broadcast(lexicon):
        how = {"mean": F.avg, "max": F.max, "std": F.stddev_pop}
        picks = [how[s](c).alias(n) for s, of in names.items() for c, n in of.items()]
        return lexicon_join(explode_tokens(df, col, key), lexicon).groupBy(key).agg(*picks)
    order = [n for of in names.values() for n in of.values()]
    return _by_block(df, {part: lexicon}, lambda block, out: block.statistics(columns, names, out), order, col, key)


def emotion_features(
    df: DataFrame, lexicon: DataFrame, col: str = "post", key: str = "post_id"
) -> DataFrame:
    """Population deviation of each emotion over all tokens; zeros without tokens."""
    return _statistics(df, lexicon, "emotion", fv.EMOTIONS, _EMOTION, col, key)


def vad_features(
    df: DataFrame, lexicon: DataFrame, col: str = "post", key: str = "post_id"
) -> DataFrame:
    """Mean, maximum and population deviation of valence, arousal and dominance."""
    return _statistics(df, lexicon, "vad", fv.VAD, _VAD, col, key)


def category_features(
    df: DataFrame, categories: DataFrame, col: str = "post", key: str = "post_id",
    names: Sequence[str] = fv.CATEGORIES,
) -> DataFrame:
    """Share of a post's tokens in each category; a word may belong to several."""
    names = list(names)

    def make(block: _Block, out: dict) -> None:
        block.categories(names, np.maximum(block.sizes(), 1), out)

    return _by_block(df, {"category": categories}, make, category_names(names), col, key)


def pos_ratio_features(
    df: DataFrame, tags: DataFrame, col: str = "post", key: str = "post_id"
) -> DataFrame:
    """Share of a post's tokens in each word class, by a word -> tag table."""
    return _by_block(df, {"tag": tags}, lambda block, out: block.tags(fv.POS_TAGS, pos_names(), out), pos_names(), col, key)


# --- sentiment ------------------------------------------------------------------------


def _sentiment_words(df: DataFrame, valence: DataFrame, col: str, key: str) -> DataFrame:
    """(post_id, sentiment_compound) of the posts that hold a sentiment word.

    A word's valence is raised or damped by intensifiers and turned by negations among the three
    words before it, halved before and raised after a "but"; S / sqrt(S^2 + 15) closes the sum.
    """

    def make(block: _Block, out: dict) -> np.ndarray:
        out["sentiment_compound"], has = block.sentiment()
        return has

    return _by_block(df, {"sentiment": valence}, make, ["sentiment_compound"], col, key)


def sentiment_compound(
    df: DataFrame, valence: DataFrame, col: str = "post", key: str = "post_id"
) -> DataFrame:
    """(post_id, sentiment_compound) in [-1, 1], 0 for a post without a sentiment word."""
    scored = _sentiment_words(df, valence, col, key)
    return df.select(key).join(scored, key, "left").na.fill(0.0, ["sentiment_compound"])


# --- all 99 ----------------------------------------------------------------------------


def psych_features(
    df: DataFrame, lexicons: Lexicons, col: str = "post", key: str = "post_id",
    categories: Sequence[str] = fv.CATEGORIES,
) -> DataFrame:
    """7 word-class, 1 sentiment, 72 category, 10 emotion and 9 valence columns per post."""
    categories = list(categories)

    def make(block: _Block, out: dict) -> None:
        block.statistics(fv.EMOTIONS, _EMOTION, out)
        block.statistics(fv.VAD, _VAD, out)
        block.tags(fv.POS_TAGS, pos_names(), out)
        block.categories(categories, np.maximum(block.word_counts(), 1), out)
        out["sentiment_compound"] = block.sentiment()[0]
        # Categories and sentiment belong to a key; rows without one have none.
        for name in ("sentiment_compound", *category_names(categories)):
            out[name] = np.where(block.known_key, out[name], 0.0)

    parts = {p: getattr(lexicons, p) for p in ("emotion", "vad", "category", "tag", "sentiment")}
    return _by_block(df, parts, make, psych_names(categories), col, key)
