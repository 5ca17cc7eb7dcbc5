"""Tokens, word filters and bags of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.entities import decode_references
from lexmill.storage import materialize, place

# Letters, numbers and underscore of every script (a plain \w is ASCII in Java).
WORD = r"[\p{L}\p{N}_]+"
NUMERIC = r"^\p{N}+$"

# Texts that a Python tokenizer cuts before it hands over their words: so many characters and so many rows at most.
SLICE_CHARS = 1 << 20
SLICE_ROWS = 4096
# A task forgets what a word function returned when it knows this many words.
KNOWN_WORDS = 100_000

# A stop-word list of at most this size is broadcast; a list for people has hundreds of words.
BROADCAST_STOP_BYTES = 32 << 20

# Entities decoded by plain replacement; &amp; has to come last,
# or "&amp;lt;" would be decoded twice.
NAMED_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
]


def decode_entities(text: Column) -> Column:
    """Decode the XML entities and ``&nbsp;`` only."""
    for entity, char in NAMED_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def tokenize(text: Column) -> Column:
    """All words of a text, in order, as an array."""
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def python_tokenizer(tokenizer) -> Callable[[Column], Column]:
    """Make a column function of an object with ``tokenize(text) -> list``.

    A worker holds the words of about SLICE_CHARS characters at a time, however
    many texts Spark hands over at once.
    """

    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in _slices(batch):
                words = [None if s is None else list(tokenizer.tokenize(s)) for s in part.to_pylist()]
                yield _strings(words, lambda ws: ws and [None if w is None else str(w) for w in ws], pa.list_(pa.string()))

    split = F.arrow_udf(split, T.ArrayType(T.StringType()))
    return lambda text: split(text)


def python_preprocess(function: Callable[[str], str]) -> Callable[[Column], Column]:
    """Make a column function of a Python ``word -> word`` function, which sees a task's words about once each."""

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, str | None] = {}
        for batch in batches:
            words = batch.dictionary_encode()
            distinct = words.dictionary.to_pylist()
            if len(known) > KNOWN_WORDS:
                known.clear()
            for w in distinct:
                if w not in known:
                    known[w] = function(w)
            new = [known[w] for w in distinct]
            yield _strings(new, str, pa.string()).take(words.indices)

    apply = F.arrow_udf(apply, T.StringType())
    return lambda word: apply(word)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices that end where they have SLICE_CHARS characters."""
    start, size = 0, 0
    for n, length in enumerate(pc.utf8_length(texts).to_pylist()):
        size += length or 0
        if size >= SLICE_CHARS or n + 1 - start >= SLICE_ROWS:
            yield texts.slice(start, n + 1 - start)
            start, size = n + 1, 0
    if start < len(texts) or not len(texts):
        yield texts.slice(start)


def _strings(values: list, text: Callable, kind: pa.DataType) -> pa.Array:
    """An Arrow array; what a user's function returned instead of strings becomes text."""
    try:
        return pa.array(values, kind)
    except (pa.ArrowTypeError, pa.ArrowInvalid):
        return pa.array([None if v is None else text(v) for v in values], kind)


def is_word(token: Column, low: Column | None = None) -> Column:
    """Whether a token has several characters in lower case (``low``, if it is not so yet) and is not a number."""
    # a token that begins with an ASCII letter or underscore is no number;
    # comparing bytes spares most tokens the pattern
    plain = (token >= "A") & (token < "{")
    if low is None:
        return (F.length(token) > 1) & (plain | ~token.rlike(NUMERIC))
    # lower case is never shorter, and a single character may become two
    return ((F.length(token) > 1) | (F.length(low) > 1)) & (plain | ~low.rlike(NUMERIC))


def normalize(word: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-case a word; empty if it is one character, numeric or a stop word."""
    low = F.lower(word)
    keep = is_word(low)
    if stop_words:
        keep = keep & ~low.isin(list(stop_words))
    return F.when(keep, low).otherwise(F.lit(""))


def default_stop_words(language: str = "english") -> list[str]:
    """Spark's own stop-word list of a language; needs a running session."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords(language)


def drop_stop_words(tokens: DataFrame, stop_words: DataFrame, word: str = "feature") -> DataFrame:
    """Rows whose word is not in the one-column stop-word table.

    The list is read once and stored; one too large to broadcast is joined by a
    shuffle, in which Spark splits the partitions of frequent words.
    """
    stop = materialize(stop_words.select(F.col(stop_words.columns[0]).alias(word)).distinct(), "stop_words")
    size = stop.agg(F.coalesce(F.sum(F.octet_length(word) + 40), F.lit(0))).first()[0]
    return tokens.join(F.broadcast(stop) if size <= BROADCAST_STOP_BYTES else stop, word, "left_anti")


def tokens(
    docs: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    keep: Sequence[str] = (),
    tokenizer: Callable[[Column], Column] | None = None,
    preprocess: Callable[[Column], Column] | None = None,
    decode: bool = False,
) -> DataFrame:
    """One row per word occurrence: ``keys, keep, feature``; empty words dropped."""
    body = F.col(text)
    if decode:
        body = decode_references(body)
    words = docs.select(*keys, *keep, F.explode((tokenizer or tokenize)(body)).alias("_w"))
    if preprocess is None:
        # normalize() as a filter, on the word as it is: a filter would put it in lower case for each comparison
        return words.filter(is_word(F.col("_w"), F.lower("_w"))).select(*keys, *keep, F.lower("_w").alias("feature"))
    words = words.select(*keys, *keep, preprocess(F.col("_w")).alias("feature"))
    return words.filter(F.length("feature") > 0)


def bag_of_words(
    docs: DataFrame, keys: Sequence[str] = ("doc_id",), placed: bool = False, **how
) -> DataFrame:
    """Word counts ``keys, keep, feature, value`` (arguments as in :func:`tokens`).

    Documents are placed by key before they are cut into words. The text is a
    fraction of the size of its word rows, so this one shuffle is cheaper than
    grouping the words across the cluster, and every later step that works per
    document (counting, lengths, joining labels, adding up scores) finds its
    rows in place and needs no further exchange. ``placed`` says that the
    documents are partitioned by key already.
    """
    keep = list(how.get("keep", ()))
    docs = docs if placed else place(docs, keys)
    preprocess = how.pop("preprocess", None)
    if preprocess is None:
        return count_words(tokens(docs, keys, **how), [*keys, *keep])
    return preprocessed(docs, [*keys, *keep], preprocess, **how)


def preprocessed(docs: DataFrame, by: Sequence[str], preprocess: Callable[[Column], Column], text: str = "text", keep: Sequence[str] = (), **how) -> DataFrame:
    """Word counts after a word -> word function, which sees the distinct words of a document.

    Words are counted as they are first; empty results drop a word. Counts stay where
    the document is: a table of all distinct words would have to be joined to them.
    """
    cut = (how.get("tokenizer") or tokenize)(decode_references(F.col(text)) if how.get("decode") else F.col(text))
    raw = count_words(docs.select(*by, F.explode(cut).alias("feature")), by)
    # no plain filter, which Spark would move below the count together with the function
    kept = F.filter(F.array(preprocess(F.col("feature"))), lambda w: F.length(w) > 0)
    new = raw.select(*by, "value", F.explode(kept).alias("feature"))
    return new.groupBy(*by, "feature").agg(F.sum("value").alias("value"))


def count_words(words: DataFrame, by: Sequence[str]) -> DataFrame:
    return words.groupBy(*by, "feature").agg(F.count(F.lit(1)).cast("double").alias("value"))
