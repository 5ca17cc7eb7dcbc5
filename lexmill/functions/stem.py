"""English stems by the published Porter2 rules, as column expressions.

Stemming is meant for a vocabulary, not for a text: :func:`stem_words` runs on
distinct words and :func:`stem_features` joins the stems back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.joins import Lookup
from lexmill.storage import materialize, place

# Fixed values of the algorithm's definition.
VOWEL = "[aeiouy]"
OTHER = "[^aeiouy]"
REGION_PREFIXES = ["gener", "commun", "arsen"]
IRREGULAR = {
    "skis": "ski",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "idly": "idl",
    "gently": "gentl",
    "ugly": "ugli",
    "early": "earli",
    "only": "onli",
    "singly": "singl",
    "sky": "sky",
    "news": "news",
    "howe": "howe",
    "atlas": "atlas",
    "cosmos": "cosmos",
    "bias": "bias",
    "andes": "andes",
}
KEPT_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEP2 = {
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "abli": "able",
    "entli": "ent",
    "izer": "ize",
    "ization": "ize",
    "ational": "ate",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "aliti": "al",
    "alli": "al",
    "fulness": "ful",
    "ousli": "ous",
    "ousness": "ous",
    "iveness": "ive",
    "iviti": "ive",
    "biliti": "ble",
    "bli": "ble",
    "ogi": "og",
    "fulli": "ful",
    "lessli": "less",
    "li": "",
}
STEP3 = {
    "tional": "tion",
    "ational": "ate",
    "alize": "al",
    "icate": "ic",
    "iciti": "ic",
    "ical": "ic",
    "ful": "",
    "ness": "",
    "ative": "",
}
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
]
SHORT_END = rf"({OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"


def _suffix(word: Column, suffixes) -> Column:
    """The longest of the suffixes the word ends in, or an empty string.

    The leftmost match of an alternation anchored at the end is the longest.
    """
    return F.regexp_extract(word, f"({'|'.join(suffixes)})$", 1)


def _cut(word: Column, count: Column | int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - count)


def _region(word: Column, start: Column) -> Column:
    """Where the part after the first consonant following a vowel begins, at or behind ``start``."""
    head = F.regexp_extract(F.substring(word, start + 1, F.length(word)), f"^.*?{VOWEL}{OTHER}", 0)
    return F.when(head != "", start + F.length(head)).otherwise(F.length(word))


def stem_words(words: DataFrame, word: str = "feature") -> DataFrame:
    """``words`` with a column ``stem`` for the lower-case word in ``word``."""
    w = F.col("_w")

    def step(df: DataFrame, suffix: Column, new: Column) -> DataFrame:
        return df.withColumn("_s", suffix).withColumn("_w", new)

    s = F.col("_s")
    begins = F.length(w) - F.length(s)

    # consonant y is marked Y
    df = words.withColumn("_w", F.regexp_replace(word, "^'", ""))
    df = df.withColumn("_w", F.regexp_replace(F.regexp_replace(w, "^y", "Y"), f"({VOWEL})y", "$1Y"))
    prefix = F.regexp_extract(w, f"^({'|'.join(REGION_PREFIXES)})", 1)
    df = df.withColumn("_r1", F.when(prefix != "", F.length(prefix)).otherwise(_region(w, F.lit(0))))
    df = df.withColumn("_r2", _region(w, F.col("_r1")))
    in_r1, in_r2 = begins >= F.col("_r1"), begins >= F.col("_r2")

    df = df.withColumn("_w", F.regexp_replace(w, "('s'|'s|')$", ""))
    # plurals
    df = step(
        df,
        _suffix(w, ["sses", "ied", "ies", "us", "ss", "s"]),
        F.when(s == "sses", _cut(w, 2))
        .when(s.isin("ied", "ies"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
        .when((s == "s") & w.rlike(f"{VOWEL}.+s$"), _cut(w, 1))
        .otherwise(w),
    )
    df = df.withColumn("_kept", F.when(w.isin(KEPT_AFTER_PLURAL), w))

    # -ed and -ing
    df = step(
        df,
        _suffix(w, ["eedly", "ingly", "edly", "eed", "ing", "ed"]),
        F.when(s.isin("eed", "eedly"), F.when(in_r1, F.concat(_cut(w, F.length(s)), F.lit("ee"))).otherwise(w))
        .when(s != "", F.when(_cut(w, F.length(s)).rlike(VOWEL), F.concat(_cut(w, F.length(s)), F.lit("\u0001"))).otherwise(w))
        .otherwise(w),
    )
    # the mark stands for a suffix just cut off
    bare = F.regexp_replace(w, "\u0001$", "")
    df = df.withColumn(
        "_w",
        F.when(~w.endswith("\u0001"), w)
        .when(bare.rlike("(at|bl|iz)$"), F.concat(bare, F.lit("e")))
        .when(bare.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(bare, 1))
        .when((F.length(bare) <= F.col("_r1")) & bare.rlike(SHORT_END), F.concat(bare, F.lit("e")))
        .otherwise(bare),
    )
    df = df.withColumn("_w", F.regexp_replace(w, f"^(.+{OTHER})[yY]$", "$1i"))

    def swap(table: dict[str, str]) -> Column:
        new = w
        for suffix, other in table.items():
            new = F.when(s == suffix, F.concat(_cut(w, len(suffix)), F.lit(other))).otherwise(new)
        return new

    allowed = F.when(s == "ogi", w.endswith("logi")).when(s == "li", w.rlike("[cdeghkmnrt]li$")).otherwise(F.lit(True))
    df = step(df, _suffix(w, STEP2), F.when(in_r1 & allowed, swap(STEP2)).otherwise(w))
    allowed = (s != "ative") | in_r2
    df = step(df, _suffix(w, STEP3), F.when(in_r1 & allowed, swap(STEP3)).otherwise(w))
    allowed = (s != "ion") | w.rlike("[st]ion$")
    df = step(df, _suffix(w, STEP4), F.when((s != "") & in_r2 & allowed, _cut(w, F.length(s))).otherwise(w))
    final_e = in_r2 | (in_r1 & ~_cut(w, 1).rlike(SHORT_END))
    df = step(
        df,
        _suffix(w, ["e", "l"]),
        F.when((s == "e") & final_e, _cut(w, 1)).when((s == "l") & in_r2 & w.endswith("ll"), _cut(w, 1)).otherwise(w),
    )
    irregular = F.create_map(*[F.lit(v) for pair in IRREGULAR.items() for v in pair])
    stem = (
        F.when(F.length(word) <= 2, F.col(word))
        .when(F.col(word).isin(list(IRREGULAR)), F.element_at(irregular, F.col(word)))
        .when(F.col("_kept").isNotNull(), F.col("_kept"))
        .otherwise(F.translate(w, "Y", "y"))
    )
    return df.withColumn("stem", stem).drop("_w", "_s", "_r1", "_r2", "_kept")


def stem_features(x: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A word-count table with words replaced by their stems and counts added up."""
    # read twice: for its words, and to replace them
    x = materialize(x, "to_stem")
    words = x.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))
    stems = Lookup.build(stem_words(place(words, ["feature"])), ["feature"], "rows", 4, "stems")
    stemmed = stems.join(x).withColumn("feature", F.col("stem"))
    rest = [c for c in x.columns if c not in ("feature", "value")]
    return stemmed.groupBy(*rest, "feature").agg(F.sum("value").alias("value"))
