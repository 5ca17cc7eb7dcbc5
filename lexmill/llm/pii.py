"""Personal data by candidate gradient boosting, in DataFrame operations only.

Exact patterns give the base spans. High-recall generators propose further,
overlapping spans of looser form; format and context features of each candidate
are small integers. Within a run of numbers that no exact card pattern takes, every
stretch of 13 to 19 digits is a candidate, and in a run of dotted numbers every four
neighbours. The label of a candidate is whether an exact rule confirms it (checksum, value range, strict form), which the features do not show. Counts
of confirmed and refused candidates per feature combination cover all documents;
there are at most a few ten thousand combinations, whatever the input. Boosted
trees are fitted on these counts and score every combination; a candidate looks
up whether its own is selected. Half of the
documents fit the trees; the other half calibrates per kind the score from which
the wanted share of candidates is confirmed. Candidates from that score on are
added where no base span lies.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.rows import only, remainder
from lexmill.llm.spans import matches, no_spans

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 24

_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"
# Equal to the plain patterns, but each run of characters is tried once: a match can begin
# only at the start of a run or where the last match ended.
_RUN_START = rf"(?:\G|(?<!{_LOCAL}))"
EMAIL = rf"{_RUN_START}{_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# What the generators look for, beside the patterns of ip and card with any value.
LOOSE_EMAIL = rf"{_RUN_START}{_LOCAL}++\x20?(?:@|[(\[]at[)\]])\x20?{_HOST}++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?{_HOST}++)++"
DOTTED = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+"
SOME_CARD = r"[0-9](?:[\x20-]?[0-9]){11}"
LOOSE_PHONE = r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check sum of a string of digits is a multiple of ten."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(number, F.length(number) - i, F.lit(1)).cast("int")
        double = 2 * digit - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def card_number(found: Column) -> Column:
    return _let(digits(found), lambda number: F.when(F.length(number).between(13, 19), luhn(number)).otherwise(F.lit(False)))


def small_parts(found: Column) -> Column:
    """All dotted numbers are at most 255, whatever their leading zeros."""
    return F.forall(F.split(found, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.substr(F.concat(F.lit("000"), p), F.length(p) + 1, F.lit(3)).cast("int") <= 255))


def phone_number(found: Column) -> Column:
    return F.length(digits(found)).between(9, 15)


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (start, end, found) by kind."""
    always = lambda found: F.lit(True)
    return {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL, always)).otherwise(no_spans()),
        "ip": matches(text, IP, small_parts),
        "card": F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), matches(text, CARD, card_number)).otherwise(no_spans()),
        "phone": F.when(F.contains(text, F.lit("+")), matches(text, PHONE, phone_number)).otherwise(no_spans()),
    }


def _with_sides(text: Column, spans: Column) -> Column:
    """Spans with the CONTEXT characters before them and the one behind them."""
    near = lambda s: F.substr(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), near(s).alias("near"), F.substr(text, s["end"] + 1, F.lit(1)).alias("after")
    ))


def _within(text: Column, runs: Column, mark: str, windows: Callable[[Column, Column], list[tuple[Column, Column, Column]]]) -> Column:
    """For each run an array of spans within it, with their sides.

    ``windows(marks, size)`` gives, from the places in the run of characters that
    match ``mark`` and its size, (number of spans, start of the i-th, its end).
    All is cut from one array of characters per run, so no span costs more for
    standing far behind in a text.
    """
    lead = lambda r: F.least(r["start"], F.lit(CONTEXT))
    cut = F.transform(runs, lambda r: F.struct(
        r["start"].alias("start"), lead(r).alias("lead"), F.length(r["found"]).alias("size"),
        F.regexp_extract_all(F.substr(text, r["start"] - lead(r) + 1, lead(r) + F.length(r["found"]) + 1), F.lit("(?s)."), F.lit(0)).alias("chars"),
    ))
    places = lambda t: F.filter(F.transform(F.slice(t["chars"], t["lead"] + 1, t["size"]), lambda c, i: F.when(c.rlike(mark), i)), lambda i: i.isNotNull())
    cut = F.transform(cut, lambda t: F.struct(t["start"].alias("start"), t["lead"].alias("lead"), t["size"].alias("size"), t["chars"].alias("chars"), places(t).alias("marks")))
    text_of = lambda t, start, end: F.array_join(F.slice(t["chars"], start + 1, end - start), "")

    def span(t: Column, start: Column, end: Column) -> Column:
        first, last = t["lead"] + start, t["lead"] + end
        return F.struct(
            (t["start"] + start).alias("start"), (t["start"] + end).alias("end"), text_of(t, first, last).alias("found"),
            text_of(t, F.greatest(first - CONTEXT, F.lit(0)), first).alias("near"), F.coalesce(F.get(t["chars"], last), F.lit("")).alias("after"),
        )

    def counted(t: Column, n: Column, start: Callable[[Column], Column], end: Callable[[Column], Column]) -> Column:
        every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(every, lambda i: span(t, start(i), end(i)))

    inside = lambda t: F.concat(*[counted(t, *w) for w in windows(t["marks"], t["size"])])
    return F.transform(cut, inside)


def _ip_windows(marks: Column, size: Column) -> list[tuple]:
    """Every four neighbouring numbers; the marks are the dots."""
    return [(F.size(marks) - 2, lambda i: F.when(i > 0, F.get(marks, i - 1) + 1).otherwise(0), lambda i: F.coalesce(F.get(marks, i + 3), size))]


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


# Card-like stretches of a run of numbers are looked for piece by piece, by the digit they begin with.
# Pieces are cut from chunks, since cutting counts characters from the beginning.
CHUNK, PIECE = 8192, 96
LENGTHS = range(13, 20)
# Characters of 20 digits with a mark between each two: fewer than a piece has, so stretches overlap only with those of the next ones.
LONGEST = 39


def refused_run(found: Column) -> Column:
    """A run of numbers of 14 digits or more that is no card as a whole."""
    return (F.length(digits(found)) >= 14) & ~card_number(found)


def run_pieces(text: Column) -> Column:
    """Pieces (run, at, text, lo, hi, stop, n) of all refused runs of numbers in a text, in order.

    ``text`` begins at ``at`` in the whole text, has the characters from ``lo`` to
    ``hi`` that a stretch may begin with, CONTEXT characters before them and what
    the longest stretch takes behind them; the run begins at ``run``, ends at
    ``stop`` in the piece and has ``n`` digits. So no stretch costs more in a long run.
    """

    def cut(of: Column, size: int) -> Column:
        """Parts of ``of`` (run, at, text, lo, hi, stop, n) by ``size`` characters to begin with."""

        def part(begin: Column) -> Column:
            first = F.greatest(begin - CONTEXT, F.lit(0))
            return F.struct(
                of["run"].alias("run"), (of["at"] + first).alias("at"), F.substr(of["text"], first + 1, begin - first + size + LONGEST + 1).alias("text"),
                (begin - first).alias("lo"), (F.least(begin + size, of["hi"]) - first).alias("hi"), (of["stop"] - first).alias("stop"), of["n"].alias("n"),
            )

        return F.transform(F.sequence(of["lo"], of["hi"] - 1, F.lit(size)), part)

    def whole(r: Column) -> Column:
        start, stop, n = r["start"], r["end"], F.length(digits(r["found"]))
        return F.struct(start.alias("run"), F.lit(0).alias("at"), text.alias("text"), start.alias("lo"), stop.alias("hi"), stop.alias("stop"), n.alias("n"))

    chunks = F.flatten(F.transform(matches(text, CARD, refused_run), lambda r: _let(whole(r), lambda of: cut(of, CHUNK))))
    return F.flatten(F.transform(chunks, lambda chunk: cut(chunk, PIECE)))


def _luhn_sums(numbers: Column) -> Column:
    """Running sums (even, odd) of digits, of which those at even or odd places are doubled as in the check sum."""

    def add(acc: Column, digit: Column) -> Column:
        double = 2 * digit - F.when(digit > 4, 9).otherwise(0)
        even = F.size(acc["even"]) % 2 == 1
        more = lambda name, doubled: F.concat(acc[name], F.array(F.element_at(acc[name], -1) + F.when(doubled, double).otherwise(digit))).alias(name)
        return F.struct(more("even", even), more("odd", ~even))

    zero = F.array(F.lit(0))
    return F.aggregate(numbers, F.struct(zero.alias("even"), zero.alias("odd")), add)


def described(piece: Column) -> Column:
    """A piece's ``chars``; of its digits ``marks``, the places in them; ``breaks``, the marks between them so far; ``ends``, and for those to begin with ``begins``: what they add to the number of features; and ``sums``."""
    is_digit = lambda c: (c >= "0") & (c <= "9")
    places = lambda chars: F.filter(
        F.transform(chars, lambda c, i: F.when((i >= piece["lo"]) & (i < piece["stop"]) & is_digit(c), i)), lambda i: i.isNotNull()
    )

    # most neighbours are digits and blanks, which need no pattern
    side = lambda c: F.when(is_digit(c), 2).when(c == " ", 0).otherwise(_side(c))

    def begin(chars: Column, q: Column) -> Column:
        before = F.when(q > 0, F.get(chars, q - 1)).otherwise("")
        # further on in the run there are no words before a stretch
        near = F.array_join(F.slice(chars, F.greatest(q - CONTEXT, F.lit(0)) + 1, F.least(q, F.lit(CONTEXT))), "")
        words = F.when(piece["at"] + q - piece["run"] < CONTEXT, _words(F.lower(near))).otherwise(0)
        return _number(first=F.when(F.get(chars, q).between("3", "6"), 1).otherwise(2), left=side(before), words=words)

    def known(cut: Column) -> Column:
        chars, marks = cut["chars"], cut["marks"]
        return F.struct(
            chars.alias("chars"), marks.alias("marks"), F.transform(marks, lambda q, i: q - i).alias("breaks"),
            F.transform(F.filter(marks, lambda q: q < piece["hi"]), lambda q: begin(chars, q)).alias("begins"),
            F.transform(marks, lambda q: _number(right=side(F.coalesce(F.get(chars, q + 1), F.lit(""))))).alias("ends"),
            _luhn_sums(F.transform(marks, lambda q: F.get(chars, q).cast("int"))).alias("sums"),
        )

    chars = F.regexp_extract_all(piece["text"], F.lit("(?s)."), F.lit(0))
    return _let(chars, lambda chars: _let(F.struct(chars.alias("chars"), places(chars).alias("marks")), known))


def _size(k: int) -> int:
    """The feature ``size`` of k digits."""
    return 6 if k <= 15 else 7 if k == 16 else 8 if k <= 19 else 9


def window_codes(docs: DataFrame, text: Column) -> DataFrame:
    """``half, code`` of all stretches of 13 to 19 digits within refused runs, and of whole runs of 20.

    A code is twice the number of the features, and one more if the check sum is
    right. Pieces become rows before stretches do, so the stretches of a text are
    never gathered, and a row has no more than the longest stretch needs.
    """
    pieces = docs.filter(text.rlike(SOME_CARD)).select("half", F.explode(run_pieces(text)).alias("p"))
    known = pieces.select("half", F.col("p.n").alias("n"), described(F.col("p")).alias("known")).select("half", "n", "known.*")
    starts = known.select("half", "n", "breaks", "ends", "sums", F.posexplode("begins").alias("i", "begin"))
    near = lambda c, n: F.slice(c, F.col("i") + 1, F.lit(n))
    # of even and odd places as seen from the first digit
    sums = [F.when(F.col("i") % 2 == k, near("sums.even", 21)).otherwise(near("sums.odd", 21)).alias(c) for k, c in enumerate(("even", "odd"))]
    starts = starts.select("half", "n", "begin", near("breaks", 20).alias("breaks"), near("ends", 20).alias("ends"), *sums)
    lengths = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(_size(k)).alias("size")) for k in [*LENGTHS, 20]])
    one = starts.withColumn("w", F.explode(lengths)).filter("size(breaks) >= w.k and (w.k < 20 or n = 20)")
    breaks = F.least(F.get("breaks", F.col("w.k") - 1) - F.get("breaks", F.lit(0)), F.lit(4))
    number = _number(size=F.col("w.size"), breaks=breaks) + F.col("begin") + F.get("ends", F.col("w.k") - 1)
    of = lambda c: F.get(c, F.col("w.k")) - F.get(c, F.lit(0))
    good = (F.col("w.k") < 20) & (F.when(F.col("w.k") % 2 == 0, of("even")).otherwise(of("odd")) % 10 == 0)
    return one.select("half", (2 * number + good.cast("int")).alias("code"))


def _window_number(known: Column, i: Column, k: int) -> Column:
    """The number of the features of the k digits from the i-th on; null if there are fewer."""
    e = i + (k - 1)
    breaks = F.least(F.get(known["breaks"], e) - F.get(known["breaks"], i), F.lit(4))
    return _number(size=F.lit(_size(k)), breaks=breaks) + F.get(known["begins"], i) + F.get(known["ends"], e)


def _window_spans(text: Column, keys: Iterable[int] | None) -> Column:
    """Per piece the stretches of digits whose feature numbers are among ``keys`` (all of them for None), with their sides, in order."""
    keys = None if keys is None else list(keys)
    # what a wanted stretch can begin with
    begins = None if keys is None else {key % 180 - key // 5 % 3 * 5 for key in keys}
    among = lambda value, wanted, size: F.lit(True) if wanted is None else _among(value, wanted, size)

    def spans(piece: Column, known: Column) -> Column:
        def span(i: Column, k: int) -> Column:
            first, last = F.get(known["marks"], i), F.get(known["marks"], i + (k - 1)) + 1
            of = lambda start, end: F.array_join(F.slice(known["chars"], start + 1, end - start), "")
            made = F.struct(
                (piece["at"] + first).alias("start"), (piece["at"] + last).alias("end"), of(first, last).alias("found"),
                of(F.greatest(first - CONTEXT, F.lit(0)), first).alias("near"), F.coalesce(F.get(known["chars"], last), F.lit("")).alias("after"),
            )
            number = _window_number(known, i, k)
            wanted = number.isNotNull() & among(number, keys, COMBINATIONS)
            return F.when(wanted & (piece["n"] == 20) if k == 20 else wanted, made)

        each = lambda begin, i: F.when(among(begin, begins, 180), F.array_compact(F.array(*[span(i, k) for k in [*LENGTHS, 20]])))
        return F.flatten(F.filter(F.transform(known["begins"], each), lambda found: found.isNotNull()))

    return F.transform(run_pieces(text), lambda p: _let(described(p), lambda known: spans(p, known)))


def _confirmed_first(pieces: Column) -> Column:
    """Of overlapping cards those with a right check sum that cut no group of digits, else with a right check sum, if there are any.

    Cards are given piece by piece and overlap only with those of the pieces beside theirs.
    """
    cuts = lambda s: s["near"].rlike("[0-9]$") | s["after"].rlike("^[0-9]")
    rank = lambda s: F.when(~card_number(s["found"]), 0).when(cuts(s), 1).otherwise(2)
    ranked = F.transform(pieces, lambda cards: F.transform(cards, lambda s: F.struct(rank(s).alias("rank"), s.alias("span"))))
    beside = lambda every, j: F.filter(F.flatten(F.slice(every, F.greatest(j, F.lit(1)), F.when(j > 0, 3).otherwise(2))), lambda c: c["rank"] > 0)
    beaten = lambda s, others: F.exists(others, lambda c: (c["rank"] > s["rank"]) & _overlaps(c["span"], s["span"]))
    settled = lambda cards, others: F.transform(F.filter(cards, lambda s: ~beaten(s, others)), lambda s: s["span"])
    some = lambda every, cards, j: F.when(F.size(cards) > 0, _let(beside(every, j), lambda others: settled(cards, others)))
    kept = _let(ranked, lambda every: F.transform(every, lambda cards, j: some(every, cards, j)))
    return F.flatten(F.filter(kept, lambda cards: cards.isNotNull()))


def generated_spans(
    text: Column, base: dict[str, Column], keep: Callable[[str], Callable[[Column], Column]] | None = None, keys: Iterable[int] | None = None, windows: bool = True
) -> dict[str, Column]:
    """Looser candidates by kind, with their sides; they may overlap each other and the base spans.

    With ``keep`` only those for which ``keep(kind)`` holds; of cards within a run
    of numbers, which are left out without ``windows``, only those with a feature
    number in ``keys``, and of those that overlap confirmed ones go first.
    """
    always = lambda found: F.lit(True)
    settle = _confirmed_first if keep else F.flatten
    free = keep("card in run") if keep else always
    keep = keep or (lambda kind: always)
    long_enough = lambda found: F.length(digits(found)).between(12, 20)
    none = _with_sides(text, no_spans())
    some_card = text.rlike(SOME_CARD)
    whole = F.filter(_with_sides(text, matches(text, CARD, lambda found: long_enough(found) & ~refused_run(found))), keep("card"))
    inner = settle(F.transform(_window_spans(text, keys), lambda cards: F.filter(cards, free))) if windows else none
    quads = F.filter(F.flatten(_within(text, matches(text, DOTTED, always), r"\.", _ip_windows)), keep("ip"))
    # a quad that cuts a base span is no candidate
    own = lambda s: ~F.exists(base["ip"], lambda b: _overlaps(b, s) & (b["start"] != s["start"]))
    return {
        "email": F.when(text.rlike(r"@|[(\[]at[)\]]"), F.filter(_with_sides(text, matches(text, LOOSE_EMAIL, always)), keep("email"))).otherwise(none),
        "ip": F.when(text.rlike(DOTTED), F.filter(quads, own)).otherwise(none),
        "card": F.when(some_card, F.concat(whole, inner)).otherwise(none),
        "phone": F.filter(_with_sides(text, matches(text, LOOSE_PHONE, always)), keep("phone")),
    }


# name -> number of values, from 0
FEATURES = {"size": 10, "breaks": 5, "first": 4, "left": 3, "right": 3, "words": 5}
COMBINATIONS = math.prod(FEATURES.values())


def _number(**values: Column) -> Column:
    """The number of a combination of features, or what some of them add to it."""
    total, step = F.lit(0), 1
    for name, size in reversed(FEATURES.items()):
        total = total + values[name] * step if name in values else total
        step *= size
    return total


def _numbered(numbers: np.ndarray) -> dict[str, np.ndarray]:
    """The features of combinations by their numbers."""
    out = {}
    for name, size in reversed(FEATURES.items()):
        numbers, out[name] = np.divmod(numbers, size)
    return {name: out[name] for name in FEATURES}


def _among(number: Column, wanted: Iterable[int], size: int) -> Column:
    """Whether a number below ``size`` is among ``wanted``: one literal, looked up by place."""
    chosen = np.zeros(size, int)
    chosen[list(wanted)] = 1
    return F.get(F.split(F.lit(",".join(map(str, chosen))), ","), number) == "1"


def _words(near: Column) -> Column:
    """What the lower-case text before a candidate speaks of."""
    return (
        F.when(near.rlike("card|visa|credit|pay"), 1).when(near.rlike("phone|tel|call|fax|mobile"), 2)
        .when(near.rlike("mail|contact|write"), 3).when(near.rlike("ip|host|server|version|addr"), 4).otherwise(0)
    )


def _side(char: Column) -> Column:
    return F.when(char.rlike("[A-Za-z0-9]"), 2).when(char.rlike(r"[^\s]"), 1).otherwise(0)


def features(span: Column) -> list[Column]:
    """Format and context of one candidate as small integers, in the order of FEATURES."""
    found, near, after = span["found"], F.lower(span["near"]), span["after"]
    before = F.right(span["near"], F.lit(1))
    n = F.length(digits(found))
    return [
        F.when(n == 0, 0).when(n <= 2, 1).when(n <= 6, 2).when(n <= 9, 3).when(n <= 10, 4).when(n <= 12, 5).when(n <= 15, 6).when(n == 16, 7).when(n <= 19, 8).otherwise(9),
        F.least(F.length(F.regexp_replace(found, "[A-Za-z0-9]", "")), F.lit(4)),
        F.when(found.rlike("^[3-6]"), 1).when(found.rlike("^[0-9]"), 2).when(found.rlike("^[A-Za-z]"), 3).otherwise(0),
        _side(before),
        _side(after),
        _words(near),
    ]


def confirmed(kind: str, span: Column, base: dict[str, Column]) -> Column:
    """Whether an exact rule confirms this candidate, or for phones a number around it."""
    if kind == "card":
        return card_number(span["found"])
    if kind == "ip":
        return small_parts(span["found"])
    inside = kind == "phone"
    return F.exists(base[kind], lambda b: ((b["start"] <= span["start"]) & (b["end"] >= span["end"])) if inside else ((b["start"] == span["start"]) & (b["end"] == span["end"])))


def _cases(kind: str, spans: Column, base: dict[str, Column]) -> Column:
    """(kind, code) of candidates: twice the number of their features, and one more if they are confirmed."""
    code = lambda s: 2 * _number(**dict(zip(FEATURES, features(s)))) + F.when(confirmed(kind, s, base), 1).otherwise(0)
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), code(s).alias("code")))


@dataclass
class Tree:
    """One split of a feature and one below each side; values at the leaves."""

    feature: str
    at: int
    low: "Tree | float"
    high: "Tree | float"

    def value(self, x: dict[str, np.ndarray]) -> np.ndarray:
        low, high = (y.value(x) if isinstance(y, Tree) else y for y in (self.low, self.high))
        return np.where(x[self.feature] <= self.at, low, high)


def _grow(x: dict[str, np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> "Tree | float":
    """Newton boosting: the split with the largest gain, or a leaf."""
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    everything = np.ones(len(g), bool)
    best = (1e-9, None)
    for name, values in x.items():
        for at in np.unique(values)[:-1]:
            low = values <= at
            gain = score(low) + score(~low) - score(everything)
            if gain > best[0]:
                best = (gain, (name, int(at), low))
    if depth == 0 or best[1] is None:
        return float(rate * g.sum() / (h.sum() + 1.0))
    name, at, low = best[1]
    side = lambda m: _grow({k: v[m] for k, v in x.items()}, g[m], h[m], depth - 1, rate)
    return Tree(name, at, side(low), side(~low))


def boost(x: dict[str, np.ndarray], good: np.ndarray, bad: np.ndarray, rounds: int, depth: int, rate: float) -> tuple[float, list]:
    """Logistic boosting on counts of confirmed and refused candidates per row of ``x``."""
    start = float(np.log((good.sum() + 1) / (bad.sum() + 1)))
    score, trees = np.full(len(good), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, good - (good + bad) * p, (good + bad) * p * (1 - p), depth, rate)
        trees.append(tree)
        score = score + (tree.value(x) if isinstance(tree, Tree) else tree)
    return start, trees


@dataclass
class PiiModel:
    """Boosted trees and the calibrated threshold of each kind."""

    precision: float = 0.9
    rounds: int = 20
    depth: int = 2
    rate: float = 0.3
    least: int = 20  # candidates needed to fit and to calibrate a kind
    start: dict[str, float] = field(default_factory=dict)
    trees: dict[str, list] = field(default_factory=dict)
    threshold: dict[str, float] = field(default_factory=dict)

    def fit(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "PiiModel":
        docs = only(docs, doc_id=id_col, text=text_col).select(F.coalesce(remainder("doc_id", 2), F.lit(0)).alias("half"), F.coalesce("text", F.lit("")).alias("text"))
        text = F.col("text")
        base = base_spans(text)
        rows = [_cases(kind, spans, base) for kind, spans in generated_spans(text, base, windows=False).items()]
        # texts without a digit or an address sign have no candidates
        some = docs.filter(text.rlike(r"[0-9]|@|[(\[]at[)\]]"))
        cases = some.select("half", F.explode(F.concat(*rows)).alias("c")).select("half", "c.*")
        cases = cases.unionByName(window_codes(docs, text).select("half", F.lit("card").alias("kind"), "code"))
        # at most one row per half, kind and combination of feature values
        counts = cases.groupBy("half", "kind", "code").agg(F.count(F.lit(1)).alias("n")).toPandas()
        counts["number"], counts["good"] = counts["code"] // 2, counts["n"].where(counts["code"] % 2 == 1, 0)
        counts["bad"] = counts["n"] - counts["good"]
        cells = counts.groupby(["half", "kind", "number"], as_index=False)[["good", "bad"]].sum()
        cells = cells.assign(**_numbered(cells["number"].to_numpy(np.int64)))
        for kind in KINDS:
            fit, held = (cells[(cells["kind"] == kind) & (cells["half"] == half)] for half in (0, 1))
            if min(fit["good"].sum() + fit["bad"].sum(), held["good"].sum() + held["bad"].sum()) < self.least:
                continue
            self.start[kind], self.trees[kind] = boost(
                {n: fit[n].to_numpy() for n in FEATURES}, fit["good"].to_numpy(float), fit["bad"].to_numpy(float), self.rounds, self.depth, self.rate
            )
            score = self._scores(kind, {n: held[n].to_numpy() for n in FEATURES})
            order = np.argsort(-score, kind="stable")
            good, n = held["good"].to_numpy()[order].cumsum(), (held["good"] + held["bad"]).to_numpy()[order].cumsum()
            last = np.append(np.diff(score[order]) != 0, True)  # equal scores are taken together
            ok = np.flatnonzero(last & (good >= self.precision * n) & (n >= self.least))
            if len(ok):
                self.threshold[kind] = float(score[order][ok[-1]])
        return self

    def _scores(self, kind: str, x: dict[str, np.ndarray]) -> np.ndarray:
        total = np.full(len(next(iter(x.values()))), self.start[kind])
        for tree in self.trees[kind]:
            total = total + (tree.value(x) if isinstance(tree, Tree) else tree)
        return total

    def keys(self, kind: str) -> list[int]:
        """The numbers of all combinations of features with which a candidate is selected."""
        if kind not in self.threshold:
            return []
        numbers = np.arange(COMBINATIONS)
        return numbers[self._scores(kind, _numbered(numbers)) >= self.threshold[kind] - 1e-9].tolist()

    def _selected(self, kind: str, base: Column) -> Callable[[Column], Column]:
        free = lambda s: ~F.exists(base, lambda b: _overlaps(b, s))
        if kind == "card in run":
            return free  # chosen by its number already
        keys = self.keys(kind)

        def selected(s: Column) -> Column:
            return free(s) & _among(_number(**dict(zip(FEATURES, features(s)))), keys, COMBINATIONS)

        return selected

    def added(self, text: Column, base: Column) -> Column:
        """Selected candidates that overlap no base span: (place, start, end, kind)."""
        parts = []
        chosen = lambda kind: self._selected(kind, base) if kind.split(" ")[0] in self.threshold else lambda span: F.lit(False)
        by_kind = F.filter(base, lambda b: b["kind"] == "ip")
        for kind, spans in generated_spans(text, {"ip": by_kind}, chosen, self.keys("card")).items():
            if kind in self.threshold:
                parts.append(_placed(kind, spans))
        return F.concat(*parts) if parts else _placed("email", no_spans())


def _placed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("place"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _with_spans(rows: DataFrame, model: PiiModel, text: Column) -> DataFrame:
    """Add ``base`` and ``spans``, arrays of (place, start, end, kind) by kind and start."""
    base = F.array_sort(F.concat(*[_placed(kind, spans) for kind, spans in base_spans(text).items()]))
    rows = rows.withColumn("base", base)
    added = F.when(text.rlike(r"[0-9]|@|[(\[]at[)\]]"), model.added(text, F.col("base"))).otherwise(_placed("email", no_spans()))
    return rows.withColumn("spans", F.array_sort(F.concat("base", added)))


def find(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans, arrays of (place, start, end, kind) by kind and start.

    ``base`` has the spans of the exact patterns, ``spans`` these and the added
    ones. A null or empty text has none. Repeated rows and null ids each get
    their own result, other columns are left out, and an empty table gives an
    empty result.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    return _with_spans(rows, model, F.coalesce("text", F.lit(""))).select("doc_id", "base", "spans")


def redacted(docs: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, whatever their names, and each span of the text replaced by its kind."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col("row")[text_col]
    rows = _with_spans(rows, model, F.coalesce(text, F.lit("")))
    return rows.select(*[redact(text, F.col("spans")).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first one counts.

    The parts are joined once, from left to right.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["at"]
        between = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        parts = F.when(free, F.concat(acc["parts"], F.array(between, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["parts"])
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), parts.alias("parts"))

    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, zero, step, rest)).otherwise(text)
