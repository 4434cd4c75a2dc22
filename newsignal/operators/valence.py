"""Valence of a text with the published rules on context: negation, degree words, contrast, capitals, punctuation.

``scoring.score_methods`` adds up the valences of a text's words as they are; here each word of the lexicon is weighed by the three
words before it and by its place. Every token takes along what the rules need of its neighbours, so a text is one
row until its tokens meet the lexicon, and the shuffle carries one row per text. No Python runs.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsignal.operators.scoring import valence_result
from newsignal.session import broadcast_if_small

# Constants of the published rules.
DEGREE = 0.293
CAPITALS = 0.733
NEGATION = -0.74
FADING = (1.0, 0.95, 0.9)
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS, MOST_QUESTIONS = 0.18, 0.96, 3

ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A token keeps its signs if no more than this is left without them: it may be made of signs.
SHORT = 2
_EXACT = "decimal(14,6)"


@dataclass(frozen=True)
class ValenceRules:
    """Words in lower case that change the valence of those after them; the caller may bring fuller lists.

    ``degrees``: what a word adds to a positive valence, and takes from a negative one.
    """

    negators: tuple[str, ...] = ("not", "no", "never", "none", "nothing", "neither", "nor", "cannot", "without", "isn't", "wasn't", "don't", "won't")
    degrees: Mapping[str, float] = field(default_factory=lambda: {
        **dict.fromkeys(("very", "really", "extremely", "highly", "most", "more", "so"), DEGREE),
        **dict.fromkeys(("barely", "hardly", "slightly", "somewhat", "less", "almost"), -DEGREE),
    })
    contrast: tuple[str, ...] = ("but",)


def tokens(text: Column) -> Column:
    """Parts between blanks, without signs around them."""
    bare = lambda t: F.btrim(t, F.lit(ASCII_PUNCTUATION))
    parts = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.transform(parts, lambda t: F.when(F.length(bare(t)) > SHORT, bare(t)).otherwise(t))


def emphasis(text: Column) -> Column:
    """What exclamation and question marks add to a text's valence, whatever its sign."""
    count = lambda sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    loud = F.least(count("!"), F.lit(MOST_EXCLAMATIONS)) * F.lit(EXCLAMATION)
    asked = F.when(count("?") <= 1, 0.0).when(count("?") <= MOST_QUESTIONS, count("?") * F.lit(QUESTION)).otherwise(MANY_QUESTIONS)
    return loud + asked


def _listed(word: Column, words) -> Column:
    return word.isin(*sorted(words)) if words else F.lit(False)


def _scalar(word: Column, degrees: Mapping[str, float]) -> Column:
    value = F.lit(0.0)
    for amount in sorted(set(degrees.values())):
        value = F.when(word.isin(*(w for w, a in degrees.items() if a == amount)), F.lit(float(amount))).otherwise(value)
    return value


def in_context(token: Column, valence: Column, mixed: Column, contrast_at: Column, rules: ValenceRules, known: set[str]) -> Column:
    """The valence of one token. ``token``: word, loud (in capitals), at, and ``near``: word and loud of those before it, the nearest first.

    ``mixed``: the text has words in capitals and others; ``known``: modifiers that the lexicon has itself, which are words like others.
    """
    signed = lambda now, amount: F.when(now < 0, -amount).otherwise(amount)

    def with_louder(now: Column, loud: Column) -> Column:
        return now + F.when(mixed & loud, signed(now, F.lit(CAPITALS))).otherwise(0.0)

    def changed(now: Column, before: Column) -> Column:
        word, degree = before["word"], before["degree"]
        louder = F.when(mixed & before["loud"], CAPITALS).otherwise(0.0)
        moved = now + F.when(degree != 0, (signed(now, degree) + signed(now, louder)) * before["fading"]).otherwise(0.0)
        moved = F.when(_listed(word, rules.negators), moved * F.lit(NEGATION)).otherwise(moved)
        return F.when(_listed(word, known), now).otherwise(moved)

    fading = F.array(*map(F.lit, FADING))
    near = F.filter(F.transform(token["near"], lambda t, k: F.struct(
        t["word"].alias("word"), t["loud"].alias("loud"), _scalar(t["word"], rules.degrees).alias("degree"), F.get(fading, k).alias("fading"),
    )), lambda before: before["word"].isNotNull())
    place = F.when(contrast_at > token["at"], BEFORE_CONTRAST).when(contrast_at < token["at"], AFTER_CONTRAST).otherwise(1.0)
    return F.aggregate(near, with_louder(valence.cast("double"), token["loud"]), changed) * F.coalesce(place, F.lit(1.0))


def score_valence(
    df: DataFrame, lexicon: DataFrame, id: str = "id", text: str = "text", rules: ValenceRules = ValenceRules(),
) -> DataFrame:
    """(id, valence) for each row: score, confidence and label of the weighed valences.

    Degree words have no valence of their own. Contributions are added as decimals, so their order does not matter.
    A text without words of the lexicon, and a null one, scores 0.
    """
    modifiers = sorted({*rules.negators, *rules.degrees})
    # At most as many rows as there are modifiers.
    known = {r.term for r in lexicon.filter(_listed(F.col("term"), modifiers)).select("term").collect()} - set(rules.degrees)
    words = F.transform(tokens(F.coalesce(F.col(text), F.lit(""))), lambda w: F.struct(
        F.lower(w).alias("word"), ((w == F.upper(w)) & (w != F.lower(w))).alias("loud")))

    def described(t: Column, i: Column) -> Column:
        near = F.array(*(F.get(F.col("_words"), i - k) for k in range(1, len(FADING) + 1)))
        return F.struct(t["word"].alias("word"), t["loud"].alias("loud"), i.alias("at"), near.alias("near"))

    loud = lambda wanted: F.exists("_words", lambda t: t["loud"] == F.lit(wanted))
    contrast = F.transform("_words", lambda t, i: F.when(_listed(t["word"], rules.contrast), i))
    texts = df.select(id, words.alias("_words"), emphasis(F.coalesce(F.col(text), F.lit(""))).alias("_emphasis")).select(
        id, "_emphasis", F.size("_words").alias("_n"), (loud(True) & loud(False)).alias("_mixed"),
        F.array_min(F.array_compact(contrast)).alias("_contrast"), F.transform("_words", described).alias("_tokens"))
    # One more token without a word, so that every text has a row; such keys are many, so that they do not meet in one task.
    nothing = F.concat(F.lit("\0"), F.pmod(F.xxhash64(id), F.lit(1024)).cast("string"))
    rows = texts.select(id, "_emphasis", "_n", "_mixed", "_contrast", F.explode_outer("_tokens").alias("_t")).withColumn(
        "_key", F.coalesce(F.when(~_listed(F.col("_t.word"), rules.degrees), F.col("_t.word")), nothing))
    terms = lexicon.select(F.col("term").alias("_key"), "valence")
    weighed = F.when(F.col("valence") != 0, in_context(
        F.col("_t"), F.col("valence"), F.col("_mixed"), F.col("_contrast"), rules, known).cast(_EXACT))
    v = F.col("_v")
    sums = (
        rows.join(broadcast_if_small(terms), "_key", "left").withColumn("_v", F.coalesce(weighed, F.lit(0).cast(_EXACT)))
        .groupBy(id).agg(
            F.max("_emphasis").alias("_emphasis"), F.max("_n").alias("_n"), F.sum("_v").alias("_total"),
            F.sum(F.when(v > 0, v + 1).otherwise(0)).alias("_up"), F.sum(F.when(v < 0, 1 - v).otherwise(0)).alias("_down"),
            F.count_if(v != 0).alias("_counted"))
    )
    up, down, total = (F.col(c).cast("double") for c in ("_up", "_down", "_total"))
    stress = F.col("_emphasis")
    return sums.select(id, valence_result(
        total + F.when(total > 0, stress).when(total < 0, -stress).otherwise(0.0),
        up + F.when(up > down, stress).otherwise(0.0), down + F.when(down > up, stress).otherwise(0.0),
        F.col("_n") - F.col("_counted")).alias("valence"))
