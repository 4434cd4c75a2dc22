import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from newsignal.operators import valence
from newsignal.operators.lexicons import LEXICON_SCHEMA
from newsignal.operators.valence import ValenceRules, score_valence

TERMS = {"good": 1.9, "bad": -2.5, "great": 3.1, "very": 1.0, "no": -1.2, "plain": 0.0, "é": 0.5}
RULES = ValenceRules(("not", "never", "no"), {"very": 0.293, "slightly": -0.293, "so": 0.293}, ("but", "aber"))


@pytest.fixture(scope="module")
def lexicon(spark):
    from decimal import Decimal

    return spark.createDataFrame([(t, Decimal(0), Decimal(0), Decimal(str(v))) for t, v in TERMS.items()], LEXICON_SCHEMA)


def plain(text):
    """The rules in loops."""
    signs = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    words = [w.strip(signs) if len(w.strip(signs)) > 2 else w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    loud = [w == w.upper() != w.lower() for w in words]
    mixed = any(loud) and not all(loud)
    low = [w.lower() for w in words]
    split = next((i for i, w in enumerate(low) if w in RULES.contrast), None)
    values = []
    for i, w in enumerate(low):
        v = 0.0 if w in RULES.degrees else TERMS.get(w, 0.0)
        if not v:
            continue
        if mixed and loud[i]:
            v += 0.733 if v > 0 else -0.733
        for k, fading in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i < k or (low[i - k] in TERMS and low[i - k] not in RULES.degrees):
                continue
            amount = RULES.degrees.get(low[i - k], 0.0)
            if amount:
                sign = -1 if v < 0 else 1
                v += (sign * amount + (sign * 0.733 if mixed and loud[i - k] else 0.0)) * fading
            if low[i - k] in RULES.negators:
                v *= -0.74
        if split is not None:
            v *= 0.5 if i < split else 1.5 if i > split else 1.0
        values.append(round(v, 6))
    bangs, asked = (text or "").count("!"), (text or "").count("?")
    stress = min(bangs, 4) * 0.292 + (0.0 if asked <= 1 else 0.18 * asked if asked <= 3 else 0.96)
    total = sum(values)
    total += stress if total > 0 else -stress if total < 0 else 0.0
    up, down = sum(v + 1 for v in values if v > 0), sum(1 - v for v in values if v < 0)
    sides = [up + (stress if up > down else 0), down + (stress if down > up else 0), len(words) - sum(v != 0 for v in values)]
    score = total / math.sqrt(total * total + 15)
    return score, max(sides) / sum(sides) if sum(sides) else 0.0, "positive" if score >= 0.05 else "negative" if score <= -0.05 else "neutral"


def check(spark, lexicon, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: r.valence for r in score_valence(df, lexicon, rules=RULES).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        score, confidence, label = plain(text)
        assert found[i].score == pytest.approx(score, abs=2e-6), text
        assert found[i].confidence == pytest.approx(confidence, abs=2e-6) and found[i].label == label, text


def test_each_rule(spark, lexicon):
    check(spark, lexicon, [
        "good", "not good", "not so good", "never ever good", "not a b c good", "very good", "slightly good", "very bad", "so x good", "so x y good",
        "GOOD day", "GOOD DAY", "VERY good day", "VERY bad", "good but bad", "bad aber good, but great", "good!", "bad!!!!!!", "good??", "good?????",
        "good bad", None, "", " \n ", "(good) \"bad\" ok.", "no good", "plain words", "not not good", "good no", ":) é É good", "good, very. good!", "but good but bad",
        "x " * 20_000 + "good"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_random_texts_against_the_loops(spark, lexicon, seed):
    rng = random.Random(seed)
    words = [*TERMS, *RULES.degrees, *RULES.negators, "but", "x", "Word", "!", "?", "!?", "...", "\n"]
    some = lambda: " ".join(rng.choice((str, str.upper, str.title))(rng.choice(words)) + rng.choice(["", "", ",", "!", "?"]) for _ in range(rng.randint(0, 25)))
    check(spark, lexicon, [some() for _ in range(40)])


def test_without_rules_it_is_the_plain_sum_and_no_python_runs(spark, lexicon):
    none = ValenceRules((), {}, ())
    df = spark.createDataFrame([(1, "not good but very bad")], "id int, text string")
    found = score_valence(df, lexicon, rules=none)
    total = 1.9 + 1.0 - 2.5
    assert found.first().valence.score == pytest.approx(total / math.sqrt(total**2 + 15), abs=1e-6)
    assert "Python" not in found._jdf.queryExecution().toString()
    assert score_valence(df.limit(0), lexicon).collect() == []
    assert valence.ValenceRules().degrees["very"] == 0.293
