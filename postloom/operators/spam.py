"""Spam scores: distinct four-character features and an ensemble of eight classifiers.

Prediction joins the distinct features of a message with the model and sums per
message once for all classifiers. Training is sequential by nature: messages in one
order update the model and the classifiers' weights one after the other, on one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_grams, logistic
from ..work import kept
from .setops import by_hash

#: Fixed values of the feature window, smoothing and margins.
GRAM, TEXT_MOST, SMOOTH = 4, 3000, 0.1
MODEL = "feature string, logist double, bwinnow_upper double, bwinnow_lower double, nsnb_spam double, nsnb_ham double, nsnb_confidence double, pam double, pa double, winnow double, hit_spam double, hit_ham double, hit double, nb_spam double, nb_ham double"
DEFAULTS = {"logist": 0.0, "bwinnow_upper": 2.0, "bwinnow_lower": 1.0, "nsnb_spam": 0.0, "nsnb_ham": 0.0, "nsnb_confidence": 1.0, "pam": 0.0, "pa": 0.0, "winnow": 1.0, "hit_spam": 0.0, "hit_ham": 0.0, "hit": 0.0, "nb_spam": 0.0, "nb_ham": 0.0}
#: Places of the columns in training.
_AT = {c: i for i, c in enumerate(DEFAULTS)}
#: The score above which a message counts as spam, and by how much a classifier's weight moves.
MARK, WEIGHT_STEP = 0.5, 0.02
#: Rows of the trained table that hold a classifier's weight; no feature is longer than ``GRAM``.
_WEIGHT = "weight of "
CLASSIFIERS = ("bwinnow", "lr", "nb", "nsnb", "winnow", "pa", "pam", "hit")


def features(text: Column) -> Column:
    """Distinct four-character runs of the first 3000 characters; none for shorter texts."""
    return F.array_distinct(char_grams(F.left(text, F.lit(TEXT_MOST)), GRAM))


def feature_rows(messages: DataFrame) -> DataFrame:
    return messages.select("idx", F.explode(features(F.col("body"))).alias("feature"))


def naive_bayes_model(labelled: DataFrame) -> DataFrame:
    """``(feature, spam, ham)`` counts of ``labelled(idx, body, spam)``: the part of the model that needs no order."""
    rows = labelled.select("spam", F.explode(features(F.col("body"))).alias("feature"))
    return rows.groupBy("feature").agg(F.count_if("spam").alias("spam"), F.count_if(~F.col("spam")).alias("ham"))


def naive_bayes(messages: DataFrame, model: DataFrame, n_spam: int, n_ham: int) -> DataFrame:
    """``(idx, score)``: the summed log-odds of known features and of the classes, through the logistic."""
    ratio = F.ln((F.col("spam") + SMOOTH) / (F.col("ham") + SMOOTH) * (n_ham + 2 * SMOOTH) / (n_spam + 2 * SMOOTH))
    sums = feature_rows(messages).join(model, "feature").groupBy("idx").agg(F.sum(ratio).alias("s"))
    prior = math.log((n_spam + SMOOTH) / (n_ham + SMOOTH))
    return messages.select("idx").join(sums, "idx", "left").select("idx", logistic((F.coalesce("s", F.lit(0.0)) + prior) / 3200).alias("score"))


def predict(messages: DataFrame, model: DataFrame, n_spam: int, n_ham: int, weights: dict[str, float] | None = None) -> DataFrame:
    """``(idx, score)`` and each classifier's score: their weighted mean; unknown features count with the defaults."""
    weights = weights or dict.fromkeys(CLASSIFIERS, 1.0)
    seen = F.col("nb_spam") + F.col("nb_ham") > 0
    odds = F.ln((F.col("nb_spam") + SMOOTH) / (F.col("nb_ham") + SMOOTH) * (n_ham + 2 * SMOOTH) / (n_spam + 2 * SMOOTH))
    confident = F.ln((F.col("nsnb_spam") + SMOOTH) / (F.col("nsnb_ham") + SMOOTH) * (n_ham + 2 * SMOOTH) / (n_spam + 2 * SMOOTH) * F.col("nsnb_confidence"))
    votes = model.select(
        "feature", (F.col("bwinnow_upper") - F.col("bwinnow_lower")).alias("bwinnow"), F.col("logist").alias("lr"), F.when(seen, odds).alias("nb"),
        F.when(F.col("nsnb_spam") + F.col("nsnb_ham") > 0, confident).alias("nsnb"), "winnow", "pa", "pam", "hit",
    )
    # Every task gets the model, as the training task had it: a message's features stay together and are summed where they are.
    rows = feature_rows(messages).join(F.broadcast(votes), "feature", "left").fillna({"bwinnow": DEFAULTS["bwinnow_upper"] - DEFAULTS["bwinnow_lower"], "lr": DEFAULTS["logist"], **{c: DEFAULTS[c] for c in ("winnow", "pa", "pam", "hit")}})
    sums = rows.groupBy("idx").agg(
        (F.avg("bwinnow") - 1).alias("bwinnow"), (F.sum("lr") / 10).alias("lr"), F.sum("nb").alias("nb"), F.sum("nsnb").alias("nsnb"),
        (F.avg("winnow") - 1).alias("winnow"), F.sum("pa").alias("pa"), (F.sum("pam") / 1.25).alias("pam"), (F.sum("hit") / 60).alias("hit"),
    )
    prior = math.log((n_spam + SMOOTH) / (n_ham + SMOOTH))
    rows = messages.select("idx").join(sums, "idx", "left").fillna(0.0)
    raw = {c: (F.col(c) + prior) / 3200 if c in ("nb", "nsnb") else F.col(c) for c in CLASSIFIERS}
    each = rows.select("idx", *(logistic(raw[c]).alias(c) for c in CLASSIFIERS))
    shares = _shares(weights)
    mean = sum(F.col(c) * shares[c] for c in CLASSIFIERS)
    return each.withColumn("score", mean)


def band(score: Column) -> Column:
    return F.when(score < 0.35, "valid").when(score <= 0.5, "unsure/valid").when(score <= 0.65, "unsure/spam").otherwise("spam")


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def _sum(x: np.ndarray) -> float:
    """The sum without the rounding of its order: thresholds are met exactly by messages of new features."""
    return math.fsum(x.tolist())


def _scores(own: np.ndarray, n_spam: int, n_ham: int) -> dict[str, float]:
    """What ``predict`` gives for one message, from the model as it stands in training: ``own`` has a row for each column."""

    def odds(name: str) -> float:
        spam, ham = own[_AT[f"{name}_spam"]], own[_AT[f"{name}_ham"]]
        seen = spam + ham > 0
        share = (spam[seen] + SMOOTH) / (ham[seen] + SMOOTH) * ((n_ham + 2 * SMOOTH) / (n_spam + 2 * SMOOTH))
        return _sum(np.log(share * own[_AT["nsnb_confidence"]][seen] if name == "nsnb" else share)) + math.log((n_spam + SMOOTH) / (n_ham + SMOOTH))

    total = lambda name: _sum(own[_AT[name]])
    n = own.shape[1]
    raw = {
        "bwinnow": total("bwinnow_upper") / n - total("bwinnow_lower") / n - 1, "lr": total("logist") / 10, "nb": odds("nb") / 3200, "nsnb": odds("nsnb") / 3200,
        "winnow": total("winnow") / n - 1, "pa": total("pa"), "pam": total("pam") / 1.25, "hit": total("hit") / 60,
    }
    return {c: _logistic(raw[c]) for c in CLASSIFIERS}


def _shares(weights: dict[str, float]) -> dict[str, float]:
    """The parts that classifiers have in the mean; equal ones where steps have made the weights' sum zero, which has no mean."""
    total = sum(weights.values())
    return {c: w / total if total else 1 / len(weights) for c, w in weights.items()}


def _reweighed(weights: dict[str, float], scores: dict[str, float], spam: bool) -> None:
    """A right ensemble takes a step from the classifiers that were wrong, a wrong one gives a step to those that were not below the mark."""
    shares = _shares(weights)
    mean = sum(scores[c] * shares[c] for c in CLASSIFIERS)
    right = (mean > MARK) == spam
    for c in CLASSIFIERS:
        if right and (scores[c] > MARK) != spam:
            weights[c] -= WEIGHT_STEP
        elif not right and (scores[c] > MARK) == spam:
            weights[c] += WEIGHT_STEP


def train(labelled: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """The model and the classifiers' weights after one pass over ``labelled(idx, body, spam)`` in order of ``idx``.

    Each message moves the weights of its features until the classifier is right by a margin or has tried often
    enough. Order is the algorithm, so one task learns; it holds the model and a batch of messages, however many there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A feature's weights are a column of an array that doubles as features come, so a message is a few array operations.
        place: dict[str, int] = {}
        table = _fresh(1 << 12)
        weights = dict.fromkeys(CLASSIFIERS, 1.0)
        seen = {"spam": 0, "ham": 0}
        for rows in batches:
            for r in rows.itertuples():
                at = np.fromiter((place.setdefault(f, len(place)) for f in r.features), np.int64, len(r.features))
                while len(place) > table.shape[1]:
                    table = np.hstack([table, _fresh(table.shape[1])])
                kind = "spam" if r.spam else "ham"
                if len(at):
                    own = table[:, at]
                    _reweighed(weights, _scores(own, seen["spam"], seen["ham"]), bool(r.spam))
                    _learn(own, bool(r.spam))
                    table[:, at] = own
                seen[kind] += 1
        names = ["feature", *DEFAULTS]
        yield pd.DataFrame([{**DEFAULTS, "feature": _WEIGHT + c, "logist": w} for c, w in weights.items()], columns=names)
        items = list(place)
        for k in range(0, len(items), 10_000):
            some = items[k : k + 10_000]
            yield pd.DataFrame({"feature": some, **{c: table[i, k : k + len(some)] for c, i in _AT.items()}}, columns=names)

    rows = labelled.select("idx", F.col("spam").cast("boolean").alias("spam"), features(F.col("body")).alias("features"))
    learnt = kept(rows.repartition(1).sortWithinPartitions("idx").mapInPandas(run, MODEL), "spam-model")
    extra = F.col("feature").startswith(_WEIGHT)
    weights = {r["feature"][len(_WEIGHT) :]: r["logist"] for r in learnt.where(extra).collect()}
    return learnt.where(~extra), {c: weights.get(c, 1.0) for c in CLASSIFIERS}


def _fresh(n: int) -> np.ndarray:
    """The weights of ``n`` new features."""
    return np.tile(np.array(list(DEFAULTS.values()))[:, None], n)


def _learn(own: np.ndarray, spam: bool) -> None:
    sign, kind, n = (1.0, "spam", own.shape[1]) if spam else (-1.0, "ham", own.shape[1])
    f = {c: own[i] for c, i in _AT.items()}
    for c in ("nb", "nsnb", "hit"):
        f[f"{c}_{kind}"] += 1
    f["hit"][:] = (f["hit_spam"] - f["hit_ham"]) / (f["hit_spam"] + f["hit_ham"])
    # Each try moves all features alike, so the sum is carried on and the array moved once.
    total, moved = _sum(f["logist"]), 0.0
    for _ in range(100):
        p = _logistic((total + n * moved) / 10)
        if (p > 0.75) == (sign > 0) and abs(p - 0.5) > 0.25:
            break
        moved += 0.05 * ((sign > 0) - p)
    f["logist"] += moved
    for name, scale in (("pa", 1.0), ("pam", 1.25)):
        loss = max(0.0, 1 - sign * _sum(f[name]) / scale)
        f[name] += sign * min(1.0, loss / n)
    for _ in range(50):
        if sign * (_sum(f["winnow"]) / n - 1) > 0.1:
            break
        f["winnow"] *= 1.1 if sign > 0 else 0.9
    for _ in range(50):
        if sign * (_sum(f["bwinnow_upper"] - f["bwinnow_lower"]) / n - 1) > 0.1:
            break
        f["bwinnow_upper"] *= 1.05 if sign > 0 else 0.95
        f["bwinnow_lower"] *= 0.95 if sign > 0 else 1.05
    if sign * _sum(np.log((f["nsnb_spam"] + SMOOTH) / (f["nsnb_ham"] + SMOOTH))) <= 0:
        f["nsnb_confidence"] *= 1.02 if sign > 0 else 0.98


def spam_messages(messages: DataFrame, conn: DataFrame, scores: DataFrame, thread: float | None = None) -> DataFrame:
    """``idx`` of what a filter drops: childless roots over one half, and with ``thread`` whole threads of which no message scores below it."""
    from .threads import roots

    top = conn.where("parent is null and child_total = 1").select("idx")
    out = top.join(scores, "idx").where("score > 0.5").select("idx")
    if thread is not None:
        rooted = roots(conn).select("idx", "root").join(scores, "idx")
        bad = rooted.groupBy("root").agg(F.min("score").alias("least"), F.count("*").alias("n")).where((F.col("least") >= thread) & (F.col("n") > 1)).select("root")
        out = out.union(rooted.join(bad, "root", "left_semi").select("idx"))
    return out


def training_candidates(conn: DataFrame, messages: DataFrame, visited: DataFrame, seed: int) -> DataFrame:
    """Childless roots that nobody has seen, in an order that the seed decides."""
    alone = conn.where("parent is null and child_total = 1").select("idx")
    return messages.join(alone, "idx").join(visited.select("msgid").distinct(), "msgid", "left_anti").orderBy(*by_hash(seed))
