"""Model fitting with the ML library: boosted and random trees, ridge, adversarial ranking,
residual codes and pseudo-labels. Trees grow level by level and differ from leaf-wise learners.

Fits that repeat (seeds, folds, rounds, levels) read one table held in the shared folder, so that
the rows behind it are computed once whatever the number of fits."""

from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from ..schema import KEY
from .lineage import cut
from .linear import moments, predicted, ridge_fit
from .preprocess import _with_row, average_rank
from .quantile import exact_quantiles

c = F.col


def assembled(df, names):
    """Feature vector `features`; missing values become 0."""
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(df.na.fill(0.0, list(names)))


def seed_average(make, train, score, seeds, keys=(KEY,)):
    """Mean prediction over models of several seeds; make(seed) gives an unfitted estimator."""
    parts = [make(s).fit(train).transform(score).select(*keys, "prediction") for s in seeds]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return both.groupBy(*keys).agg(F.avg("prediction").alias("prediction"))


def boosted_trees(df, names, train_filter, score_filter, seeds=(1, 2), depth=4, rounds=20, weight=None):
    """Gradient-boosted regression on the training months, averaged over seeds."""
    v = cut(assembled(df, names))
    return seed_average(lambda seed: _booster(seed, depth, rounds, weight), v.filter(train_filter), v.filter(score_filter), seeds)


def _booster(seed, depth, rounds, weight=None):
    m = GBTRegressor(labelCol="target", maxDepth=depth, maxIter=rounds, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    return m.setWeightCol(weight) if weight else m


def round_cosines(model, df, target="target"):
    """Cosine of target and prediction after each round of a boosted ensemble, from one pass over `df`.

    Each tree's share is a column; the product sums of these columns and the target give every partial sum's.
    """
    names = [f"_tree_{i}" for i in range(len(model.trees))]
    for name, tree in zip(names, model.trees):
        df = tree.setPredictionCol(name).transform(df)
    n, mean, cov = moments(df, [*names, target])
    products = n * (cov + np.outer(mean, mean))
    w = np.array(model.treeWeights)
    own = np.cumsum(np.cumsum(products[:-1, :-1] * np.outer(w, w), 0), 1).diagonal()
    size = np.sqrt(np.maximum(own, 0.0) * products[-1, -1])
    return np.divide(np.cumsum(w * products[:-1, -1]), size, out=np.zeros(len(w)), where=size > 0)


def best_round(scores, patience):
    """Rounds to keep: the first with the best score, looking no further once `patience` rounds brought nothing better."""
    best = 0
    for i, score in enumerate(scores):
        if score > scores[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def stopped_trees(df, names, train_filter, valid_filter, score_filter, seeds=(1, 2), depth=4, rounds=60, patience=15, more=1.1):
    """Boosting stopped by the cosine of the validation months: (mean prediction over seeds, [(seed, rounds kept, cosine)]).

    Each seed's ensemble is fitted again on training and validation months together, with `more` times the rounds kept.
    """
    v = cut(assembled(df, names))
    train, valid = v.filter(train_filter), v.filter(valid_filter)
    kept = []
    for seed in seeds:
        scores = round_cosines(_booster(seed, depth, rounds).fit(train), valid)
        n = best_round(scores, patience)
        kept.append((seed, n, float(scores[n - 1])))
    grown = {seed: max(1, int(n * more)) for seed, n, _ in kept}
    both = v.filter(F.expr(train_filter) | F.expr(valid_filter))
    return seed_average(lambda seed: _booster(seed, depth, grown[seed]), both, v.filter(score_filter), seeds), kept


def random_forest(df, names, train_filter, score_filter, seeds=(1,), depth=6, trees=20):
    v = cut(assembled(df, names))
    make = lambda seed: RandomForestRegressor(labelCol="target", maxDepth=depth, numTrees=trees, seed=seed)
    return seed_average(make, v.filter(train_filter), v.filter(score_filter), seeds)


def ridge(df, names, train_filter, score_filter, alpha=1.0):
    """Ridge on standardised features; missing values become 0."""
    df = df.na.fill(0.0, list(names))
    fit = ridge_fit(df.filter(train_filter), names, "target", alpha)
    return df.filter(score_filter).select(KEY, predicted(names, fit).alias("prediction"))


def feature_gains(df, names, train_filter, seed=1, depth=4, rounds=10):
    """Importance of each feature in one boosted model: {name: gain}."""
    m = GBTRegressor(labelCol="target", maxDepth=depth, maxIter=rounds, seed=seed).fit(assembled(df, names).filter(train_filter))
    return dict(zip(names, m.featureImportances.toArray().tolist()))


def _halves(train, test, names):
    """Both tables with `label` 0 and 1 and a fold by the hash of the id, held for all fits."""
    train, test = (df.select(KEY, *names).withColumn("label", F.lit(x)) for df, x in ((train, 0.0), (test, 1.0)))
    return cut(train.unionByName(test).withColumn("fold", F.pmod(F.hash(KEY), F.lit(2))))


def _told_apart(both, names, seed, rounds):
    v = assembled(both, names)
    scored, gains = [], [0.0] * len(names)
    for k in (0, 1):
        m = GBTClassifier(maxDepth=3, maxIter=rounds, seed=seed).fit(v.filter(c("fold") != k))
        scored.append(m.transform(v.filter(c("fold") == k)).select(KEY, "label", "rawPrediction", "probability"))
        gains = [a + b for a, b in zip(gains, m.featureImportances.toArray())]
    out = scored[0].unionByName(scored[1])
    auc = BinaryClassificationEvaluator().evaluate(out)
    return out, auc, dict(zip(names, gains))


def adversarial(train, test, names, seed=1, rounds=10):
    """Can a classifier tell test from train? Rows of out-of-fold scores, AUC and feature gains.

    Two folds by the hash of the id; each half is scored by the model of the other.
    """
    return _told_apart(_halves(train, test, names), names, seed, rounds)


def drop_shifted(train, test, names, keep_auc=0.55, step=1, seed=1, rounds=10):
    """Drop the most telling features until train and test look alike: (kept, [(auc, dropped)])."""
    kept, history = list(names), []
    both = _halves(train, test, names)
    while len(kept) > step:
        _, auc, gains = _told_apart(both, kept, seed, rounds)
        worst = sorted(kept, key=lambda n: -gains[n])[:step]
        history.append((auc, worst if auc > keep_auc else []))
        if auc <= keep_auc:
            break
        kept = [n for n in kept if n not in worst]
    return kept, history


def rank_auc(df, score, label):
    """Area under the ROC curve from average ranks: one row."""
    r = average_rank(df, c(score), name="_r")
    pos = c(label) == 1
    s = r.agg(
        F.sum(F.when(pos, c("_r"))).alias("ranks"), F.count_if(pos).alias("p"), F.count_if(~pos).alias("n")
    )
    return s.select(((c("ranks") - c("p") * (c("p") + 1) / 2.0) / (c("p") * c("n"))).alias("auc"))


def residual_codes(df, column="target", levels=2, size=8, seed=1):
    """Residual quantisation: at each level a k-means code of what earlier levels left over.

    A level reads what the one before it wrote.
    """
    out = cut(df.withColumn("_res", c(column)))
    for level in range(levels):
        v = VectorAssembler(inputCols=["_res"], outputCol="_v").transform(out)
        m = KMeans(k=size, seed=seed, featuresCol="_v", predictionCol=f"code_{level}").fit(v)
        centres = F.array(*[F.lit(float(x[0])) for x in m.clusterCenters()])  # `size` numbers
        out = m.transform(v).drop("_v")
        out = cut(out.withColumn("_res", c("_res") - F.element_at(centres, c(f"code_{level}") + 1)))
    return out.withColumnRenamed("_res", "residual")


def pseudo_labelled(train, scored, weight=0.5):
    """Training rows plus the confident half of the scored rows as labels, with weights.

    Confident means |prediction| at or above its median.
    """
    cut = exact_quantiles(scored, F.abs("prediction"), {"_med": 0.5})
    confident = _with_row(scored, cut).filter(F.abs("prediction") >= c("_med")).drop("_med")
    extra = confident.withColumn("target", c("prediction")).withColumn("weight", F.lit(float(weight)))
    names = [*train.columns, "weight"]
    return train.withColumn("weight", F.lit(1.0)).unionByName(extra.select(*names))
