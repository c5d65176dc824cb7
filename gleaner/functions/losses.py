"""Loss columns of a binary classifier, from logit and label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of the two losses.
POS_WEIGHT = 5.0
FOCAL_ALPHA = 0.25
FOCAL_GAMMA = 2.0


def sigmoid(logit: Column) -> Column:
    """1 / (1 + e^-x), written so that neither tail overflows."""
    small = F.exp(-F.abs(logit))
    return F.when(logit >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def _softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def bce_with_logits(logit: Column, label: Column, pos_weight: float = POS_WEIGHT) -> Column:
    """Cross entropy on the logit, positives weighted by ``pos_weight``."""
    y = label.cast("double")
    return pos_weight * y * _softplus(-logit) + (1 - y) * _softplus(logit)


def sigmoid_focal(logit: Column, label: Column, alpha: float = FOCAL_ALPHA,
                  gamma: float = FOCAL_GAMMA) -> Column:
    """Focal loss; a negative ``alpha`` leaves the classes unweighted."""
    y = label.cast("double")
    # 1 - p_t is the probability of the wrong class, taken straight from the logit.
    wrong = F.when(y == 1, sigmoid(-logit)).otherwise(sigmoid(logit))
    loss = bce_with_logits(logit, label, 1.0) * F.pow(wrong, F.lit(float(gamma)))
    return loss if alpha < 0 else loss * (alpha * y + (1 - alpha) * (1 - y))


def focal_weight(logit: Column, label: Column, alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA) -> Column:
    """Weight under which the cross entropy's gradient at ``logit`` is the focal loss's.

    With p the probability of the right class, the focal gradient is (1 - p)^gamma * (1 - p - gamma * p * ln p), the cross
    entropy's is 1 - p; the weight is their ratio, times the class's alpha.
    """
    y = label.cast("double")
    right = F.when(y == 1, logit).otherwise(-logit)
    wrong = sigmoid(-right)
    # -ln p / (1 - p) tends to 1 where p does, and both lose their digits.
    steep = F.when(wrong > 1e-12, _softplus(-right) / wrong).otherwise(F.lit(1.0))
    weight = F.pow(wrong, F.lit(float(gamma))) * (1 + gamma * sigmoid(right) * steep)
    return weight if alpha < 0 else weight * (alpha * y + (1 - alpha) * (1 - y))


def loss(kind: str, logit: Column, label: Column, **params: float) -> Column:
    if kind == "BCE":
        return bce_with_logits(logit, label, **params)
    if kind == "focal":
        return sigmoid_focal(logit, label, **params)
    raise ValueError(f"unsupported loss: {kind}")
