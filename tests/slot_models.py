"""Inference models that workers import: the same answers under other orders and sets of labels."""

from tonescope.operators import delivery


def permuted() -> delivery.PairModel:
    model, order = delivery.shared_words_model(), [2, 0, 1]
    return delivery.PairModel(lambda a, b: model.logits(a, b)[:, order], {i: model.labels[k] for i, k in enumerate(order)})


def two_labels() -> delivery.PairModel:
    model = delivery.shared_words_model()
    return delivery.PairModel(lambda a, b: model.logits(a, b)[:, [2, 1]], {0: "entailment", 1: "not_entailment"})
