"""Parameters of the batch pipeline, as frozen values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # fixed values: lengths, thresholds and prices that results depend on
    min_headline_chars: int = 12
    max_headline_chars: int = 300
    num_perm: int = 128
    lsh_threshold: float = 0.8
    shingle_size: int = 3
    max_body_chars: int = 4000
    min_post_chars: int = 5
    test_size: float = 0.15
    val_size: float = 0.15
    seed: int = 42
    word_ngram_max: int = 2
    char_ngram_min: int = 3
    char_ngram_max: int = 5
    max_features: int = 200_000
    lr_iterations: int = 2000
    gbt_trees: int = 400
    gbt_rate: float = 0.05
    gbt_leaves: int = 63
    body_window_sents: int = 4
    max_windows: int = 6
    n_samples: int = 3
    max_headlines: int = 500
    max_usd_per_run: float = 5.0
    input_usd_per_mtok: float = 5.0
    output_usd_per_mtok: float = 25.0
    min_gold_alpha: float = 0.6
    student_temperature: float = 2.0
    intensity_loss_weight: float = 1.0
    taxonomy_loss_weight: float = 0.5
    binary_loss_weight: float = 0.5


PARAMS = Params()
