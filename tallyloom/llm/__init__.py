"""Operators for training-data pipelines, each with its query and, where SQL can express it, its SQL."""

from . import (  # noqa: F401
    decontaminate,
    fill_middle,
    html_text,
    lm_score,
    mixing,
    quality,
    repeats,
    setjoin,
    token_counts,
    token_files,
    topk,
    url_filter,
    whitening,
)
from .registry import ORACLES, QUERIES  # noqa: F401
