"""Toxicity scores of whole texts by a character n-gram classifier trained on labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from evalspark.llm import ngram_linear
from evalspark.llm.scoring import score_texts, training_sample

#: Most labelled rows that the classifier is fitted on (a bounded sample, chosen by a hash of the id).
MOST_ROWS = 6000
#: Bytes scored at a time.
STRIP = 1 << 18


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS) -> ngram_linear.NgramLinear:
    """Fit on at most ``most_rows`` labelled rows for which ``held_out`` is false.

    Whole texts are learnt: tasks count their n-grams, the driver sees counts and bits only. Null labels and ids are
    left out, as are ids with two labels; repeated ids count once.
    """
    return ngram_linear.fit(training_sample(docs, labels, held_out, id_col, text_col, label_col, most_rows))


def score_toxicity(docs: DataFrame, model: ngram_linear.NgramLinear, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability that a text's toxicity label is 1; every n-gram of every text is read.

    Null and empty texts have the score of a text without n-grams. ``score_col`` wins over a column of the same name.
    """
    return score_texts(docs, model, STRIP, text_col, score_col)
