"""Quality scores of whole texts by a byte-level convolutional network trained on labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from evalspark.llm import byte_cnn
from evalspark.llm.scoring import collected, score_texts, training_sample

#: Most labelled rows, and bytes of all their texts, that the network is fitted on (a bounded sample of whole texts,
#: chosen by a hash of the id).
MOST_ROWS, MOST_BYTES = 6000, 64 << 20
#: Bytes scored at a time.
STRIP = 1 << 20


def fit_quality(docs: DataFrame, labels: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> byte_cnn.ByteCnn:
    """Fit on at most ``most_rows`` labelled rows of ``most_bytes`` together for which ``held_out`` is false.

    Whole texts are learnt. Null labels and ids are left out, as are ids with two labels; repeated ids count once.
    """
    return byte_cnn.fit(*collected(training_sample(docs, labels, held_out, id_col, text_col, label_col, most_rows), most_bytes))


def score_quality(docs: DataFrame, model: byte_cnn.ByteCnn, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability that a text's quality label is 1; every byte of every text is read.

    Null and empty texts have the score of an empty text. ``score_col`` wins over a column of the same name.
    """
    return score_texts(docs, model, STRIP, text_col, score_col)
