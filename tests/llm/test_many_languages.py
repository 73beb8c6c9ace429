"""Languages beyond the 128th and the 256th."""

import numpy as np

from postingworks.llm import langid


def test_viterbi_with_many_languages():
    want = np.array([3, 150, 150, 299])
    emit = np.full((4, 300), -50.0)
    emit[np.arange(4), want] = 0
    assert langid._viterbi(emit, np.zeros(4, np.int64), 1, 2.0).tolist() == want.tolist()


def test_every_language_is_learned(spark):
    names = [f"l{i:03}" for i in range(260)]
    docs = spark.createDataFrame([(i, f"text {i}", s) for i, s in enumerate(names)], "doc_id long, text string, lang string")
    assert langid.fit_languages(docs).langs == names
