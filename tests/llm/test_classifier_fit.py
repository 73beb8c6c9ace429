"""The classifier's fit where keys of documents and of labels repeat."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postingworks.llm import gbt
from postingworks.llm.common import flat

TEXTS = [(k, f"text {k} of key {k} " + "word! " * (i + 1)) for k in range(4) for i in range(30)]
LABELS = [(k, q) for k in range(3) for q in (0, 1, 1)] * 20 + [(3, 1), (0, 7), (None, 1)]


def _frames(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(4), spark.createDataFrame(LABELS, "doc_id long, quality int")


def _fitted(spark, monkeypatch, **kw):
    seen, fit = [], gbt.fit_trees
    with monkeypatch.context() as m:
        m.setattr(gbt, "fit_trees", lambda x, y: seen.append((x, y)) or fit(x, y))
        gbt.fit_classifier(*_frames(spark), **kw)
    return seen[0]


def test_each_text_is_measured_once(spark, monkeypatch):
    measured, plain = spark.sparkContext.accumulator(0), gbt.statistics

    def counted(data, at):
        measured.add(len(at) - 1)
        return plain(data, at)

    monkeypatch.setattr(gbt, "statistics", counted)
    gbt.fit_classifier(*_frames(spark))
    assert measured.value == len(TEXTS)


def test_repeated_labels_count_each(spark, monkeypatch):
    """The rows are those of a plain join, in its order, up to the limit."""
    docs, labels = _frames(spark)
    plain = docs.join(labels.where("quality in (0, 1)"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("text")).collect()
    assert len(plain) == 3 * 30 * 60 + 30
    for n in (len(plain), 2000, 1801, 1):
        x, y = _fitted(spark, monkeypatch, sample_rows=n)
        want = plain[:n]
        measured = gbt.statistics(*flat(pa.array([r.text for r in want])))
        key = lambda a, b: np.column_stack([a, b])[np.lexsort([*a.T, b])]
        assert y.tolist().count(1.0) == sum(r.quality for r in want)
        assert np.array_equal(key(x, y), key(measured, np.array([float(r.quality) for r in want])))


def test_rows_of_all_tasks_do_not_meet_at_the_driver(spark, monkeypatch):
    seen, kind = [], type(spark.range(1))
    plain = kind.toPandas
    monkeypatch.setattr(kind, "toPandas", lambda self: seen.append(self) or plain(self))
    gbt.fit_classifier(*_frames(spark))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    # As the root of a plan it would send the limit's rows of each task to the driver.
    assert "TakeOrderedAndProject" in plan and "Coalesce" in plan[: plan.index("TakeOrderedAndProject")]
