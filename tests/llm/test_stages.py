"""The stages of the pipeline on rows with odd column names, null and repeated ids, and no rows."""

import os

import numpy as np
import pytest

import corpus_pipeline
from tripweave.llm import decontaminate

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
NAMES = ["spans", "n_bytes", "n_removed", "__n", "__id", "kept_text", "__tid", "__text", "__features", "__full", "__rest", "__row", "__c", "__bad",
         "__null", "is_null", "a.b", "tick`ed", "two words", "fp", "component_id", "tid", "hits", "r", "column_0", "column_7", "__slice", "__domain", "item"]


@pytest.fixture(scope="module")
def plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()]
    rows += [rows[5], rows[5], (None, rows[7][1], None, None, 3), (None, "", "en", None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, docs.schema)


def odd(docs):
    rows = [(*r, *(f"{n}-{r.doc_id}" for n in NAMES)) for r in docs.collect()]
    text = docs.schema.simpleString()[7:-1].replace(":", " ")
    more = ", ".join("`" + n.replace("`", "``") + "` string" for n in NAMES)
    return docs.sparkSession.createDataFrame(rows, f"{text}, {more}")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_takes_any_column_name(spark, plain, name, stage):
    want = stage(spark, plain, SF)
    got = stage(spark, odd(plain), SF)
    assert got.columns == plain.columns + NAMES + want.columns[len(plain.columns):]
    rows = got.collect()
    assert all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in NAMES)
    keep = [got.columns.index(c) for c in want.columns]
    assert sorted(repr(tuple(r[i] for i in keep)) for r in rows) == sorted(repr(tuple(r)) for r in want.collect())
    assert stage(spark, odd(plain.limit(0)), SF).count() == 0


def test_rows_without_id_are_judged_by_their_own_text(spark):
    words = ["w%d" % x for x in np.random.default_rng(2).integers(0, 900, 60)]
    item = " ".join(words[10:30])
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(None, "a " + item + " b"), (None, " ".join(words[30:])), (7, item), (7, "nothing of it"), (None, None), (8, "")],
                                 "doc_id bigint, text string")
    left = [(r.doc_id, r.text) for r in decontaminate.drop_leaking(docs, items).collect()]
    assert sorted(left, key=repr) == sorted([(None, " ".join(words[30:])), (7, "nothing of it"), (None, None), (8, "")], key=repr)
