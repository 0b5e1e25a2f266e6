"""Ids beyond the whole numbers of floating point, beside a null id, come back unchanged."""

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillcask.llm import alignment, licenses, mixlm, near, packing, repeats, tokens

BIG = 2**60 + 1
DOCS = [(BIG, "one two three four five six seven"), (BIG - 1, "eight nine ten eleven twelve thirteen"),
        (None, "a text without an id of its own"), (BIG + 2, "released under the MIT License.")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, "web") for d in DOCS], "doc_id long, text string, source string").coalesce(1)


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=repr)


WANTED = sorted((i for i, _ in DOCS), key=repr)


def test_each_operator_returns_the_ids(docs):
    assert ids(near.near_groups(docs)) == WANTED
    assert ids(licenses.license_scan(docs)) == WANTED
    assert ids(packing.pack(docs, 100)) == WANTED
    assert ids(mixlm.score_texts(docs, F.lit(False))) == WANTED
    assert ids(repeats.find_repeats(docs)) == WANTED
    assert ids(alignment.align_tokens(docs)[0]) == WANTED
    packed = tokens.packed_tokens(docs).select(F.explode("segments").alias("s")).select("s.doc_id")
    assert ids(packed) == WANTED


def test_drop_near_keeps_neighbouring_ids(docs):
    assert ids(near.drop_near(docs)) == WANTED


def test_long_runs_of_white_space_are_packed(spark):
    """Two million blanks, line feeds and letters: each comes back token by token."""
    texts = ["x" + " " * 2_000_000 + "y", "\n" * 2_000_000, "z" * 2_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = tokens.packed_tokens(df, width=1 << 20).collect()
    import numpy as np

    parts = {}
    for r in rows:
        found = np.frombuffer(r.ids, "<u2")
        for s, at in zip(r.segments, r.cu_seqlens):
            parts.setdefault(s.doc_id, {})[s.start] = found[at : at + s.length]
    model = Tokenizer.from_file(alignment.VOCABULARIES[0])
    for i, text in enumerate(texts):
        whole = np.concatenate([parts[i][k] for k in sorted(parts[i])])
        assert model.decode(whole[:-1].tolist()) == text and whole[-1] == 50256
