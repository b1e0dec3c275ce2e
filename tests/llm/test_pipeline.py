"""The pipeline's stages, each judged on its own input."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    room = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{room}/{name}")
        docs = spark.read.parquet(f"{room}/{name}")
        out.append(docs)
    return out


def grams(text):
    """Distinct runs of five words, A-Z lower-cased; a shorter text is one run."""
    words = (text or "").encode().lower().split()
    size = min(5, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def test_stages_keep_the_columns_and_only_shrink(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    sizes = [s.count() for s in steps]
    assert sizes == sorted(sizes, reverse=True) and sizes[1] == sizes[2] and sizes[4] == sizes[5]


def test_near_duplicates_leave_one_of_each_class(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[2].select("doc_id", "text").collect()]
    sets = [grams(t) for _, t in rows]
    least = list(range(len(rows)))
    near = [[j for j, y in enumerate(sets) if x == y or 5 * len(x & y) >= 4 * len(x | y)] for x in sets]
    while True:  # spread the smallest id over links until nothing changes
        new = [min((least[j] for j in near[i]), key=lambda j: rows[j][0]) for i in range(len(rows))]
        if new == least:
            break
        least = new
    assert {r["doc_id"] for r in steps[3].collect()} == {rows[j][0] for j in least}


def test_ids_decode(steps):
    for r in steps[5].collect():
        assert len(r["ids"]) == 4 * r["n_tokens"]
