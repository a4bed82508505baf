"""Each stage of the corpus pipeline on its own input, against plain Python."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from bookflow.llm.common import held
from tests.llm import brute


@pytest.mark.parametrize("case", ["hard", "small"])
def test_stages(spark, tmp_path, case):
    if case == "hard":
        path = brute.table(spark, tmp_path, brute.hard_rows())
    else:
        path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = held(stage(spark, docs, path), "out")
        assert out.columns == columns and out.dtypes == docs.dtypes
        before, after = ([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in x.collect()] for x in (docs, out))
        if name == "quality rules":
            for r in before:
                w = brute.words(r[1])
                if len(w) < 50 or 100 * brute.repeated(w) > 50 * len(w):
                    assert r not in after
            assert not Counter(after) - Counter(before)
        elif name == "line dedup":
            assert sorted((r[0], r[1]) for r in after) == sorted((i, t) for i, _, _, t in brute.deduped(before))
            assert all(r[4] == len(r[1]) for r in after)
        elif name == "n-gram join":
            groups = brute.near_groups([r for r in before if r[0] is not None])
            assert Counter(r[0] for r in after) == Counter({i: 1 for i, (c, _) in groups.items() if c == i})
        else:
            size, target = brute.targets(before)
            words, times, whole = {}, Counter(), {r[0]: brute.words(r[1]) for r in before}
            words = defaultdict(int)
            for i, text, _, source, n in after:
                w = brute.words(text)
                words[source] += len(w)
                times[i] += len(w)
                assert n == len(text) and w and not Counter(w) - Counter(whole[i])
            assert all(times[i] <= 2 * len(whole[i]) for i in times)
            assert all(abs(words[s] - target[s]) <= 3 * 128 for s in size)
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert sum(r.length for r in pieces) >= docs.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
