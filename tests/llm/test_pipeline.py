from collections import Counter

import pyarrow as pa

import corpus_pipeline as pipeline
from tidemark.llm import decontamination, personal_data, tokens, toxicity
from tidemark.llm.common import table, written

from .cases import documents, rows
from .test_dedup import brute_components


def test_stages_take_effect_and_keep_the_rest(spark, sf):
    docs = table(spark, sf, "documents")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        columns = docs.columns
        docs = written(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        kept[name] = (before, {r.doc_id: r.text for r in docs.collect()})
    before, after = kept["toxicity"]
    model = toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    matcher = toxicity.Matcher(model.terms)
    assert all(after[k] == before[k] for k in after)
    assert all(toxicity.evidence(before[k], matcher)[0] > 0 for k in set(before) - set(after))
    before, after = kept["near copies"]
    want = {c for (d, n, c) in brute_components([(k, t) for k, t in before.items()], 5, 80) if n} | {d for (d, n, _) in brute_components([(k, t) for k, t in before.items()], 5, 80) if not n}
    assert set(after) == want
    before, after = kept["decontamination"]
    items = [(r.item_id, r.text.encode()) for r in table(spark, sf, "benchmark").collect()]
    leaks = decontamination.Searcher(items).search(pa.array(before.values(), pa.string()))
    assert set(after) == {k for k, found in zip(before, leaks) if not found}
    held = {k for k, t in before.items() if any(i.decode() in t for _, i in items)}
    assert not held & set(after)
    before, after = kept["personal data"]
    assert set(before) == set(after)
    assert not any(any(personal_data.base_spans(t)[:2]) for t in after.values())
    last = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    encode = tokens.encoder(tokens.vocabulary_path())
    total = sum(len(x) // 2 + 1 for x in encode(list(after.values())))
    assert sum(r.length for r in last) == total


def test_stages_on_nulls_repeats_long_texts_and_clashing_columns(spark, sf):
    for data in (rows(), []):
        docs = documents(spark, data)
        for _, stage in pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = written(stage(spark, docs, sf), "stage")
            assert docs.columns == columns
        left = docs.collect()
        last = pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert Counter(r.doc_id for r in last if r.start == 0) == Counter(r.doc_id for r in left)
        # Nothing here is toxic or leaked: null and blank texts stay, and of equal texts with words one.
        blank = [d for d, t, *_ in data if not (t or "").strip()]
        assert sorted(map(str, (r.doc_id for r in left if not (r.text or "").strip()))) == sorted(map(str, blank))
        texts = {r.text for r in left if (r.text or "").strip()}
        assert len(texts) == len(left) - len(blank)
