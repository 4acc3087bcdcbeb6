"""The whole corpus pipeline against its stages' rules."""

from collections import defaultdict

import corpus_pipeline
from colonnade.llm import near_copies, pairwise_quality, rules

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    pieces = corpus_pipeline.run(spark, SF).collect()
    accepted = pairwise_quality.accepted(docs, labels)
    good = {r.doc_id for r in rules.rules_table(accepted, labels).collect() if r.kept}
    classes = {r.doc_id: r.class_id for r in near_copies.near_copies(accepted.filter(accepted.doc_id.isin(list(good)))).collect()}
    held = {p.doc_id for p in pieces}
    assert held and held <= good and len({classes[d] for d in held}) == len(held)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end and length > 0
            end += length
        assert end <= 4096
    # every copy of a document is packed whole
    packed, whole = defaultdict(int), {}
    for p in pieces:
        packed[p.doc_id] += p.length
        whole[p.doc_id] = max(whole.get(p.doc_id, 0), p.doc_tokens)
    assert all(packed[d] >= whole[d] for d in held)
