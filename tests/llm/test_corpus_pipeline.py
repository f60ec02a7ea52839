"""Every stage against its operator's brute force, on the rows that the stage before it kept."""

from collections import defaultdict

import numpy as np
from test_simhash import brute_components
from test_tokens import check_pieces
from tokenizers import Tokenizer

import corpus_pipeline
from visitflow.llm.quality import judge, language_references
from visitflow.llm.queries import WORD_VOCABULARY
from visitflow.llm.toxicity import fit_toxicity
from visitflow.session import materialize


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "SimHash near-dedup", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        following = materialize(stage(spark, docs, sf), "stage")
        if name == "quality rules":
            references = language_references(docs)
            expected = {k for k, r in rows.items() if judge(r.text, references)[-1]}
        elif name == "toxicity":
            model = fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            expected = {k for k, r in rows.items() if model.grade_chances([r.text])[0, 0] < 0.5}
        elif name == "SimHash near-dedup":
            pairs = [(k, r.text) for k, r in rows.items()]
            expected = set(brute_components(pairs)[1])
        else:
            library = Tokenizer.from_file(WORD_VOCABULARY)
            ids = defaultdict(list)
            for k, r in rows.items():
                ids[k].append(np.append(library.encode(r.text, add_special_tokens=False).ids, 2).astype("<u4"))
            check_pieces(following.collect(), ids, 4096)
            break
        assert following.columns == docs.columns
        kept = {r.doc_id: r for r in following.collect()}
        assert set(kept) == expected and 0 < len(kept) <= len(rows)
        assert all(kept[k] == rows[k] for k in kept)
        docs, rows = following, kept


def test_odd_documents_and_no_documents(spark, edge_docs, no_docs, sf):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf), "stage")
        assert docs.columns[0] == "doc_id"
