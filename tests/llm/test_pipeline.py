import re
from collections import defaultdict

import pytest
import public_tokenizers
from tokenizers import Tokenizer

from quarry.llm.quality import quality_scores

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(rows, scores, items):
    rows = [r for r in rows if scores[r.doc_id] >= 0.7]
    last = {}
    for r in rows:
        last[r.text or ""] = max(last.get(r.text or "", -1), r.doc_id)
    rows = [r for r in rows if last[r.text or ""] == r.doc_id]
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for _ in sets:
        before = dict(group)
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    rows = [r for r in rows if group[r.doc_id] == r.doc_id]
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {tuple(w[i : i + 13]) for w in (re.findall(word, lower(x.text)) for x in items) if w for i in range(max(1, len(w) - 12))}
    out = {}
    for r in rows:
        w = re.findall(word, lower(r.text))
        hit = {k for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out[r.doc_id] = r.text or ""
    return out


def test_pipeline_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    want = plain(docs.collect(), scores, spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert set(pieces) == set(want)
    for doc, text in want.items():
        n = len(model.encode(text, add_special_tokens=False).ids) + 1
        at = 0
        for start, length, total in sorted(pieces[doc]):
            assert start == at and total == n
            at += length
        assert at == n


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a text", 5, "x"), (2, None, 6, "y"), (3, "", 7, "z")], "doc_id long, text string, n_words int, member string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.count()
