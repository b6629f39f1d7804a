import hashlib

import corpus_pipeline
from tests.llm import test_minhash, test_mixing_sharding, test_substrings
from tidewell.llm import bpe, common, mixing, quality


def test_against_brute_force(spark, make, corpus, tmp_path, monkeypatch):
    """run() against plain versions of its stages (the classifier's own scores, and the rates of the mix, are taken as they are)."""
    tiktoken = __import__("tiktoken")
    docs = make(corpus)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    known = [(i, int(i % 5 != 0), 0) for i, _, _ in corpus if i is not None]
    known += [*known[:9], (3, 0, 0), (12, None, None), (None, 1, 0)]  # repeated, contradictory, null
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = quality.score(docs, quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()
    keep = {r.doc_id for r in good if r.predicted}
    rows = [r for r in corpus if r[0] in keep]
    kept = {i for i, _, _, k in test_minhash.brute(rows) if k}
    rows = [r for n, r in enumerate(rows) if str(r[0]) in kept and (r[0] is None or r not in rows[:n])]  # repeated rows stay once
    last = (1 << 63) - 1
    seen = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            seen[b[p : p + 50]] = min(seen.get(b[p : p + 50], last), last if i is None else i)
    cut = []
    for i, t, s in rows:
        b = (t or "").encode()
        gone = set()
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < (last if i is None else i):
                gone |= set(range(p, p + 50))
        cut.append((i, None if t is None else bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore"), s))
    want = []
    for r in mixing.copies(make(cut)).collect():
        t = r.text or ""
        want.append((str(r.doc_id), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    c = bpe.codec(common.tokenizer_path(bpe.RANKS))
    e = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in got) == sorted(want)
    assert all(r.ids == e.encode_ordinary(c.decode(r.ids).decode()) and r.n_tokens == len(r.ids) for r in got)
    assert len(got) > 20 and test_substrings and test_mixing_sharding


def test_empty(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns(spark, make, corpus, tmp_path):
    spark.createDataFrame([(0, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = make(corpus, extra=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.names == docs.columns
