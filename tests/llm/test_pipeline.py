"""The pipeline's stages against plain versions of what they decide."""

from collections import Counter

import corpus_pipeline
from levelstone.llm import quality, secrets
from levelstone.llm.queries import vocabulary_path

from .cases import documents, frame
from .test_corpus import components, library, shingle_set, water


def test_stages_and_run(spark, tmp_path):
    rows = [r for r in documents() if r[0] != 11]
    docs = frame(spark, rows, extra=False).selectExpr("*", "cast(length(text) as bigint) as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2)) for i in range(1, 140)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "bpe"]

    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    model = quality.train(d, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [r for r, s in zip(d.collect(), quality.score(d, model).collect()) if s.predicted == 1]
    first = stages["quality"](spark, d, str(tmp_path))
    assert first.columns == d.columns and sorted(map(str, first.collect())) == sorted(map(str, kept))

    second = stages["near_dedup"](spark, d, str(tmp_path)).collect()
    want = components({r.doc_id: shingle_set(r.text) for r in d.collect() if r.doc_id is not None})
    assert sorted(r.doc_id for r in second if r.doc_id is not None) == sorted(i for i, c in want.items() if i == c)

    model_ = secrets.default_model(vocabulary_path())
    third = {(r.doc_id, r.source): r.text for r in stages["secrets"](spark, d, str(tmp_path)).collect()}
    for r in d.collect():
        text = r.text
        for a, b, _, s in reversed(secrets.scan(text, r.source or "", model_) if text else []):
            text = text[:a] + "<SECRET>" + text[b:] if s >= 0.5 else text
        assert third[r.doc_id, r.source] == text

    want = plain_mix([(r.doc_id, r.text, r.source) for r in d.collect()])
    assert Counter((r.doc_id, r.text) for r in stages["mixing"](spark, d, str(tmp_path)).collect()) == want
    fourth = stages["mixing"](spark, d, str(tmp_path))
    assert fourth.columns == d.columns and {r.doc_id for r in fourth.collect()} <= {r.doc_id for r in d.collect()}
    t, texts = library(), {r.doc_id: r.text or "" for r in d.where("doc_id is not null").collect()}
    for r in stages["bpe"](spark, d, str(tmp_path)).where("doc_id is not null").collect():
        assert r.n_tokens == len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, out.collect())) == plain_run([tuple(r) for r in kept], model_, t)


def plain_mix(rows):
    """(doc_id, text) as often as the mix takes it: water filling, digest order, whole and partial takes counted alike."""
    import hashlib
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    sizes = [sum(size(t) for _, t, s in rows if s == n) for n in names]
    out = Counter()
    for name, total, target in zip(names, sizes, water(sizes, [1 + i % 3 for i in range(len(names))])):
        turns, start = (int(target // total), 0) if total else (0, 0)
        own = sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), size(t), i, t) for i, t, s in rows if s == name) if all(t is not None for _, t, s in rows if s == name) else sorted(((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), size(t), i, t) for i, t, s in rows if s == name), key=lambda x: x[:2])
        for _, n, i, t in own:
            taken = turns * n + max(0, min(n, int(target - turns * total) - start))
            start += n
            if taken:
                out[i, t] += -(-taken // n)
    return out


def plain_run(rows, model, tokenizer):
    """The stages after the classifier, in plain Python, over rows (doc_id, text, lang, source, ...) that it keeps."""
    import hashlib

    want = components({i: shingle_set(t) for i, t, *_ in rows if i is not None})
    rows = [r for r in dict.fromkeys(r for r in rows if r[0] is not None and want[r[0]] == r[0])] + [r for r in rows if r[0] is None]
    clean = []
    for i, text, _, source, *_ in rows:
        for a, b, _, s in reversed(secrets.scan(text, source or "", model) if text else []):
            text = text[:a] + "<SECRET>" + text[b:] if s >= 0.5 else text
        clean.append((i, text, source))
    out = Counter()
    for (i, text), n in plain_mix(clean).items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False))]
        out[(i, len(ids), *digests)] += n
    return out
