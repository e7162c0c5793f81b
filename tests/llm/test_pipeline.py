"""The pipeline against brute force of its stages."""

import re

import corpus_pipeline
from failtriage.llm import packing, pii

FOLDER = "/root/testdata/sf0.001"


def near_classes(texts):
    """Smallest id that each text reaches by links of shingle similarity."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in texts}


def test_pipeline(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = [r.text.lower() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    left = {i: r.text for i, r in docs.items() if r.text and any(c.isalpha() for c in r.text)}
    first = near_classes(left)
    left = {i: t for i, t in left.items() if first[i] == i}
    left = {i: t for i, t in left.items() if not any(item in t.lower() for item in items)}
    left = {i: pii.masked(t, pii.spans([t.encode()])[0][1]) for i, t in left.items()}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in got} == set(left)
    want = {i: len(d) // 4 for i, d in zip(left, packing.token_bytes([t.encode() for t in left.values()], packing.vocabulary_path()))}
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == want


def test_odd_documents(spark, tmp_path):
    """Null ids, repeated rows, clashing columns, no n_chars, an empty table."""
    said = "the quick brown fox jumps over the lazy dog and then sleeps while other animals of the forest wonder what happened"
    schema = "doc_id long, text string, lang string, source string, score string, rank string, piece string, spans string, _lang string"
    more = ("s", "x", "y", "z", "w", "v")
    rows = [(1, said, "en", *more), (1, said, "en", *more), (2, said + "!", "en", *more), (None, "a text without id " + said[::-1], "en", *more)]
    rows += [(3, None, "en", *more), (4, "", None, *more), (5, "12 34", "en", *more), (6, "mail x.yz@mail.example.com now or never my friend", "en", *more)]
    rows += [(7, "word " * 30_000, "en", *more)]
    spark.createDataFrame([(0, None), (1, "one question that nobody asks of anyone at all today")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, None, 6, 7}
    assert sum(r.piece == 0 for r in got) == 4
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).dtypes == docs.dtypes
