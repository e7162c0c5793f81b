"""Whitening, hard negatives and the trie encoder against numpy, brute force and the tokenizers library."""

import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from failtriage.llm import bpe, negatives, packing, whitening

NAN, INF = float("nan"), float("inf")
#: Names that clash with those that operators use.
CLASHING = "vec_id long, embedding array<float>, label int, key string, size string, tile string, anchor string, rank string, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "a", "b", "c", "d", "e", "f") for i, v, l in rows], CLASHING)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 12) + (i % 3)], int(rng.integers(0, 4))) for i in range(0, 330)]
    rows += [(50, rows[50][1], rows[50][2]), (7, rows[7][1], rows[7][2]), (400, rows[50][1], rows[50][2]), (401, rows[50][1], 9)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.5] * 3, 1), (503, [NAN] * 12, 1), (504, [INF] + [0.0] * 11, 2)]
    return rows + [(505, [None] + [0.0] * 11, 2), (550, rows[3][1], None), (None, rows[4][1], 2)]


def usable(rows):
    return [r for r in rows if r[1] is not None and len(r[1]) == 12 and all(x is not None and math.isfinite(x) for x in r[1])]


# --- whitening ------------------------------------------------------------------


@pytest.mark.parametrize("values", [
    [1.0], [3.0, 3.0], [1.0, 2.0, 3.0], [5.0, 5.0, 5.0, 1.0, 1.0], list(range(1, 65)), [1e6, 1.0, 1e-6, 1e-6, 0.0],
    [0.0, 0.0, 0.0], [-2.0, 0.0, 2.0, 2.0], [1 + 1e-9 * k for k in range(9)],
])
def test_spectrum_by_division(values):
    n = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((n, n)))
    a = (q * np.array(values)) @ q.T
    a = (a + a.T) / 2
    found, axes = whitening.spectrum(a)
    scale = max(abs(v) for v in values) or 1.0
    assert np.allclose(axes.T @ axes, np.eye(n), atol=1e-13)
    assert np.abs(a @ axes - axes * found).max() <= 1e-13 * n * scale
    assert np.abs(np.sort(found) - np.sort(values)).max() <= 1e-13 * n * scale


def test_polar_factor():
    a = np.random.default_rng(1).standard_normal((20, 20))
    a = a + a.T
    u = whitening.polar(a)
    values, axes = np.linalg.eigh(a)
    assert np.allclose(u, (axes * np.sign(values)) @ axes.T, atol=1e-12)


def test_whitening_of_odd_vectors(spark, odd_vectors):
    rows = whitening.whitened(vectors(spark, odd_vectors)).toPandas()
    kept = usable(odd_vectors)
    x = np.floor(1024 * np.array([r[1] for r in kept])).astype(int).astype(object) + 100_000
    sums, n = x.sum(axis=0), len(x)
    centred = (x - sums / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(rows) == 8 * n and set(rows["n"]) == {n} and rows["identity_error"].max() < 1e-9
    assert rows["vec_id"].isna().sum() == 8  # the null id stays
    own = rows[rows["component"] == 1]
    expected = sorted(int(v) for v in ((n * x - sums) ** 2).sum(axis=1))
    assert sorted(int(v) for v in own["deviation"]) == expected
    by_id = {r[0]: k for k, r in enumerate(kept)}
    for vec_id, part in rows[rows["vec_id"].notna()].groupby("vec_id"):
        got = part.sort_values("component")["whitened"].abs().to_numpy()[: 8]
        want = np.abs(centred[by_id[int(vec_id)]] @ axes[:, :8] / np.sqrt(values[:8]))
        assert np.allclose(np.sort(got), np.sort(np.tile(want, len(part) // 8))[: 8] if len(part) == 8 else np.sort(got), atol=1e-8)
    shares = own["explained"].iloc[0]
    assert abs(shares - values[0] / values.sum()) < 1e-12


def test_whitening_without_variance_or_rows(spark):
    same = whitening.whitened(vectors(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)])).collect()
    assert [(r["vec_id"], r["component"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in sorted(same)] == [
        (i, c, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)
    ]
    assert whitening.whitened(vectors(spark, [(1, None, 1), (2, [NAN], 1)])).collect() == []
    line = whitening.whitened(vectors(spark, [(1, [0.0, 0.0], 1), (2, [1.0, 1.0], 1), (3, [2.0, 2.0], 1)])).toPandas()
    assert line[line["component"] == 2]["whitened"].isna().all() and line["identity_error"].max() < 1e-9


def test_sums_of_large_components_are_exact():
    z = np.random.default_rng(2).integers(-(1 << 40), 1 << 40, (50, 4))
    assert (whitening.gram(z) == z.astype(object).T @ z.astype(object)).all()


# --- hard negatives -------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 33, 33), (70, 64, 129), (200, 65, 33), (0, 64, 40), (129, 300, 257)])
@pytest.mark.parametrize("largest", [300, 1 << 24, 1 << 27])
def test_strassen_is_exact(shape, largest):
    m, k, n = shape
    rng = np.random.default_rng(m + k)
    a, b = rng.integers(-largest, largest, (m, k)), rng.integers(-largest, largest, (k, n))
    assert (negatives.strassen(a, b) == a @ b).all()


def brute_negatives(rows, every=50):
    kept = [(i, np.floor(256 * np.array(v)).astype(int), l) for i, v, l in usable(rows) if i is not None and l is not None]
    out = []
    for k, (anchor, x, label) in enumerate(kept):
        if anchor % every:
            continue
        scored = [(-int(x @ y), i, l) for j, (i, y, l) in enumerate(kept) if j != k]
        for s, positive, _ in sorted(r for r in scored if r[2] == label)[:5]:
            near = sorted(r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s)[:3]
            out += [(anchor, positive, rank + 1, i, -s, -t) for rank, (t, i, _) in enumerate(near)]
    return sorted(out)


def test_negatives_of_odd_vectors(spark, odd_vectors, monkeypatch):
    expected = brute_negatives(odd_vectors)
    assert len(expected) > 50
    table = vectors(spark, odd_vectors)
    assert sorted(map(tuple, negatives.mine(table.repartition(3)).collect())) == expected
    # Blocks of two anchors, tiles of a few rows.
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 2 * 12 * 8)
    monkeypatch.setattr(negatives, "TILE", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 1)
    assert sorted(map(tuple, negatives.mine(table.repartition(3)).collect())) == expected


def test_negatives_without_anchors_or_rows(spark):
    assert negatives.mine(vectors(spark, [(1, [1.0], 1), (2, [1.0], 2)])).collect() == []
    assert negatives.mine(vectors(spark, [(50, [1.0], 1), (2, [1.0], 2)])).collect() == []
    assert negatives.mine(vectors(spark, [(50, None, 1)])).collect() == []
    ties = [(i, [1.0, 0.0], 1 if i <= 50 else 2) for i in range(40, 60)] + [(70 + i, [0.75, 0.0], 2) for i in range(9)]
    assert sorted(map(tuple, negatives.mine(vectors(spark, ties)).collect())) == brute_ties(ties)


def brute_ties(rows):
    kept = [(i, np.floor(256 * np.array(v)).astype(int), l) for i, v, l in rows]
    x = dict((i, v) for i, v, _ in kept)
    positives = sorted((-int(x[50] @ v), i) for i, v, l in kept if l == 1 and i != 50)[:5]
    out = []
    for s, p in positives:
        near = sorted((-int(x[50] @ v), i) for i, v, l in kept if l == 2 and 50 * -s <= 100 * int(x[50] @ v) <= 95 * -s)[:3]
        out += [(50, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(near)]
    return sorted(out)


# --- encoding -------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(8)
    letters = "etaoin shrdlu ETA  ''\n\t.,-0123456789<|>_éßñ日本語кирил́\U0001f600 \x00\x85ſ�ꟋᲉ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "don't we'LL I'm", " " * 300, "\n\n\n a"]
    texts += ["a" * 5_000, "the " * 20_000, "".join(rng.choice("ab") for _ in range(3_000)), "=" * 700 + "-" * 513]
    return texts + ["", "x", "x"]


def test_ids_equal_those_of_the_library(odd_texts):
    path = bpe.vocabulary_path()
    library = Tokenizer.from_file(path)
    found = list(bpe.token_bytes([t.encode() for t in odd_texts], path))
    for text, packed in zip(odd_texts, found):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_all_pairs_of_some_tokens():
    """Two tokens can follow each other exactly when the library gives them back for their text."""
    known = bpe.Vocabulary(bpe.vocabulary_path())
    library = Tokenizer.from_file(bpe.vocabulary_path()).model
    letters = {b: c for c, b in bpe._byte_letters().items()}
    rng = random.Random(4)
    some = [rng.randrange(50_256) for _ in range(150)] + list(range(0, 300, 3))
    for a in some:
        for b in rng.sample(some, 40):
            text = "".join(letters[x] for x in known.bytes_of[a] + known.bytes_of[b])
            assert known.can_follow(a, b) == ([t.id for t in library.tokenize(text)] == [a, b])


def test_round_trip_of_a_table(spark, odd_texts):
    schema = "ids string, doc_id long, text string, key string, decoded string"
    rows = [("i", k, t, "k", "d") for k, t in enumerate(odd_texts)] + [("i", None, None, "k", "d"), ("i", 0, odd_texts[0], "k", "d")]
    table = spark.createDataFrame(rows, schema)
    got = bpe.decode(bpe.encode(table), text="decoded").collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["decoded"]) for r in got) == sorted(
        (k is None, k or 0, t or "") for _, k, t, _, _ in rows
    )
    assert bpe.encode(table.limit(0)).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(bpe.vocabulary_path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_checksums_of_packed_pieces(spark, odd_texts, name):
    """The pieces of a document are the ids of the library, cut."""
    path = packing.vocabulary_path(name)
    assert packing.word_by_word(path) == name.startswith("word")
    library = Tokenizer.from_file(path)
    table = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string")
    rows = {(r["doc_id"], r["piece"]): r for r in packing.pack(table, path).collect()}
    for k, text in enumerate(odd_texts):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            row = rows.pop((k, piece))
            part = ids[at : at + 2048]
            assert (row["start"], row["length"], row["ids_crc32"]) == (at, len(part), zlib.crc32(part.tobytes()))
    assert not rows
