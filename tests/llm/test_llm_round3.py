"""Rank BPE, vector codes and whitening against plain versions, and at their edges."""

import base64
import hashlib
import math
import os
import random
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from paceline.llm import queries, rowmerge, vectorcodes, whitening

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
EDGES = [None, "", " \n\t ", "a", "one two three", "é " * 40, "x\x1cy\x85z", "word " * 5000, "<|endoftext|>", "中文 🙂 ½ ²", "a" * 3000, "=" * 700, "ab" * 2000 + " end", "don't  we'll\n\n've"]
VECTORS = "vec_id long, embedding array<double>, label int, error long, component int, x binary"


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def ranked(request):
    path = public_tokenizers.path(request.param)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, b"x") for i, v, label in rows], VECTORS)


# op 11 ------------------------------------------------------------------------------------------------------


def random_texts(rng, n):
    kinds = [(32, 127), (97, 100), (160, 0x600), (0x4E00, 0x5000), (0x1F300, 0x1F650)]
    return ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(120))) for _ in range(n)]


def test_matrices_merge_as_the_library_does(ranked):
    path, library = ranked
    v = rowmerge.Ranks(path)
    texts = [t or "" for t in EDGES] + random_texts(random.Random(5), 400)
    for text, raw in zip(texts, v.encode(texts), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert v.decode(ids) == library.decode_bytes(ids) == text.encode()


def test_long_and_short_paths_agree(ranked, monkeypatch):
    """The heap of long pre-tokens, matrices of a few rows, and a vocabulary without its cache give the same ids."""
    v, rng = rowmerge.Ranks(ranked[0]), random.Random(6)
    words = [bytes(rng.choice(b"abcdet\xc3\xa9") for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    want = [x.tolist() for x in v.merged(words)]
    monkeypatch.setattr(rowmerge, "CELLS", 600)
    assert [x.tolist() for x in v.merged(words)] == want
    assert [v._heap(w).tolist() for w in words] == want


def test_pair_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 50, 5000).astype(np.uint64))
    t = rowmerge.PairTable(keys, np.arange(len(keys), dtype=np.int32))
    assert (t.look_up(keys >> np.uint64(32), keys & np.uint64(2**32 - 1)) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 50, 5000).astype(np.uint64), keys)
    assert (t.look_up(other >> np.uint64(32), other & np.uint64(2**32 - 1)) == rowmerge.NONE).all()
    assert (rowmerge.PairTable(keys[:0], np.zeros(0, np.int32)).look_up(keys[:3], keys[:3]) == rowmerge.NONE).all()


def test_rank_frames(spark):
    rows = [(None if k == 4 else 7 if k in (5, 6) else k, t, "ids", 1) for k, t in enumerate(EDGES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    encoded = rowmerge.encode(docs)
    assert encoded.columns == ["doc_id", "ids"]
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    back = sorted(((r.doc_id, bytes(r.data)) for r in rowmerge.decode(encoded).collect()), key=key)
    assert back == sorted(((i, (t or "").encode()) for i, t, *_ in rows), key=key)
    trip = sorted(((r.doc_id, r.decoded_sha256) for r in rowmerge.round_trip(docs).collect()), key=key)
    assert trip == sorted(((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows), key=key)
    assert rowmerge.round_trip(docs.limit(0)).collect() == [] and rowmerge.encode(docs.limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(rowmerge.decode(nothing).head().data) == b""


@tables
def test_op11_whole_table(spark):
    path = rowmerge.DEFAULT
    with open(path, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    want = {}
    for i, text in duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall():
        ids = library.encode_ordinary(text)
        want[i] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_rank_matrix_bpe(spark, SF).collect()} == want


# op 12 ------------------------------------------------------------------------------------------------------


def codes_plain(rows):
    """By the contract, with Python's integers; rows: (vec_id, vector, label) with vectors of one length, a multiple of 4."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 4
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))[:256]
    out, books = [["", 0] for _ in kept], []
    for j in range(4):
        parts = [z[j * width : (j + 1) * width] for _, z, _ in kept]
        book = [z[j * width : (j + 1) * width] for _, z, _ in first]
        near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), e) for e, c in enumerate(book))  # noqa: B023, E731
        for _ in range(4):
            groups = {}
            for p in parts:
                groups.setdefault(near(p)[1], []).append(p)
            book = [[sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)] if e in groups else c for e, c in enumerate(book)]
        for o, p in zip(out, parts, strict=True):
            d, e = near(p)
            o[0], o[1] = o[0] + f"{e:02x}", o[1] + d
        books += [x for c in book for x in c]
    total = {}
    for (_, _, label), (_, e) in zip(kept, out, strict=True):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted(((i, c, e, total[label], digest) for (i, _, label), (c, e) in zip(kept, out, strict=True)), key=str)


def test_codes_against_plain(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * rng.randrange(5) / 700 + rng.random() * (i % 3) for _ in range(8)], rng.choice([1, 2, None])) for i in range(330)]
    rows += [(1000 + i, rows[3][1], 2) for i in range(150)]  # a hot vector
    rows += [(2000, None, 1), (2001, [None] * 8, 1), (2002, [math.nan] * 8, 1), (2003, [0.0] * 7 + [math.inf], None), (-5, [0.0] * 8, None), (None, [0.25] * 8, 3)]
    got = sorted((tuple(r) for r in vectorcodes.compress(vectors(spark, rows).repartition(5)).collect()), key=str)
    assert got == codes_plain(rows)


def test_codes_at_edges(spark):
    assert vectorcodes.compress(vectors(spark, [(1, None, 1), (2, [], 1), (3, [None], 1)])).collect() == []
    few = [(1, [0.5, 0.25, -1.0, 2.0], 1), (1, [0.5, 0.25, -1.0, 2.0], None), (2, [9.0, 9.0, 9.0, 9.0], None), (7, [1.0], 1), (8, [], 1)]  # the last two have other lengths
    assert sorted((tuple(r) for r in vectorcodes.compress(vectors(spark, few)).collect()), key=str) == codes_plain(few[:3])
    odd = vectorcodes.compress(vectors(spark, [(1, [1.0] * 5, 1), (2, [2.0] * 5, 1)])).collect()
    assert sorted(r.code for r in odd) == ["00000000", "01010100"] and {r.error for r in odd} == {0}
    large = [(i, [float(1 << 29) * i, 1e300, -1e300, 0.1], 1) for i in range(3)]
    assert len(vectorcodes.compress(vectors(spark, large)).collect()) == 3


def test_nearest_is_exact_beyond_doubles():
    rng = random.Random(4)
    values = np.array([[rng.randrange(-(1 << 40), 1 << 40) for _ in range(3)] for _ in range(50)], np.int64)
    book = np.concatenate([values[:5] + 1, values[:5] - 1, values[:5] + 1])
    index, error = vectorcodes.nearest(values, book)
    for v, i, e in zip(values.tolist(), index.tolist(), error.tolist(), strict=True):
        d, k = min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(book.tolist()))
        assert (i, e) == (k, min(d, 1 << 60))


@tables
def test_op12_equals_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = db.sql(queries.ORACLES["op12_vector_codes"])
    got = queries.op12_vector_codes(spark, SF)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# op 13 ------------------------------------------------------------------------------------------------------


def exact_covariance(rows):
    """n, sums and covariance as fractions; rows of doubles."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    y = [[n * r[i] - s[i] for i in range(d)] for r in x]
    return n, y, [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]


def check_whitened(got, rows):
    """got: whiten()'s rows by vec_id; rows: vec_id to vector."""
    ids = sorted(rows)
    n, y, v = exact_covariance([rows[i] for i in ids])
    d, trace = len(v), sum(v[i][i] for i in range(len(v)))
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert sorted(by) == ids
    assert all([r.component for r in sorted(by[i], key=lambda r: r.component)] == list(range(1, min(32, d) + 1)) for i in ids)
    assert {r.n for r in got} == {n} and {(r.vec_id, r.deviation) for r in got} == {(i, sum(e * e for e in row)) for i, row in zip(ids, y, strict=True)}
    w = np.array([[r.whitened for r in sorted(by[i], key=lambda r: r.component)] for i in ids])
    values = np.linalg.eigvalsh(np.array([[float(c) for c in row] for row in v]))[::-1][: w.shape[1]]
    explained = [r.explained for r in sorted(by[ids[0]], key=lambda r: r.component)]
    assert np.allclose(explained, values / float(trace), rtol=1e-9)
    assert np.abs(w.T @ w / n - np.eye(w.shape[1])).max() < 1e-9 and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    # each column is the projection on a unit vector over sqrt(e): V^-1/2's Gram matrix gives all distances within the components when d <= 32
    if d <= 32:
        centred = np.array([[float(Fraction(e, n)) for e in row] for row in y])
        assert np.allclose(w @ w.T, centred @ np.linalg.inv(np.array([[float(c) for c in row] for row in v])) @ centred.T, atol=1e-6)


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(260, 6)) @ rng.normal(size=(6, 6)) + 5
    rows = {i: v.tolist() for i, v in enumerate(mixed)}
    frame = [(i, v, None) for i, v in rows.items()] + [(900, None, 1), (901, [1.0] * 5 + [math.nan], 1), (902, [1.0] * 5 + [None], 1), (903, [2.0], 1)]
    check_whitened(whitening.whiten(vectors(spark, frame).repartition(3)).collect(), rows)


def test_products_are_exact(spark):
    """Sums far beyond 2**53, and centred values beyond 64 bits."""
    rng = random.Random(8)
    for size, n in ((1e3, 40), (2.0**30, 30)):
        rows = [[rng.uniform(-size, size) for _ in range(5)] for _ in range(n)]
        df = whitening.integers(vectors(spark, [(i, v, 1) for i, v in enumerate(rows)]).repartition(3), 5)
        sums = whitening.sums_of(df, 5)
        _, y, _ = exact_covariance(rows)
        want = [[sum(r[i] * r[j] for r in y) for j in range(5)] for i in range(5)]
        assert whitening.products(df, 5, sums).tolist() == want
        wide = whitening.Sums(sums.n, sums.sums, 1 << 63)  # the same by Python's integers
        assert whitening.products(df, 5, wide).tolist() == want
        assert wide.centred(np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in rows], np.int64)).tolist() == y


def test_limbs():
    rng = random.Random(9)
    y = np.array([[rng.randrange(-(1 << 61), 1 << 61) for _ in range(4)] for _ in range(50)] + [[-(1 << 61), 1 << 61, 0, -1]], np.int64)
    limbs = whitening.cut(y, 4)
    assert all(np.abs(x).max() <= 1 << whitening.LIMB for x in limbs)
    assert (sum(x.astype(object).astype(int).astype(object) * (1 << whitening.LIMB * k) for k, x in enumerate(limbs)) == y.astype(object)).all()


def test_whitening_at_edges(spark):
    assert whitening.whiten(vectors(spark, [(1, None, 1), (2, [], 1)])).collect() == []
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 1)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    flat = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 1), (1, [3.0, 2.0], 1), (None, [5.0, 2.0], 1)])).collect()  # no variance in the second dimension
    assert len(flat) == 6 and all(r.whitened == 0 and r.explained == 0 for r in flat if r.component == 2) and flat[0].identity_error < 1e-12
    assert sorted(round(r.whitened, 6) for r in flat if r.component == 1) == [-1.224745, 0.0, 1.224745]
    huge = whitening.whiten(vectors(spark, [(i, [1e300 * (-1) ** i, float(i)], 1) for i in range(4)])).collect()
    assert len(huge) == 8 and max(r.deviation for r in huge) == 2**63 - 1


@tables
def test_op13_whole_table(spark):
    rows = {i: [float(c) for c in v] for i, v in duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()}
    check_whitened(queries.op13_whitening(spark, SF).collect(), rows)
