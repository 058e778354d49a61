"""Whitening, packing and hard negatives against brute force, and odd inputs."""

from __future__ import annotations

import zlib
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("aerolith.llm")
P = pytest.importorskip("public_tokenizers")

DATA = Path("/root/testdata/sf0.001")
VECTORS = "vec_id bigint, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


# ------------------------------------------------------------------ whitening

def spread(n: int, d: int, seed: int = 1, scale: float = 1.0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) @ np.diag(np.linspace(2, 0.3, d)) * scale + rng.normal(size=d) * scale


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS).repartition(3)


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e14])
def test_whitening_against_big_integers(spark, scale):
    """Digits of one, several and (beyond 64 bits) very many places give the covariance that fractions give."""
    from aerolith.llm.whitening import fit_whitening, whiten

    v = spread(60, 5, scale=scale)
    rows = [(i, [float(c) for c in x], 0) for i, x in enumerate(v)]
    rows += [(100, None, 0), (101, [1.0, None, 0.0, 0.0, 0.0], 0), (102, [NAN] * 5, 0), (103, [INF, 0.0, 0.0, 0.0, 0.0], 0), (104, [], 0)]
    x = [[int(np.floor(1024 * c)) + 100_000 for c in r] for r in v]
    n, d = len(x), 5
    s = [sum(r[i] for r in x) for i in range(d)]
    y = [[n * r[i] - s[i] for i in range(d)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]
    model = fit_whitening(vectors(spark, rows))[d]
    assert model.n == n and list(model.sums) == s and model.trace == pytest.approx(float(sum(cov[i][i] for i in range(d))), rel=1e-15)
    rebuilt = model.components.T @ np.diag(model.values) @ model.components
    want = np.array([[float(c) for c in r] for r in cov])
    assert np.abs(rebuilt - want).max() < 1e-13 * np.abs(want).max()
    got = whiten(vectors(spark, rows), ["vec_id"]).toPandas().sort_values(["vec_id", "component"])
    assert got["vec_id"].nunique() == n and len(got) == n * d and set(got["n"]) == {n}
    exact = [sum(c * c for c in r) for r in y]
    assert [None if q is None else int(q) for q in got.groupby("vec_id", sort=True)["deviation"].first()] == [q if q < 10**38 else None for q in exact]
    w = got["whitened"].to_numpy().reshape(n, d)
    by_hand = (np.array([[float(Fraction(c, n)) for c in r] for r in y]) @ model.components.T) / np.sqrt(model.values)
    assert np.abs(w - by_hand).max() < 1e-9
    assert np.abs(np.cov(w.T, bias=True) - np.eye(d)).max() < 1e-9 and got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1
    assert got["explained"][:d].sum() == pytest.approx(1)


def test_digits_are_exact():
    from aerolith.llm.whitening import Gram, digits

    rng = np.random.default_rng(3)
    y = rng.integers(-(1 << 61), 1 << 61, size=(50, 4))
    back = sum(d.astype(object).astype(int).astype(object) * (1 << (20 * k)) for k, d in enumerate(digits(y)))
    assert (back == y.astype(object)).all()
    gram = Gram(4)
    for part in (y[:20], y[20:]):
        gram.add(part)
    words: dict = {}
    for i, j, k, w in gram.words():
        words[i, j] = words.get((i, j), 0) + w * (1 << (30 * k))
    o = y.astype(object)
    assert all(words[i, j] == (o[:, i] * o[:, j]).sum() for i in range(4) for j in range(i, 4))


def test_whitening_odd_rows(spark):
    """No rows, one vector, equal vectors, several lengths, repeated and null ids, clashing names."""
    from aerolith.llm.whitening import whiten

    assert whiten(vectors(spark, []), ["vec_id"]).count() == 0
    assert whiten(vectors(spark, [(1, None, 0)]), ["vec_id"]).count() == 0
    one = whiten(vectors(spark, [(1, [0.5, 1.0], 0)] * 3), ["vec_id"]).toPandas()
    assert len(one) == 6 and one["whitened"].isna().all() and one["explained"].isna().all() and (one["identity_error"] == 0).all() and (one["deviation"] == 0).all()
    flat = whiten(vectors(spark, [(i, [float(i), 7.0], 0) for i in range(4)]), ["vec_id"]).toPandas()
    assert flat[flat["component"] == 2]["whitened"].isna().all() and flat[flat["component"] == 1]["whitened"].notna().all()
    mixed = whiten(vectors(spark, [(i, [float(i), float(i % 3)], 0) for i in range(5)] + [(None, [float(i)], 0) for i in range(3)]), ["vec_id"]).toPandas()
    assert sorted(mixed.groupby("n").size().to_dict().items()) == [(3, 3), (5, 10)]
    clash = vectors(spark, [(i, [float(i), float(i % 3)], 0) for i in range(5)]).withColumn("n", F.lit("mine")).withColumn("v", F.lit(1))
    out = whiten(clash, ["vec_id", "n", "v"])
    assert out.columns[:4] == ["vec_id", "n", "v", "component"] and "n_" in out.columns and {r["n"] for r in out.collect()} == {"mine"}


def test_whitening_query(spark):
    from aerolith.llm.queries import QUERIES

    got = QUERIES["op11_whitening"](spark, str(DATA)).toPandas()
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.floor(1024 * np.array([r[1] for r in rows], float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    assert len(got) == 8 * n and dict(got.dtypes)["deviation"] == np.int64
    assert got[got["component"] == 1].sort_values("vec_id")["deviation"].tolist() == (y * y).sum(axis=1).tolist()
    values, axes = np.linalg.eigh((y / n).T @ (y / n) / n)
    for c in range(8):
        w = (y / n) @ axes[:, -1 - c] / np.sqrt(values[-1 - c])
        mine = got[got["component"] == c + 1].sort_values("vec_id")
        assert min(np.abs(mine["whitened"] - w).max(), np.abs(mine["whitened"] + w).max()) < 1e-8
        assert np.allclose(mine["explained"], values[-1 - c] / values.sum(), rtol=1e-9)
    assert got["identity_error"].max() < 1e-9


# ------------------------------------------------------------------ packing

def test_hilbert_curve_visits_every_cell_by_single_steps():
    from aerolith.llm.packing import hilbert_keys

    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        along = cells[np.argsort(keys)]
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def check_pieces(got, want: dict):
    """Every id in one piece, sequences without gaps, at most 1024 long, none that needs padding."""
    by_doc: dict = {}
    for r in got:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert set(by_doc) == set(want)
    for doc, spans in by_doc.items():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == len(want[doc])
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    return sequences


def encoded(rows):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return {i: [*enc.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}


def test_packing(spark):
    from aerolith.llm.packing import pack_documents, padded, piece_digests, read_sequences, sequence_ids

    rng = np.random.default_rng(4)
    words = ["river", "stone", "Über", "cloud", "naïve", "x", "<|endoftext|>", "  ", "\n", "7"]
    rows = [(0, None), (1, ""), (2, "one"), (3, "word " * 5000), *((i, " ".join(rng.choice(words, rng.integers(0, 300)))) for i in range(4, 80))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumn("ids", F.lit(1)).withColumn("curve", F.lit("x"))
    path = pack_documents(df, P.path("byte_bpe_50k.json"))
    want = encoded(rows)
    check_pieces(piece_digests(read_sequences(spark, path)).collect(), want)
    for r in sequence_ids(read_sequences(spark, path)).select("ids", padded().alias("all"), "pieces", "length").collect():
        assert len(r["ids"]) == r["length"] and r["all"][: r["length"]] == r["ids"]
        assert r["ids"] == [x for p in r["pieces"] for x in want[p["doc_id"]][p["start"] : p["start"] + p["length"]]]
    few = spark.createDataFrame([([1, 2, 3],), ([1, 2],)], "ids array<int>").select(padded(to=8).alias("p")).collect()
    assert [r["p"] for r in few] == [[1, 2, 3, 0, 0, 0, 0, 0], [1, 2]]


def test_packing_of_odd_rows(spark):
    """No rows; repeated and null ids stay documents; other lengths than powers of two are padded only at the ends."""
    from aerolith.llm.packing import pack_documents, piece_digests, read_sequences

    path = P.path("byte_bpe_50k.json")
    assert piece_digests(read_sequences(spark, pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), path))).count() == 0
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (2, "")]
    got = piece_digests(read_sequences(spark, pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), path, length=3))).collect()
    assert sum(r["length"] for r in got) == sum(len(x) for x in encoded(enumerate(t for _, t in rows)).values())
    assert {r["doc_id"] for r in got} == {1, 2, None}


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents of two vocabularies, mixed in the table, are (nearly) apart along the curve."""
    from aerolith.llm.packing import pack_documents, read_sequences

    rng = np.random.default_rng(6)
    kinds = [["river", "stone", "cloud", "wind", "grass"], ["invoice", "credit", "ledger", "audit", "market"]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 100))) for i in range(200)]
    path = pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), P.path("byte_bpe_50k.json"))
    order = [p["doc_id"] for r in read_sequences(spark, path).orderBy("sequence_id").collect() for p in r["pieces"] if p["start"] == 0]
    changes = sum((a % 2) != (b % 2) for a, b in zip(order, order[1:], strict=False))
    assert sorted(order) == list(range(200)) and changes < 20


def test_packing_query(spark):
    from aerolith.llm.queries import QUERIES

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    check_pieces(QUERIES["op12_packing"](spark, str(DATA)).collect(), encoded(rows))


# ------------------------------------------------------------------ hard negatives

def brute(rows, positives=5, negatives=3):
    rows = sorted({(i, lab, tuple(int(np.floor(256 * c)) for c in v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)})
    out = []
    for i, lab, x in rows:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, m) for j, m, y in rows if j != i and len(y) == len(x))
        for s, j in [(-s, j) for s, j, m in scored if m == lab][:positives]:
            for r, (t, k) in enumerate([(-t, k) for t, k, m in scored if m != lab and 50 * s <= -100 * t <= 95 * s][:negatives]):
                out.append((i, j, r + 1, k, s, t))
    return sorted(out)


def mined(df, **how):
    from aerolith.llm.hard_negatives import hard_negatives

    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 50 == 0, F.col("label"), **how).collect())


@pytest.mark.parametrize("first", [0.05, 0.5])
def test_hard_negatives(spark, monkeypatch, first):
    """Whatever the first radius: ties, copies, null and odd vectors, several lengths; small blocks and groups."""
    from aerolith.llm import hard_negatives as h

    monkeypatch.setattr(h, "BLOCK", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(400):
        v = centres[i % 6] + rng.normal(size=8) * 0.4
        rows.append((i, [float(c) for c in np.round(v / np.linalg.norm(v), 1 + i % 3)], int(rng.integers(0, 3)) if i % 31 else None))
    rows += [(1000 + i, rows[2][1], i % 2) for i in range(80)] + [(50, rows[50][1], rows[50][2])]
    rows += [(2000, None, 1), (2050, [NAN] * 8, 1), (2100, [INF] + [0.0] * 7, 1), (2150, [None] + [0.0] * 7, 1), (None, rows[3][1], 1), (2200, [], 1), (2250, [0.0] * 8, 1)]
    rows += [(3000 + i, [float(c) for c in rng.normal(size=3)], i % 2) for i in range(60)]
    df = vectors(spark, rows).withColumn("akey", F.lit(1)).withColumn("x", F.lit("mine"))
    assert mined(df, first=first) == brute([(i, v, lab) for i, v, lab in rows])


def test_hard_negatives_of_few(spark):
    assert mined(vectors(spark, [])) == []
    assert mined(vectors(spark, [(0, [1.0, 0.0], 1)])) == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [-1.0, 0.0], 1), (4, [0.0, 1.0], 1), (5, [0.0, 1.0], 2)]
    assert mined(vectors(spark, rows)) == brute(rows)


def test_hard_negatives_of_large_entries(spark):
    """Products beyond 2^53 are made in whole numbers of 64 bits."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.integers(-400_000, 400_000, 4)], i % 2) for i in range(120)]
    assert mined(vectors(spark, rows)) == brute(rows)


def test_searches_of_clustered_vectors_scan_few_rows(spark, monkeypatch):
    """With vectors in tight groups the positives' key intervals lie in a small share of the rows, that falls with the groups."""
    from aerolith.llm import hard_negatives as h

    rng = np.random.default_rng(12)
    shares = []
    for groups in (4, 16):
        scanned = spark.sparkContext.accumulator(0)
        centres = rng.normal(size=(groups, 12))
        v = centres[np.arange(groups * 60) % groups] + rng.normal(size=(groups * 60, 12)) * 0.02
        v /= np.linalg.norm(v, axis=1)[:, None]
        rows = [(i, [float(c) for c in x], i // groups % 3) for i, x in enumerate(v)]
        plain = h.scan_block

        def counted(b, a, *rest, plain=plain, scanned=scanned):
            scanned.add(len(a) * len(b["ids"]) // 8)
            return plain(b, a, *rest)

        monkeypatch.setattr(h, "scan_block", counted)
        monkeypatch.setattr(h, "BLOCK", 8)
        assert mined(vectors(spark, rows), first=0.02) == brute(rows)
        monkeypatch.undo()
        anchors = sum(i % 50 == 0 for i, *_ in rows)
        shares.append(scanned.value / (anchors * len(rows)))
    assert shares[1] < shares[0] / 2, shares


def test_hard_negative_query(spark):
    from aerolith.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = sorted(map(tuple, con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL['op13_hard_negatives']})").fetchall()))
    got = sorted(tuple(r) for r in QUERIES["op13_hard_negatives"](spark, str(DATA)).select(*cols).collect())
    assert got == want and len(got) > 0
