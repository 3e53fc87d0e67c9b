"""Trained operators by held-out results, the index by recall, and the pipeline stage by stage."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatlake.llm import ann, calibration, catalog, langid, packing, quality, toxicity
from chatlake.llm.common import read_table
from tests.llm import brute
from tests.llm.test_similar import _grams, _roots

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return read_table(spark, SMALL, "labels").toPandas().set_index("doc_id")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def _held(frame, labels, name):
    frame = frame[frame["held_out"]].set_index("doc_id").join(labels, how="inner")
    return frame["score"].to_numpy(), frame[name].to_numpy()


def _contract(frame, rows: int) -> None:
    assert len(frame) == rows and frame["score"].between(0, 1).all()
    assert ((frame["score"] >= 0.5).astype(int) == frame["predicted"]).all()


def test_quality_on_held_out_rows(spark, labels) -> None:
    frame = catalog.op1_quality(spark, SMALL).toPandas()
    _contract(frame, 1000)
    assert brute.auc(*_held(frame, labels, "quality")) > 0.95


def test_toxicity_on_held_out_rows(spark, labels) -> None:
    frame = catalog.op5_toxicity(spark, SMALL).toPandas()
    _contract(frame, 1000)
    scores, toxic = _held(frame, labels, "toxic")
    assert brute.auc(scores, toxic) > 0.85 and (scores[toxic == 0] < 0.5).mean() > 0.95


def test_language_on_held_out_rows(spark) -> None:
    frame = catalog.op2_language(spark, SMALL).toPandas().set_index("doc_id")
    docs = read_table(spark, SMALL, "documents").select("doc_id", "lang").toPandas().set_index("doc_id")
    frame = frame.join(docs)
    held = frame[frame["held_out"]]
    assert len(frame) == 1000 and frame["score"].between(0, 1).all()
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_fold_is_the_checksum_of_the_id(spark) -> None:
    import zlib

    frame = catalog.op1_quality(spark, "/root/testdata/sf0.001").select("doc_id", "held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in frame)


def test_scores_of_odd_rows(spark, odd, none, no_labels) -> None:
    docs, labels = read_table(spark, SMALL, "documents"), read_table(spark, SMALL, "labels")
    rows = odd.count()
    tox = toxicity.train(docs, labels)
    _contract(toxicity.score(odd, tox).toPandas(), rows)
    assert toxicity.score(none, tox).count() == 0 and toxicity.kept(odd, tox).schema == odd.schema
    good = quality.train(docs, docs, labels)
    found = quality.score(odd, good).toPandas()
    _contract(found, rows)
    assert quality.score(none, good).count() == 0
    # copies score alike, and so do null and empty texts
    assert found[found["doc_id"].isin([5, 6])]["score"].nunique() == found[found["doc_id"].isin([1, 2])]["score"].nunique() == 1
    # nothing to learn from
    for taught in (docs, none):
        blank = toxicity.train(taught, no_labels)
        assert set(toxicity.score(odd, blank).toPandas()["score"]) == {0.0}
        flat = quality.train(none, taught, no_labels)
        assert set(quality.score(odd, flat).toPandas()["score"]) == {0.5}


def test_languages_of_odd_rows(spark, odd, none) -> None:
    model = langid.train(read_table(spark, SMALL, "documents"))
    found = langid.predict(odd, model).toPandas()
    unknown = found[found["lang_pred"] == langid.UNKNOWN]
    assert sorted(unknown["doc_id"].dropna()) == [1, 2, 3, 14] and (unknown["score"] == 0).all()
    assert set(found["lang_pred"]) <= {"en", "de", "fr", "es", "und"} and len(found) == odd.count()
    assert langid.predict(none, model).count() == 0 and langid.kept(odd, model).schema == odd.schema
    nothing = langid.train(none)
    assert set(langid.predict(odd, nothing).toPandas()["lang_pred"]) == {langid.UNKNOWN}


def test_gram_counts_do_not_depend_on_neighbours() -> None:
    texts = ["Ab 1c", None, "", "été", "ab  c"]
    whole, some = langid.gram_counts(texts)
    for i, text in enumerate(texts):
        alone, letter = langid.gram_counts([text])
        assert (alone[0] == whole[i]).all() and letter[0] == some[i]
    assert some.tolist() == [True, False, False, True, True]


def test_features_do_not_depend_on_neighbours() -> None:
    texts = ["You are an idiot!", None, "", "an 1d10t, really", "Das ist gut.", "you i.d.i.o.t"]
    whole = toxicity.text_features(pa.array(texts))
    for i, text in enumerate(texts):
        assert np.allclose(toxicity.text_features(pa.array([text], pa.string()))[0], whole[i])
    at = {name: i for i, name in enumerate(toxicity.FEATURES)}
    assert whole[0, at["strong_count"]] == 1 and whole[0, at["near"]] > 0
    assert whole[3, at["hidden"]] > 0 and whole[5, at["hidden"]] > 0 and whole[4, at["hidden"]] == 0
    pooled = quality.pooled(pa.array(texts), np.ones((quality.BUCKETS, quality.DIMENSIONS), np.float32))
    assert np.isfinite(pooled).all() and not pooled[1].any()


def test_isotonic_steps() -> None:
    raw, y = np.array([0.0, 1.0, 2.0, 3.0, 3.0, 4.0]), np.array([0, 1, 0, 1, 1, 1])
    steps, values = toxicity.isotonic(raw, y)
    assert (np.diff(steps) >= 0).all() and (np.diff(values) >= 0).all() and 0 < values[0] < values[-1] < 1


def test_temperature_finds_the_scale() -> None:
    r = np.random.default_rng(1)
    logits = r.normal(0, 2, (5000, 3))
    p = calibration.softmax(logits)
    y = np.array([r.choice(3, p=row) for row in p])
    assert calibration.temperature(logits * 3, y) == pytest.approx(3, rel=0.15)
    assert calibration.temperature(logits[:0], y[:0]) == 1.0


# -- neighbours --------------------------------------------------------------------------------


def _nearest(ids: list[int], vectors: np.ndarray, query: int, k: int) -> list[int]:
    own = vectors[ids.index(query)]
    scores = vectors @ own
    order = sorted(range(len(ids)), key=lambda i: (-round(scores[i], 12), ids[i]))
    return [ids[i] for i in order if ids[i] != query][:k]


def test_recall_against_all_pairs(spark) -> None:
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        rows = read_table(spark, folder, "embeddings").select("vec_id", "embedding").collect()
        ids = [r["vec_id"] for r in rows]
        vectors = np.array([r["embedding"] for r in rows], float)
        found = catalog.op4_neighbours(spark, folder).toPandas()
        hits = total = 0
        for query, group in found.groupby("query_id"):
            group = group.sort_values("rank")
            assert group["rank"].tolist() == list(range(1, 21)) and (np.diff(group["score"]) <= 0).all()
            own = vectors[ids.index(query)]
            assert np.allclose(group["score"], [vectors[ids.index(v)] @ own for v in group["vec_id"]], atol=1e-12)
            hits += len(set(_nearest(ids, vectors, query, 20)) & set(group["vec_id"]))
            total += 20
        assert set(found["query_id"]) == {i for i in ids if i % 20 == 0} and hits / total >= 0.9


def test_visiting_everything_is_exact(spark) -> None:
    r = np.random.default_rng(2)
    vectors = r.normal(size=(150, 6)).round(2)
    vectors[40:80] = vectors[0]  # ties
    rows = [(i, [float(x) for x in v], "clash", 0) for i, v in enumerate(vectors)]
    rows += [(900, None, "x", 0), (901, [0.0] * 6, "x", 0), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x", 0), (903, [math.nan] * 6, "x", 0)]
    rows += [(904, [math.inf] * 6, "x", 0), (905, [], "x", 0), (906, [1.0, 2.0], "x", 0), (None, [1.0] * 6, "x", 0), rows[3], rows[3]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string, rank int").repartition(3)
    found = ann.search(table, F.col("id") % 20 == 0, share=1.0).collect()
    ids = list(range(150))
    for query in range(0, 150, 20):
        got = sorted((x["rank"], x["vec_id"]) for x in found if x["query_id"] == query)
        assert [v for _, v in got] == _nearest(ids, vectors, query, 20)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(x)[:3] for x in ann.search(few, F.col("id") % 20 == 0).collect()) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert ann.search(few.limit(0), F.col("id") % 20 == 0).count() == 0
    assert ann.search(few.where("vec_id = 0"), F.col("id") % 20 == 0).count() == 0


def test_walk_follows_summed_distance() -> None:
    r = np.random.default_rng(3)
    index = ann.Index(r.normal(size=(7, 3)), r.normal(size=(5, 3)), np.ones(35, np.int64))
    query = r.normal(size=6)
    order = index.walk(query, 35)
    a, b = -(index.left @ query[:3]), -(index.right @ query[3:])
    cost = [a[c // 5] + b[c % 5] for c in order]
    assert sorted(order) == list(range(35)) and (np.diff(cost) >= -1e-12).all()
    assert len(index.walk(query, 4)) == 4


# -- pipeline ----------------------------------------------------------------------------------


def test_stages_in_turn(spark, labels) -> None:
    docs = read_table(spark, SMALL, "documents").cache()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "repeats", "packing"]
    first, second, third, fourth, last = (stage for _, stage in corpus_pipeline.STAGES)

    clean = first(spark, docs, SMALL).cache()
    assert clean.schema == docs.schema
    kept = {r["doc_id"] for r in clean.select("doc_id").collect()}
    toxic, fine = set(labels.index[labels["toxic"] == 1]), set(labels.index[labels["toxic"] == 0])
    assert len(kept & fine) > 0.97 * len(fine) and len(kept & toxic) < 0.5 * len(toxic)

    known = second(spark, clean, SMALL).cache()
    assert known.schema == docs.schema and known.count() > 0.97 * clean.count()

    single = third(spark, known, SMALL).cache()
    rows = sorted(known.select("doc_id", "text").collect())
    roots = _roots([_grams(r["text"]) for r in rows])
    assert {r["doc_id"] for r in single.collect()} == {rows[k]["doc_id"] for k in set(roots)}

    cut = fourth(spark, single, SMALL).cache()
    assert cut.schema == docs.schema
    rows = single.select("doc_id", "text").collect()
    wanted = {}
    for r, mark in zip(rows, brute.removed([r["text"] for r in rows], 200), strict=True):
        kept_bytes = bytes(c for c, m in zip(r["text"].encode(), mark, strict=True) if not m)
        wanted[r["doc_id"]] = kept_bytes.decode(errors="ignore")
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    from tokenizers import Tokenizer

    hub = Tokenizer.from_file(packing.TOKENIZER)
    hub.encode_special_tokens = True
    ids = {i: [*hub.encode(text, add_special_tokens=False).ids, 0] for i, text in wanted.items()}
    pieces = last(spark, cut, SMALL).toPandas()
    assert pieces["length"].sum() == sum(map(len, ids.values()))
    for piece in pieces.itertuples():
        assert np.frombuffer(piece.ids, "<u4").tolist() == ids[piece.doc_id][piece.start : piece.start + piece.length]


def test_stages_on_odd_rows(spark, odd, none) -> None:
    for docs, rows in ((odd, odd.count()), (none, 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, SMALL)
            assert found.schema == docs.schema, name
            left = Counter(r["doc_id"] for r in found.collect())
            assert sum(left.values()) <= rows
            if name == "language" and rows:
                assert not {1, 2, 3, 14} & set(left)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).select("doc_id").distinct().count() == (16 if rows else 0)
