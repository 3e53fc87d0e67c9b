"""Operators with one right answer, against loops and the public libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer, normalizers

from chatlake.llm import bpe, catalog, components, licenses, packing, pretokens, repeats, rules, simhash
from chatlake.llm.common import read_table, slices
from tests.conftest import DATA
from tests.llm import brute


def _encoding() -> tiktoken.Encoding:
    with open(bpe.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _tokenizer() -> Tokenizer:
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _random_texts(n: int) -> list[str]:
    parts = ["a", "bc", "é", " ", " ", " ", "\n", "\t", "'s", "'re", "'", "v", "e", "ll", "1", "!", "日", "\x85", "\x1d", "\r", "m", "🙂"]
    r = random.Random(5)
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_texts_reach_python_in_batches_of_bounded_bytes(spark):
    docs = spark.range(0, 6000, 1, 1).selectExpr("id as doc_id", "repeat('abcdefgh', 500) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "rows"])

    found = docs.mapInArrow(sizes, "bytes long, rows long").toPandas()
    assert found["rows"].sum() == 6000
    assert found["bytes"].max() < 5 << 20


def test_tables_and_slices_for_pretokens_take_little_memory(monkeypatch):
    monkeypatch.setattr(pretokens, "_CLASSES", [])
    tracemalloc.start()
    try:
        table = pretokens._classes()
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
        assert len(table) == 0x110000 and table[ord("é")] == pretokens._LETTER and table[0xD800] == pretokens._OTHER
        text = " ".join(map("{:x}".format, range(0, 1 << 30, 5000)))
        batch = pa.RecordBatch.from_arrays([pa.array([text[at : at + 2000] for at in range(0, len(text), 2000)])], ["text"])
        encode = pretokens.Encoder(lambda words: [[len(word)] for word in words])
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        for part in slices(iter([batch]), pretokens.TEXT_BYTES):
            encode(part.column("text").to_pylist())
        held = tracemalloc.get_traced_memory()[0]
        assert tracemalloc.get_traced_memory()[1] - max(before, held) < 40 << 20
    finally:
        tracemalloc.stop()



def test_ids_of_random_texts() -> None:
    texts = [*_random_texts(3000), "<|endoftext|> a", "a" * 2000, "ab" * 300 + " " * 300, ""]
    ids, at = bpe.vocabulary(bpe.RANKS)[1](texts)
    other, places = packing.tokenizer_ids(packing.TOKENIZER)(texts)
    public, hub = _encoding(), _tokenizer()
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == public.encode_ordinary(text)
        assert other[places[i] : places[i + 1]].tolist() == hub.encode(text, add_special_tokens=False).ids


class _Counting:
    """A tokenizer that counts the strings it is given."""

    def __init__(self) -> None:
        self.__dict__["inner"], self.__dict__["given"] = _tokenizer(), []

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def __setattr__(self, name, value):
        setattr(self.inner, name, value)

    def encode_batch_fast(self, strings, **settings):
        self.given.extend(strings)
        return self.inner.encode_batch_fast(strings, **settings)


def test_pretokens_are_joined_for_the_tokenizer() -> None:
    hub, counting = _tokenizer(), _Counting()
    encode = packing.joined_encode(counting)
    words = [*(f" w{i}" for i in range(1000)), "\n\n", " ", "\t", "'s", " é日", "🙂", "<|", "endoftext", "|>"]
    ids, lengths = encode(words)
    one = [hub.encode(word, add_special_tokens=False).ids for word in words]
    assert ids.tolist() == [i for row in one for i in row]
    assert lengths.tolist() == [len(row) for row in one]
    assert len(counting.given) < len(words) / 100


def test_pretokens_that_hold_the_mark_between_them() -> None:
    hub = _tokenizer()
    texts = ["a\x00b c", "\x00", "\x00\x00 \x00", "plain words", "", " \x00<|endoftext|>\x00"]
    for some in (texts, texts[3:5], texts[:1]):
        ids, at = packing.tokenizer_ids(packing.TOKENIZER)(some)
        found = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert found == [hub.encode(text, add_special_tokens=False).ids for text in some]


def test_other_tokenizers_get_pretokens_one_by_one(tmp_path) -> None:
    other = _tokenizer()
    other.normalizer = normalizers.Lowercase()
    other.save(path := str(tmp_path / "lower.json"))
    ids, _ = packing.tokenizer_ids(path)(["Some WORDS here"])
    assert ids.tolist() == _tokenizer().encode("some words here", add_special_tokens=False).ids


def test_pretokens_of_one_hash_keep_their_ids() -> None:
    """The sums of these words and of their complements are equal for every odd base."""
    public, hub = _encoding(), _tokenizer()
    texts = ["y"]
    for bits in (10, 11, 13):
        word = "".join("ab"[i.bit_count() % 2] for i in range(1 << bits))
        texts += [word, word.translate(str.maketrans("ab", "ba")), word]
    for encode, one in (
        (bpe.vocabulary(bpe.RANKS)[1], public.encode_ordinary),
        (packing.tokenizer_ids(packing.TOKENIZER), lambda text: hub.encode(text, add_special_tokens=False).ids),
    ):
        ids, at = encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [one(text) for text in texts]
        assert [encode([text])[0].tolist() for text in texts] == [one(text) for text in texts]


def test_long_runs_merge_as_short_ones(monkeypatch) -> None:
    r = random.Random(6)
    words = ["".join(r.choice(pool) for _ in range(n)) for pool in ("ab", "etaoinshrdlu", "é日a", "a") for n in (1, 2, 3, 40, 300, 700)]
    known = bpe.Vocabulary(bpe.RANKS)
    rows = [ids.tolist() for ids in known.encode(words)]
    monkeypatch.setattr(bpe, "WIDEST", 0)
    assert [ids.tolist() for ids in known.encode(words)] == rows == [_encoding().encode_ordinary(word) for word in words]


def test_a_very_long_run_takes_seconds() -> None:
    r = random.Random(7)
    text = "".join(r.choice("etaoinshrdlu") for _ in range(200_000))
    start = time.perf_counter()
    ids, _ = bpe.vocabulary(bpe.RANKS)[1]([text])
    assert time.perf_counter() - start < 20
    assert bpe.vocabulary(bpe.RANKS)[0].decode(ids).tobytes() == text.encode()
    assert ids.tolist()[:1000] == bpe.vocabulary(bpe.RANKS)[1]([text[:3000]])[0].tolist()[:1000]


def test_forgetting_pretokens_changes_nothing(monkeypatch) -> None:
    texts = _random_texts(200)
    known = bpe.Vocabulary(bpe.RANKS)
    whole = pretokens.Encoder(known.encode)(texts)
    monkeypatch.setattr(pretokens, "MEMORY", 10)
    small = pretokens.Encoder(known.encode)
    pieces = [small(texts[i : i + 7])[0] for i in range(0, len(texts), 7)]
    assert np.concatenate(pieces).tolist() == whole[0].tolist()


def test_bpe_of_odd_rows(odd, none) -> None:
    public = _encoding()
    wanted = Counter()
    for row in odd.collect():
        ids = public.encode_ordinary(row["text"] or "")
        wanted[(row["doc_id"], len(ids), np.array(ids, "<u4").tobytes(), (row["text"] or "").encode())] += 1
    found = bpe.decode(bpe.encode(odd)).collect()
    assert wanted == Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["data"])) for r in found)
    assert bpe.decode(bpe.encode(none)).count() == 0


def test_packing_of_odd_rows(odd, none) -> None:
    hub = _tokenizer()
    window = 64
    pieces = packing.pack(odd, window).toPandas()
    ids = Counter(tuple(hub.encode(r["text"] or "", add_special_tokens=False).ids) + (0,) for r in odd.collect())
    pieces["place"] = pieces["sequence_id"] * window + pieces["offset"]
    pieces = pieces.sort_values("place")
    assert (pieces["place"] + pieces["length"]).tolist()[:-1] == pieces["place"].tolist()[1:]
    assert (pieces["offset"] + pieces["length"] <= window).all() and pieces["place"].min() == 0
    found, current = Counter(), []
    for piece in pieces.itertuples():
        assert piece.start == len(current)
        current += np.frombuffer(piece.ids, "<u4").tolist()
        if len(current) == piece.doc_tokens:
            found[tuple(current)] += 1
            current = []
    assert found == ids
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("length,gram", [(200, 40), (24, 9)])
def test_repeats_of_odd_rows(odd, none, length, gram) -> None:
    rows = odd.collect()
    wanted = Counter()
    for row, mark in zip(rows, brute.removed([r["text"] for r in rows], length), strict=True):
        data = (row["text"] or "").encode()
        kept = bytes(c for c, m in zip(data, mark, strict=True) if not m)
        wanted[(row["doc_id"], len(data), tuple(brute.spans(mark)), kept)] += 1
    found = repeats.remove_repeats(odd, length, gram).collect()
    assert wanted == Counter(
        (r["doc_id"], r["n_bytes"], tuple((s["first"], s["last"]) for s in r["spans"]), bytes(r["kept"])) for r in found
    )
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_of_random_strings(spark) -> None:
    """Few letters, so that repeats nest, overlap and differ in length."""
    r = random.Random(3)
    pool = ["".join(r.choice("ab") for _ in range(r.randint(5, 60))) for _ in range(12)]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 6))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    marks = brute.removed(texts, 20)
    found = {x["doc_id"]: [(s["first"], s["last"]) for s in x["spans"]] for x in repeats.remove_repeats(docs, 20, 6).collect()}
    assert found == {i: brute.spans(mark) for i, mark in enumerate(marks)}


def test_intervals_cover_all_common_prefixes() -> None:
    r = random.Random(8)
    rows = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(40)})
    shared = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    prefixes = [0, *(shared(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True))]
    wanted = set()
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            common = min(prefixes[i + 1 : j + 1])
            if (i == 0 or prefixes[i] < common) and (j == len(rows) - 1 or prefixes[j + 1] < common):
                wanted.add((i, j, common))
    assert set(repeats.intervals(prefixes)) == wanted


def test_shortened_keeps_columns(odd, none) -> None:
    found = repeats.shortened(odd)
    assert found.schema == odd.schema
    rows = odd.collect()
    wanted = Counter()
    for row, mark in zip(rows, brute.removed([r["text"] for r in rows], 200), strict=True):
        kept = bytes(c for c, m in zip((row["text"] or "").encode(), mark, strict=True) if not m)
        text = kept.decode(errors="ignore") if any(mark) else row["text"]
        wanted[(row["doc_id"], text, row["score"], len(text) if any(mark) else row["n_chars"])] += 1
    assert wanted == Counter((r["doc_id"], r["text"], r["score"], r["n_chars"]) for r in found.collect())
    assert repeats.shortened(none).count() == 0


def test_simhash_of_odd_rows(odd, none) -> None:
    rows = odd.select("doc_id", "text").collect()
    prints = [brute.fingerprint(r["text"]) for r in rows]
    roots = brute.classes(prints)
    lowest: dict[int, int] = {}
    for row, root in zip(rows, roots, strict=True):
        if row["doc_id"] is not None:
            lowest[root] = min(lowest.get(root, row["doc_id"]), row["doc_id"])
    wanted = Counter((r["doc_id"], p, lowest.get(root)) for r, p, root in zip(rows, prints, roots, strict=True))
    found = simhash.near_duplicates(odd).collect()
    assert wanted == Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found)
    assert simhash.near_duplicates(none).count() == 0


def test_trie_join() -> None:
    r = np.random.default_rng(0)
    groups = []
    for _ in range(30):
        base = r.integers(0, 2**63, 5, dtype=np.uint64)
        group = []
        for _ in range(80):
            x = base[r.integers(5)]
            for bit in r.integers(0, 64, r.integers(0, 7)):
                x ^= np.uint64(1) << np.uint64(bit)
            group.append(x)
        groups.append(np.unique(np.array(group, np.uint64)))
    starts = np.cumsum([0, *map(len, groups)])[:-1]
    found = simhash.trie_links(np.concatenate(groups), starts)
    for start, group in zip(starts, groups, strict=True):
        assert (found[start : start + len(group)] - start).tolist() == brute.classes(group.tolist())


def test_components_of_chains_and_hubs(spark) -> None:
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 90)] + [(500, 500), (3, 2), (2, 3)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    wanted = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 90)} | {2: 2, 3: 2}
    assert {r["node"]: r["root"] for r in found} == wanted
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(odd, none) -> None:
    kept = simhash.keep_one(odd)
    assert kept.schema == odd.schema and kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[5] == ids[4] == ids[1] == 1 and ids[6] == ids[2] == ids[3] == 0 and ids[None] == 2
    assert simhash.keep_one(none).count() == 0


def _loop_licenses(text: str, scan: licenses.Scanner) -> list[tuple]:
    """All windows against all templates, without bands."""
    value, _, first, last = licenses.shingles(pa.array([text]))
    found = []
    for group in scan.classes:
        windows = licenses._windows(len(value), group.window)
        for name in group.names:
            wanted = set(scan.sets[name].tolist())
            shares = [len(wanted & set(value[a:b].tolist())) / len(wanted) for a, b in windows]
            i = 0
            while i < len(shares):
                if shares[i] >= licenses.CONTAINED:
                    j = i
                    while j + 1 < len(shares) and shares[j + 1] >= licenses.CONTAINED:
                        j += 1
                    inside = [k for k in range(windows[i][0], windows[j][1]) if int(value[k]) in wanted]
                    found.append((name, int(first[inside[0]]), int(last[inside[-1]]), max(shares[i : j + 1])))
                    i = j
                i += 1
    return sorted(found)


@pytest.mark.parametrize("name", ["Apache-2.0 header", "LGPL header", "MIT warranty", "ISC permission"])
def test_stretched_licenses(name) -> None:
    """Without windows: a notice with words put in anywhere, at any place of a text, as long as enough of it is left."""
    scan = licenses.scanner()
    size = next(group.window // 2 for group in scan.classes if name in group.names)
    notice, wanted = licenses.TEMPLATES[name].split(" "), scan.sets[name]
    for more in (1, 9, 20):
        for cut in range(0, len(notice), 5):
            for lead in (0, 13, 47, 101):
                words = [f"l{i}" for i in range(lead)] + notice[:cut] + [f"w{i}" for i in range(more)] + notice[cut:] + ["t"] * 40
                own = licenses.shingles(pa.array([" ".join(words)]))[0]
                at = np.flatnonzero(np.isin(own, wanted))
                share = len(np.intersect1d(own, wanted)) / len(wanted)
                if share < licenses.CONTAINED or at[-1] - at[0] + 1 > size:
                    continue
                found = [x for x in licenses.scan_text(own, scan) if x[0] == name]
                assert found == [(name, at[0], at[-1], share)]


def test_licenses_against_all_windows(spark, odd, none) -> None:
    r = random.Random(4)
    plain = [t for t in (row["text"] for row in odd.collect()) if t]
    rows = []
    for i in range(60):
        notice = r.choice(list(licenses.TEMPLATES.values())).split(" ")
        for _ in range(r.randint(0, 2)):
            notice[r.randrange(len(notice))] = r.choice(["word", "The", ""])
        rows.append((i, " ".join([*r.choice(plain).split(" ")[: r.randint(0, 90)], *notice, "and", *notice[: r.randint(0, 20)]])))
    scan = licenses.scanner()
    found = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = Counter((i, *x) for i, text in rows for x in _loop_licenses(text, scan))
    assert wanted and wanted == Counter(tuple(x) for x in found)
    assert licenses.find_licenses(odd).count() == 0 and licenses.find_licenses(none).count() == 0


def test_band_settings() -> None:
    for group in licenses.scanner().classes:
        for name in group.names:
            size = len(licenses.scanner().sets[name])
            kept = -(-4 * size // 5)
            likeness = kept / (group.window + size - kept)
            assert (1 - likeness) ** len(group.seeds) <= licenses.MISS
    with pytest.raises(ValueError):
        licenses.scanner({"short": "All rights reserved"})


def test_rules_of_odd_rows(odd, none) -> None:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    wanted = Counter((r["doc_id"], *brute.quality_counts(r["text"])) for r in odd.collect())
    found = rules.judge(odd).collect()
    assert wanted == Counter((r["doc_id"], *(r[n] for n in names)) for r in found)
    for r in found:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert rules.judge(none).count() == 0


def test_rules_follow_language_and_source(spark) -> None:
    """What is normal in one source is far off in another; small groups follow their language."""
    def text(i: int, marks: int) -> str:
        return " ".join(f"w{i}x{k}" + ("#" * 3 if k < marks else "") for k in range(60))

    rows = [(i, text(i, 50), "en", "code") for i in range(30)] + [(100 + i, text(i, i % 2), "en", "news") for i in range(30)]
    rows += [(200, text(200, 50), "en", "news"), (300, text(300, 1), "en", "tiny"), (400, text(400, 0), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(docs, min_group=20).collect()}
    assert not kept[200] and all(kept[i] for i in (*range(30), *range(100, 130), 300, 400))


def test_query_digests(spark) -> None:
    """Queries over the smallest tables against loops."""
    docs = {r["doc_id"]: r["text"] for r in read_table(spark, DATA, "documents").select("doc_id", "text").collect()}
    marks = dict(zip(docs, brute.removed(list(docs.values()), 200), strict=True))
    for r in catalog.op6_suffix_dedup(spark, DATA).collect():
        data, mark = (docs[r["doc_id"]] or "").encode(), marks[r["doc_id"]]
        kept = bytes(c for c, m in zip(data, mark, strict=True) if not m)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), sum(mark), len(brute.spans(mark)))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    ids = sorted(docs)
    prints = [brute.fingerprint(docs[i]) for i in ids]
    roots = brute.classes(prints)
    wanted = {i: (f"{p:016x}", ids[k]) for i, p, k in zip(ids, prints, roots, strict=True)}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in catalog.op7_simhash(spark, DATA).collect()}
    assert found == wanted
    public = _encoding()
    for r in catalog.op8_byte_bpe(spark, DATA).collect():
        ids = np.array(public.encode_ordinary(docs[r["doc_id"]] or ""), "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()


def test_a_text_moves_once_to_its_spans(spark, capsys) -> None:
    docs = spark.createDataFrame([(1, "de", "ab" * 30), (2, None, "ab" * 30 + "c"), (3, "fr", None)], "doc_id long, lang string, text string")
    rows = repeats._with_spans(docs, 20, 6)
    rows.explain("formatted")
    shuffled = [line for part in capsys.readouterr().out.split("\n\n") if "Exchange" in part for line in part.splitlines() if "Input" in line]
    assert any("row#" in line for line in shuffled)
    assert not any("row#" in line and "text#" in line for line in shuffled)
    found = {x["row"]["doc_id"]: (x["row"]["text"], x["text"]) for x in rows.collect()}
    assert found == {1: ("ab" * 30, "ab" * 30), 2: ("ab" * 30 + "c", "ab" * 30 + "c"), 3: (None, "")}
