"""Main text of pages, spelling variants and phrases, against loops."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from chatlake.llm import catalog, pages, phrases, spelling
from chatlake.llm.common import read_table
from tests.conftest import DATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# -- pages -------------------------------------------------------------------------------------

PROSE = " ".join(f"word{i}" for i in range(40))


def _article_text(source: str) -> str:
    """What stands between the article tags, for the plain pages of the given tables."""
    body = source[source.index("<article>") + 9 : source.index("</article>")]
    blocks = (re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", block)) for block in re.split(r"</?(?:p|h1)>", body))
    for mark, sign in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&copy;", "©")):
        blocks = [block.replace(mark, sign) for block in blocks]
    plain = (" ".join(re.sub("&amp;?", "&", block).split()) for block in blocks)
    return "\n".join(block for block in plain if block)


def test_text_of_all_given_pages(spark) -> None:
    source = {r["page_id"]: r for r in read_table(spark, DATA, "pages").collect()}
    found = catalog.op11_html_text(spark, DATA).collect()
    assert len(found) == len(source)
    for row in found:
        page = source[row["page_id"]]
        assert row["text"] == _article_text(page["html"]) and row["n_chars"] == len(row["text"]) and row["url"] == page["url"]


@pytest.mark.parametrize(
    "source,wanted",
    [
        (
            '<body class="has-sidebar"><div id="header"><a href=/>Home</a> Of things</div><div id="cookie-notice">We use them</div>'
            f'<div class="wrapper"><div class="post-content"><h1>Title of it</h1><p>{PROSE} one</p><div class="ad-slot">BUY</div>'
            f"<ul><li>first item here</li><li>second</li></ul><p>{PROSE} &amp; two&nbsp;&mdash; end</p></div>"
            f'<div class="sidebar"><h3>About</h3><p>{PROSE}</p></div></div><section id="comments"><h2>Comments</h2>'
            f"<div class=comment><p>{PROSE} no</p></div></section><form><label>Name</label></form><footer>2020</footer>",
            f"Title of it\n{PROSE} one\nfirst item here\nsecond\n{PROSE} & two — end",
        ),
        (
            f"<header><h1>Site</h1><nav>a b</nav></header><main><h1>T</h1><p>{PROSE}</p><aside>x {PROSE}</aside><p>end</p>"
            f'</main><div class="related"><article><h2>Other</h2><p>{PROSE}</p></article></div>',
            f"T\n{PROSE}\nend",
        ),
        (f"<article><header><h1>Real title</h1></header><p>{PROSE}</p><footer>by me</footer></article>", f"Real title\n{PROSE}"),
        (f'<p>a<b>b</b> c <br>d<i>!</i><script>if (a<b) x("</p>")</script> e</p><!-- {PROSE} --><style>p{{}}</style>', "ab c d! e"),
        (f'<p class="notice">{PROSE}<p title="a>b">x &lt; y &#233; &notanentity; 3<4 &am', "x < y é ¬anentity; 3<4 &am"),
        (f"<nav><ul><li><a>menu<article><p>{PROSE}</article>", PROSE),
        (f"<article><p>{PROSE}</p><p hidden>no</p><div style='display: none'>no</div></article>", PROSE),
        ("<p></p><script>var a = 1", ""),
        ("just\n text", "just text"),
        ("", ""),
        (None, ""),
    ],
)
def test_layouts(source, wanted) -> None:
    assert pages.main_text(source, pages.Weights()) == wanted


def test_best_region_is_the_best_of_all() -> None:
    r = random.Random(4)
    for _ in range(300):
        scores = [r.choice([-3.0, -1.0, -0.5, 1.0, 2.0]) for _ in range(r.randint(0, 12))]
        every = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        start, end = pages.best_region(scores)
        assert sum(scores[start:end]) == max(0.0, max(every.values(), default=0.0))


def test_weights_follow_the_labelled_pages(spark) -> None:
    """Tags that stand outside of content only cost much; words of an element that is never content gain little."""
    one = f"<div><span>site</span></div><article><section><p>{PROSE}</p></section></article><div><span>{PROSE}</span></div>"
    rows = [(i, None, one, "clash") for i in range(30)] + [(None, "u", one, "x"), (99, "u", "<p>no label</p>", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    weights = pages.train(table)
    assert weights.of("div") < weights.of("section") < 0 and weights.of("article") < weights.of("section")
    assert weights.of("words in div") < weights.of("words in p")
    assert {r["text"] for r in pages.extract(table, weights).collect()} == {PROSE, "no label"}


def test_odd_pages(spark) -> None:
    nested = "<div>" * 30_000 + PROSE + "<b><div></b>" * 5000 + "<a" * 1000
    rows = [(1, "u", None, "c"), (2, None, "", "c"), (None, "u", f"<p>{PROSE}", "c"), (3, "u", nested, "c"), (4, "u", "<p>" + PROSE * 20_000, "c")]
    rows += [rows[2], rows[2], (5, "u", "\x00<p>\x00 a &#0; &#xD800; b", "c")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string").repartition(3)
    found = sorted((r["page_id"] or 0, r["text"]) for r in pages.extract(table, pages.train(table)).collect())
    wanted = [(1, ""), (2, ""), *[(0, PROSE)] * 3, (3, PROSE), (4, PROSE * 20_000), (5, "\x00\n\x00 a � � b")]
    assert found == sorted(wanted)
    assert pages.extract(table.limit(0), pages.train(table.limit(0))).count() == 0


# -- spelling ----------------------------------------------------------------------------------


def _vocabulary(rows: list) -> dict[str, int]:
    counts: Counter[str] = Counter()
    for row in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", row["text"] or ""):
            run = run.translate(LOWER)
            key = "" if row["doc_id"] is None else row["doc_id"]
            h = zlib.crc32(f"{key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 5 and n >= 3}


def _near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows: list) -> set[tuple]:
    words = _vocabulary(rows)
    by_length = defaultdict(list)
    for word in words:
        by_length[len(word)].append(word)
    near = {w: [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if _near(w, v)] for w in words}
    form = {}
    for word, n in words.items():
        best = min(near[word], key=lambda v: (-words[v], v), default=None)
        form[word] = best if best and words[best] >= 2 * n else None
    found = set()
    for word, n in words.items():
        root = word
        while form[root]:
            root = form[root]
        found.add((word, form[word], root, n, len(near[word]), words.get(form[word])))
    return found


def test_variants_of_given_documents(spark) -> None:
    rows = read_table(spark, DATA, "documents").select("doc_id", "text").collect()
    found = [tuple(r) for r in catalog.op12_spelling(spark, DATA).collect()]
    assert len(found) == len(set(found)) and set(found) == _variants(rows)


def test_variants_of_odd_rows(spark, odd, none) -> None:
    assert {tuple(r) for r in spelling.variants(odd).collect()} == _variants(odd.collect())
    assert spelling.variants(none).count() == 0
    # chains of forms, letters beyond ASCII, upper case outside of it, equal neighbours, a word beside a very long one
    texts = ["kitten " * 40, "kittens " * 20, "kittenss " * 10, "kittensss " * 5, "kktten sitten " * 4, "Éclair éclair " * 6]
    texts += ["aaaaaa " * 3 + "aaaaaaa " * 9, "z" * 3000 + " " + "z" * 3001, "mittex×÷ mittex÷× " * 3, "KITTEN Kitten"]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string").repartition(3)
    wanted = _variants(docs.collect())
    assert {tuple(r) for r in spelling.variants(docs).collect()} == wanted
    assert {w: r for w, _, r, *_ in wanted}["kittensss"] == "kitten"


def test_filters_in_parts_lose_nothing(spark) -> None:
    r = random.Random(2)
    words = list({"".join(r.choice("abé") for _ in range(r.randint(5, 8))) for _ in range(600)})
    table = spark.createDataFrame([(w, 3 + i % 7) for i, w in enumerate(words)], "word string, n long").repartition(3)
    wanted = {(a, b) for a in words for b in words if _near(a, b)}
    for size in (1 << 20, 600, 200):
        found = [(x["word"], x["near"]) for x in spelling.near_words(table, size).collect()]
        assert len(found) == len(set(found)) and set(found) == wanted


def test_edits_are_spelt_once() -> None:
    word = "aabcé"
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32).reshape(1, -1)
    letters = [chr(c) for c in spelling.ALPHABET]
    wanted = {word[:i] + word[i + 1 :] for i in range(5)}
    wanted |= {word[:i] + c + word[i + 1 :] for i in range(5) for c in letters if c > word[i]}
    found = []
    for length, hashes, spell in spelling.edits(points):
        chosen = np.flatnonzero(hashes.ravel())
        rows = spell(chosen)
        assert rows.shape[1] == length
        assert (spelling._hash(spelling._sums(rows)) == hashes.ravel()[chosen]).all()
        found += ["".join(map(chr, row)) for row in rows]
    assert sorted(found) == sorted(wanted)


# -- phrases -----------------------------------------------------------------------------------


def _phrases(rows: list, words: int = 3, least: int = 10, top: int = 2000) -> set[tuple]:
    counts: dict[str, Counter] = defaultdict(Counter)
    totals: Counter[str] = Counter()
    for row in rows:
        lang = "und" if row["lang"] is None else row["lang"]
        for piece in re.split("[.,;:!?\x0a-\x0d]", (row["text"] or "").translate(LOWER)):
            ws = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in range(1, words + 1):
                counts[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    found = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept, covering = [], Counter()
        for q, b in candidates.items():
            for i in range(len(q)):
                for part in (q[i:j] for j in range(i + 1, len(q) + 1)):
                    if len(part) < len(q):
                        covering[part] = max(covering[part], b)
        for p, a in candidates.items():
            if 100 * covering[p] >= 50 * a:
                continue
            cuts = [(int(Fraction(1_000_000 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            found.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return found


def test_phrases_of_odd_rows(spark, odd, none) -> None:
    assert {tuple(r) for r in phrases.mine(odd, min_count=2).collect()} == _phrases(odd.collect(), least=2)
    assert phrases.mine(none).count() == 0


@pytest.mark.parametrize("words", [2, 3, 4])
def test_phrases_of_random_texts(spark, words, monkeypatch) -> None:
    """Few words, so that prefixes are hot, counts pass the threshold by a little and phrases stand inside others."""
    r = random.Random(words)
    pool = ["a", "b", "B", "ça", "Ça", "日", "d.e", "f", "the", "the", "of", "the of", "x\ty", "!", "\n", ", z"]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None]), "p", 1) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, piece string, f int").repartition(4)
    wanted = _phrases(docs.collect(), words, 5, 40)
    monkeypatch.setattr(phrases, "SLICE", 500)
    assert {tuple(x) for x in phrases.mine(docs, words, 5, top=40).collect()} == wanted
    # as if no prefix were hot
    monkeypatch.setattr(phrases, "hot_prefixes", lambda *_: [])
    assert {tuple(x) for x in phrases.mine(docs, words, 5, top=40).collect()} == wanted


def test_wide_windows_are_told_apart(spark, monkeypatch) -> None:
    """Numbers of windows stay exact where words times places pass 62 bits."""
    texts = [" ".join(f"w{(i * 7 + j) % 1500}" for j in range(12)) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    windows = phrases.longest_windows(docs, 7).collect()
    counts: Counter[tuple] = Counter()
    for text in texts:
        ws = text.split()
        counts.update(tuple((ws[i : i + 7] + [""] * 7)[:7]) for i in range(len(ws)))
    found = Counter({(*r["prefix"].split("\n")[:-1], r["last"] or ""): r["c"] for r in windows})
    assert counts == found and len(windows) == len(counts)
