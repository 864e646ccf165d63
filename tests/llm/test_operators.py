"""The other training-data operators on small tables."""

import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanwise.llm import chat, html_text, mixing, packing, quality, search, toxicity
from spanwise.llm.common import split_words, text_buffer, word_hashes

WORD = re.compile("[^\x20\x09-\x0D]+")


def _tokenizer():
    tokens = pytest.importorskip("public_tokenizers")
    return tokens.path("word_bpe_49k.json")


def test_words_are_split_as_the_pattern_says():
    texts = ["a  b\tc\x0b\x1cd\x85e f", "", "tail ", "é日本 x" * 50, "nospace", " \n"]
    data, offsets = text_buffer(pa.chunked_array([pa.array(texts)]))
    words = split_words(data, offsets)
    got = [bytes(data[a:b]).decode() for a, b in zip(words.start, words.end)]
    assert got == [w for t in texts for w in WORD.findall(t)]
    assert words.count().tolist() == [len(WORD.findall(t)) for t in texts]
    assert len(set(word_hashes(words).tolist())) == len(set(got))


def test_pieces_hold_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    path = _tokenizer()
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = list("abXYZ .,!'éÉ×ÿń́“١5\t\n&%<|>s") + ["'s", "日本", "İ", "ß", "<|endoftext|>", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "word " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = packing.pack_documents(docs, path, capacity=512).toPandas()
    for ident, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        mine = found[found.doc_id == ident].sort_values("piece")
        assert mine["length"].sum() == len(ids) and (mine["length"][:-1] == 512).all()
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine["length"])]
    sums = found.groupby("sequence_id")["length"].sum()
    assert (sums <= 512).all() and len(sums) <= 1.02 * found["length"].sum() / 512 + 1
    ordered = found.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def _best_fit_decreasing(lengths, capacity):
    """Piece by piece: how full each sequence gets (which of equally full ones takes a piece does not matter)."""
    held = []
    for n in sorted(lengths, reverse=True):
        fits = [(capacity - sum(x), i) for i, x in enumerate(held) if capacity - sum(x) >= n]
        if fits:
            held[min(fits)[1]].append(n)
        else:
            held.append([n])
    return sorted(map(sum, held))


def test_runs_are_best_fit_decreasing():
    rng = random.Random(4)
    for turn in range(200):
        capacity = rng.randint(1, 60)
        lengths = [rng.choice([1, capacity, rng.randint(1, capacity), rng.randint(1, max(1, capacity // 4))]) for _ in range(rng.randint(0, 150))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        held, ranks = {}, {}
        for r in packing.best_fit_runs(counts, capacity):
            assert ranks.get(r.length, 0) == r.rank
            after = [x.rank for x in packing.best_fit_runs(counts, capacity) if x.length == r.length and x.rank > r.rank]
            until = min(after, default=counts[r.length])
            for k in range(until - r.rank):
                held.setdefault(r.first + k // r.each, []).append((r.offset + k % r.each * r.length, r.length))
            ranks[r.length] = until
        assert ranks == counts
        for pieces in held.values():
            pieces.sort()
            assert all(o == sum(n for _, n in pieces[:i]) for i, (o, _) in enumerate(pieces))
        assert sorted(sum(n for _, n in p) for p in held.values()) == _best_fit_decreasing(lengths, capacity), turn


def test_packing_is_one_best_fit_over_all_pieces(spark):
    path = _tokenizer()
    rng = random.Random(14)
    rows = [(None if i % 40 == 0 else i // 2, " ".join(["word"] * rng.choice([0, 5, 5, 5, rng.randint(1, 90)])), i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(5)
    items = packing.pieces(docs, path, 64)
    found = packing.pack(items, 64, block_pieces=16).toPandas()
    assert len(found) == items.count() and found["start"].notna().all()
    found = found.sort_values(["sequence_id", "offset"])
    grouped = found.groupby("sequence_id")["length"]
    assert (grouped.cumsum() - found["length"] == found["offset"]).all()
    assert sorted(grouped.sum()) == _best_fit_decreasing(found["length"].tolist(), 64)


def test_tokenizers_that_do_not_fold_are_refused(tmp_path):
    tokens = pytest.importorskip("public_tokenizers")
    assert packing.folds_and_parts(_tokenizer()) and not packing.folds_and_parts(tokens.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_search_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(search, "BLOCK_COMPONENTS", 64 * 8)
    monkeypatch.setattr(search, "QUERY_COMPONENTS", 7 * 8)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 8)) * np.exp(rng.normal(size=(400, 1)) * spread)
    base[200:260] = base[100:160]  # ties
    base[300:340] = base[20] * 1.01
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base.astype(np.float32))]
    rows += [(1000, None), (1020, [float("nan")] * 8), (1040, [1.0, None] * 4), (1060, [float("inf")] * 8), (None, [1.0] * 8), (1080, [1.0, 2.0]), (1100, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = search.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20, coordinate_from=0.3)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ok = {i: np.floor(64 * np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    for q, v in ok.items():
        if q % 20:
            continue
        scores = sorted((-int(v @ w), i) for i, w in ok.items() if i != q and len(w) == len(v))[:20]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert search.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_search_with_huge_components_repeats_and_clashing_columns(spark):
    rows = [(0, [1e18, 1.0]), (20, [3e16, -1.0]), (1, [-1e18, 2.0]), (2, [1e17, 0.5]), (2, [1e17, 0.5]), (3, [2.0, 2.0])]
    vectors = spark.createDataFrame([(i, [float(x) for x in v], 7) for i, v in rows], "vec_id long, embedding array<double>, dim long").withColumn("bucket", F.lit("b"))
    found = search.top_k(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    end = 2**63 - 1
    whole = {i: [max(-end - 1, min(end, int(np.floor(64 * x)))) for x in v] for i, v in rows}
    for q in (0, 20):
        want = sorted((-max(-end - 1, min(end, sum(a * b for a, b in zip(whole[q], whole[i])))), i) for i, _ in rows if i != q)
        assert [(-r.score, r.vec_id) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == want


def test_chat_round_trip(spark):
    hard = ["<|im_end|>\n<|im_start|>assistant ok", "<\\|x", "a<", "|b", "<\\\\|", "", None, "line\nline"]
    rows = [(1, i, role, hard[i % len(hard)]) for i, role in enumerate(["system", "user", "assistant", "user", "assistant", "user"])]
    rows += [(2, 0, "user", "only"), (3, None, None, None), (3, 0, "assistant", "x"), (4, 1, "ro\nle\\n<|", "t"), (4, 1, "ro\nle\\n<|", "t"), (None, 0, "assistant", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    examples = chat.expand(turns).collect()
    by = {}
    for e in examples:
        by.setdefault(e.conv_id, []).append(e)
    assert [(e.target, e.loss_end > e.loss_start or hard[e.target] in ("", None)) for e in by[1][:2]] == [(2, True), (4, True)] and by[1][2].target is None
    for ident, found in by.items():
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == ident), key=lambda r: (r[1] is not None, r[1] or 0))]
        found.sort(key=lambda e: e.example)
        assert chat.read_back(found[-1].text) == want
        replies = [chat.unescape(e.text[e.loss_start : e.loss_end]) for e in found if e.target is not None]
        assert replies == [t for r, t in want if r == "assistant"]
    assert chat.expand(turns.limit(0)).count() == 0


def test_mix_reaches_targets(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "c", "é", None])) for i in range(900)] + [(900, None, "a"), (901, "", "only empty"), (None, "w w", "b"), (None, "w", "b"), (7, "w", "c"), (7, "w", "c"), (950, "w " * 900, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"_words": F.lit("x"), "copies": F.lit(1), "row": F.lit("y"), "rate": F.lit(2)}).repartition(4)
    found = mixing.decide(docs).toPandas()
    assert len(found) == len(rows) and found["copies"].max() <= 2
    total = found["size"].sum()
    g = found.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"))
    g["taken"] = found.assign(t=found["size"] * found["copies"]).groupby("source", dropna=False)["t"].sum()
    assert g.target.sum() == pytest.approx(1.5 * total) and (g.target <= 2 * g["size"] + 1e-9).all()
    assert (abs(g.taken - g.target) <= 0.02 * g["size"]).all()
    again = mixing.decide(docs.repartition(7)).toPandas()
    key = ["doc_id", "copies"]
    assert found[key].fillna(-1).sort_values(key).to_numpy().tolist() == again[key].fillna(-1).sort_values(key).to_numpy().tolist()
    table = mixing.mix(docs)
    assert table.columns == docs.columns and table.count() == found["copies"].sum()
    # expected copies fall with the length of a document: no one probability for a whole source
    part = found[(found.source == "c") & (found["size"] > 0)]
    assert part[part["size"] < 20].copies.mean() > part[part["size"] > 40].copies.mean()
    assert mixing.decide(docs.limit(0)).count() == 0


def _toy_labels(n):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        toxic = i % 3 == 0
        words = [rng.choice("the of and to report water house green river".split()) + rng.choice(["", "s", "ing"]) for _ in range(30)]
        if toxic:
            words[rng.randrange(30)] = rng.choice(["idiot", "Scum,", "loweifach", "loweizahl", "loweiheit"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_scores_are_those_of_the_network_by_hand():
    rows = _toy_labels(300)
    texts = [t for _, t, _ in rows[:40]] + ["", "one", "two words", "x " * 500]
    model = toxicity.train(pa.chunked_array([pa.array([t for _, t, _ in rows])]), np.array([y for _, _, y in rows]))
    tokens = toxicity.tokenise(*text_buffer(pa.chunked_array([pa.array(texts)])))
    found = toxicity.score(model, tokens, model.responses())
    langs = toxicity.languages(tokens)
    for i in range(len(texts)):
        buckets = tokens.buckets[tokens.first[i] : tokens.first[i + 1]]
        vectors = [sum(model.embedding[b] for b in row) for row in buckets]
        logit = model.out_bias
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                outs = [sum(vectors[at + j] @ model.kernel[toxicity.SLOTS.index((w, j)), :, f] for j in range(w) if at + j < len(vectors)) for at in range(len(vectors))]
                logit += model.out[k, f] * max(0.0, max(outs, default=0.0) + model.bias[k, f])
        assert found[i] == pytest.approx(1 / (1 + np.exp(-(logit - model.shift[langs[i]]))), abs=1e-4)


def test_toxicity_learns_and_holds_out(spark):
    rows = _toy_labels(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, "")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert len(got) == 1502 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert got[5000].score == got[5001].score
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    unlabelled = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(docs, unlabelled).collect()} == {0.0}


def test_toxicity_is_trained_by_a_task(spark, monkeypatch):
    import os

    rows = _toy_labels(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    driver, tokenise = os.getpid(), toxicity.tokenise

    def elsewhere(data, offsets):
        assert os.getpid() != driver, "the driver holds no texts"
        return tokenise(data, offsets)

    chosen = [(t, y) for i, t, y in sorted(rows) if zlib.crc32(str(i).encode()) % 5]
    here = toxicity.train(pa.chunked_array([pa.array([t for t, _ in chosen])]), np.array([y for _, y in chosen]))
    monkeypatch.setattr(toxicity, "tokenise", elsewhere)
    model = toxicity.fit(docs, labels)
    assert model.trained and np.allclose(model.embedding, here.embedding) and np.allclose(model.shift, here.shift)


def test_tokens_never_span_texts():
    data, offsets = text_buffer(pa.chunked_array([pa.array(["ab", "cd", "", "É e", "f"])]))
    tokens = toxicity.tokenise(data, offsets)
    assert np.diff(tokens.first).tolist() == [1, 1, 0, 2, 1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="page">
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="cookie-notice">We use cookies, really we do. Accept all of them.</div><div class="ad">Buy this now. It is good.</div>
<article><h1>A title &amp; more</h1><p><b>First   paragraph,
with words &eacute;.<br>and a break<p>Short.</p><p>The third paragraph has a <a href="/x">link</a> in it, and goes on for a while.</p></article>
<aside class="sidebar"><p>Related stories that you may like, and more of them.</p></aside><form><p>Sign up for the letter, please.</p></form>
<section id="comments"><p>A reader says: this is a long comment, with many words and marks.</p></section><footer>&copy; somebody</footer>"""


def test_main_text_of_a_page(spark):
    want = "A title & more\nFirst paragraph, with words é. and a break\nShort.\nThe third paragraph has a link in it, and goes on for a while."
    assert html_text.main_text(PAGE) == want
    rows = [(1, "u", PAGE, "x"), (2, "v", None, None), (3, None, "", "y"), (4, "w", "<p>" * 3000 + "x", "z"), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _html string")
    got = html_text.extract(pages, columns=("page_id", "url", "_html")).collect()
    assert sorted((r.page_id, r.text, r.n_chars, r._html or "") for r in got if r.page_id < 4) == sorted([(1, want, len(want), "x")] * 2 + [(2, "", 0, ""), (3, "", 0, "y")])
    assert html_text.extract(pages.limit(0)).count() == 0


PROSE = "A long sentence about things, with a comma. Another one follows here, and it ends too."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div id="search-algorithms"><p>{PROSE}</p><p>{PROSE} B</p></div>', [PROSE, f"{PROSE} B"]),
        (f'<div class="side-effects"><p>{PROSE}</p></div>', [PROSE]),
        (f'<div class="search"><p>{PROSE}</p></div>', [PROSE]),
        (f'<article><p>{PROSE}</p><div class="side-effects"><p>{PROSE} B</p></div></article><div class="site-sidebar"><p>{PROSE} C</p></div>', [PROSE, f"{PROSE} B"]),
        (f'<form id="all"><div class="site-header"><a href="x">Home</a></div><div><p>{PROSE}</p></div></form>', [PROSE]),
        (f'<main><h1>Title</h1><p>{PROSE}</p></main><section class="comments"><article class="comment"><p>I like it.</p></article></section>', ["Title", PROSE]),
        (f"<article><p>{PROSE} <math><mi>x</mi></math> <noscript>n</noscript><select><option>no</option></select></p></article>", [f"{PROSE} x n"]),
        (f"<article><title>open<p>{PROSE}</p><p a='>{PROSE} &amp;<p>{PROSE} </nav></article>", ["open", PROSE, f"{PROSE} &", PROSE]),
        (f"<article><p>{PROSE}</p></article><script>let a = '<p>{PROSE}</p>'", [PROSE]),
    ],
)
def test_names_do_not_overrule_the_page(page, want):
    assert html_text.main_text(page).split("\n") == want


def test_pages_are_read_in_linear_time():
    rng = random.Random(5)
    mixed = ["<p>", "</p>", "<div>", "</div>", "<a href=x>", "</a>", "<li>", "<ul>", "word and more, yes. ", "<nav>", "</nav>", "<td>", "<b>", "<"]
    n = 15_000
    pages = ["<div>a b" * n, "<a 'x " * n, "<a b='x " * n + ">", "<svg>" * n, "<template>" * n, "<![CDATA[" * n, "</" * 3 * n, "<a " + "= " * n, "<ul><li>" * n, "".join(rng.choice(mixed) for _ in range(2 * n))]
    begin = time.process_time()
    for page in pages:
        html_text.main_text(page)
    assert time.process_time() - begin < 20  # reading that is not linear takes minutes


def test_labels_are_a_minimum_cut_of_the_pages_costs():
    rng = random.Random(7)
    parts = ["<p>", "</p>", "<div>", "</div>", '<div class="ad">', "<nav>", "</nav>", "<ul><li>", "</ul>", "One, two. ", "<a href=x>link</a>", "Words and words: yes! "]
    for _ in range(80):
        page = html_text.read("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))))
        odds, edges = html_text.costs(page)
        if len(odds) > 10:
            continue

        def cost(sides):
            return sum(abs(o) for o, s in zip(odds, sides) if (o > 0) != s) + sum(w for a, b, w in edges if sides[a] != sides[b])

        best = min(cost([bool(m >> i & 1) for i in range(len(odds))]) for m in range(1 << len(odds)))
        assert cost(html_text.label(page)) == pytest.approx(best)


def test_cut_is_minimum():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 7)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(sides):
            return sum(abs(o) for o, s in zip(odds, sides) if (o > 0) != s) + sum(w for a, b, w in edges if sides[a] != sides[b])

        flow = html_text.Flow(n)
        for i, o in enumerate(odds):
            flow.edge(flow.n, i, o) if o > 0 else flow.edge(i, flow.n + 1, -o)
        for a, b, w in edges:
            flow.edge(a, b, w, w)
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(flow.source_side()) == pytest.approx(best)


def test_base_counts_equal_brute_force():
    rng = random.Random(8)
    texts = ["\n".join(" ".join(rng.choice(["a", "b", "cé", "#x*", "\x0b", ""]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 8))) for _ in range(300)] + ["", "\n\n", "a\na\na\n", "x" * 5000]
    got = quality.base_counts(*text_buffer(pa.chunked_array([pa.array(texts)])))
    for i, t in enumerate(texts):
        words = WORD.findall(t)
        lines = [line for line in t.split("\n") if WORD.search(line)]
        grams = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        covered = {k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(j, j + 5)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(got[k][i]) for k in quality.BASE) == want


def test_quality_rejects_what_is_far_from_its_language(spark):
    rng = random.Random(9)
    plain = lambda: " ".join(rng.choice("the of and a river house that water green was for with stone".split()) + str(rng.randrange(50)) * (rng.random() < 0.5) for _ in range(120)) + "."
    texts = [plain() for _ in range(60)] + [" | ".join(plain().split()), plain().upper().replace(" ", "!! "), "short one", None, ""]
    docs = spark.createDataFrame([(i, t, None if i % 7 == 0 else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(2)
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[i] for i in range(60, 65))
    # a small language of another script is near itself, whatever else there is
    wide = "".join(chr(0x0420 + rng.randrange(32)) + " " * (rng.random() < 0.2) for _ in range(900))
    extra = spark.createDataFrame([(100, wide, "xx"), (101, wide, "xx"), (None, plain(), ""), (60, texts[60], "en")], docs.schema)
    more = docs.unionByName(extra).withColumns({"counts": F.lit(1), "row": F.lit("r"), "kept": F.lit(9)})
    found = quality.judge(more, columns=more.columns).collect()
    assert len(found) == 69 and {r.kept for r in found if r.lang == "xx"} == {True} and all(r.counts == 1 and r.row == "r" for r in found)
    assert [r.kept for r in found if r.doc_id == 60] == [False, False] and [r.kept for r in found if r.doc_id is None] == [True]
    assert quality.judge(docs.limit(0)).count() == 0
    # the distances by their definition
    reference = {r.lang: np.array(r.counts, float) for r in quality.language_references(docs).collect()}
    assert set(reference) == {"", "en"}
    for r in quality.judge(docs, columns=["doc_id", "lang", "text"]).collect():
        chars = np.array([sum(_char_class(c) == k for c in r.text or "") for k in quality.CLASSES], float)
        other = reference[r.lang or ""][: len(chars)]
        assert r.char_distance == pytest.approx(_jensen_shannon(chars, other), abs=1e-9)


def _char_class(c):
    for name, chars in {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "space": " \t", "line": "\n\r", "stop": ".?", "inner": ",;:", "quote": "\"'()[]{}-", "bar": "|/\\_", "mark": "!", "symbol": "#*$%&<>+=@^~`"}.items():
        if c in chars:
            return name
    return "wide" if ord(c) > 127 else "control"


def _jensen_shannon(a, b):
    if not a.sum():
        return 0.0
    p, q = a / a.sum(), b / b.sum()
    entropy = lambda x: -sum(v * np.log2(v) for v in x if v > 0)
    return np.sqrt(max(0.0, entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2))
    assert quality.judge(docs.limit(0)).count() == 0


def test_distance_bounds():
    counts = np.array([[5, 0], [0, 5], [1, 1], [0, 0]])
    found = quality.jensen_shannon(counts, np.array([[5.0, 0.0]] * 4))
    assert found[0] == 0 and found[1] == 1 and 0 < found[2] < 1 and found[3] == 0


def test_training_holds_two_bytes_for_each_bucket_of_a_token():
    import numpy as np

    from spanwise.llm import toxicity

    data = np.frombuffer(b"some longer words, and short ones", np.uint8)
    tokens = toxicity.tokenise(data, np.array([0, 17, len(data)]))
    assert tokens.buckets.itemsize == 2 and toxicity.BUCKETS <= 1 << 16
    assert tokens.buckets.shape == (6, toxicity.FEATURES) and (tokens.buckets[:, 0] > 0).all()
