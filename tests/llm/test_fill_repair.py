"""Fill-in-the-middle and the repair of conversations, against plain versions of what they do."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from spanwise.llm import fill_middle, html_text, quality, repair, toxicity


def _pieces(output, form):
    if form == "plain":
        return None
    a, b, c = re.fullmatch(r"<[PS]>(.*)<[SP]>(.*)<M>(.*)", output, re.S).groups()
    return (b, c, a) if form == "spm" else (a, c, b)


@pytest.mark.parametrize("pattern", [None, r"[^\s]+", r"(?=b)|é+"])
def test_cuts_by_checkpoints_equal_plain_cuts(spark, monkeypatch, pattern):
    monkeypatch.setattr(fill_middle, "STEP", 3)
    monkeypatch.setattr(fill_middle, "CHUNK", 7)  # chunks end inside of code points
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é漢😀\n") for _ in range(rng.randrange(90))) for _ in range(80)] + ["a<", "<P", "<S", "x<M>y", "", None, " ", "😀" * 50]
    units = fill_middle.Matches(pattern) if pattern else fill_middle.CodePoints()
    for text in filter(None, texts):
        starts = [m.start() for m in re.finditer(pattern, text)] if pattern else list(range(len(text)))
        index = units.index(text.encode(), 3)
        assert index.count == len(starts) and len(index.bytes) == -(-len(starts) // 3)
        for unit in range(len(starts) + 1):
            chars = 0 if unit == 0 else len(text) if unit == len(starts) else starts[unit]
            assert units.cut(text.encode(), index, unit) == (len(text[:chars].encode()), chars)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("n", F.lit("x"))
    rows = fill_middle.fill_in_middle(docs, pattern=pattern).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.back == text
        if r.form != "plain":
            prefix, middle, suffix = _pieces(r.output, r.form)
            assert prefix + middle + suffix == text and (len(prefix), len(middle)) == (r.prefix_chars, r.middle_chars)
        else:
            assert r.output == text and r.prefix_chars is None and r.middle_chars is None


def test_fill_in_middle_edges(spark):
    docs = spark.createDataFrame([(None, "abc"), (None, "abc"), (1, "x" * 300_000), (1, None)], "doc_id long, text string")
    rows = fill_middle.fill_in_middle(docs, fim_percent=100).collect()
    assert len({(r.form, r.output) for r in rows if r.doc_id is None}) == 1 and sorted(r.n for r in rows) == [0, 3, 3, 300_000]
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    assert {r.form for r in fill_middle.fill_in_middle(docs, fim_percent=0).collect()} == {"plain"}
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, markers=("<P>", "<S>", "x<"))


def _faults(turns):
    seen, out = set(), []
    for role, text in turns:
        last = text.rstrip(repair.SPACE)
        out.append("b" if not last else "d" if (role, text) in seen else "" if last[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def _cheapest(turns):
    """All edits of up to two insertions at each place, tried out."""
    faults, best = _faults(turns), None
    for codes in itertools.product(repair.CODES, repeat=len(turns)):
        for more in range(3):
            ways = [("", [])]
            cost = 5 * more + sum(5 * (len(c) - 1) for c in codes)
            items = []
            for (role, text), fault, code in zip(turns, faults, codes):
                items += [None] * (len(code) - 1)
                if code[-1] == "D":
                    cost += 2
                    continue
                if fault in ("b", "d"):
                    break
                cost += (code[-1] == "R") + 5 * (fault == "t")
                items.append((role, text, code[-1]))
            else:
                items += [None] * more
                audit = "".join(codes) + "I" * more
                if best is not None and (cost, audit) >= best[:2]:
                    continue
                for letters in [tuple("ua"[i % 2] for i in range(len(items))), ("s", *("ua"[i % 2] for i in range(len(items) - 1)))]:
                    if not re.fullmatch("(s?(ua)+)?", "".join(letters[: len(items)])) or (letters[:1] == ("s",) and (not items or items[0] is None or items[0][2] == "R")):
                        continue
                    if all(x is None or x[2] == "R" or x[0][:1] == y for x, y in zip(items, letters)):
                        out = [f"{repair.NAMES.get(y)}:" if x is None else f"{repair.NAMES[y] if x[2] == 'R' else x[0]}:{x[1]}" for x, y in zip(items, letters)]
                        best = (cost, audit, "\n".join(out))
            del ways
    return best


def test_repairs_equal_trying_all_edits(spark):
    rng = random.Random(8)
    words = ["Hi.", "No!", "cut", "  ", "", "What?\n"]
    conversations = {i: [(rng.choice(["user", "assistant", "system", "tool", "umpire", ""]), rng.choice(words)) for _ in range(rng.randint(1, 4))] for i in range(40)}
    rows = [(i, t, role, text) for i, turns in conversations.items() for t, (role, text) in enumerate(turns)]
    sums, repaired = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    texts = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.conv_id, r.position)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    got = {r.conv_id: (r.cost, r.audit, "\n".join(texts.get(r.conv_id, []))) for r in sums.collect()}
    assert got == {i: _cheapest(turns) for i, turns in conversations.items()}
    for r in sums.collect():
        faults = _faults(conversations[r.conv_id])
        assert (r.blank, r.duplicate, r.truncated, r.gaps) == (faults.count("b"), faults.count("d"), faults.count("t"), 0)


def test_repair_edges(spark):
    schema = "conv_id long, turn long, role string, text string, cost string, at int"
    rows = [(None, None, None, None, "x", 1), (1, 5, "user", "Hi.", "x", 1), (1, None, "system", "Be.", "x", 1), (1, 9, "assistant", "Yes.", "x", 1), (1, 9, "assistant", "Yes.", "x", 1)]
    sums, repaired = repair.repair(spark.createDataFrame(rows, schema))
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in sums.collect()}
    assert got == {None: (0, 1, 0, 0, 0, 2, "D"), 1: (3, 0, 1, 0, 1, 2, "KKKD")}
    assert [(r.position, r.role, r.text) for r in repaired.orderBy("position").collect()] == [(1, "system", "Be."), (2, "user", "Hi."), (3, "assistant", "Yes.")]
    sums, repaired = repair.repair(spark.createDataFrame([], schema))
    assert sums.count() == 0 and repaired.count() == 0


def test_repair_of_a_long_conversation(spark):
    turns = [("user" if i % 3 else "assistant", f"turn {i}." if i % 7 else f"turn {i}") for i in range(60_000)]
    programme = repair.Programme()
    for role, text in turns:
        programme.turn("ua".index(role[0]), repair.FINE if text.endswith(".") else repair.CUT_OFF)
    cost, codes, more = programme.end()
    assert len(programme.known) < 200  # steps are looked up, not worked out anew
    sums, repaired = repair.repair(spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string"))
    row = sums.first()
    assert row.cost == cost and row.audit == "".join(codes) + "I" * more
    letters = "".join(r.role[0] for r in repaired.orderBy("position").select("role").collect())
    assert re.fullmatch("(ua)+", letters)


def test_columns_of_the_results_names_are_replaced(spark):
    pages = spark.createDataFrame([(1, "<p>Some words in a paragraph of the page, enough of them.</p>", "old", 5, "x")], "page_id long, html string, text string, n_chars long, _html string")
    row = html_text.extract(pages, columns=("page_id", "text", "n_chars", "_html")).first()
    assert (row.page_id, row._html) == (1, "x") and row.text != "old" and row.n_chars == len(row.text)
    docs = spark.createDataFrame([(i, "bad words" if i % 2 else "good words", 9.0, "p") for i in range(40)], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_documents(docs, model, docs.columns).collect()
    assert len(rows) == 40 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)


def test_fit_takes_one_row_of_each_id_and_bounds_characters(spark):
    docs = spark.createDataFrame([(i, ("awful " if i % 2 else "lovely ") * 30) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    repeated = docs.unionByName(docs.filter("doc_id = 1").crossJoin(spark.range(500)).select("doc_id", "text"))
    one, many = (toxicity.score_documents(docs, toxicity.fit(d, labels)).orderBy("doc_id").collect() for d in (docs, repeated))
    assert one == many
    assert not toxicity.fit(docs, labels, characters=10).trained


def test_languages_without_a_reference_are_judged_by_the_base_rule(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat and saw the other cat there", "en"), (2, "yksi kaksi kolme nelja viisi kuusi seitseman kahdeksan yhdeksan kymmenen", "fi"), (3, "one two", "fi")], "doc_id long, text string, lang string")
    references = quality.language_references(docs).filter("lang = 'en'")
    rows = {r.doc_id: r for r in quality.judge(docs, references).collect()}
    assert set(rows) == {1, 2, 3} and rows[2].kept and rows[2].char_distance is None and rows[2].word_distance is None
    assert not rows[3].kept and rows[1].char_distance is not None
