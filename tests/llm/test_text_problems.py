"""Problems 1, 5, 8, 9: operators on one text each."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.llm import markup as M
from lakeloom.llm import p1_markup, p5_quality, p8_leaks, p9_reading, wrappers
from lakeloom.llm import quality_lines as Q

LONG = "The office pays 12 per day, although the list is old. " * 20_000
ODD = [None, "", " \t\n\u00a0", LONG, "x" * 300_000, "<!--" * 50_000, "." * 100_000, "*a" * 50_000, "[[" * 50_000, "\x00\ufeff", "|" * 1000]


@pytest.mark.parametrize(
    "text, found",
    [
        ("<p>Hello</p>", {"html"}),
        ("a &lt;b", {"html"}),
        ("R&D note [16] and <unknown> sizes 2 * 3 * 4", set()),
        ("## Heading\ntext", {"markdown"}),
        ("Heading\n=======\ntext", {"markdown"}),
        ("* one\n* two", set()),
        ("1. **bold** item", {"markdown"}),
        ("see [here](https://a.example/x)", {"markdown"}),
        ("| a | b |\n|---|:-:|\n| 1 | 2 |", {"markdown"}),
        ("a | b | c", set()),
        ("== Heading ==\ntext", {"wiki"}),
        ("[[Category:x]] and '''bold'''", {"wiki"}),
        ("w[[1, 9]] == 38 holds", set()),
        ("{| class=x\n|-\n| a || b\n|}", {"wiki"}),
        ("\\begin{itemize}\n\\item one\n\\end{itemize}", {"latex"}),
        ("as shown \\cite{a2024}", {"latex"}),
        ("The path is C:\\data\\selutas", set()),
        ("Lunch is $53.05 and dinner $203.80", set()),
        ("########## 4855 %%%%%%%\n------- 12 @@@@", set()),
        ("```python\nx = '<div>' # not html\n```", {"markdown"}),
        ("<pre><code>if (a &lt; b) { **x** }</code></pre>", {"html"}),
        ("const a = require('./b');\nfunction f(x) {\n  return g('<div>' + x);\n}", set()),
    ],
)
def test_languages(text, found):
    assert M.languages(text) == found


def test_clean_keeps_structure():
    assert M.clean("<h2>Head</h2><ul><li>a &amp; b</li></ul>") == "## Head\n\n- a & b"
    assert M.clean("== Head ==\n* [[x|y]] and '''z'''") == "# Head\n* y and z"
    assert M.clean("\\section{A}\n\\begin{equation}\nx = \\frac{1}{2}\n\\end{equation}") == "# A\n\n$$ x = \\frac{1}{2} $$"
    assert M.clean("**a** [b](http://c.example)\n\n```\n**kept**\n```") == "a b\n\n```\n**kept**\n```"
    assert M.clean("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>").split("\n")[-1].count("|") == 2
    assert M.clean("plain text") == "plain text"


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_pass_every_function(text):
    M.languages(text)
    M.clean(text)
    if text is not None:
        Q.kinds_of_lines(text)
        Q.text_stats(text)
        p8_leaks.plain_words(text)
        p9_reading.running_words(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab <>/&;#*_`[]()|={}\\$'\n\t.:-1é", max_size=200))
def test_any_text_passes(text):
    M.languages(text)
    assert M.clean(M.clean(text)) is not None
    count, _ = Q.kinds_of_lines(text)
    assert sum(count.values()) == len([x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()])


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Notes:\n- a b\n- c d\n- e f", "list"),
        ("(1) one\n(2) two", "list"),
        ("<ul>\n<li>a</li>\n<li>b</li>\n</ul>", "list"),
        ("a,b,c\nx,1,2\ny,3,4", "table"),
        ("name      n\nfoo       12\nbar       9", "table"),
        ("Owner: x\nUnit: 3.5\nCity: y", "table"),
        ('{"Owner": "x", "Unit": "3"}', "table"),
        ("Owner: x; Unit: 3.5; City: y", "table"),
        ("def f(x):\n    return g(x)\n\nfor i in range(3):\n    f(i)", "code"),
        ("```\nanything at all here\n```", "code"),
        ("Home | Back | Login | Menu | Top | Home | Print | Next", "junk"),
        (". . . . . . . 12\n. . . . . . . . 33", "junk"),
        ("read more a passage 1 " * 12, "junk"),
        ("Search results improve when the index is read together with its list.", "prose"),
        ("THE OFFICE PAYS 12 PER DAY, ALTHOUGH THE LIST IS OLD AND\nNOBODY IN THE OFFICE KNOWS WHY IT IS SO.", "prose"),
        ("# A heading", "prose"),
        ("WEEKLY NOTES  FOR ROME  00000763", "prose"),
    ],
)
def test_kind(text, kind):
    assert Q.kind_of(Q.kinds_of_lines(text)[0]) == kind


WIDE = [f"{i}.5" for i in range(900)]
PROSE, MORE = (" ".join(f"the keeper{i} of house{i} wrote that gate{i} was late and" for i in r) for r in (range(60), range(60, 120)))
MINIFIED = "var a={b:1,c:[2,3]};function f(x){return x<a.b?f(x+1):[x,a.c]};" * 60


@pytest.mark.parametrize(
    "text, kind",
    [
        *((sep.join(["name", *WIDE]) + "\n" + sep.join(["x", *WIDE]), "table") for sep in ("\t", "   ", ",", ";")),
        (f"Owner: x; City: y; Notes: {PROSE}", "table"),
        (f"Owner: x\nCity: y\nNotes: {PROSE}", "table"),
        (f"The house\nOwner: x\nCity: y\nUnit: 4\nNotes: {PROSE}", "table"),
        (f"The values\nFirst: {' '.join(WIDE)}\nSecond: {' '.join(WIDE)}", "table"),
        (MINIFIED + "\n" + MINIFIED, "code"),
        (f"data = [{', '.join(WIDE)}]\nother = [{', '.join(WIDE)}]", "code"),
        (PROSE + ".\n" + MORE + ".", "prose"),
        (f"Note: {PROSE}.\nThen: {MORE}.", "prose"),
        (f"He said; {PROSE};\nand then; {MORE};", "prose"),
    ],
)
def test_kind_of_long_lines(text, kind):
    assert Q.kind_of(Q.kinds_of_lines(text)[0]) == kind


def test_literals_in_long_code_lines_are_no_markup():
    line = MINIFIED + 'g("<b>x</b>");'
    assert M.languages(line + "\n" + line) == set()


def frame(spark, texts, extra=True):
    rows = [(f"d{i}", t, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, content string, kind int" if extra else "id string, content string, n int")


def test_markup_operator_on_odd_rows(spark):
    df = frame(spark, [*ODD[:4], "<b>x</b>", "<b>x</b>", "# h\n\\cite{a}"]).withColumn("clean_text", F.lit("old"))
    out = p1_markup.clean_markup(df).collect()
    assert len(out) == 7 and [r for r in out if r.id == "d4"][0].clean_text == "x"
    more = df.unionByName(df.withColumn("id", F.concat("id", F.lit("+"))))
    found = {(r.id, r.markup) for r in p1_markup.markup_found(more).collect() if "+" not in r.id}
    assert found == {("d4", "html"), ("d5", "html"), ("d6", "markdown"), ("d6", "latex")}
    assert p1_markup.markup_found(df.limit(0)).count() == 0


HOST = "id string, source string, content string"


def test_template_classes(spark):
    pages = [(f"p{i}", "h", f"<title>site</title>\n<ul>\n<li>word{i}</li>\n<li>other{i}</li>\n</ul>\n## end {i}") for i in range(6)]
    pages += [(f"q{i}", "g", f"'''word{i}''' and [[link {i}]], <b>lone {i}") for i in range(3)]
    df = spark.createDataFrame([*pages, ("q", "h", None), ("r", "h", " "), ("s", None, "**once**")], HOST)
    got = p1_markup.template_classes(df).collect()
    of = {t: r for r in got for t in r.tokens if r.host == "h"}
    assert of["<ul"].tokens == of["</ul"].tokens and of["<li"].tokens == of["</li"].tokens and of["<li"].class_id != of["<ul"].class_id
    assert of["<ul"].support == 6 and of["<li"].per_page == 2.0 and of["<li"].inside == of["<ul"].class_id and of["<ul"].inside is None
    assert {t for r in got for t in r.tokens if r.host == "g"} >= {"'''‹", "›'''", "[[‹", "›[[", "<b", "><b"}
    assert not any("**" in t for r in got for t in r.tokens)  # one page alone is no template
    slots = p1_markup.template_slots(df, p1_markup.template_classes(df)).where("page like 'p%'").collect()
    assert [s.slot_text for s in sorted(slots, key=lambda s: s.slot) if s.page == "p3"] == ["site", "word3", "other3", "end 3"]
    assert p1_markup.template_classes(df.limit(0)).count() == 0
    assert p1_markup.template_slots(df.limit(0), p1_markup.template_classes(df.limit(0))).count() == 0


def test_classes_without_one_order_are_split(spark):
    rows = [("p1", "h", "**a** then [b](c)"), ("p2", "h", "[b](c) then **a**")]
    df = spark.createDataFrame(rows, HOST)
    assert {(r.id, r.markup) for r in p1_markup.markup_found(df, F.col("source")).collect()} == {("p1", "markdown"), ("p2", "markdown")}
    tokens = [set(r.tokens) for r in p1_markup.template_classes(df).collect()]
    assert not any({"**‹", "["} <= t for t in tokens) and any({"**‹", "›**"} <= t for t in tokens)


def test_deduction_decides_and_the_grammar_confirms(spark):
    """A sign that wraps nothing is in no class, whatever the grammar says; a class without a language is none either."""
    texts = ["**a** b", "**c** d", "(x) y", "(z) w", "```\n<b>k</b>\n```", "```\n<b>m</b>\n```", "$$$$$$ 12 $$$$$", "$$$$ 7 $$$", "<u>rare", "[[x]] y", "f(x) = {1}\ng(y) = {2};"]
    df = spark.createDataFrame([(f"p{i}", "h", t) for i, t in enumerate(texts)], HOST)
    got = {(r.id, r.markup) for r in p1_markup.markup_found(df, F.col("source")).collect()}
    assert got == {("p0", "markdown"), ("p1", "markdown"), ("p4", "markdown"), ("p5", "markdown")}
    alone = {(r.id, r.markup) for r in p1_markup.markup_found(df, F.col("source"), checked=False).collect()}
    assert got <= alone and not any(i in ("p2", "p3") for i, _ in alone)
    every = {(r.id, r.markup) for r in p1_markup.markup_found(df, F.col("id")).collect()}
    assert every == got  # each page a host of its own: classes come from all hosts


@pytest.mark.parametrize("text", ODD)
def test_wrappers_of_odd_texts(text):
    tokens = wrappers.page_tokens(text)
    assert all(n > 0 and a <= z for _, n, a, z, _ in tokens)
    wrappers.page_slots(text, {"<b", "**"})


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab <>/&;#*_`[]()|={}\\$'\n\t.:-1é", max_size=200))
def test_wrappers_of_any_text(text):
    wrappers.page_tokens(text)
    assert all(p.strip() for p in wrappers.page_slots(text, {"**", "<b"}))


def test_quality_operator(spark):
    good = "The office in the town pays for the lunch, and the list of the costs is in the box."
    rows = [("a", good, 18, 1), ("b", good, 17, 1), ("c", None, 3, 3), ("d", " ", 0, 1), ("e", " ", 1, None), ("f", "x\ny", None, 1), ("g", "x\ny", None, 2), ("g", "x\ny", None, None)]
    df = spark.createDataFrame(rows, "id string, content string, word_count int, line_count int").withColumn("key", F.lit(1))
    assert {r.id for r in p5_quality.miscounts(df).collect()} == {"a", "b", "e", "f"} - ({"a"} if len(good.split()) == 18 else {"b"} if len(good.split()) == 17 else set())
    stats = p5_quality.document_stats(df)
    assert {r.id for r in stats.collect()} == {"a", "b", "f", "g"}
    q = p5_quality.sketch_quantiles(p5_quality.stat_sketches(stats))
    scored = p5_quality.with_tails(stats, q).collect()
    assert len(scored) == 5 and all(r.z_words is not None for r in scored)
    assert p5_quality.with_tails(stats.limit(0), q).count() == 0
    assert p5_quality.sketch_quantiles(p5_quality.stat_sketches(stats.limit(0))).count() <= 5


LISTS = ["- keys and cards\n- old cups\n- the box\n- maps", "1. read it\n2. sort it\n3. send it"]
JUNK = ["Home | Back | Login | Menu | Top | Home | Print | Next", "read more a passage 1 " * 12, ". . . . . . . 12\n. . . . . . . . 33", "row loader index table cell vector query column report thread form score digest"]


def good_text(i):
    rng = random.Random(i)
    return " ".join(f"The {rng.choice(['office', 'keeper', 'clerk'])} in the {rng.choice(['town', 'north'])} pays for the {rng.choice(['lunch', 'repair'])}, and the list of the costs is in box {rng.randint(1, 90)}." for _ in range(rng.randint(2, 6)))


def test_kinds_lie_in_tails(spark):
    rows = [(f"g{i}", good_text(i)) for i in range(60)] + [(f"j{i}", x) for i, x in enumerate(JUNK)] + [(f"l{i}", x) for i, x in enumerate(LISTS)] + [("n", None), ("b", " \n")]
    df = spark.createDataFrame(rows, "id string, content string").withColumn("kind", F.lit("clash"))
    q = p5_quality.sketch_quantiles(p5_quality.stat_sketches(p5_quality.document_stats(df)))
    got = {(r.id, r.kind) for r in p5_quality.kinds_in_tails(df, q).collect()}
    assert got == {(f"j{i}", "junk") for i in range(4)} | {("l0", "list"), ("l1", "list")}
    assert p5_quality.kinds_in_tails(df.limit(0), q).count() == 0


def test_tails_decide_what_the_lines_may_say(spark, monkeypatch):
    """Where every document is a list, being one is no tail, and the line rules alone name nothing."""
    monkeypatch.setattr(p5_quality, "KIND_TAILS", {"list": {"marked": 1}})
    rows = [(f"l{i}", f"- {good_text(i)}\n- {good_text(i + 500)}") for i in range(30)]
    df = spark.createDataFrame(rows, "id string, content string")
    assert {Q.kind_of(Q.kinds_of_lines(t)[0]) for _, t in rows} == {"list"}
    q = p5_quality.sketch_quantiles(p5_quality.stat_sketches(p5_quality.document_stats(df)))
    assert p5_quality.kinds_in_tails(df, q).count() == 0
    more = df.unionByName(spark.createDataFrame([(f"g{i}", good_text(i)) for i in range(40)], "id string, content string"))
    q = p5_quality.sketch_quantiles(p5_quality.stat_sketches(p5_quality.document_stats(more)))
    assert p5_quality.kinds_in_tails(more, q).count() == 30


def test_percentiles(spark):
    df = spark.createDataFrame([(f"d{i:03d}", "the " * (i + 1)) for i in range(200)], "id string, content string")
    stats = p5_quality.document_stats(df)
    got = {r.id: r for r in p5_quality.with_tails(stats, p5_quality.sketch_quantiles(p5_quality.stat_sketches(stats))).collect()}
    assert got["d000"].p_words <= 1 and abs(got["d100"].p_words - 50) <= 3 and got["d199"].p_words >= 98
    assert got["d199"].z_words > got["d150"].z_words > 0 > got["d020"].z_words


def brute_leak(doc, item):
    d, w = p8_leaks.plain_words(doc), item.lower().split()
    return any(d[i : i + 12] == w[j : j + 12] for i in range(len(d) - 11) for j in range(len(w) - 11))


def test_leaks_against_brute_force():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(12, 40)))) for k in range(12)]
    find = p8_leaks.Patterns([*items, (99, None), (98, "too short"), (97, " ")])
    for _ in range(150):
        doc = rng.choices(vocabulary, k=rng.randint(5, 60))
        if rng.random() < 0.6:
            k, text = rng.choice(items)
            w = text.split()
            a = rng.randint(0, len(w) - 12)
            at = rng.randint(0, len(doc))
            doc[at:at] = w[a : a + rng.randint(10, 14)]
        text = " ".join(doc)
        exact = {k for k, item in items if brute_leak(text, item)}
        assert exact <= set(find.leaked(text))


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_close_leaks_against_brute_force():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(80)]
    items = [(k, rng.choices(vocabulary, k=rng.choice([4, 5, 9, 12, 15, 20, 25]))) for k in range(20)]
    find = p8_leaks.Patterns([(k, " ".join(w)) for k, w in items])
    hits = no_window = 0
    for _ in range(250):
        _, w = rng.choice(items)
        edited = list(w)
        for i in rng.sample(range(len(w)), int(len(w) * rng.choice([0.1, 0.2, 0.3]))):
            edited[i] = rng.choice(["other", "", rng.choice(vocabulary)])
        for _ in range(rng.randint(0, len(w) // 3)):
            edited.insert(rng.randint(0, len(edited)), rng.choice(["more", *vocabulary]))
        doc = [*rng.choices(vocabulary, k=rng.randint(0, 40)), *filter(None, edited), *rng.choices(vocabulary, k=rng.randint(0, 40))]
        got = set(find.leaked(" ".join(doc)))
        for k, item in items:
            n = int(1.5 * len(item)) + 4
            close = any(longest_common(item, doc[i : i + n]) >= 0.8 * len(item) - 1e-9 for i in range(max(1, len(doc) - n + 1)))
            exact = brute_leak(" ".join(doc), " ".join(item))
            assert close <= (k in got) and (k not in got or close or exact or len(item) >= 12)
            hits += close
            no_window += close and not any(doc[i : i + 4] == item[j : j + 4] for i in range(len(doc) - 3) for j in range(len(item) - 3))
    assert hits > 100 and no_window > 10


def test_leaks_of_many_items_take_several_scans(spark, monkeypatch):
    items = [(k, " ".join(f"w{k}x{i}" for i in range(14))) for k in range(9)]
    docs = spark.createDataFrame([(k, "start " + t + " end") for k, t in items] + [(50, None)], "doc_id long, text string")
    monkeypatch.setattr(p8_leaks, "MAX_ITEMS", 2)
    got = p8_leaks.leaks(docs, spark.createDataFrame(items, "case_id long, ground_truth string")).collect()
    assert {(r.doc_id, r.case_id) for r in got} == {(k, k) for k in range(9)} and len(got) == 9


def test_leak_forms(spark):
    item = "Neither inspectors nor Delalith could trace the seasonal stipend numbered 4157 last seen in Orvale on the ninth of May by the old harbour wall"
    w = item.split()
    changed = [x if i % 6 else "other" for i, x in enumerate(w)]
    docs = [
        (1, "x " + "<b>" + "</b> <i>".join(w[:14]) + "</i> y"),
        (2, " ".join(w[:11])),
        (3, " ".join(changed)),
        (4, "a b c " + " ".join(w[:8]) + " filler filler filler " + " ".join(w[8:15])),
        (5, None),
        (6, " "),
        (7, "nothing of it " * 500),
        (8, (item + " ") * 3),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("case_id", F.lit("clash"))
    cases = spark.createDataFrame([(10, item), (11, None), (12, "")], "case_id long, ground_truth string").withColumn("text", F.lit(0))
    got = {(r.doc_id, r.case_id) for r in p8_leaks.leaks(df, cases).collect()}
    assert got == {(1, 10), (3, 10), (4, 10), (8, 10)}
    assert p8_leaks.leaks(df.limit(0), cases).count() == 0 and p8_leaks.leaks(df, cases.limit(0)).count() == 0


EASY = "The cup is on the box. We like the red bag best. You can put the book in the bag. If the key is wet, ask Tam for help. "
HARD = "Notwithstanding the contradictory character of inference, probabilistic calibration necessitates a comprehensive reconceptualisation of the assumptions underlying normalisation. "
MID = "Users who sort the record from the office also merge the broken invoice and its rankings, because the list is old. "


def test_isotonic_is_monotone():
    import numpy as np

    x, y = p9_reading.isotonic(np.array([3.0, 1, 2, 4, 5]), np.array([1.0, 0, 2, 1, 2]))
    assert list(x) == sorted(x) and list(y) == sorted(y)


def test_ngram_probabilities_sum_to_one():
    rng = random.Random(2)
    levels = [[rng.choices("abcdefgh"[: 4 + 2 * k], k=30) for _ in range(3)] for k in range(3)]
    for order in (1, 2, 3):
        models = p9_reading.NGrams(levels, order)
        words = [*models.rows[0], "never seen"]
        for history in (["a"], ["a", "h"], ["h", "a", "b"], ["never seen", "b"]):
            total = sum(2.0 ** -models([*history, w])[-1] for w in words)
            assert total == pytest.approx([1.0] * 3)
    assert p9_reading.NGrams(levels, 3)(["a"]).shape == (1, 3)


def test_reading_levels(spark):
    rng = random.Random(1)

    def text(base, n=6):
        parts = [s for s in base.split(". ") if s.strip()] * n
        rng.shuffle(parts)
        return ". ".join(p.strip(". ") for p in parts) + "."

    samples = [(text(b), level) for b, level in ((EASY, "basic"), (MID, "middle"), (HARD, "advanced")) for _ in range(10)]
    ex = spark.createDataFrame([*samples, (None, "basic"), ("x", None), ("x", "unknown")], "text string, reading_level string")
    reader = p9_reading.fit(ex)
    docs = [(1, text(EASY)), (2, text(MID)), (3, text(HARD, 8)), (4, None), (5, " "), (6, EASY), (7, "Der Dienst speichert alle Anlagen aus dem Haus für die Tage. " * 20), (8, "a,b,c\n1,2,3\n" * 60), (9, "- " + text(MID).replace(". ", "\n- "))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("grade", F.lit("clash"))
    got = {r.doc_id: r.reading_level for r in p9_reading.reading_profile(df, reader).collect()}
    assert got == {1: "basic", 2: "middle", 3: "advanced", 9: "middle"}
    assert p9_reading.reading_profile(df.limit(0), reader).count() == 0
    with pytest.raises(ValueError):
        p9_reading.fit(ex.limit(0))
