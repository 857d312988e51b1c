"""Decontamination, line deduplication, extraction, classifiers and the pipeline."""
import random
import re

import numpy as np
import pytest

from vacantia.llm import gam_quality, toxicity
from vacantia.llm.decontaminate import decontaminate, hits
from vacantia.llm.html_main import extract, main_text
from vacantia.llm.line_dedup import line_chunks, line_dedup
from vacantia.llm.toxicity import Automaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(text, items):
    words, covered, found = folded(text), set(), set()
    for item, t in items:
        w = folded(t)
        k = min(13, len(w))
        for window in {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else ():
            for s in range(len(words) - k + 1):
                if tuple(words[s:s + k]) == window:
                    covered.update(range(s, s + k))
                    found.add(str(item) if item is not None else "")
    return len(words), len(covered), sorted(found), bool(covered) and 20 * len(covered) >= len(words)


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_hits_match_plain_python(spark, docs_of, block_bytes):
    rng = random.Random(3)
    pool = [" ".join(rng.choice(["the", "of", "A", *(f"w{i}" for i in range(40))]) for _ in range(n)) for n in (30, 14, 13, 12, 3, 1, 40)]
    items = list(enumerate(pool)) + [(0, pool[1]), (70, pool[2]), (None, "qq rr"), (9, None), (10, "--"), (11, "é ß x")]
    docs = [None, "", "...", "QQ, rr!", "qq", "É ß x é ß X", pool[4], pool[0] + " " + pool[0], pool[6][20:]]
    for _ in range(40):
        a, b = rng.choice(pool), rng.choice(pool)
        docs.append(" ".join(rng.choice(["zz", "the", "w1"]) for _ in range(rng.choice([1, 30, 400]))) + " " + a[rng.randrange(9):] + "-" + b)
    rows = list(enumerate(docs)) + [(3, docs[3]), (None, docs[7])]
    table = spark.createDataFrame([(None if i is None else str(i), t) for i, t in items], "item_id string, text string")
    got = hits(docs_of([(*r, 5) for r in rows], ", N_hit long"), table, block_bytes=block_bytes).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got), key=key) == sorted(((i, *plain_hits(t, items)) for i, t in rows), key=key)
    kept = decontaminate(docs_of([(*r, 5, 6) for r in rows], ", n_hit long, _spans long"), table)
    assert kept.columns == ["doc_id", "text", "n_hit", "_spans"] and {r.n_hit for r in kept.collect()} == {5}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in rows if not plain_hits(t, items)[3])


def test_empty_benchmark_and_documents(spark, docs_of):
    none = spark.createDataFrame([], "item_id string, text string")
    assert [(r.n_hit, r.n_items, r.contaminated) for r in hits(docs_of([(1, "a b")]), none).collect()] == [(0, 0, False)]
    assert hits(docs_of([]), none).collect() == []


def plain_dedup(rows, min_words=25):
    """Removed text by doc_id; chunks and lines are counted in one dictionary."""
    first, out = {}, {}

    def parts(lines):
        chunks = line_chunks(lines)
        return chunks, sorted({*chunks, *((i, i + 1) for i in range(len(lines)))}, key=lambda p: (p[0], -p[1]))

    for d, t in rows:
        lines = t.split("\n") if t else []
        for a, b in parts(lines)[1]:
            e = first.setdefault("\n".join(lines[a:b]), [d, 0])
            e[0], e[1] = min(e[0], d), e[1] + 1
    for d, t in rows:
        lines = t.split("\n") if t else []
        chunks, every = parts(lines)
        again, hit, seen, gone = set(), set(), set(), set()
        for a, b in every:
            text = "\n".join(lines[a:b])
            if first[text][1] > 1 and (first[text][0] != d or text in seen):
                again.update(range(a, b))
                hit.add((a, b))
            seen.add(text)
        core = {i for a, b in chunks if first["\n".join(lines[a:b])][1] > 1 and again.issuperset(range(a, b)) for i in range(a, b)}
        for i in sorted(again):
            if i - 1 not in again:
                j = i
                while j in again:
                    j += 1
                words = [len(x.split()) for x in lines[i:j]]
                if core & set(range(i, j)) and sum(words) >= min_words and (j - i > 1 or words[0] >= 25):
                    gone.update(range(i, j))
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t, len(gone))
    return out


def test_line_dedup_matches_plain_python_and_removes_passages(docs_of):
    rng = random.Random(9)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(60)], [line(12) for _ in range(8)], [line(30), line(30)], [line(4), line(4)]]
    rows = []
    for i in range(120):
        lines = [line(rng.choice([3, 8, 30])) for _ in range(rng.randint(0, 6))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(lines))
            lines[at:at] = p
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, rows[50][1]), (203, "\n\n"), (204, line(30) + "\n" + "\n".join([line(40)] * 3))]
    got = line_dedup(docs_of([(*r, 1) for r in rows], ", N_lines int"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed", "emptied"]
    found = {r.doc_id: r for r in got.collect()}
    want = plain_dedup(rows)
    assert {d: (r.text, r.n_removed) for d, r in found.items()} == want
    for p in (passages[0], passages[2]):
        assert sum("\n".join(p) in (r.text or "") for r in found.values()) <= 1
    several = [sum(x in (r.text or "") for x in passages[1]) for r in found.values()]
    assert sum(n > 1 for n in several) <= 1  # ragged ends go too
    assert found[202].emptied or not rows[50][1].strip() or found[202].text == rows[50][1]
    assert line_dedup(docs_of([])).collect() == []
    assert sorted(r.text for r in line_dedup(docs_of([(None, line(40)), (1, "a"), (1, "a")])).collect())[:2] == ["a", "a"]


def test_line_dedup_finds_short_passages_without_a_chunk(docs_of):
    rng = random.Random(10)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, passages = [], []
    for k in range(120):
        sizes = [(18, 18, 18), (14, 13, 13, 13), (11,) * 5, (9,) * 6, (17, 0, 17, 17)][k % 5]
        passages.append([line(n) for n in sizes])
        rows += [(2 * k + i, "\n".join([line(12), line(12), *passages[-1], line(12), line(12)])) for i in (0, 1)]
    alone = [line(13), line(14)]  # common lines, never side by side before the last row
    rows += [(300, alone[0]), (301, alone[1]), (302, "\n".join([line(12), alone[0], "", line(12), alone[1]]))]
    got = {r.doc_id: r.text for r in line_dedup(docs_of(rows)).collect()}
    for k, p in enumerate(passages):
        assert got[2 * k] == rows[2 * k][1], k
        assert not any(x in got[2 * k + 1].split("\n") for x in p if x) and len(got[2 * k + 1].split("\n")) == 4, k
    assert got[302] == rows[-1][1]


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no</p>";</script></head><body class="home ad-free">
<nav><a href=x>Home</a><a href=y>News, more, and more</a></nav><div id="cookie-notice"><p>We use cookies, really, a lot of them, all the time.</p></div>
<div class=wrap><article><h1>Title &amp; more</h1><p>First <b>bold</b>word, and then&nbsp;some&#x20;text, long enough.<p>Second<br>line &lt;x&gt;
 <ul><li>one<li>two</ul><div class="ad banner">Buy now, cheap, cheap</div><p>Last.</p></article>
<section class="comments"><p>I disagree, strongly, with all of this, and more of that.</p></section></div><aside>side</aside><footer>foot"""


def test_main_text():
    assert main_text(PAGE) == "Title & more First boldword, and then some text, long enough. Second line <x> one two Last."
    assert main_text("<div><p>a, b and c</p><form>q</form><!-- x --><p>d</p></div><div class='sidebar'><p>long, long, long side text here</p></div>") == "a, b and c d"
    assert [main_text(x) for x in (None, "", "<p", "<script>x", "<title>x</title>")] == [""] * 5
    assert main_text("plain <i>te</i>xt &copy; &amp") == "plain text © &"
    links = "<div>" + "<p><a href=x>one link, another, and a third</a></p>" * 9 + "</div><div><p>Real words, here, in a row.</p><p>More.</p></div>"
    assert main_text(links) == "Real words, here, in a row. More."
    assert len(main_text("<div>" * 3000 + "<p>deep text</p>")) == 9 and main_text("<p>x</p>" * 20000).count("x") == 20000


def test_extract_odd_rows(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>x y</p>", "t"), (2, "u", PAGE, None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.n_chars == len(r.text), r.text[:3]) for r in got.collect()) == [("1", True, ""), ("1", True, ""), ("2", True, "Tit"), ("None", True, "x y")]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def edits(a, b):
    """Edits with swaps of neighbours as one."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(5)
    terms = ["abcde", "abcdd", "bad", "ccccccccc", "deabcdeab", "eeeee"]
    auto = Automaton(terms, ["ebb"])
    for _ in range(6000):
        word = list(rng.choice(terms)) if rng.random() < 0.7 else [rng.choice("abcde") for _ in range(rng.randint(0, 11))]
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word) + 1)
            word[i:i + rng.randint(0, 1)] = rng.choice([[], ["a"], ["e"], ["x"]])
        word = "".join(word)
        near = [(e, -len(t), t) for t in terms if (e := edits(t, word)) <= Automaton.allowed(t)]
        near += [(0, -3, "ebb")] * word.startswith("ebb")
        best = min(near, default=None)
        assert auto.find(word) == (best and (best[2], best[0])), word


def toxic_rows(rng, n):
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(40)]
        if toxic := rng.random() < 0.3:
            words[rng.randrange(40)] = rng.choice(["horrid", "wretched", "stem" + rng.choice("abcd") + rng.choice("xyz")])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows_misspellings_and_quotes(spark, docs_of):
    rows = toxic_rows(random.Random(2), 900)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (10**6, 1)], "doc_id long, label int")
    docs = docs_of([(i, t) for i, t, _ in rows])
    model = toxicity.fit(docs, labels)
    flipped = toxicity.fit(docs, labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - label, label) as label"))
    assert flipped == model  # held-out labels are never read
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows]) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    clean = " w1 w2 w3 w4" * 9
    plain, typo, swap, quoted, empty, none = model.score(["horrid" + clean, "horid" + clean, "ohrrid" + clean, 'w9 "horrid" w8' + clean, "", None])
    assert min(plain, typo, swap) > 0.5 and quoted < plain and empty == none < 0.5
    again = toxicity.score(docs_of([(1, None, 3.0), (1, None, 3.0)], ", SCORE double"), model)
    assert len(again.collect()) == 2 and again.columns == ["doc_id", "text", "score", "predicted"]
    nothing = toxicity.fit(docs, labels.limit(0))
    assert nothing.score(["horrid"]).tolist() == [0.0] and toxicity.score(docs.limit(0), model).collect() == []


def test_rare_terms_of_a_rich_vocabulary_are_learned(spark, docs_of):
    rng = random.Random(4)
    common = [f"w{i:04}q" for i in range(5000)]
    rows = [(i, " ".join(rng.sample(common, 500)), int(i % 4 == 0)) for i in range(700)]
    rare = ["gruffle", "snidgin", "plovack"]
    rows = [(i, t + f" {rare[i // 4 % 3]}" * (y and i < 132), y) for i, t, y in rows]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    model = toxicity.fit(docs_of([(i, t) for i, t, _ in rows]), labels)
    assert all(model.auto.find(w) for w in rare)


def test_additive_model_learns_pairs_and_reads_no_held_out_label(spark, docs_of):
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam_quality.boost(x[:2000], y[:2000])
    assert np.mean((model.score(x[2000:]) > 0.5) == y[2000:]) > 0.9 and model.pairs[0] == (1, 0)
    assert gam_quality.boost(x[:5], np.ones(5)).score(x[:2]).tolist() == [1.0, 1.0]
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "of", f"w{r.randrange(99)}" + "$$$" * (i % 3 == 0)]) for _ in range(60)), int(i % 3 != 0)) for i in range(400)]
    docs = docs_of([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, label int")
    model = gam_quality.fit(docs, labels)
    flip = gam_quality.fit(docs, labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - label, label) as label"))
    got = {s.doc_id: s for s in gam_quality.score(docs, model).collect()}
    assert np.mean([got[i].predicted == q for i, _, q in rows]) > 0.97
    assert {i: s.predicted for i, s in got.items()} == {s.doc_id: s.predicted for s in gam_quality.score(docs, flip).collect()}
    odd = gam_quality.score(docs_of([(1, None, 1), (2, " \n ", 1), (2, "x" * 100_000, 1), (None, "a\n\n|", 1)], ", Predicted int"), model).collect()
    assert len(odd) == 4 and all(0 <= s.score <= 1 for s in odd)
    assert gam_quality.fit(docs, labels.limit(0)).constant == 0.0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p
    from tests.llm.test_packing_sharding import check

    rng = random.Random(8)
    line = lambda n: " ".join(rng.choice(["the", "of", *(f"u{rng.randrange(10**5)}",)]) for _ in range(n))
    passage, bench = line(60), line(30)
    rows = [(i, line(80) + "\n" + line(9)) for i in range(60)]
    rows += [(60 + i, line(50) + " horrid " + line(30)) for i in range(30)]
    rows += [(100 + i, line(50) + "\n" + passage + "\n" + line(20)) for i in range(6)]
    rows += [(120, rows[3][1]), (121, rows[4][1].replace("u", "v", 1)), (130, line(20) + " " + bench), (131, None), (132, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 90)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, line(9))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf, seen = str(tmp_path), []
    df = docs
    for name, stage in p.STAGES[:-1]:
        before = {r.doc_id: r for r in df.collect()}
        df = spark.createDataFrame(stage(spark, df, sf).collect(), docs.schema)
        after = {r.doc_id: r for r in df.collect()}
        seen.append((name, set(before) - set(after)))
        if name == "line_dedup":
            assert {d: r.text for d, r in after.items()} == {d: t for d, (t, n) in plain_dedup([(d, r.text) for d, r in before.items()]).items() if d in after}
            assert sum(passage in (r.text or "") for r in after.values()) == 1 and all(r.n_chars == len(r.text or "") for r in after.values())
    gone = dict(seen)
    assert gone["toxicity"] == set(range(60, 90)) and gone["line_dedup"] == {120} and gone["near_duplicates"] <= {121} and gone["decontamination"] == {130}
    out = p.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in df.collect()}
    check([(r.length, r.sequence_id, r.offset) for r in out], 2048)
    assert [len(p.STAGES), p.ORACLE_SQL] == [5, None]


PARAS = "<p>Real words, here, in a row, and long enough to count as text.</p><p>More text, with commas, follows in the second paragraph.</p>"
PARAS_TEXT = "Real words, here, in a row, and long enough to count as text. More text, with commas, follows in the second paragraph."
COMMENTS = "<div class=comments>" + "<article class=comment><p>A comment, with words, that is long enough to be text, too.</p></article>" * 30 + "</div>"


@pytest.mark.parametrize("page", [
    f"<html><head><title>t</title><meta charset=utf-8><body>{PARAS}",  # the head is never closed
    f"<head><title>t</title>{PARAS}",
    f"<body><div class='site has-sidebar'><article>{PARAS}</article><div class='sidebar'><p>side text, short</p></div></div>",
    f"<body><div class='site has-sidebar'><div>{PARAS}</div><div class='sidebar'><p>side text, short</p></div></div>",
    f"<div class='post share-enabled'>{PARAS}</div>",
    f"<div class='search-results-article'>{PARAS}</div>",
    f"<form id=aspnetForm><input type=hidden>{PARAS}</form>",
    "<div>" + PARAS.replace("in a row", "<span class='ad'>AD <b>TEXT</b></span>in a row") + "</div>",
    f"<article>{PARAS}</article>{COMMENTS}",
    f"<div>{PARAS}</div>{COMMENTS}",
    f"<div>{PARAS}<form><label>Name</label><input></form></div>",
    f"<article><header><h1>Left out</h1></header>{PARAS}</article>",
    f"<div class=promo>{PARAS}</div>",
])
def test_names_do_not_empty_a_page(page):
    assert main_text(page) == PARAS_TEXT


def test_pages_against_a_plain_reader():
    """All pages of the smallest tables, read with the standard library's parser: what stands in the article, less the parts that go."""
    import os
    from html.parser import HTMLParser

    import duckdb

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables not present")

    class Plain(HTMLParser):
        """Text inside article; every block tag ends a block; parts that go are counted until their end tag."""

        GO = {"nav", "header", "footer", "aside", "form", "button", "select", "script", "style"}
        INLINE = {"a", "b", "i", "em", "strong", "span", "u", "small", "code", "sup", "sub"}

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside = self.gone = 0
            self.blocks = [""]

        def handle_starttag(self, tag, attrs):
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower().replace("-", " ").replace("_", " ").split()
            if self.gone or tag in self.GO or (self.inside and {"ad", "ads", "comments", "comment", "related", "share"} & set(names)):
                self.gone += tag not in ("br", "img", "hr", "input", "p", "li")
            elif tag == "article":
                self.inside += 1
            elif tag == "br":
                self.blocks[-1] += " "
            elif tag not in self.INLINE:
                self.blocks.append("")

        def handle_endtag(self, tag):
            if self.gone:
                self.gone -= tag not in ("br", "img", "hr", "input", "p", "li")
            elif tag == "article":
                self.inside -= 1
            elif tag not in self.INLINE:
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside and not self.gone:
                self.blocks[-1] += data

    for (page,) in duckdb.sql(f"SELECT html FROM '{path}'").fetchall():
        if not page or "<article" not in page:
            continue
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert main_text(page) == " ".join(t for b in plain.blocks if (t := " ".join(b.split())))


def test_quotations_are_pairs_of_marks():
    cut_out = lambda t: [t[a:b] for a, b, _ in toxicity.quotations(t)]
    assert cut_out("I don't want you horrid people here, that's all") == []
    assert cut_out("the dogs' bowls and the cats' beds, rock 'n' roll") == ["'n'"]
    assert cut_out("he said 'don't be horrid' and left; a 5\" pipe, the \"word\" here") == ["'don't be horrid'", '"word"']
    assert cut_out("„schlimm“ «mal» ‘it’s bad’ “so there”") == ["„schlimm“", "«mal»", "‘it’s bad’", "“so there”"]
    assert toxicity.quotations("'" * 50_000 + " a'a" * 50_000) is not None


def plain_meant(text, word):
    """What each hit of ``word`` counts, read word by word with the quotations looked up one by one."""
    import re

    out, words = [], list(re.finditer(r"[^\W_]+", text))
    for i, m in enumerate(words):
        if m.group().lower() == word:
            inside = [n for a, b, n in toxicity.quotations(text) if a <= m.start() < b]
            talk = any(w.group().lower() in toxicity._ABOUT for w in words[max(0, i - 3) : i])
            out.append(0.0 if talk else min(1.0, (inside[0] - 1) / 12) if inside else 1.0)
    return out


@pytest.mark.parametrize("text", [
    "I don't want you horrid people here, that's all", 'they wrote "horrid" on it', 'the word horrid is rude', "horrid horrid 'horrid'",
    '"you are all horrid and nobody wants any of you horrid people here at all today" he said', "İİİİİİİİİİ İİİİ don't 'horrid' horrid", "",
])
def test_features_against_a_plain_version(text):
    import math

    meant = plain_meant(text, "horrid")
    total = sum(2.0 * (0.25 + 0.75 * m) for m in meant)
    want = [min(1.0, total / 3), math.log1p(total), math.log1p(sum(meant)), 100 * sum(meant) / len(toxicity.words_of(text))] if meant else [0.0] * 4
    assert toxicity.Model({"horrid": 2.0}).features(text) == pytest.approx(want)
