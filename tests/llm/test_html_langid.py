import html.parser
import itertools
import random
import re

import numpy as np

from tidelog.llm import html_text, langid, queries


def test_viterbi_is_the_best_of_all_labellings():
    chain = html_text.trained()
    rng = random.Random(3)
    for _ in range(60):
        feats = [[rng.randrange(len(html_text._NAMES)) for _ in range(3)] for _ in range(rng.randint(1, 8))]
        score = lambda ys: sum(chain.w[f].sum() for f, y in zip(feats, ys) if y) + sum(chain.pair[a, b] for a, b in zip(ys, ys[1:]))
        assert abs(score(chain.viterbi(feats)) - max(score(ys) for ys in itertools.product((0, 1), repeat=len(feats)))) < 1e-9


def test_made_pages_not_trained_on():
    chain, wrong, total = html_text.trained(), 0, 0
    for page in html_text.training_pages(99, 150):
        blocks = html_text.blocks_of(page)
        for b, y in zip(blocks, chain.viterbi(html_text.block_features(blocks))):
            wrong += y != ("KEEP" in b.text)
            total += 1
    assert wrong < 0.01 * total


def test_blocks():
    text = lambda p: [b.text for b in html_text.blocks_of(p)]
    assert text("<p>a<p>b &amp; c&nbsp;d<br>e<script>x<p>y</script></p>f") == ["a", "b & c d e", "f"]
    assert text("<div title='a>b'>x<!-- <p>no --> y</div><style>p{}") == ["x y"]
    assert text("<ul><li>a<li>b</ul>< 3 and &lt;p&gt; &am") == ["a", "b", "< 3 and <p> &am"]
    assert text(None) == [] and text("") == [] and text("<") == ["<"] and text("<p") == []
    assert text("<div>" * 3000 + "deep") == ["deep"]


def test_elements_left_out_do_not_take_the_rest_along():
    text = lambda p: [b.text for b in html_text.blocks_of(p)]
    assert text("<p>a<svg width='1'/>b</p><p>c<math/>d</p><svg><text>no</text></svg>e") == ["ab", "cd", "e"]
    assert text("<svg class=x/><text>no</text></svg>b") == ["b"]
    for tag in ("svg", "math", "iframe", "object", "noscript", "select", "textarea", "template", "title"):
        assert "".join(text(f"<p>a</p><{tag}><p>b</p><p>c</p>")) == "abc", tag
    assert text("<html><head><meta charset=x><title>t</title><script>1</script><p>a</p><p>b</p>") == ["a", "b"]
    assert text("<head><link rel=x><!-- c -->plain <b>text</b>") == ["plain text"] and text("<head><title>t</title></head><p>a") == ["a"] and text("<head><title>t</title><body>a") == ["a"]
    assert text("<head><noscript><style>x</style></noscript><title>t") == ["t"] and text("<head><script>x") == [] and text("<head>") == []
    assert text("<article><p>Let <math><mi>x</mi></math> be</p><object><p>b</p></object><noscript>c</noscript><p>d</article>") == ["Let x be", "b", "c", "d"]
    page = "<head><title>t</title></head><body><nav><a href='/'>Home</a></nav><article><h1>On the tide</h1><p>The <svg viewBox='0 0 1 1'/>first paragraph of the page has a fair number of words in it.</p><p>And <math><mi>x</mi></math> comes second, as a sentence of its own here.</p></article>"
    assert html_text.main_blocks(page, html_text.trained()) == ["On the tide", "The first paragraph of the page has a fair number of words in it.", "And x comes second, as a sentence of its own here."]


class Article(html.parser.HTMLParser):
    """The blocks of <article>, by the standard library's parser: another way to the text than the operator's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks, self.now = 0, 0, [], []

    def cut(self):
        text = re.sub(r"\s+", " ", "".join(self.now)).strip()
        self.blocks += [text] if text else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("script", "style")
        if tag in html_text.BLOCKS:
            self.cut()

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.cut()
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.now.append(data)


def test_pages_by_another_parser(spark, sf):
    got = {r["page_id"]: r["text"] for r in queries.op8_html_main_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        p = Article()
        p.feed(r["html"])
        p.close()
        assert got[r["page_id"]].split("\n") == p.blocks


def test_depth_has_no_bound():
    page = "<main>" + "<div>" * 5000 + "<p>The paragraph lies far below the element that tells that it is the main text of all.</p>"
    block = html_text.blocks_of(page)[0]
    assert "main" in block.path and block.own == "p"
    nested = html_text.blocks_of("<ul class=menu><li>a<ul><li>b</ul>c</ul><p>d <b>e<div>f</div>g")
    assert [(b.text, b.own, "nav" in b.words) for b in nested] == [("a", "li", True), ("b", "li", True), ("c", "li", True), ("d e", "p", False), ("f", "div", False), ("g", None, False)]


def test_pages(spark, sf, odd_dir, empty_dir):
    got = queries.op8_html_main_text(spark, sf).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        body = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        want = [b.text for b in html_text.blocks_of(body)]
        assert r["text"].split("\n") == want and r["n_chars"] == len(r["text"])
    odd = {r["page_id"]: r["text"] for r in queries.op8_html_main_text(spark, odd_dir).collect()}
    assert odd[1] == "" and odd[2] == "" and len(odd) == 4
    assert queries.op8_html_main_text(spark, empty_dir).count() == 0


def test_languages(spark, sf, odd_dir, empty_dir):
    big = "/root/testdata/sf0.01"
    got = queries.op10_language_id(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and sum(r["lang"] == r["lang_pred"] for r in held) > 0.95 * len(held)
    odd = queries.op10_language_id(spark, odd_dir).collect()
    assert len(odd) == 12 and all(r["lang_pred"] == "und" for r in odd if r["doc_id"] in (1, 2, 7, 9)) and all(0 <= r["score"] <= 1 for r in odd)
    assert queries.op10_language_id(spark, empty_dir).count() == 0


def test_nystrom_with_all_landmarks_is_kernel_ridge():
    rng = random.Random(8)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(60))
    chunks = [("a", make("abcde ")) for _ in range(12)] + [("b", make("cdefg ")) for _ in range(12)]
    z, root = langid.nystrom([t for _, t in chunks])
    parts = [langid.normal_sums(chunks[k : k + 7], ["a", "b"], {"a": 1.0, "b": 1.0}, z, root) for k in range(0, 24, 7)]
    model = langid.solved(["a", "b"], sum(p[0] for p in parts), sum(p[1] for p in parts), z, root, ridge=0.1)
    grams = langid.Grams()
    x = np.zeros((24, langid.SLOTS))
    for k, (_, t) in enumerate(chunks):
        g = grams(langid.codes_of(t)[0])
        x[k, g] = 1 / np.sqrt(len(g))
    kernel = x @ x.T
    y = np.where(np.array([c[0] for c in chunks])[:, None] == np.array(["a", "b"]), 1.0, -1.0)
    alpha = np.linalg.solve(kernel + 0.1 * np.eye(24), y)
    assert np.abs(x @ model.weights - kernel @ alpha).max() < 1e-3
    assert grams(langid.codes_of("ab")[0]).size == 3 and grams(langid.codes_of("abab")[0]).size == 2 + 2 + 2 + 1


def test_query_by_hand(spark):
    """Every text scored alone: the sum over its chunks of kernels with the landmarks, by the folded weights."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model, grams = langid.train(docs), langid.Grams()
    got = {r["doc_id"]: r for r in queries.op10_language_id(spark, d).collect()}
    for i, t in docs.select("doc_id", "text").collect():
        c, is_letter = langid.codes_of(t)
        sums = np.zeros(len(model.langs))
        for at in range(0, len(c), langid.CHUNK):
            part = is_letter[at : at + langid.CHUNK].sum()
            if part:
                g = grams(c[at : at + langid.CHUNK])
                sums += part / is_letter.sum() * model.weights[g].astype(float).sum(0) / np.sqrt(len(g))
        if not is_letter.any():
            assert got[i]["lang_pred"] == "und"
            continue
        e = np.exp(langid.SHARPNESS * (sums - sums.max()))
        top = np.sort(e)[::-1]
        assert abs(got[i]["score"] - top[0] / e.sum()) < 1e-3 and (got[i]["lang_pred"] == model.langs[int(e.argmax())] or top[0] - top[1] < 1e-3)
