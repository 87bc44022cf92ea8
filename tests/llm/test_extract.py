"""Extraction: parsing by hand-made cases, held-out pages against their marked articles."""

import random

import numpy as np
import pytest

from shelfmark.llm import extract

WORDS = "river stone light morning paper garden window letter silver market forest winter harbour music bridge".split()


def page(rng, n):
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    head, paragraphs = say(5), [say(rng.randrange(1, 60)) for _ in range(rng.randrange(2, 9))]
    html = (f"<!DOCTYPE html><html><head><title>{head}</title><style>p{{}}</style><script>if (a<b) x('</p>');</script></head><body>"
            f"<nav><ul>{''.join(f'<li><a href=/{k}>{say(2)}</a></li>' for k in range(5))}</ul></nav><!-- ad {n} -->"
            f"<div class='ad'>{say(6)}</div><article><h1>{head}</h1><p><b>{paragraphs[0]}<br>"
            + "".join(f"<p>{p} &amp;  x&nbsp;y</p>" for p in paragraphs[1:])
            + f"</article><footer>&copy; {say(4)}</footer></body></html>")
    return html, " ".join([head, paragraphs[0], *[f"{p} & x y" for p in paragraphs[1:]]])


@pytest.fixture(scope="module")
def labeller():
    rng = random.Random(1)
    return extract.train([page(rng, n)[0] for n in range(extract.TRAIN_PAGES)])


def test_blocks():
    got = [b.text for b in extract.blocks_of(
        "<div>a<b>b</b> c<br>d<p>e<p>f &lt;g&gt; &eacute;&#33;</div>tail<script>if(a<b){'</div>'}</script>!<ul><li>x<li>y</ul>"
        "<!-- <p>no</p> --><textarea>no</textarea><img alt='no'>\n<h2> two  \n words </h2><p>unclosed <i>x")]
    assert got == ["ab c d", "e", "f <g> é!", "tail!", "x", "y", "two words", "unclosed x"]


def test_formulas_are_text_without_annotations():
    got = [b.text for b in extract.blocks_of(
        "<p>so <math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow>"
        "<annotation encoding='application/x-tex'>E=mc^2</annotation><annotation-xml><ci>no</ci></annotation-xml></semantics></math> holds"
        "<p><math display='block'><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>0</mn></mtd></mtr></mtable></math></p>")]
    assert got == ["so E=mc2 holds", "1 0"]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    model = extract.Labeller.fresh(rng)
    model.output += rng.normal(size=model.output.shape)
    x, mask, y = rng.normal(size=(3, 5, extract.INPUT)), np.ones((3, 5)), rng.integers(0, 2, (3, 5)).astype(float)
    mask[1, 3:] = 0

    def loss():
        p = model.scores(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    for weights, gradient in zip([*model.gates, model.output], model.gradients(x, mask, y)):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in weights.shape)
            keep = weights[at]
            weights[at] = keep + 1e-5
            up = loss()
            weights[at] = keep - 1e-5
            down = loss()
            weights[at] = keep
            assert gradient[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_held_out_pages(spark, labeller):
    rng = random.Random(2)
    pages = [page(rng, n) for n in range(150)]
    rows = [(n, "u", h, "clash", "clash") for n, (h, _) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in extract.main_text(
        spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, path string"), labeller).collect()}
    right = sum(got[n] == text for n, (_, text) in enumerate(pages))
    assert right >= 0.97 * len(pages)


def test_sections_that_the_sample_lacks(labeller):
    html = """<body><header><a href=/>Home</a></header><div id="cookie-banner">we use cookies <button>ok</button></div>
      <div class="sidebar"><h3>related</h3><ul><li><a>river stone</a></ul></div>
      <main><article><h1>paper garden</h1><p>river stone light morning paper garden window letter silver market</p>
      <form><label>mail</label><input><button>sign up</button></form><p>forest winter harbour music &amp; bridge</p></article></main>
      <section class="comments"><div class="comment"><p>morning paper garden window letter silver market forest</p></div></section>
      <footer>legal</footer></body>"""
    blocks = extract.blocks_of(html)
    keep = labeller.label([blocks], extract._Slots(extract.PATH_SLOTS), extract._Slots(extract.WORD_SLOTS))[0]
    assert [b.text for b, use in zip(blocks, keep) if use] == [
        "paper garden", "river stone light morning paper garden window letter silver market", "forest winter harbour music & bridge"]


def test_odd_pages(spark, labeller):
    long = "<article><p>" + "river stone " * 100_000 + "</p></article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<"), (3, "u", "<"), (None, "u", "<p"), (5, "u", "<script>only"), (6, "u", long),
            (7, "u", "<article>" + "<p>stone light" * 3_000)]
    got = extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), labeller).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == text[2] == text[5] == ""
    assert text[6] == ("river stone " * 100_000).strip()
    assert len(text[7]) == 3_000 * len("stone light ") - 1
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert extract.extract(empty).count() == 0


def test_long_page_in_bounded_memory():
    """20,000 blocks beside 255 short pages stay below 500 MB; slices give the labels of one run."""
    import tracemalloc

    model = extract.train(['<nav>a b</nav><article><p>some text of a page</p></article><footer>c</footer>'])
    slots = extract._Slots(extract.PATH_SLOTS), extract._Slots(extract.WORD_SLOTS)
    long = extract.blocks_of("<body>" + "<nav><a>home</a></nav><article><p>words of it</p></article>" * 10_000 + "</body>")
    short = extract.blocks_of("<nav>x</nav><article><p>text</p></article>")
    assert len(long) == 20_000
    tracemalloc.start()
    found = model.label([short] * 255 + [long], *slots)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500_000_000 and [len(f) for f in found] == [2] * 255 + [20_000]
    some = long[:300]
    whole = model.label([some], *slots, cells=1_000)[0]
    assert model.label([short, some, short], *slots, cells=7)[1].tolist() == whole.tolist()
    x = extract._vectors(some, model.paths, model.words, *slots)
    assert np.allclose(model._long_scores(some, *slots, 7), model.scores(x[None], np.ones((1, 300)))[0])


def test_sample_takes_one_page_per_id(spark):
    rows = [(1, "u", "<p>b</p>"), (1, "u", "<p>a</p>"), (None, "u", "<p>n</p>"), (2, "u", None), (3, "u", "")] + [(4, "u", "<p>c</p>")] * 50
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    assert sorted(extract.sample_pages(pages)) == ["<p>a</p>", "<p>c</p>", "<p>n</p>"]
    assert len(extract.sample_pages(pages, 2)) == 2
