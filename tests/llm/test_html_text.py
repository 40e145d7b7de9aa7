import html
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.conftest import SF_MID
from visitlens.llm import html_text as X


@pytest.fixture(scope="module")
def weights():
    rows = pq.read_table(f"{SF_MID}/pages.parquet").to_pylist()
    return X.fitted(sorted(w for r in rows[:100] if (w := X.sampled_words(r["html"]))))


def extracted(weights, *pages):
    model = X.Labeller()
    model.w = weights
    parsed = [X.leaves(p) for p in pages]
    return [" ".join(leaf.text for leaf, k in zip(p, y, strict=True) if k) for p, y in zip(parsed, X.labelled(model, parsed), strict=True)]


def texts(page):
    return [leaf.text for leaf in X.leaves(page)]


def test_leaves():
    assert texts(None) == texts("") == texts("<p> \n</p>") == []
    assert texts("<p>a&amp;b &eacute;&#x41;&nbsp;c\n d</p>") == ["a&b éA c d"]
    assert texts("<p><b>x</b>y<br>z<p>w</div>q") == ["xy z", "w", "q"]
    assert texts("<head><title>t</title><style>p{}</style><body><script>var t='</p>';</script><!-- n --><p>a") == ["a"]
    assert texts("<ul><li>a<li>b</ul>c<table><tr><td>d<td>e</table>") == ["a", "b", "c", "d", "e"]
    assert texts("plain text only") == ["plain text only"]
    assert [leaf.path for leaf in X.leaves('<div class="ad-box X"><p><a href=q>k</a> l')] == [("div", "ad", "box", "x", "p")]
    assert X.leaves("<p><a>abc</a> de")[0].link_chars == 3


def test_gradients_are_right():
    """Back-propagation against finite differences."""
    pages = [p for p, _ in X.training_pages([["a", "b", "c"] * 20], 3)]
    v = X.vectorised(pages)
    labels = (np.arange(len(v.figures)) % 3 == 0).astype(np.float32)
    model = X.Labeller()
    model.w = {k: w.astype(np.float64) for k, w in model.w.items()}

    def loss():
        y = np.clip(model.forward(v).astype(np.float64), 1e-9, 1 - 1e-9)
        return -(labels * np.log(y) + (1 - labels) * np.log(1 - y)).mean()

    start = {k: w.copy() for k, w in model.w.items()}
    model.train(v, labels, rate=0.0)
    slope = {k: m[0] / 0.1 for k, m in model.moment.items()}
    rng = np.random.default_rng(0)
    for name, w in start.items():
        at = np.unravel_index(np.abs(slope[name]).argmax(), w.shape) if rng.random() < 2 else None
        model.w[name][at] += 1e-2
        up = loss()
        model.w[name][at] -= 2e-2
        down = loss()
        model.w[name][at] += 1e-2
        assert abs((up - down) / 2e-2 - slope[name][at]) < 2e-3 + 0.05 * abs(slope[name][at]), name


def test_made_pages_held_out(weights):
    model = X.Labeller()
    model.w = weights
    words = [x.split() for x in ("alpha beta gamma, delta. " * 30, "Uno dos tres cuatro. Cinco " * 40)]
    held = X.training_pages(words, 150, 1234)
    got = X.labelled(model, [p for p, _ in held])
    wrong = sum(int((a != np.array(b)).sum()) for a, (_, b) in zip(got, held, strict=True))
    assert wrong / sum(len(b) for _, b in held) < 0.02


def test_given_pages(spark):
    """The text between the article's tags, cut out by pattern."""
    want = {}
    for r in pq.read_table(f"{SF_MID}/pages.parquet").to_pylist():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>|<br>", body)
        want[r["page_id"]] = " ".join(" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in blocks)
        want[r["page_id"]] = " ".join(want[r["page_id"]].split())
    got = {r["page_id"]: r for r in X.op5_extract(spark, SF_MID).collect()}
    assert got.keys() == want.keys()
    assert sum(got[k]["text"] == want[k] for k in want) >= 0.99 * len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_kinds_of_furniture(weights):
    article = "<article><h1>Of the and then</h1>" + "".join(f"<p>Thion the er and of it {k} the rest was here.</p>" for k in range(4)) + "</article>"
    want = " ".join(texts(article))
    for extra in ('<aside class="sidebar"><p>More from the er and of</p></aside>', '<div class="cookie-notice"><p>We use cookies, the and</p></div>',
                  '<form><p>Email</p><p>Send the</p></form>', '<section class="comments"><p>I think the er was right.</p><p>Reply</p></section>',
                  '<header><p>The er daily</p></header>', '<div class="ad">Buy the er now</div>'):
        assert extracted(weights, f"<html><body><nav><ul><li><a href=/>Home</a><li><a href=/x>er</a></ul></nav>{article}{extra}<footer>&copy; er</footer>") == [want], extra


def test_edges(spark, weights):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article>" + "<p>word and word here.</p>" * 3000), (3, "u", "<p>x"), (None, None, "<p>x")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")
    out = X.extract(df, weights).collect()
    assert len(out) == 5 and {r["text"] for r in out if r["page_id"] in (1, 2)} == {""}
    assert max(r["n_chars"] for r in out) == 3000 * 20 - 1
    assert X.extract(df.limit(0), X.fit(df.limit(0), 5)).count() == 0
