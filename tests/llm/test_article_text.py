"""What an article keeps, hosts of very many paths, and the bounded fit of the field."""

import time

import pytest

from geopressure.llm import html_text, personal_data
from tests.llm.test_robustness import docs_of

FILLER = "<p>" + "Some long sentence of the article that carries its weight. " * 6 + "</p>"


def text_of(inner):
    page = f"<html><body><nav><a href='/'>Home</a></nav><article>{FILLER}{inner}</article><footer>foot</footer></body></html>"
    path, _ = html_text.best_path(page)
    return html_text.extract(page, path)[1:]


@pytest.mark.parametrize(
    "inner, want",
    [
        ("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here</p>", ["Energy is E=m here"]),
        ("<p>Set <label>Field A</label> to one</p>", ["Set Field A to one"]),
        ("<p>See <svg viewBox='0'><title>t</title><desc>d</desc><text>axis</text></svg> now</p>", ["See axis now"]),
        ("<p>one<br>two<br/>three</p><p>four</p>", ["one two three", "four"]),
        ("loose<br>text", ["loose text"]),
        ("<figure><img src=x><figcaption>A caption</figcaption></figure>", ["A caption"]),
        ("<p>a <object data=x>fallback</object> <canvas>drawn</canvas> <video>no video</video> z</p>", ["a fallback drawn no video z"]),
        ("<p>a <select><option>x</option></select><button>b</button> z</p>", ["a z"]),
        ("<dialog>closed</dialog><dialog open>shown</dialog>", ["shown"]),
        ("<p>x<sup>2</sup> &lt; y&nbsp;&amp; z</p>", ["x2 < y & z"]),
        ("<math><semantics><mi>x</mi><annotation>\\x</annotation></semantics></math>", ["x"]),
    ],
)
def test_article_keeps(inner, want):
    assert text_of(inner) == want


def test_repeated_pages_and_ties(spark):
    page = f"<html><body><article>{FILLER}</article></body></html>"
    rows = [(1, "https://a.example/x", page), (1, "https://a.example/x", page), (None, "https://a.example/y", page), (2, None, None), (3, "", ""), (4, "https://b.example", None)]
    got = html_text.main_texts(spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, path string"))
    want = " ".join(("Some long sentence of the article that carries its weight. " * 6).split())
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted([(i, u, want if h else "") for i, u, h in rows], key=str)


def test_a_host_with_a_path_for_each_page(spark):
    n = 50_000
    names = spark.range(n).selectExpr("id AS page_id", "'https://one.example/' || id AS url", "concat('<div class=c', translate(id, '0123456789', 'abcdefghij'), '><p>text ', id, ' goes on here</p></div>') AS html")
    began = time.time()
    best = html_text.winning_paths(names).collect()
    assert len(best) == 1 and best[0].host == "one.example"
    assert time.time() - began < 120


def test_fit_of_very_long_texts_is_bounded(spark, monkeypatch):
    text = " ".join(f"{i * 7919 % 100000:05d}-{i}" for i in range(30_000))
    docs = docs_of(spark, [(1, text), (2, "a@b.cd +1 555 123 4567"), (3, None)])
    seen = []
    fitted = personal_data.pseudo_likelihood
    monkeypatch.setattr(personal_data, "pseudo_likelihood", lambda x, label, **k: (seen.append((len(x), k["times"].sum())), fitted(x, label, steps=3, **k))[1])
    personal_data.fit(docs, max_nodes=50)
    personal_data.fit(docs)
    (few, _), (every, times) = seen
    assert few <= 120 and few < every <= 50_000 and times > 30_000


def test_equal_rows_weigh_as_often_as_they_stand():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (12, personal_data.N_FEATURES + 2 * personal_data.LABELS)).astype(float)
    label, times = rng.integers(0, personal_data.LABELS, 12), rng.integers(1, 5, 12)
    once = personal_data.pseudo_likelihood(np.repeat(x, times, axis=0), np.repeat(label, times))
    counted = personal_data.pseudo_likelihood(x, label, times=times.astype(float))
    assert all(np.allclose(getattr(once, w), getattr(counted, w)) for w in ("node", "chain", "skip"))
