from __future__ import annotations

import random

import numpy as np
import pytest

from clauseweave.llm.html_extraction import HIDDEN, INPUTS, Vectors, _backward, blocks, examples, fit, forward, label, main_text, meaning, new_model, pad, train


def page(k, words_of):
    rng = random.Random(k)
    paragraphs = [" ".join(words_of(rng.randint(3, 60), 100 * k + j)).capitalize() + "." for j in range(rng.randint(1, 15))]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words_of(5, k))
    html = f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul>{nav}</ul></nav><div class=\"ad\">Buy {k}!</div><article><h1>Title {k} &amp; more</h1>{body}</article><footer>&copy; {k}</footer></body></html>"
    return html, "\n".join([f"Title {k} & more", *paragraphs])


@pytest.fixture(scope="module")
def pages(spark, words_of):
    rows = [(k, f"u{k}", page(k, words_of)[0], "x") for k in range(150)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


@pytest.fixture(scope="module")
def model(pages):
    return fit(pages, sample=100)


def test_held_out_pages(pages, model, words_of):
    found = {r.page_id: r for r in main_text(pages, model).collect()}
    assert len(found) == 150
    right = sum(found[k].text == page(k, words_of)[1] for k in range(100, 150))
    assert right >= 48
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_other_layouts(words_of, model):
    held = examples([page(k, words_of)[0] for k in range(200, 240)], seed=77)
    wrong = total = 0
    for x, y in held:
        p, _, _ = forward(model, *pad([x]))
        wrong += int(((p[:, 0] >= 0.5) != (y > 0.5)).sum())
        total += len(y)
    assert wrong <= 0.03 * total


def test_blocks():
    found = blocks("<!-- <p>no</p> --><p>a &lt;b&gt;\n <b>c</b>d<br>e<P class='x Y'>f<script>g<p></script>h<table><tr><td>i<td>j</table>k &amp l &#233; m&nbsp;n<style>o")
    assert [b.text for b in found] == ["a <b> cd e", "f h", "i", "j", "k & l é m n"]
    assert blocks(None) == blocks("") == blocks("<p> </p>") == []
    assert [b.text for b in blocks("a < b <i>c</i> <5 d> & <p")] == ["a < b c <5 d> &"]
    assert [meaning(b.path) for b in blocks('<main>a<aside>b</aside><div class="commentBox">c</div></main><div>d</div>')] == [1, 0, 0, None]
    assert len(blocks("<div>" * 3000 + "x" + "<p class=\"" * 50)) >= 1


def test_gradients():
    rng = np.random.default_rng(0)
    model, x, mask = new_model(1), rng.standard_normal((5, 3, INPUTS)).astype(np.float32), np.ones((5, 3), np.float32)
    mask[3:, 1] = 0
    y = (rng.random((5, 3)) > 0.5).astype(np.float32)

    def loss():
        p, _, _ = forward(model, x, mask)
        p = np.clip(p.astype(np.float64), 1e-7, 1 - 1e-7)
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum())

    p, _, (tape, back) = forward(model, x, mask, keep=True)
    d = ((p - y) * mask)[:, :, None] * model.out
    gradient = _backward(x, d[:, :, :HIDDEN], tape, model.wx[0], model.wh[0])
    reverse = _backward(x[::-1], d[::-1, :, HIDDEN:], back, model.wx[1], model.wh[1])
    for part, exact in ((model.wx[0], gradient[0]), (model.wh[0], gradient[1]), (model.wh[1], reverse[1]), (model.b[1], reverse[2])):
        flat = part.reshape(-1)
        for i in rng.integers(len(flat), size=6):
            old = flat[i]
            flat[i] = old + 0.01
            up = loss()
            flat[i] = old - 0.01
            down = loss()
            flat[i] = old
            assert abs((up - down) / 0.02 - exact.reshape(-1)[i]) < 0.02


def test_odd_rows(spark, model, words_of):
    long = "<article>" + "<p>word after word</p>" * 3000 + "</article>"
    rows = [(1, None, None, None), (1, "u", "", "t"), (None, "u", "<p>", "t"), (2, "u", long, "t"), (2, "u", long, "t"), (3, "u", page(3, words_of)[0], "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = main_text(df, model).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in found)[:3] == [(0, 0), (1, 0), (1, 0)]
    assert all(r.text.count("\n") == 2999 for r in found if r.page_id == 2)
    assert main_text(df.filter("false"), model).collect() == []
    assert fit(df.filter("false")) is None
    assert [r.text for r in main_text(df.filter("page_id = 3"), None).collect()] == [page(3, words_of)[1]]


def test_training_separates_simple_sequences():
    rng = np.random.default_rng(3)
    data = []
    for _ in range(60):
        x = rng.standard_normal((12, INPUTS)).astype(np.float32) * 0.1
        y = np.zeros(12, np.float32)
        a = int(rng.integers(1, 6))
        y[a : a + 4] = 1
        x[a, 0] = x[a + 3, 1] = 3  # only the ends are marked
        data.append((x, y))
    model = train(data, steps=200)
    p, _, _ = forward(model, *pad([x for x, _ in data]))
    assert ((p.T > 0.5) == np.stack([y for _, y in data])).mean() > 0.97
    assert label(model, [[]], Vectors())[0].shape == (0,)


def test_formulas_and_unclosed_elements_lose_no_text():
    found = blocks("<article><p>so <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds</p></article>")
    assert [b.text for b in found] == ["so a=b holds"]
    for tag in ("button", "object", "svg", "select", "canvas", "audio", "video", "template"):
        found = blocks(f"<article><p>one</p>two<{tag}>three<p>four</p><p>five</article><p>six")
        assert [b.text for b in found] == ["one", "two", "three", "four", "five", "six"]
        assert [meaning(b.path) for b in found] == [1, 1, 1, 1, 1, None]
        found = blocks(f"<article><p>one <{tag}>in</{tag}> two</p><p>three</p></article>")
        assert sorted((b.text, meaning(b.path)) for b in found) == [("in", 0), ("one two", 1), ("three", 1)]
    found = blocks("<article><object>a<object>b</object>c</object><p>d</p></article>")
    assert sorted((b.text, meaning(b.path)) for b in found) == [("a c", 0), ("b", 0), ("d", 1)]
    assert len(blocks("<article>" + "x<button>" * 3000 + "y</article>")) == 3001
