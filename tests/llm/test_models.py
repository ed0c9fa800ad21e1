"""Embeddings against all pairs in numpy, and the page labeller on held-out pages."""

import numpy as np
import pytest

from roadgrain.llm import embeddings, html_text
from roadgrain.llm.shared import connected_components


def test_connected_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, k) for k in range(2000, 2200)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in par}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 7] * 3 + rng.normal(size=12) * 0.15).tolist()) for i in range(80)]
    rows += [(300, None), (301, [0.0] * 12), (302, [1.0] * 11 + [None]), (303, [float("nan")] * 12), (304, [float("inf")] + [0.0] * 11), (305, []), (306, [1.0, 0.0]), (307, [2.0, 0.0]), (308, base[0].tolist()), (308, base[0].tolist())]
    return rows


@pytest.mark.parametrize("least", [16, 1024])
def test_embeddings(spark, vectors, monkeypatch, least):
    monkeypatch.setattr(embeddings, "LEAST_TILE", least)
    monkeypatch.setattr(embeddings, "STAGES", (4, 8))
    monkeypatch.setattr(embeddings, "SUB", 32)
    df = spark.createDataFrame([(*r, 1) for r in vectors], "vec_id long, embedding array<double>, node int")
    got = {r["node"]: (r["n_links"], r["component"]) for r in embeddings.near_duplicate_vectors(df).collect()}
    ids = [i for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = list(dict.fromkeys(ids))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors if i in ids}
    links = {i: [j for j in ids if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in ids}
    par = {i: i for i in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, js in links.items():
        for j in js:
            x, y = find(i), find(j)
            par[max(x, y)] = min(x, y)
    assert got == {i: (len(js), find(i)) for i, js in links.items() if js}
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/a>b">Menu</a></li></ul></nav>
<!-- c --><div class="cookie-notice">We use cookies</div><div id="main-content"><h1>The &amp; title</h1><p>First   paragraph<b>bold</b> of some length, with words.<br>More<p>Second one&nbsp;here, also with some length.</p></div>
<section class="comments"><p>A reader says hello there.</p></section><form><label>Mail</label></form><footer>&copy; us</footer></body></html>"""


def test_blocks():
    got = [b.text for b in html_text.blocks_of(PAGE)]
    assert got == ["Menu", "We use cookies", "The & title", "First paragraphbold of some length, with words.", "More", "Second one here, also with some length.", "A reader says hello there.", "Mail", "© us"]
    assert html_text.blocks_of("") == [] and html_text.blocks_of("<<p>a<b") != []
    for tag in ("<p class=it's>", '<p class="it\'s">', "<p title=\"a > 'b'\" id='x>y'>", '<p data-x=5">', "<p class=a'b id=c'd>", "<p class = 'q>r'>"):
        assert [b.text for b in html_text.blocks_of(f"<div>{tag}hello world</p></div>")] == ["hello world"], tag


def test_labeller_on_held_out_pages(spark):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    model = html_text.train(words, pages=240, epochs=8)
    tp = fp = fn = 0
    for _ in range(100):
        page, main = html_text.training_page(rng, words)
        found = html_text.blocks_of(page)
        truth = [b.text.partition(" ")[0] in main for b in found]
        for b in found:
            b.text = b.text.partition(" ")[2] or b.text
        for t, g in zip(truth, html_text.label_pages(model, [found])[0]):
            tp, fp, fn = tp + (t and g), fp + (not t and g), fn + (t and not g)
    assert tp / (tp + fp) > 0.97 and tp / (tp + fn) > 0.97
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", "x")], "page_id long, url string, html string, text string")
    got = html_text.extract_main_text(pages, model).collect()
    assert sorted((r["page_id"], r["text"]) for r in got)[0][1].startswith("The & title First paragraphbold") and [r["text"] for r in got if r["page_id"] > 1] == ["", ""]
    assert html_text.extract_main_text(pages.limit(0), model).count() == 0


def test_gradient():
    rng = np.random.default_rng(0)
    model = html_text.Labeller.fresh(rng)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x = rng.normal(size=(2, 3, html_text.DIM)).astype(np.float64)
    mask, y = np.array([[1.0, 1, 1], [1, 1, 0]]), np.array([[1.0, 0, 1], [0, 1, 0]])
    _, grad = model.gradient(x, mask, y)
    for name in ("Wf", "Ub", "cb", "out"):
        at = tuple(0 for _ in model.weights[name].shape)
        for sign in (1,):
            model.weights[name][at] += 1e-4 * sign
            up, _ = model.gradient(x, mask, y)
            model.weights[name][at] -= 2e-4
            down, _ = model.gradient(x, mask, y)
            model.weights[name][at] += 1e-4
        assert abs((up - down) / 2e-4 - grad[name][at]) < 1e-4
